"""SimHash near-duplicates, linked through BK-trees.

Equal fingerprints are one class. The 64 bits are cut into radius + 1 blocks; two fingerprints within the radius agree in one
of them at least, so each block is a table, and the first bits of its value name a shard: so many bits that a shard has about
``SHARD`` members, whatever the number of fingerprints, enough for a tree to prune. A task builds one BK-tree a shard (children
keyed by their Hamming distance to the parent) and every fingerprint walks the tree of its shard along the edges within the
radius. A shard with more than ``HOT`` members is cut again by the same rule on the bits that are left. Trees are built where
their shard is, instead of being sent to all executors: the number of distinct fingerprints grows with the corpus, has no
bound that a broadcast could rely on, and may not pass the driver.

A shard's links are reduced to a spanning star before they leave the task: no connection is lost, and a group of n gives
n - 1 links, not n squared.

Defined cases: a null or empty text has no words and fingerprint zero, which is linked like others; fewer words than a
shingle's make one shingle; null ids take part, and a component whose ids are all null has a null component id; repeated
rows are repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semweave.llm.arrow_rows import free_name, map_text, raw_bytes, slices
from semweave.llm.components import connected_components
from semweave.llm.shared import stage_table

SEED = 42
#: Members that a shard has on average, and from how many on it is cut once more.
SHARD, HOT = 2_048, 30_000
#: Times that a hot shard is cut.
CUTS = 3
#: Fingerprints that a task takes at once, whole shards.
TOGETHER = 200_000
#: Walks that a task makes side by side.
WALKS = 20_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included (unsigned)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hash64(flat, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], stops[:-width])).tolist()
    return np.array([hash64(flat[a:b], SEED) for a, b in zip(starts, (stops[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes. Signed 64-bit."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def blocks(bits: list[int], radius: int, n: int | None = None) -> list[int]:
    """Masks by which fingerprints are dealt to shards: the radius + 1 blocks that ``bits`` are cut into; for ``n``
    fingerprints their first bits, so many that a shard has about SHARD members."""
    parts = [p.tolist() for p in np.array_split(np.array(bits), radius + 1)]
    use = 64 if n is None else max(0, math.ceil(math.log2(max(1, n) / SHARD)))
    masks = [sum(1 << b for b in p[:use]) for p in parts]
    return masks if use else masks[:1]  # one shard needs one table


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Forest:
    """BK-trees over shards that lie one after another: node i is fingerprint i, roots are the first of each shard."""

    def __init__(self, prints: np.ndarray, root: np.ndarray):
        self.prints, self.root = prints, root
        rest = np.flatnonzero(root != np.arange(len(prints)))
        at, keys, kids = root[rest], [], []
        while len(rest):
            key = at * 65 + np.bitwise_count(prints[rest] ^ prints[at])
            new, first, group = np.unique(key, return_index=True, return_inverse=True)
            keys.append(new)
            kids.append(rest[first])
            stay = np.ones(len(rest), bool)
            stay[first] = False  # the first with a key is the child, the others go on below it
            at, rest = rest[first][group][stay], rest[stay]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(key)
        self.key, self.kid = key[order], (np.concatenate(kids) if kids else np.empty(0, np.int64))[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes of one tree within the radius, larger number first, for some walks at a time."""
        self.walked = 0
        for low in range(0, len(self.prints), WALKS):
            who = np.arange(low, min(low + WALKS, len(self.prints)))
            at = self.root[who]
            while len(who):
                self.walked += len(who)
                far = np.bitwise_count(self.prints[who] ^ self.prints[at]).astype(np.int64)
                hit = (far <= radius) & (at < who)
                yield who[hit], at[hit]
                first = np.searchsorted(self.key, at * 65 + np.maximum(far - radius, 0))
                count = np.searchsorted(self.key, at * 65 + np.minimum(far + radius, 64), side="right") - first
                who = np.repeat(who, count)
                place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                at = self.kid[np.repeat(first, count) + place]


def stars(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node connected with it."""
    label = np.arange(n)
    for a, b in links:
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (up := label[label] != label).any():
                label[up] = label[label[up]]
    return label


def shard_links(members: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within the shards of ``members`` (tab, shard, fp), a star a connected part of a shard."""
    dealt = members.repartition("tab", "shard").sortWithinPartitions("tab", "shard", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def walk(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            root = np.flatnonzero(new)[np.cumsum(new) - 1]
            label = stars(len(rows), Forest(rows[:, 2].astype(np.uint64), root).links(radius))
            linked = np.flatnonzero(label != np.arange(len(rows)))
            for i in range(0, len(linked), 50_000):
                x = linked[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(rows[x, 2]), pa.array(rows[label[x], 2])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64))
            size += batch.num_rows
            if size >= TOGETHER:
                rows = np.concatenate(held)
                edge = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
                cut = int(edge[-1]) + 1 if len(edge) else 0  # the last shard may go on
                if cut:
                    yield from walk(rows[:cut])
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield from walk(np.concatenate(held))

    return dealt.mapInArrow(run, "a long, b long")


def dealt(prints: DataFrame, masks: list[int], first: int) -> DataFrame:
    """(tab, shard, fp): a row for each mask; tables are numbered from ``first``."""
    tables = (F.struct(F.lit(first + i).cast("long").alias("tab"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("shard")) for i, m in enumerate(masks))
    return prints.select("fp", F.explode(F.array(*tables)).alias("m")).select("m.tab", "m.shard", "fp")


def link_prints(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all of the distinct ``prints`` (fp), a written table, within the radius of one another."""
    masks = dict(enumerate(blocks(list(range(64)), radius, prints.count())))
    members = dealt(prints, list(masks.values()), 0)
    parts: list[DataFrame] = []
    for cut in range(CUTS):
        # few: each has over HOT members
        hot = stage_table(members.groupBy("tab", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), f"hot-shards-{cut}")
        tables = [r["tab"] for r in hot.select("tab").distinct().collect()]  # a row a table
        if not tables:
            break
        parts.append(members.join(hot.drop("n"), ["tab", "shard"], "left_anti"))
        finer, cuts = {}, []
        for tab in tables:
            of_tab = members.where(F.col("tab") == tab).join(hot.drop("n"), ["tab", "shard"], "left_semi")
            free = [b for b in range(64) if not (masks[tab] >> b) & 1]
            if len(free) <= radius:
                parts.append(of_tab)
                continue
            first = (tab + 1) * 1000
            own = [masks[tab] | m for m in blocks(free, radius)]
            finer |= dict(enumerate(own, first))
            cuts.append(dealt(of_tab.select("fp"), own, first))
        if not cuts:
            members = None
            break
        masks = finer
        members = stage_table(reduce(DataFrame.unionByName, cuts), f"cut-shards-{cut}")
    if members is not None:
        parts.append(members)
    return shard_links(reduce(DataFrame.unionByName, parts), radius)


def fingerprints(docs: DataFrame, width: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (signed 64-bit)."""
    return map_text(docs, lambda: lambda text: (fingerprint(shingle_hashes(text, width)),), [("fp", pa.int64(), "long")], id_col=id_col, text_col=text_col)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id that links lead to."""
    rows = stage_table(fingerprints(docs, width, id_col=id_col, text_col=text_col), "prints")
    classes = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    labels = connected_components(link_prints(classes.select("fp"), radius), "simhash")
    placed = classes.join(labels, classes.fp == labels.id, "left").where("n > 1 or id is not null")
    placed = placed.select("fp", "first", F.coalesce("label", "fp").alias("label"))
    first = placed.groupBy("label").agg(F.min("first").alias("component"))
    named = placed.join(first, "label").select("fp", "component")
    out = rows.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def hex_print(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


BANDS, BAND_ROWS, BINS = 12, 3, 256
#: Four standard errors of a sketch's similarity: pairs this near the threshold are compared by their whole texts.
MARGIN = 0.1
#: Shingles that a task remembers while it compares texts.
HELD = 1_000_000
#: Counters by which the shingles of crowded band groups are put in order.
SLOTS = 1 << 18
#: Bits of the filter of wanted texts, as a power of 2: 8 MB.
WANTED_BITS = 26
_seeds = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A key a band: documents of similarity s share one with probability 1 - (1 - s^3)^12, over 0.999 for 0.8."""
    if not len(hashes):
        return []
    least = np.full(len(_seeds), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _seeds
        least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=0))
    key = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> bytes:
    """The least hash in each of 256 bins, as a byte; 0 for an empty bin."""
    out = np.full(BINS, np.uint64(2**64 - 1))
    np.minimum.at(out, (hashes >> np.uint64(56)).astype(np.int64), hashes << np.uint64(8) >> np.uint64(8))
    return np.where(out == np.uint64(2**64 - 1), 0, out % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of shingle sets, from rows of sketches; exact while no bin holds two shingles, 1 for empty sets."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(used == 0, 1, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(used, 1))


def led_pairs(member: DataFrame, name: str, *leaders: Column) -> DataFrame:
    """Pairs (node, other) of the members (node, band, key) and each of the leaders, aggregates, of their group. The leaders
    are written, so that the rows of a large group can be split."""
    led = stage_table(member.groupBy("band", "key").agg(F.array(*(x["node"] for x in leaders)).alias("leaders")), name)
    return member.join(led, ["band", "key"]).select("node", F.explode("leaders").alias("other")).distinct()


def alike(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs that are at most ``MARGIN`` below the threshold by their sketches, with their similarity times 1000."""
    own, theirs = texts.select("node", "sketch"), texts.select(F.col("node").alias("other"), F.col("sketch").alias("theirs"))
    # the leaders first: theirs are the frequent keys, and the rows are still small
    met = pairs.join(theirs, "other").join(own, "node").select("node", "other", "sketch", "theirs")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
                s = similarity(a, b)
                out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((s * 1000).astype(np.int64))], names=["node", "other", "score"])
                yield out.filter(pa.array(s >= least - MARGIN))

    return stage_table(met.mapInArrow(run, "node long, other long, score long"), "alike")


def printed_pairs(texts: DataFrame, radius: int) -> DataFrame:
    """Pairs (node, other) of texts with equal fingerprints, or with fingerprints that the trees link."""
    first = stage_table(texts.groupBy("fp").agg(F.min("node").alias("other"), F.count(F.lit(1)).alias("n")), "first-texts")
    equal = texts.select("fp", "node").join(first.where("n > 1"), "fp").select("node", "other")
    left, right = first.select(F.col("fp").alias("a"), F.col("other").alias("node")), first.select(F.col("fp").alias("b"), "other")
    return equal.unionByName(link_prints(first.select("fp"), radius).join(left, "a").join(right, "b").select("node", "other"))


def wanted_texts(whole: DataFrame, texts: DataFrame, need: DataFrame) -> DataFrame:
    """(node, text) of the nodes of ``need``, a written table. ``whole`` (c1, c2, text) has them, with copies.

    Only rows that a filter of fixed size lets through are exchanged: nearly those that are needed while they are a few
    million, all of them when the filter is full. The filter's words, 2^20 rows at most, are all that reaches the driver."""
    keys = stage_table(need.join(texts.select("node", "c1", "c2"), "node"), "wanted-keys")
    place = lambda c: F.col(c).bitwiseAND(F.lit((1 << WANTED_BITS) - 1))
    bits = keys.select(F.explode(F.array(place("c1"), place("c2"))).alias("p"))
    words = bits.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask")).toArrow()
    table = np.zeros(1 << (WANTED_BITS - 6), np.uint64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    sent = whole.sparkSession.sparkContext.broadcast(table)

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            places = ((batch.column(i).to_numpy().view(np.uint64) & np.uint64((1 << WANTED_BITS) - 1)) for i in (0, 1))
            one, two = ((bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1 for p in places)
            yield batch.filter(pa.array(one & two))

    some = whole.select("c1", "c2", "text").mapInArrow(held, "c1 long, c2 long, text string")
    return some.join(keys, ["c1", "c2"]).groupBy("node").agg(F.first("text").alias("text"))


def similar_links(texts: DataFrame, whole: DataFrame, least: float, width: int, radius: int) -> DataFrame:
    """Links (a, b: nodes) of similar texts among the distinct ``texts`` (node, c1, c2, fp, keys, sketch); ``whole`` has the
    texts themselves (c1, c2, text).

    In each group of equal band keys every text is compared with two leaders, the first and the last by a hash that
    differs from band to band, and then with the text that was most like all leaders it met: that is the one that the
    copies of a group were made from. These three comparisons a text and band link most of a group; ``crowd_links`` then
    compares what they left apart. Every pair is verified, on sketches and near the threshold on the texts.
    """
    member = stage_table(texts.select("node", F.posexplode("keys").alias("band", "key")), "band-keys")
    sizes = stage_table(member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "band-sizes")
    member = stage_table(member.join(sizes, ["band", "key"]), "band-members")
    by_hash = F.struct(F.xxhash64("node", "band").alias("order"), "node")
    first = alike(led_pairs(member, "leaders", F.min(by_hash), F.max(by_hash)).unionByName(printed_pairs(texts, radius)).distinct(), texts, least)
    central = stage_table(first.groupBy("node").agg(F.sum("score").alias("total")), "central")
    ranked = stage_table(member.join(central, "node", "left"), "ranked")
    middle = alike(led_pairs(ranked, "middles", F.max(F.struct("total", "node"))), texts, least)
    near = first.unionByName(middle).where("node <> other").distinct()
    near = stage_table(near.withColumn("sure", F.col("score") >= 1000 * (least + MARGIN)), "near")
    open_ = near.where("not sure")
    need = stage_table(open_.select("node").union(open_.select("other")).distinct(), "open-texts")
    held = stage_table(wanted_texts(whole, texts, need), "near-texts")
    left, right = held.withColumnRenamed("text", "x"), held.select(F.col("node").alias("other"), F.col("text").alias("y"))
    both = open_.join(right, "other").join(left, "node").select(F.col("node").alias("a"), F.col("other").alias("b"), "x", "y")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[bytes, np.ndarray] = {}
            keep, held_words = [], 0
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].as_py().encode() for c in (2, 3))
                if held_words > HELD:  # a leader's set serves many pairs; what is remembered stays small
                    sets, held_words = {}, 0
                for t in (x, y):
                    if t not in sets:
                        sets[t] = np.unique(shingle_hashes(t, width))
                        held_words += len(sets[t])
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                keep.append(shared >= least * (len(sets[x]) + len(sets[y]) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    led = near.where("sure").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(both.mapInArrow(compare, "a long, b long"))
    led = stage_table(led, "led-links")
    rest = crowd_links(texts, whole, ranked, led, least, width)
    return led if rest is None else led.unionByName(rest)


def crowd_links(texts: DataFrame, whole: DataFrame, ranked: DataFrame, led: DataFrame, least: float, width: int) -> DataFrame | None:
    """Links (a, b: nodes) between texts of one band group that ``led`` leaves in different components; ``ranked`` (node,
    band, key, total) are the members of the groups.

    The texts of groups that are not yet one component are joined exactly, by what tells them from the reference of their
    group, the text most like all leaders it met: copies of one origin have most shingles in common, but few differences.
    Let D be the shingles that a text of n shingles has and the reference r has not, or the reverse, d their number and
    s = d - c n with c = (1 - least) / (1 + least). Two texts are similar if and only if their D share (s + s') / 2 or more.
    No text has a smaller s than r, so if that is 0 or less both are similar to r, and every text is compared with r. All
    others share one of the first shingles of each D, with the shingles in one order, the rarest first, at places from
    which enough of them follow in both. Pairs of one component need no link. The order is by counts in 2^18 slots, which
    are all that reaches the driver; any order gives the same links. Groups with one reference are taken together.
    """
    labels = connected_components(led, "led")
    named = stage_table(ranked.join(labels, ranked.node == labels.id, "left").select("node", "band", "key", "total", F.coalesce("label", "node").alias("label")), "band-labels")
    # in a group of three the leaders met everyone
    split = named.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("total", "node"))["node"].alias("ref"))
    split = stage_table(split.where("n > 3 and low <> high").select("band", "key", "ref"), "split-groups")
    crowd = stage_table(named.join(split, ["band", "key"]).select("ref", "node", "label").distinct(), "crowd")
    if crowd.isEmpty():
        return None
    held = wanted_texts(whole, texts, stage_table(crowd.select("node").distinct(), "crowd-texts"))

    def shingle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [np.unique(shingle_hashes(t or b"", width)).view(np.int64) for t in raw_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    sets = stage_table(held.mapInArrow(shingle, "node long, hashes array<bigint>"), "crowd-sets")
    refs = sets.select(F.col("node").alias("ref"), F.col("hashes").alias("theirs"))
    # the references first: theirs are the frequent keys, and the rows are still small
    met = crowd.join(refs, "ref").join(sets, "node").select("ref", "node", "label", "hashes", "theirs")

    def differ(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, parts = [], []
            for i in range(batch.num_rows):
                own, theirs = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                salt = batch.column(0)[i].as_py() * 0x9E3779B97F4A7C15 % 2**64  # shingles of other references are others
                parts.append((np.setxor1d(own, theirs, assume_unique=True).view(np.uint64) ^ np.uint64(salt)).view(np.int64))
                sizes.append((len(own), len(theirs)))
            size, ref_size = np.array(sizes, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size), pa.array(ref_size), pa.array(parts, pa.list_(pa.int64()))], names=["ref", "node", "label", "size", "ref_size", "hashes"])

    parts = stage_table(met.mapInArrow(differ, "ref long, node long, label long, size long, ref_size long, hashes array<bigint>"), "crowd-differences")
    shared = (F.col("size") + F.col("ref_size") - F.size("hashes")) / 2
    to_ref = parts.where((shared >= least * (F.col("size") + F.col("ref_size") - shared)) & (F.col("node") != F.col("ref")))
    count = parts.select(F.explode("hashes").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[count["slot"].to_numpy()] = count["n"].to_numpy()

    def prefix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = batch.column(5)[i].values.to_numpy()
                node, label, size, ref_size = (batch.column(c)[i].as_py() for c in range(1, 5))
                # differences shared with any similar text that is not found through the reference
                least_shared = max(1, (len(h) - (1 - least) / (1 + least) * (size + ref_size)) / 2, len(h) - (1 - least) / least * size)
                first = h[np.lexsort((h, often[h & (SLOTS - 1)]))][: max(0, len(h) - math.ceil(least_shared - 1e-6) + 1)]
                own = [np.full(len(first), v, np.int64) for v in (node, label, size, len(h))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first, *own, len(h) - np.arange(len(first)))], names=["h", "node", "label", "size", "differ", "rest"])

    prefixes = parts.mapInArrow(prefix, "h long, node long, label long, size long, differ long, rest long")
    pairs = prefixes.repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches: apart_pairs(batches, least), "node long, other long")
    near = alike(pairs.distinct(), texts, least)
    other = sets.select(F.col("node").alias("other"), F.col("hashes").alias("y"))
    both = near.join(other, "other").join(sets.select("node", F.col("hashes").alias("x")), "node")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= least * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = both.select(F.col("node").alias("a"), F.col("other").alias("b"), "x", "y").mapInArrow(compare, "a long, b long")
    return found.unionByName(to_ref.select(F.col("node").alias("a"), F.col("ref").alias("b")))


def apart_pairs(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (node, other) of rows (h, node, label, size, differ, rest), in order of h, with one h and different labels, the
    smaller node first: texts of ``size`` shingles and ``differ`` differences, ``rest`` of them from h on. Their sizes, and
    the rests, must allow the similarity; at the first difference that two similar texts share they do. A pair comes once
    from the rows that are walked together."""
    part = (1 - least) / (1 + least)

    def walk(rows: np.ndarray) -> Iterator[np.ndarray]:
        edge = np.flatnonzero(np.diff(rows[:, 0])) + 1
        for low, high in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)], strict=True):
            group = rows[low:high]
            if high - low < 2 or (group[:, 2] == group[0, 2]).all():
                continue
            for i in range(1, len(group)):
                x, own = group[:i], group[i]
                shared = np.minimum(x[:, 5], own[5])
                apart, sizes = x[:, 2] != own[2], np.minimum(x[:, 3], own[3]) >= least * np.maximum(x[:, 3], own[3])
                met = x[apart & sizes & (2 * shared >= x[:, 4] + own[4] - part * (x[:, 3] + own[3]) - 1e-6), 1]
                if len(met):
                    yield np.stack((np.minimum(met, own[1]), np.maximum(met, own[1])), axis=1)

    def batched(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in chain(walk(rows), (None,)):
            if part is not None:
                held.append(part)
                size += len(part)
            if held and (part is None or size >= 1_000_000):
                every = np.unique(np.concatenate(held), axis=0)
                held, size = [every], len(every)
                if part is None or size >= 500_000:
                    for i in range(0, size, 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(every[i : i + 50_000].T)], names=["node", "other"])
                    held, size = [], 0

    held, size = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64))
        size += batch.num_rows
        if size >= TOGETHER:
            rows = np.concatenate(held)
            edge = np.flatnonzero(np.diff(rows[:, 0]))
            cut = int(edge[-1]) + 1 if len(edge) else 0  # the last group may go on
            if cut:
                yield from batched(rows[:cut])
            held, size = [rows[cut:]], len(rows) - cut
    if size:
        yield from batched(np.concatenate(held))


def drop_near_duplicates(docs: DataFrame, width: int = 5, radius: int = 3, least: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of each group of near-duplicates: that with the smallest id (null ids last; equal rows: one of them).

    Texts are linked if the similarity of their sets of shingles is ``least`` or more; texts without words are alike.
    Candidates are fingerprints within the radius, from the trees, and, since at 0.8 fingerprints of 64 bits differ in
    about ten and no tree prunes at such a radius, band keys of the same shingle hashes. Texts are told apart by two 64-bit
    hashes.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = {"k0": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1)), "c1": F.xxhash64(text), "c2": F.xxhash64(F.lit(1), text)}

    def kernel(raw: bytes) -> tuple:
        hashes = shingle_hashes(raw, width)
        return fingerprint(hashes), bands(hashes), sketch(hashes)

    fields = [("fp", pa.int64(), "long"), ("keys", pa.list_(pa.int64()), "array<bigint>"), ("sketch", pa.binary(), "binary")]
    rows = stage_table(map_text(docs, lambda: kernel, fields, id_col=id_col, text_col=text_col, also=key), "sketches")
    texts = rows.groupBy("c1", "c2").agg(F.min("k0").alias("k0"), *(F.first(c).alias(c) for c in ("fp", "keys", "sketch")))
    texts = stage_table(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    whole = docs.select(key["c1"].alias("c1"), key["c2"].alias("c2"), text.alias("text"))
    labels = connected_components(similar_links(texts, whole, least, width, radius), "similar")
    labelled = texts.join(labels, texts.node == labels.id, "left").select(F.coalesce("label", "node").alias("label"), F.struct("k0", "c1", "c2").alias("k"))
    kept = labelled.groupBy("label").agg(F.min("k").alias("k"))
    names = dict(zip(key, (free_name(docs, f"key_{k}") for k in key), strict=True))
    kept = stage_table(kept.select(*(F.col("k")[k].alias(n) for k, n in names.items())), "kept")
    found = docs.withColumns({names[k]: c for k, c in key.items()}).join(kept, list(names.values()), "left_semi").dropDuplicates(list(names.values()))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))
