"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into overlapping probes, one from each word and each ``STRIDE`` characters of a longer word, so every passage of
``PROBE`` characters from the start of a word, and any of ``PROBE + STRIDE - 1``, holds a whole probe. A probe of m
characters that stands in a document with at most e edits shares at least m - q + 1 - q e of its q-grams with it, all on
diagonals (place in the document less place in the item) at most e apart; q is ``Q``, or less where that bound would not be
positive.

One pass over the documents, whatever the benchmark's size, finds those that can hold a passage at all: the q-grams of all
items stand in a Bloom filter of bounded size, and some stretch as long as a probe with its edits must have as many of them
as the bound says. Only these suspects, and the items in blocks of bounded size, are exchanged: every block meets every part
of the suspects in one task. There q-grams are counted in overlapping diagonal bands twice as wide as the edits, first of the
item, then of its probes; bands that reach the bound are retained, and an alignment verifies them.

Texts are compared in lower case (A-Z) with white space collapsed. Items stay in tables; what reaches the driver is the
filter, 64 MB at most. A benchmark that fills it (over 16 million characters) makes more documents suspects, and costs more
alignments, but changes no result.

Defined cases: null and empty texts and items match nothing; an item of under ``Q`` characters has to stand exactly, as whole
words; repeated rows and items give repeated hits; documents of any length are searched whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.arrow_rows import extend_rows, free_name, raw_bytes, slices
from semweave.llm.shared import stage_table

Q = 12
PROBE = 60
STRIDE = 10
#: Edits that a probe may have, as a share of its length.
EDITS = 0.05
#: Bytes of benchmark text, and of suspects, that meet in a task.
BLOCK_BYTES, SUSPECT_BYTES = 8_000_000, 16_000_000
#: Bits of the filter for a character of the benchmark, hashes of a q-gram, and the filter's largest size as a power of 2.
BITS_A_GRAM, HASHES, MOST_BITS = 32, 4, 29
#: Bytes of documents that are searched together; a task takes some fifty times as much memory for it.
TOGETHER = 1_000_000
FILTER_BITS = 22

U = np.uint64


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def codes(data: bytes, q: int = Q) -> np.ndarray:
    """A 64-bit code of the q-gram at every place: of two overlapping runs of 8 bytes, or of one shorter run."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, U)
    data = data.ljust(len(data) + 8, b"\x00")
    eight = np.empty(len(data) - 7, U)
    for k in range(8):
        part = eight[k::8]
        part[:] = np.frombuffer(data, "<u8", len(part), k)
    if q < 8:
        return (eight[:n] & U((1 << 8 * q) - 1)) * U(0x9E3779B97F4A7C15)
    return (eight[:n] * U(0x9E3779B97F4A7C15)) ^ (eight[q - 8 : q - 8 + n] * U(0xC2B2AE3D27D4EB4F))


def slots(code: np.ndarray) -> np.ndarray:
    return (code * U(0x165667B19E3779F9)) >> U(64 - FILTER_BITS)


def lemma(size: np.ndarray, edits: float) -> tuple[np.ndarray, ...]:
    """For items of these sizes: characters of a probe, its edits, q, and the q-grams that it shares at least."""
    long = np.minimum(size, PROBE)
    e = (long * edits).astype(np.int64)
    q = np.maximum(1, np.minimum(Q, long // (e + 1)))
    return long, e, q, np.maximum(1, long - q + 1 - q * e)


IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def whole_words(data: bytes, at: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which stretches of ``data`` begin and end where a word may."""
    inside = np.append(IN_WORD[np.frombuffer(data, np.uint8)], False)
    cut_before = inside[at] & (at > 0) & inside[np.maximum(at - 1, 0)]
    stop = np.minimum(at + long, len(data))
    return ~cut_before & ~(inside[stop - 1] & inside[stop])


class Grams:
    """Postings of the q-grams, for one q, of items that lie in one text: each place of an item once."""

    def __init__(self, flat: bytes, begin: np.ndarray, size: np.ndarray, q: int):
        self.q = q
        place = np.repeat(begin, size - q + 1) + np.arange((size - q + 1).sum()) - np.repeat(np.cumsum(size - q + 1) - (size - q + 1), size - q + 1)
        code = codes(flat, q)[place]
        order = np.argsort(code, kind="stable")
        self.place = place[order]
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[slots(self.code)] = True

    def meet(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in the data and in the items' text with equal q-grams."""
        code = codes(data, self.q)
        at = np.flatnonzero(self.filter[slots(code)])
        which = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
        same = self.code[which] == code[at]
        at, which = at[same], which[same]
        count = self.count[which]
        at = np.repeat(at, count)
        post = np.repeat(self.first[which], count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, self.place[post]


class Probes:
    """Probes of a block of benchmark items, and the q-gram postings of the items."""

    def __init__(self, items: list[tuple[int | None, bytes]], edits: float = EDITS):
        self.text: list[bytes] = []
        self.item: list[int | None] = []
        texts, begin, start, owner, at_flat = [], [], [], [], 0
        for item, raw in items:
            text = normal(raw)
            if not text:
                continue
            last = max(0, len(text) - PROBE)
            words = [0, *(m.end() for m in re.finditer(b" ", text) if m.end() < last), last]
            for at in sorted({last, *(i for x, y in pairwise(words) for i in range(x, y, STRIDE))}):
                self.text.append(text[at : at + PROBE])
                self.item.append(item)
                start.append(at_flat + at)
                owner.append(len(texts))
            texts.append(text)
            begin.append(at_flat)
            at_flat += len(text) + PROBE
        self.begin, self.start, self.owner = np.array(begin, np.int64), np.array(start, np.int64), np.array(owner, np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        # the probes of one item are equally long
        self.long, self.edits, self.q, self.bound = lemma(size, edits)
        self.budget = self.edits[self.owner]
        flat = (b"\x00" * PROBE).join(texts)
        self.grams = [Grams(flat, self.begin[self.q == q], size[self.q == q], int(q)) for q in np.unique(self.q)]
        self.widest = int(self.edits.max(initial=0))

    def search(self, texts: list[bytes]) -> list[list[dict]]:
        """For each text its hits: item, number of probes found, fewest edits."""
        found: list[list[dict]] = [[] for _ in texts]
        low = 0
        while low < len(texts) and self.text:
            high, size = low, 0
            while high < len(texts) and (high == low or size < TOGETHER):
                size += len(texts[high])
                high += 1
            self.search_some([normal(t) for t in texts[low:high]], found[low:high])
            low = high
        return found

    def search_some(self, texts: list[bytes], found: list[list[dict]]) -> None:
        # so wide that no band reaches over two texts
        gap = b"\x00" * (PROBE + 4 * self.widest + Q + 2)
        data = gap.join(texts)
        size = np.array([len(t) + len(gap) for t in texts])
        begin = np.cumsum(size) - size
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for grams in self.grams:
            at, place = grams.meet(data)
            item = np.searchsorted(self.begin, place, side="right") - 1
            if (self.long[item] < Q).any():
                keep = (self.long[item] >= Q) | whole_words(data, at, self.long[item])
                at, place, item = at[keep], place[keep], item[keep]
            diagonal = at - place + int(self.start[-1]) + PROBE
            wide = 2 * (2 * self.edits[item] + 1)
            for shift in (0, 1):  # bands overlap by half
                band = (diagonal + shift * (wide // 2)) // wide
                _, group, n = np.unique(band * len(self.begin) + item, return_inverse=True, return_counts=True)
                enough = np.flatnonzero(n[group] >= self.bound[item])
                # the probes that have this q-gram: they begin at most a probe less a q-gram before it
                low = np.searchsorted(self.start, np.maximum(place[enough] - self.long[item[enough]] + grams.q, self.begin[item[enough]]))
                many = np.searchsorted(self.start, place[enough], side="right") - low
                each = np.repeat(enough, many)
                probe = np.repeat(low, many) + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                doc = np.searchsorted(begin, at[each], side="right") - 1
                key = (doc.astype(np.int64) << 40) + probe
                order = np.lexsort((band[each], key))
                key, banded, each, probe = key[order], band[each][order], each[order], probe[order]
                edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (banded[1:] != banded[:-1])))) if len(key) else np.empty(0, np.int64)
                n = np.diff(np.append(edge, len(key)))
                for i in edge[n >= self.bound[item[each[edge]]]]:
                    w = int(wide[each[i]])
                    # where the probe stands if on the band's first diagonal
                    first = int(banded[i]) * w - shift * (w // 2) - int(self.start[-1]) - PROBE + int(self.start[probe[i]])
                    hits.setdefault((int(key[i]) >> 40, int(probe[i])), []).append((first, first + w))
        best: dict[tuple[int, int | None], dict[int, int]] = {}
        for (d, p), bands_of in hits.items():
            e, m = int(self.budget[p]), len(self.text[p])
            joined: list[list[int]] = []
            for low, high in sorted(bands_of):
                if joined and low <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], high)
                else:
                    joined.append([low, high])
            for low, high in joined:
                a, b = max(int(begin[d]), low - e), min(int(begin[d]) + len(texts[d]), high + m + e)
                far = edits_within(self.text[p], data[a:b], e)
                if far is not None:
                    own = best.setdefault((d, self.item[p]), {})
                    own[p] = min(far, own.get(p, far))
        for (d, item), probes in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0)):
            found[d].append({"item_id": item, "n_probes": len(probes), "edits": min(probes.values())})


def edits_within(probe: bytes, region: bytes, budget: int) -> int | None:
    """Fewest edits with which the probe stands somewhere in the region, if at most ``budget``.

    A column of the alignment is two integers of a bit a character of the probe (Myers 1999)."""
    if probe in region:
        return 0
    if not budget:
        return None
    m = len(probe)
    every, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[int, int] = {}
    for i, c in enumerate(probe):
        equal[c] = equal.get(c, 0) | 1 << i
    up, down, score, best = every, 0, m, m
    for c in region:
        eq = equal.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & every, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1, mh << 1
        up, down = (mh | ~(xv | ph)) & every, ph & xv & every
    return best if best <= budget else None


def gram_hashes(code: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the q-grams of one kind of items; the filter's places are sums of them."""
    x = (code ^ U(kind * 0x9E3779B97F4A7C15 % (1 << 64))) * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x, ((x * U(0xA0761D6478BD642F)) >> U(29)) | U(1)


class GramFilter:
    """A Bloom filter of the q-grams of all items, by kind: (characters of a probe, edits, q, bound), at most one a length."""

    def __init__(self, bits: np.ndarray, kinds: list[tuple[int, int, int, int]]):
        self.bits, self.kinds, self.shift = bits, kinds, U(64 - (len(bits) * 64).bit_length() + 1)

    def has(self, code: np.ndarray, kind: int) -> np.ndarray:
        x, step = gram_hashes(code, kind)
        at = np.arange(len(code))
        for _ in range(HASHES):
            place = x >> self.shift
            held = (self.bits[place >> U(6)] >> (place & U(63))) & U(1) == 1
            at, x, step = at[held], x[held] + step[held] * U(0x9E3779B97F4A7C15), step[held]
        out = np.zeros(len(code), bool)
        out[at] = True
        return out

    def suspects(self, texts: list[bytes]) -> list[bool]:
        """Texts that can hold a probe."""
        found = np.zeros(len(texts), bool)
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size < TOGETHER):
                size += len(texts[high])
                high += 1
            gap = b"\x00" * (3 * PROBE)
            shown = [normal(t) for t in texts[low:high]]
            begin = np.cumsum([0, *(len(t) + len(gap) for t in shown)])
            data = gap.join([*shown, b""])
            code = {q: codes(data, q) for q in {k[2] for k in self.kinds}}
            for long, edits, q, bound in self.kinds:
                held = self.has(code[q], long)
                if long < Q:
                    at = np.flatnonzero(held)
                    held[at] = whole_words(data, at, np.full(len(at), long))
                width = long + edits - q + 1
                sums = np.concatenate(([0], np.cumsum(held, dtype=np.int64)))
                at = np.flatnonzero(sums[np.minimum(np.arange(len(held)) + width, len(held))] - sums[:-1] >= bound) if bound > 1 else np.flatnonzero(held)
                found[low + np.unique(np.searchsorted(begin, at, side="right") - 1)] = True
            low = high
        return found.tolist()


def benchmark_items(benchmark: DataFrame, block_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """The items (item_id, text, block), written; their bytes, and the number of blocks."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where(F.length(F.trim("text")) > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    own = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    return stage_table(items.withColumn("block", own), "items"), size, n_blocks


def gram_filter(items: DataFrame, size: int, edits: float) -> GramFilter:
    """The filter of all items. Its bits are made in the tasks and joined by OR."""
    n_bits = min(MOST_BITS, max(16, math.ceil(math.log2(max(2, size * BITS_A_GRAM)))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places = []
            texts = [t for t in map(normal, raw_bytes(batch.column(0))) if t]
            by_kind: dict[int, list[bytes]] = {}
            for t in texts:
                by_kind.setdefault(min(len(t), PROBE), []).append(t)
            for long, some in by_kind.items():
                q = int(lemma(np.array([long]), edits)[2][0])
                for t in some:
                    x, step = gram_hashes(codes(t, q), long)
                    for _ in range(HASHES):
                        places.append(x >> U(64 - n_bits))
                        x = x + step * U(0x9E3779B97F4A7C15)
            if not places:
                continue
            at = np.unique(np.concatenate(places))
            word, first = np.unique(at >> U(6), return_index=True)
            mask = np.bitwise_or.reduceat(U(1) << (at & U(63)), first)
            kinds = np.array(sorted(by_kind), np.int64)
            columns = [np.concatenate((word.astype(np.int64), -1 - kinds)), np.concatenate((mask.view(np.int64), np.zeros(len(kinds), np.int64)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "mask"])

    # a row of 16 bytes for each word of the filter at most, and one a length of probes
    rows = items.select("text").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    word, mask = (rows[c].to_numpy() for c in ("word", "mask"))
    bits = np.zeros(1 << (n_bits - 6), U)
    bits[word[word >= 0]] = mask[word >= 0].view(U)
    kinds = np.sort(-1 - word[word < 0])
    return GramFilter(bits, [tuple(map(int, k)) for k in zip(*lemma(kinds, edits), strict=True)])


def with_suspicion(docs: DataFrame, grams: GramFilter, name: str, text_col: str) -> DataFrame:
    """All rows with a column that says whether a passage may stand in the text. The filter goes to every executor once."""
    sent = docs.sparkSession.sparkContext.broadcast((grams.bits, grams.kinds))

    def make() -> Callable[[list[bytes]], list[tuple]]:
        suspects = GramFilter(*sent.value).suspects
        return lambda texts: [(x,) for x in suspects(texts)]

    return extend_rows(docs, make, [(name, pa.bool_(), "boolean")], text_col=text_col, batched=True)


def verified(suspects: DataFrame, items: DataFrame, n_blocks: int, edits: float) -> DataFrame:
    """(row, item_id, n_probes, edits) of the ``suspects`` (row, text), a written table: every part of them meets every block."""
    size = suspects.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(math.ceil(size / SUSPECT_BYTES), suspects.sparkSession.sparkContext.defaultParallelism)
    left = suspects.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    right = items.select("item_id", "text", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    schema = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("n_probes", pa.int32()), ("edits", pa.int32())])

    def search(some: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in schema.names}
        if some.num_rows and block.num_rows:
            column = lambda t, c: raw_bytes(t[c].combine_chunks())
            probes = Probes(list(zip(block["item_id"].to_pylist(), column(block, "text"), strict=True)), edits)
            for row, hits in zip(some["row"].to_pylist(), probes.search(column(some, "text")), strict=True):
                for h in hits:
                    for n, v in zip(schema.names, (row, h["item_id"], h["n_probes"], h["edits"]), strict=True):
                        out[n].append(v)
        return pa.table(out, schema=schema)

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, "row long, item_id long, n_probes int, edits int")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, edits: float = EDITS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(doc_id, item_id, n_probes, edits): documents in which a passage of a benchmark item stands."""
    items, size, n_blocks = benchmark_items(benchmark, block_bytes, item_col, "text")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = with_suspicion(rows, gram_filter(items, size, edits), "suspect", "text").where("suspect")
    suspects = stage_table(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "suspects")
    hits = verified(suspects.select("row", "text"), items, n_blocks, edits)
    return suspects.select("row", "doc_id").join(hits, "row").select("doc_id", "item_id", "n_probes", "edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, edits: float = EDITS, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """Whole rows of ``docs`` in which no passage of the benchmark stands."""
    items, size, n_blocks = benchmark_items(benchmark, block_bytes, "item_id", "text")
    name = free_name(docs, "suspect")
    rows = with_suspicion(docs, gram_filter(items, size, edits), name, text_col)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # the documents are filtered twice, which costs less than writing all of them
    suspects = rows.where(F.col(name)).select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("whole"))
    suspects = stage_table(suspects, "suspects")
    hits = verified(suspects.select("row", F.col("whole")[text_col].alias("text")), items, n_blocks, edits)
    cleared = suspects.join(hits, "row", "left_anti").select("whole.*")
    return rows.where(~F.col(name)).select(*columns).unionByName(cleared)
