"""Removal of repeated passages by recompression.

Words are named by hashes of their content. A round names maximal runs of one name, or pairs: every name is a left or a
right one (a bit of its hash), and a left one followed by a right one becomes one symbol, named by a hash of the two. The
names depend on content alone, so they are the same in all documents without any exchange, and the parse of a passage
is the same wherever it stands but for its ends. Each symbol carries the words that its parse depends on; a symbol whose
dependence lies inside a window of words is certain there.

Each window chooses one of its certain symbols (the longest; then by hash): equal windows choose equal symbols. Windows
next to one another with one choice are a block. Symbols are counted over the corpus, with map-side sums:

* chosen once: its windows stand nowhere else;
* chosen several times, always in equal blocks: all of its windows are repeats;
* otherwise, and for windows without a certain symbol, the windows themselves are counted, by 128-bit hashes.

So colliding names cost work but change nothing. Texts are exchanged once, to meet what was found about them; equal texts
share it, by a 96-bit key, and rows of one text can be split among tasks.

Defined cases: a null or empty text has no words; with fewer words than a window nothing is removed; a window equal to
another of its own document counts as a repeat, overlapping or not; repeated rows and null ids are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.arrow_rows import raw_bytes
from semweave.llm.shared import stage_table

WINDOW = 35
ROUNDS = 4
#: Words that are parsed together; longer documents are parsed whole.
TOGETHER = 400_000
FAR = 1 << 40

U = np.uint64
ODD_1, ODD_2, ODD_3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * ODD_1
    return (x ^ (x >> U(29))) * ODD_2


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * ODD_3 + mix(b + ODD_1))


class Rolling:
    """Hashes of stretches of a sequence of names, by prefix sums of powers."""

    def __init__(self, names: np.ndarray, base: int):
        n = len(names)
        self.powers = power_table(base, n)
        self.inverse = power_table(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(names * self.powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


_tables: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    table = _tables.get(base)
    if table is None or len(table) <= n:
        table = np.full(max(n + 1, 1 << 16), base, U)
        table[0] = 1
        table = _tables[base] = np.cumprod(table)
    return table


def word_names(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


class Symbols:
    """Symbols of several documents: name, words [start, stop), words [low, high) that the parse depends on, document."""

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        at = np.arange(len(names))
        self.name, self.start, self.stop, self.low, self.high, self.doc = names, at, at + 1, at, at + 1, doc

    def take(self, keep: np.ndarray) -> None:
        for f in ("name", "start", "stop", "low", "high", "doc"):
            setattr(self, f, getattr(self, f)[keep])

    def beside(self) -> tuple[np.ndarray, ...]:
        """Dependence of the left and of the right neighbour; beyond a document's end it is out of reach."""
        same = self.doc[1:] == self.doc[:-1]
        left_low, left_high = np.full(len(self.name), -FAR), np.full(len(self.name), -FAR)
        left_low[1:], left_high[1:] = np.where(same, self.low[:-1], -FAR), np.where(same, self.high[:-1], -FAR)
        right_low, right_high = np.full(len(self.name), FAR), np.full(len(self.name), FAR)
        right_low[:-1], right_high[:-1] = np.where(same, self.low[1:], FAR), np.where(same, self.high[1:], FAR)
        return left_low, left_high, right_low, right_high

    def runs(self) -> None:
        """Name maximal runs of equal names; a run, also of one, depends on what stands on either side."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        ll, lh, rl, rh = self.beside()
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        count = (last - first + 1).astype(U)
        low = np.minimum(np.minimum(np.minimum.reduceat(self.low, first), ll[first]), rl[last])
        high = np.maximum(np.maximum(np.maximum.reduceat(self.high, first), lh[first]), rh[last])
        stop = self.stop[last]
        self.take(first)
        self.low, self.high, self.stop = low, high, stop
        self.name = np.where(count > 1, join_names(self.name, count), self.name)

    def pairs(self, level: int) -> None:
        """Join each left name with a right name that follows it."""
        if len(self.name) < 2:
            return
        salt = U(level * int(ODD_2) % (1 << 64))
        left = (mix(self.name + salt) >> U(63)).astype(bool)
        joined = np.zeros(len(left), bool)
        joined[:-1] = left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])
        second = np.zeros(len(left), bool)
        second[1:] = joined[:-1]
        ll, lh, rl, rh = self.beside()
        # joined or not, a left name depends on the right neighbour; a right name that is left alone on the left one
        low = np.minimum(self.low, np.where(left, rl, ll))
        high = np.maximum(self.high, np.where(left, rh, lh))
        at = np.flatnonzero(joined)
        self.name = self.name.copy()
        self.stop = self.stop.copy()
        self.name[at] = join_names(self.name[at], self.name[at + 1])
        self.stop[at] = self.stop[at + 1]
        self.low, self.high = low, high
        self.take(~second)


def blocks(names: np.ndarray, sizes: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, symbol name, block hash, bare) of the blocks of documents laid end to end."""
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    s = Symbols(names, doc)
    s.runs()
    for level in range(rounds):
        s.pairs(level)
    # windows [low, high] in which a symbol is certain
    first = np.maximum(s.high - window, begin[s.doc])
    last = np.minimum(s.low, (begin + sizes)[s.doc] - window)
    sure = np.flatnonzero((first <= last) & (s.low > -FAR) & (s.high < FAR))
    n = len(names)
    rank = (np.minimum(s.stop - s.start, 63).astype(U) << U(58)) | (mix(s.name) >> U(36) << U(30)) | (U((1 << 30) - 1) - np.arange(len(s.name)).astype(U))
    best = range_max(n, first[sure], last[sure], rank[sure])
    at = np.arange(n)
    inside = at <= (begin + sizes)[doc] - window
    chosen = np.where(best > 0, ((1 << 30) - 1) - (best & U((1 << 30) - 1)).astype(np.int64), -1)
    chosen = np.where(inside, chosen, -2)
    new = np.ones(n, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    count = np.diff(start, append=n)
    keep = chosen[start] != -2
    start, count = start[keep], count[keep]
    which = chosen[start]
    bare = which < 0
    sym = np.maximum(which, 0)
    content = Rolling(names, BASES[0])(start, np.minimum(start + count + window - 1, n))
    offset = np.where(bare, 0, s.start[sym] - start).astype(U)
    content = mix(content + offset * ODD_3 + count.astype(U) * ODD_2)
    return doc[start], start - begin[doc[start]], count, s.name[sym], content, bare


def range_max(n: int, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    """At each place the largest value of the intervals [first, last] over it, 0 where there is none."""
    if not len(first):
        return np.zeros(n, U)
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    table = None
    for k in range(int(level.max()), -1, -1):
        now = np.zeros(n, U)
        if table is not None:  # halves of the longer stretch
            half = 1 << k
            now = table.copy()
            now[half:] = np.maximum(now[half:], table[:-half] if half else table)
        mine = level == k
        np.maximum.at(now, first[mine], value[mine])
        np.maximum.at(now, last[mine] - (1 << k) + 1, value[mine])
        table = now
    return table


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` and the key of the text, (c1, c2)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"c1": F.xxhash64("text"), "c2": F.shiftrightunsigned(F.xxhash64(F.lit(1), "text"), 32)})


def found_blocks(rows: DataFrame, window: int, rounds: int) -> DataFrame:
    """(name, block, c1, c2, p, m, bare) of all blocks; p: first window, m: windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parse(some: list[tuple[list[bytes], int, int]]) -> pa.RecordBatch:
            sizes = np.array([len(w) for w, _, _ in some])
            names = word_names([x for w, _, _ in some for x in w])
            doc, p, m, name, content, bare = blocks(names, sizes, window, rounds)
            c1, c2 = (np.array([x[i] for x in some], np.int64)[doc] for i in (1, 2))
            arrays = [name.view(np.int64), content.view(np.int64), c1, c2, p.astype(np.int32), m.astype(np.int32), bare]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["name", "block", "c1", "c2", "p", "m", "bare"])

        held: list[tuple[list[bytes], int, int]] = []
        size = 0
        for batch in batches:
            for text, c1, c2 in zip(raw_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                held.append((words, c1, c2))
                size += len(words)
                if size >= TOGETHER:
                    yield parse(held)
                    held, size = [], 0
        if held:
            yield parse(held)

    return rows.select("text", "c1", "c2").mapInArrow(run, "name long, block long, c1 long, c2 long, p int, m int, bare boolean")


def window_hashes(names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.arange(len(names) - window + 1)
    return Rolling(names, BASES[0])(start, start + window).view(np.int64), Rolling(mix(names + ODD_3), BASES[1])(start, start + window).view(np.int64)


def equal_windows(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each group of equal ones, and each window's group."""
    _, first, group = np.unique(h1, return_index=True, return_inverse=True)
    if (h2 != h2[first][group]).any():  # two windows with one h1
        _, first, group = np.unique(np.stack((h1, h2)), axis=1, return_index=True, return_inverse=True)
        group = group.ravel()
    return first, group


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays; a null row is empty."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        return [values[i:j] if v else values[:0] for i, j, v in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist(), strict=True)]
    return [values[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def windows_of(marks: np.ndarray, sure: bool, n: int) -> np.ndarray:
    """Which of n windows the marks (first window << 32 | windows << 1 | sure) cover: those that are repeats for sure, or
    those that have to be counted one by one."""
    marks = marks[(marks & 1) == sure]
    edge = np.zeros(n + 1, np.int64)
    first = marks >> 32
    np.add.at(edge, first, 1)
    np.add.at(edge, first + ((marks >> 1) & 0x7FFFFFFF), -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, *, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space).

    A word goes if it lies in a window of ``window`` words whose words also start anywhere else.
    """
    rows = keyed(docs, id_col, text_col)
    found = stage_table(found_blocks(rows, window, rounds), "blocks")  # the texts are parsed once
    named = found.where("not bare")
    shared = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("least"), F.max("block").alias("most"))
    # written, as are the sides of the joins below: they then exchange both sides, and Spark can split the rows of a
    # frequent name, or of a frequent text
    shared = stage_table(shared.where("n > 1").select("name", F.expr("least = most").alias("sure")), "shared-names")
    mark = "shiftleft(cast(p as bigint), 32) + shiftleft(cast(m as bigint), 1) + {} as mark"
    marks = named.join(shared, "name").selectExpr("c1", "c2", mark.format("if(sure, 1L, 0L)"))
    marks = marks.unionByName(found.where("bare").selectExpr("c1", "c2", mark.format("0L")))
    per_text = marks.groupBy("c1", "c2").agg(F.collect_set("mark").alias("marks"))
    per_text = stage_table(per_text.withColumn("t", F.monotonically_increasing_id()), "marks")  # from here on texts have short names
    met = rows.join(per_text, ["c1", "c2"], "left").select("text", "t", "marks")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            marks = lists_of(batch.column(2))
            todo = [i for i, m in enumerate(marks) if ((m & 1) == 0).any()]
            if not todo:
                continue
            texts, t = batch.column(0), batch.column(1)
            for i in todo:
                h1, h2 = window_hashes(word_names(texts[i].as_py().encode().split()), window)
                pick = np.flatnonzero(windows_of(marks[i], False, len(h1)))
                first, group = equal_windows(h1[pick], h2[pick])
                at = pick[first]
                own = (h1[at], h2[at], np.full(len(at), t[i].as_py()), at.astype(np.int32), np.bincount(group, minlength=len(at)).astype(np.int32))
                for part, x in zip(parts, own, strict=True):
                    part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=["h1", "h2", "t", "at", "n"])

    seen = met.mapInArrow(counted, "h1 long, h2 long, t long, at int, n int")
    again = seen.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    # the first place of each repeated window in the text: its other places there are found again by both hashes
    hits = seen.select("h1", "h2", "t", "at").join(again, ["h1", "h2"]).groupBy("t").agg(F.collect_set("at").alias("hits"))
    known = stage_table(per_text.join(hits, "t", "left").drop("t"), "known")
    last = rows.join(known, ["c1", "c2"], "left").select("doc_id", "text", "marks", "hits")

    def cleared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_words, n_removed, kept = [], [], []
            for text, marks, hits in zip(raw_bytes(batch.column(1)), lists_of(batch.column(2)), lists_of(batch.column(3)), strict=True):
                words = text.split()
                gone = 0
                if len(marks):
                    n = len(words) - window + 1
                    starts = windows_of(marks, True, n)
                    if len(hits):
                        h1, h2 = window_hashes(word_names(words), window)
                        pick = np.flatnonzero(windows_of(marks, False, n))
                        first, group = equal_windows(h1[pick], h2[pick])
                        starts[pick[np.isin(pick[first], hits)[group]]] = True
                    at = np.flatnonzero(starts)
                    hit = np.zeros(len(words) + 1, np.int64)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + window, -1)
                    stay = np.cumsum(hit)[:-1] == 0
                    gone = len(words) - int(stay.sum())
                    if gone:
                        words = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return last.mapInArrow(cleared, "doc_id long, n_words long, n_removed long, kept string")
