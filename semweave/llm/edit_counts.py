"""Token counts that follow edits.

The leaves of a document's segment tree are its pre-tokens, so each is encoded on its own and the leaves' token counts add
up to the document's. The tree is kept: sizes and tokens of all nodes, inner sums too. A pre-token depends on its own
characters and on ``CONTEXT`` after them; so an edit touches the leaves from ``CONTEXT`` characters before it up to the
first old boundary behind it that is a boundary again. Only these are split and encoded again, and the sums on their paths
to the root follow.

Defined cases: a null or empty text is one empty leaf; edits are (start, end, text) in code points of the old text, end
exclusive, applied as if at once; they are taken by start and then end, and one that overlaps an earlier one, lies outside
the text or has a null place is skipped; repeated rows are repeated; a null edit list is an empty one; a region with more
pre-tokens than it had leaves keeps the rest of them in its last leaf, one with fewer leaves some empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.arrow_rows import slices
from semweave.llm.pii import placed
from semweave.llm.secret_scan import vocabulary

#: Characters behind a pre-token that it may depend on: two of a contraction, or one of white space.
CONTEXT = 3
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 200_000


class PreTokens:
    """Splits a text as the vocabulary does, and counts tokens of pre-tokens."""

    def __init__(self, vocabulary_path: str | None = None):
        import public_tokenizers
        import regex

        self.split: Callable[[str], list[str]] = regex.compile(public_tokenizers.PATTERN).findall
        self.encode = vocabulary(vocabulary_path).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = len(self.encode(p))
        return [known[p] for p in pieces]


class SegmentTree:
    """Characters and tokens of leaves, with sums: node i has children 2 i and 2 i + 1, leaves begin at ``base``."""

    def __init__(self, size: np.ndarray, tokens: np.ndarray, n: int):
        self.size, self.tokens, self.n, self.base = size, tokens, n, len(size) // 2

    @classmethod
    def of_leaves(cls, sizes: list[int], tokens: list[int]) -> SegmentTree:
        n = max(1, len(sizes))
        base = 1 << (n - 1).bit_length()
        both = []
        for leaves in (sizes, tokens):
            a = np.zeros(2 * base, np.int32)
            a[base : base + len(leaves)] = leaves
            low = base
            while low > 1:
                a[low // 2 : low] = a[low : 2 * low : 2] + a[low + 1 : 2 * low : 2]
                low //= 2
            both.append(a)
        return cls(*both, n)

    def find(self, at: int) -> tuple[int, int, int]:
        """The leaf with the character ``at``, and where it starts and ends; the last leaf with characters for the end."""
        if not self.size[1]:
            return 0, 0, 0
        at = max(0, min(at, int(self.size[1]) - 1))
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if at >= start + self.size[i]:
                start += int(self.size[i])
                i += 1
        return i - self.base, start, start + int(self.size[i])

    def put(self, leaf: int, size: int, tokens: int) -> None:
        """Change a leaf and the sums on its path."""
        i = self.base + leaf
        more, extra = size - self.size[i], tokens - self.tokens[i]
        while i and (more or extra):
            self.size[i] += more
            self.tokens[i] += extra
            i //= 2


def usable(edits: Iterable[dict] | None, n: int) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for e in sorted((e["start"], e["end"], e["text"] or "") for e in edits or () if e and e["start"] is not None and e["end"] is not None):
        if 0 <= e[0] <= e[1] <= n and (not out or (e[0] >= out[-1][1] and e[:2] != out[-1][:2])):
            out.append(e)
    return out


def apply_edits(text: str, tree: SegmentTree, edits: list[tuple[int, int, str]], words: PreTokens) -> tuple[str, int]:
    """The new text and the number of pre-tokens that were encoded again; ``tree`` follows."""
    out, at, n_encoded, k = [], 0, 0, 0
    fresh: list[tuple[int, int, list[str], list[int]]] = []  # first leaf, leaves, pre-tokens, counts
    while k < len(edits):
        first, start, _ = tree.find(edits[k][0] - CONTEXT)
        own, step, end = [], 1, start
        while True:
            while k < len(edits) and (not own or edits[k][0] - CONTEXT < end):
                own.append(edits[k])
                end = max(end, tree.find(edits[k][1])[2])
                k += 1
            parts, here = [], start
            for a, b, new in own:
                parts += [text[here:a], new]
                here = b
            joined = "".join([*parts, text[here:end]])
            pieces = words.split(joined + text[end : end + CONTEXT])
            ends = list(accumulate(map(len, pieces)))
            if end == len(text) or not joined or len(joined) in ends:
                break
            for _ in range(step):  # the last pre-token goes on: take in more leaves
                end = tree.find(end)[2]
            step *= 2
        pieces = pieces[: ends.index(len(joined)) + 1] if joined else []
        last = tree.find(end - 1)[0] if end else tree.n - 1
        last = tree.n - 1 if end == len(text) else last
        fresh.append((first, last - first + 1, pieces, words.count(pieces)))
        n_encoded += len(pieces)
        out += [text[at:start], joined]
        at = end
    out.append(text[at:])
    for first, room, pieces, tokens in fresh:
        for i in range(room):
            if i == room - 1:
                tree.put(first + i, sum(map(len, pieces[i:])), sum(tokens[i:]))
            else:
                tree.put(first + i, len(pieces[i]) if i < len(pieces) else 0, tokens[i] if i < len(tokens) else 0)
    return "".join(out), n_encoded


TREE = "n_leaves int, node_chars array<int>, node_tokens array<int>"


def list_column(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


def build_trees(docs: DataFrame, *, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text``, the columns of ``extra``, and each document's tree: leaves, characters and tokens of its nodes."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *extra)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PreTokens(vocabulary_path)
        for batch in slices(batches, 1):
            trees = []
            for text in batch.column(1).to_pylist():
                pieces = words.split(text)
                trees.append(SegmentTree.of_leaves(list(map(len, pieces)), words.count(pieces)))
            own = [pa.array([t.n for t in trees], pa.int32()), list_column([t.size for t in trees]), list_column([t.tokens for t in trees])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "n_leaves", "node_chars", "node_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, {TREE}")


def count_edited(trees: DataFrame, *, vocabulary_path: str | None = None, edits_col: str = "edits") -> DataFrame:
    """``trees`` as ``build_trees`` gives them, with a column of edits: ``doc_id``, ``n_tokens`` before, ``n_edits``,
    ``n_tokens_edited``, ``n_reencoded`` pre-tokens, the new ``text`` and its tree."""
    rows = trees.select("doc_id", "text", "n_leaves", "node_chars", "node_tokens", F.col(f"`{edits_col}`").alias("edits"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PreTokens(vocabulary_path)
        for batch in slices(batches, 1):
            out, kept = [], []
            columns = (batch.column(1).to_pylist(), batch.column(2).to_pylist(), *([x.values.to_numpy() for x in batch.column(i)] for i in (3, 4)), batch.column(5).to_pylist())
            for text, n, size, tokens, edits in zip(*columns, strict=True):
                tree = SegmentTree(size.copy(), tokens.copy(), n)
                before, todo = int(tree.tokens[1]), usable(edits, len(text))
                new, encoded = apply_edits(text, tree, todo, words)
                out.append((before, len(todo), int(tree.tokens[1]), encoded, new, n))
                kept.append(tree)
            types = [pa.int64()] * 4 + [pa.string(), pa.int32()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            arrays += [list_column([t.size for t in kept]), list_column([t.tokens for t in kept])]
            names = ["n_tokens", "n_edits", "n_tokens_edited", "n_reencoded", "text", "n_leaves", "node_chars", "node_tokens"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long, text string, {TREE}")


def masking_edits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``edits``: every run of six digits or more becomes ``0``, and a line end is appended."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    pattern = "[0-9]{6,}+"
    found = placed("number", text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    each = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("0").alias("text")))
    end = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("\n").alias("text"))
    return docs.withColumn("edits", F.concat(each, F.array(end)))
