"""Row-wise kernels over Arrow batches: the one place where documents cross into Python.

Every kernel sees one document at a time, so memory is bounded by one Arrow batch plus the kernel's own
bounded memo tables, and a lost executor only repeats its own input split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and text bytes that a kernel takes at once. Spark's own batches hold 64 MB and 10000 rows at most.
ROWS_TOGETHER, BYTES_TOGETHER = 1000, 8_000_000


def slices(batches: Iterable[pa.RecordBatch], text_at: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows and bytes of the text column; a part has one row at least, none is empty."""
    for batch in batches:
        column, at = batch.column(text_at), 0
        ends = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)))
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(at + ROWS_TOGETHER, max(at + 1, int(np.searchsorted(ends, before + BYTES_TOGETHER, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, … that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def map_text(
    docs: DataFrame,
    make_kernel: Callable[[], Callable[[bytes], tuple]],
    fields: Sequence[tuple[str, pa.DataType, str]],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    batched: bool = False,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Apply a per-document kernel to whole texts.

    ``make_kernel`` runs once a task and returns ``bytes -> tuple`` with one value for each of ``fields`` (name, Arrow
    type, Spark DDL type); a ``batched`` one takes and gives the list for a batch of rows. A null text is the empty text; ids, repeated or null, pass through unchanged. Only the two
    columns named are read, so other columns can have any name; ``also`` adds columns (long) that go along.
    """
    also = also or {}
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(c.cast("long").alias(n) for n, c in also.items()))
    names = ["doc_id", *also, *(f[0] for f in fields)]
    types = [f[1] for f in fields]
    ddl = ", ".join(f"`{n}` {t}" for n, t in zip(names, [*["long"] * (1 + len(also)), *(f[2] for f in fields)], strict=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in slices(batches, 1):
            texts = [text or b"" for text in raw_bytes(batch.column(1))]
            out = list(zip(*(kernel(texts) if batched else map(kernel, texts)), strict=True))
            arrays = [batch.column(0), *batch.columns[2:], *(pa.array(v, t) for v, t in zip(out, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, ddl)


def extend_rows(
    docs: DataFrame, make_kernel: Callable[[], Callable[[bytes], tuple]], fields: Sequence[tuple[str, pa.DataType, str]], *, text_col: str = "text", batched: bool = False
) -> DataFrame:
    """All columns of ``docs`` and, after them, one for each of ``fields``: what the kernel gives for the whole text."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, _, t in fields)).fields])
    names, types = schema.names, [f[1] for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in slices(batches, at):
            texts = [text or b"" for text in raw_bytes(batch.column(at))]
            out = list(zip(*(kernel(texts) if batched else map(kernel, texts)), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=names)

    # names of the kernel's input are its own: a user's may hold anything
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, schema)


class CodePoints:
    """Code-point offsets of ascending byte offsets in one UTF-8 text."""

    def __init__(self, text: bytes):
        self.text, self.ascii = text, text.isascii()
        self.at, self.points = 0, 0

    def __call__(self, offset: int) -> int:
        if self.ascii:
            return offset
        if offset < self.at:
            self.at = self.points = 0
        self.points += len(self.text[self.at : offset].decode("utf-8", "replace"))
        self.at = offset
        return self.points


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS_DDL = "array<struct<kind:string,start:int,end:int>>"


def span_rows(text: bytes, found: list[tuple[int, int, int]], kinds: Sequence[str]) -> list[dict]:
    """(start, kind number, end) byte spans, in any order, as code-point spans by start, then kind as listed."""
    points = CodePoints(text)
    found = sorted(found)
    at = {offset: points(offset) for offset in sorted({x for s, _, e in found for x in (s, e)})}
    return [{"kind": kinds[k], "start": at[s], "end": at[e]} for s, k, e in found]


def span_text(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans (only of ``kinds``, if given), comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
