"""Sharding by a k-d tree over metadata, with DataFrame operations only.

A node that stands for k shards is cut along its widest dimension at the weighted quantile that gives floor(k/2)/k of
its bytes to the left, until every leaf is one shard. All nodes of a level are cut together: histograms of at most
``BINS`` bins a node are aggregated over the rows and the bin that holds the cut is refined, so what reaches the driver
depends on the number of shards alone. Rows are written once and never moved while the tree grows: a row's node is an
expression of its coordinates, made of the cuts.

Equal texts are one group: they take the least coordinates among them, and stand together in every dimension. Equal
values of a dimension are ordered by the text's checksum and then by a hash of the row's own number, so a hot value can be
cut, repeated rows too. A cut that falls among equal texts moves to the nearer edge of their group if that shifts no shard
below it by more than ``GROUP_SLACK`` of its bytes; the law goes first, and a group that is too large for that is cut.

Defined cases: a null text has size 8 and checksum 0; null ids and repeated rows are rows like others; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from semweave.llm.shared import stage_table

#: Bins of a node's histogram.
BINS = 1 << 15
#: A cut may miss its weight by this share of a shard's bytes.
TOLERANCE = 5e-4
#: A cut may miss it by this share of the bytes of the smaller side's shards, to keep a group of equal texts whole.
GROUP_SLACK = 0.005
TIE_BITS = 19
#: Bits of a key below its coordinate.
COORDINATE = 47
#: Rows that one task numbers.
ROWS_PER_SLOT_TASK = 500_000


@dataclass
class Node:
    shards: int
    first: int
    dim: int = -1
    cut: int = 0
    sides: tuple[Node, Node] | tuple[()] = ()
    low: int = field(default=0, repr=False)
    high: int = field(default=0, repr=False)
    below: float = field(default=0.0, repr=False)
    goal: float = field(default=0.0, repr=False)


def category(value: Column) -> Column:
    """16-bit coordinate of a categorical value; nulls have their own."""
    return F.shiftright(F.crc32(F.coalesce(value.cast("string"), F.lit("\x00")).cast("binary")), 16)


def magnitude(value: Column) -> Column:
    """16-bit coordinate of a non-negative number, on a logarithmic scale."""
    return F.least(F.floor(F.log2(1.0 + F.coalesce(value, F.lit(0))) * 1024), F.lit(65535)).cast("long")


def key_of(dim: int) -> str:
    """63-bit order along a dimension: coordinate, checksum, hash of the row."""
    return f"shiftleft(x{dim}, {COORDINATE}) + shiftleft(shiftright(crc, 4), {TIE_BITS}) + tie"


def key_along(n_dims: int) -> str:
    """The order along the row's ``dim``."""
    return "case dim " + " ".join(f"when {d} then k{d}" for d in range(n_dims)) + " end"


def leaves(node: Node) -> list[Node]:
    return [x for side in node.sides for x in leaves(side)] if node.sides else [node]


def small_table(spark: SparkSession, columns: str, rows: list[tuple[int, ...]]) -> DataFrame:
    """A row a node of the tree, to be broadcast."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"select * from values {values} as t({columns})"))


def place(node: Node) -> str:
    """The leaf of a row: a choice between two sides at each cut."""
    if not node.sides or node.dim < 0:
        return f"{node.first}L"
    return f"if(k{node.dim} < {node.cut}L, {place(node.sides[0])}, {place(node.sides[1])})"


def extent(stats: Row, dim: int) -> int:
    """How far a node's coordinates reach along a dimension."""
    return (stats[f"h{dim}"] >> COORDINATE) - (stats[f"l{dim}"] >> COORDINATE)


def grow(points: DataFrame, n_dims: int, n_shards: int) -> DataFrame:
    """``points`` (size, keys k0..) with ``node``, the shard, after all cuts."""
    root = Node(n_shards, 0)
    spread: list[int] = []
    rows = points.withColumn("node", F.expr(place(root)))
    while open_ := {n.first: n for n in leaves(root) if n.shards > 1}:
        stats = [F.sum("size").alias("bytes")]
        stats += [x for d in range(n_dims) for x in (F.min(f"k{d}").alias(f"l{d}"), F.max(f"k{d}").alias(f"h{d}"))]
        found = {r["node"]: r for r in rows.groupBy("node").agg(*stats).collect()}  # a row a node
        if not found:
            break
        if not spread:
            spread = [max(1, extent(found[0], d)) for d in range(n_dims)]
        each = sum(r["bytes"] for r in found.values()) / n_shards
        cut: dict[int, Node] = {}
        for first, node in open_.items():
            half = node.shards // 2
            node.sides = (Node(half, first), Node(node.shards - half, first + half))
            if r := found.get(first):
                node.dim = max(range(n_dims), key=lambda d: extent(r, d) / spread[d])
                node.low, node.high = r[f"l{node.dim}"], r[f"h{node.dim}"] + 1
                node.goal = r["bytes"] * half / node.shards
                cut[first] = node
        refine(rows, n_dims, dict(cut), each * TOLERANCE)
        keep_groups(rows, n_dims, cut, each * GROUP_SLACK)
        rows = points.withColumn("node", F.expr(place(root)))
    return rows


def keep_groups(rows: DataFrame, n_dims: int, cut: dict[int, Node], most: float) -> None:
    """Move cuts that fall in a group of equal texts to its nearer edge, if it costs each shard ``most`` bytes at most."""
    inside = {f: n for f, n in cut.items() if n.cut % (1 << TIE_BITS)}
    if not inside:
        return
    table = small_table(rows.sparkSession, "node, dim, cut", [(f, n.dim, n.cut) for f, n in inside.items()])
    near = rows.join(table, "node").withColumn("key", F.expr(key_along(n_dims))).where(f"shiftright(key, {TIE_BITS}) = shiftright(cut, {TIE_BITS})")
    for r in near.groupBy("node").agg(F.sum("size").alias("bytes"), F.sum(F.expr("if(key < cut, size, 0)")).alias("below")).collect():  # a row a node
        n = inside[r["node"]]
        if min(r["below"], r["bytes"] - r["below"]) <= most * min(side.shards for side in n.sides):
            low = n.cut >> TIE_BITS << TIE_BITS
            n.cut = low if 2 * r["below"] < r["bytes"] else low + (1 << TIE_BITS)


def refine(rows: DataFrame, n_dims: int, todo: dict[int, Node], slack: float) -> None:
    """Find the cut of each node: the key under which ``goal`` bytes lie, ``slack`` off at most."""
    while todo:
        width = {f: max(1, math.ceil((n.high - n.low) / BINS)) for f, n in todo.items()}
        table = small_table(rows.sparkSession, "node, dim, low, high, wide", [(f, n.dim, n.low, n.high, width[f]) for f, n in todo.items()])
        near = rows.join(table, "node").withColumn("key", F.expr(key_along(n_dims))).where("key >= low and key < high")
        bins = near.groupBy("node", F.expr("(key - low) div wide").alias("bin")).agg(F.sum("size").alias("bytes")).toArrow()  # BINS rows a node at most
        held: dict[int, dict[int, int]] = {f: {} for f in todo}
        for f, b, size in zip(*(c.to_pylist() for c in bins.columns), strict=True):
            held[f][b] = size
        for f, n in list(todo.items()):
            under, b = n.below, 0
            for b in sorted(held[f]):
                if under + held[f][b] >= n.goal:
                    break
                under += held[f][b]
            start = n.low + b * width[f]
            over = under + held[f].get(b, 0)
            # the nearer edge of the bin is good enough, or the bin is one key
            if min(n.goal - under, over - n.goal) <= slack or width[f] == 1:
                n.cut = start if n.goal - under <= over - n.goal else start + width[f]
                del todo[f]
            else:
                n.low, n.high, n.below = start, min(n.high, start + width[f]), under


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 24, *, categories: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` (near equal sums of ``size``) and ``slot`` (gapless in a shard)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    dims = [category(F.col(f"`{c}`")) for c in categories if c in docs.columns] + [magnitude(F.octet_length(text))]
    n = len(dims)
    meta = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
        *(x.cast("long").alias(f"x{d}") for d, x in enumerate(dims)),
    )
    # the row's own number keeps repeated rows apart; it is written here once
    meta = meta.withColumn("tie", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << TIE_BITS)))
    own = stage_table(meta, "shards")
    least = own.groupBy("crc", "size", "hash").agg(F.count(F.lit(1)).alias("n"), *(F.min(f"x{d}").alias(f"g{d}") for d in range(n)))
    groups = stage_table(least.where("n > 1").drop("n"), "groups")
    rows = own.join(groups, ["crc", "size", "hash"], "left").withColumns({f"x{d}": F.coalesce(f"g{d}", f"x{d}") for d in range(n)})
    rows = stage_table(rows.select("doc_id", "size", "crc", *(F.expr(key_of(d)).alias(f"k{d}") for d in range(n))), "points")
    placed = grow(rows, len(dims), n_shards).select("doc_id", "size", "crc", F.col("node").cast("int").alias("shard"))
    return number(placed, rows.count(), n_shards)


def number(placed: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Slots from 0 without gaps: numbers in small parts of a shard, plus the rows of the parts before."""
    parts = max(16, math.ceil(n_rows / n_shards / ROWS_PER_SLOT_TASK))
    cut = placed.withColumn("part", F.expr(f"cast(pmod(xxhash64(doc_id, crc, size, 7), {parts}) as int)"))
    counts = cut.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # shards x parts rows
    before = counts.selectExpr("shard", "part", "sum(n) over (partition by shard order by part) - n as before")
    inner = cut.selectExpr("*", "row_number() over (partition by shard, part order by doc_id, crc, size) - 1 as at")
    slot = (F.col("at") + F.col("before")).cast("long").alias("slot")
    joined = inner.join(F.broadcast(before) if parts * n_shards <= 100_000 else before, ["shard", "part"])
    return joined.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", slot)
