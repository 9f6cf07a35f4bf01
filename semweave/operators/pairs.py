"""Distinct pairs on their way to the judge, without a text for each pair.

If one side of a semantic join is small enough to be broadcast, pairs are kept as one row a text of the other, large side,
with the keys of its partners. Only these rows are exchanged; pairs and their texts are made in the task that asks about
them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semweave.functions.keys import known
from semweave.operators.judge import PAIR, PAIR_KEY

#: Bytes of a row beside its text, as far as sizes are guessed from rows.
ROW_BYTES = 64


@dataclass(frozen=True)
class GroupedPairs:
    """``groups``: key and text of the large side, and the keys of its partners; ``partners``: key and text of the small side."""

    groups: DataFrame
    partners: DataFrame
    small: str

    @property
    def large(self) -> str:
        return "left" if self.small == "right" else "right"

    def dealt(self, n: int | None = None) -> DataFrame:
        """Keys and texts of the pairs, those of a large side's text in one of ``n`` tasks."""
        own, others = side_keys(self.large), side_keys(self.small)
        rows = self.groups if n is None else self.groups.repartition(n, *own)
        pairs = rows.select(*own, text_name(self.large), F.explode("partners").alias("partner"))
        partners = F.broadcast(self.partners.withColumnsRenamed(dict(zip(others, ("p1", "p2"), strict=True))))
        met = pairs.join(partners, (F.col("partner.k1") == F.col("p1")) & (F.col("partner.k2") == F.col("p2")))
        return met.select(*own, F.col("p1").alias(others[0]), F.col("p2").alias(others[1]), *PAIR).select(*PAIR_KEY, *PAIR)

    def sizes(self) -> dict[str, int]:
        """Number of pairs, of texts of both sides, and bytes of both sides summed over pairs; no text meets a pair."""
        n = F.size("partners")
        own = self.groups.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("texts"), F.sum(n * F.octet_length(text_name(self.large))).alias("bytes")).first()
        others = side_keys(self.small)
        used = self.groups.select(F.explode("partners").alias("partner")).groupBy("partner").agg(F.count(F.lit(1)).alias("times"))
        known_by = self.partners.select(F.struct(*(F.col(k).alias(a) for k, a in zip(others, ("k1", "k2"), strict=True))).alias("partner"), F.octet_length(text_name(self.small)).alias("length"))
        other = used.join(F.broadcast(known_by), "partner").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("times") * F.col("length")).alias("bytes")).first()
        found = {self.large: own, self.small: other}
        return {"n": own["n"] or 0} | {k: found[s][c] or 0 for s, c, k in (("left", "texts", "l"), ("right", "texts", "r"), ("left", "bytes", "lb"), ("right", "bytes", "rb"))}


def side_keys(side: str) -> tuple[str, str]:
    return PAIR_KEY[:2] if side == "left" else PAIR_KEY[2:]


def text_name(side: str) -> str:
    return PAIR[0] if side == "left" else PAIR[1]


def grouped(found: DataFrame, texts: dict[str, DataFrame], small: str, n: int) -> GroupedPairs:
    """Pairs of keys, which may come more than once. ``texts``: keys and text of each side, each text once."""
    large = "left" if small == "right" else "right"
    own, others = side_keys(large), side_keys(small)
    partner = F.struct(*(F.col(k).alias(a) for k, a in zip(others, ("k1", "k2"), strict=True)))
    groups = found.groupBy(*own).agg(F.collect_set(partner).alias("partners"))
    return GroupedPairs(groups.join(texts[large].repartition(n, *own), list(own)), texts[small], small)


def bytes_planned(df: DataFrame) -> int:
    """Catalyst's estimate; of a join it is the product of both inputs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bytes_counted(df: DataFrame) -> int:
    """The rows' size, by reading them."""
    fixed = (T.NumericType, T.BooleanType, T.DatetimeType, T.NullType)
    length = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema.fields if not isinstance(f.dataType, fixed)), F.lit(ROW_BYTES))
    return df.agg(F.sum(length.cast("long"))).first()[0] or 0


def small_side(left: DataFrame, right: DataFrame) -> str | None:
    """The side that can be broadcast, by Catalyst's estimate or, if that names none, by its rows; None if neither can."""
    most = bytes_of(left.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    sides = {"left": left, "right": right}
    for size in (bytes_planned, bytes_counted):
        found = min((size(df), name) for name, df in sides.items())
        if found[0] <= most:
            return found[1]
        if most <= 0:
            break
    return None


def bytes_of(setting: str) -> int:
    """A size as Spark's settings write it."""
    text = setting.strip().lower().removesuffix("b")
    for unit, power in (("k", 10), ("m", 20), ("g", 30), ("t", 40)):
        if text.endswith(unit):
            return int(text[:-1]) << power
    return int(text)


def tokens(keys: Column, kind: T.DataType, first: bool) -> Column:
    """What a row's key list has to share with that of a partner: two known lists an element, an unknown list of the second
    side any row of the first, an unknown one of the first side any known list of the second."""
    token = lambda n, k: F.struct(F.lit(n).alias("kind"), k.cast(kind).alias("key"))
    own = F.transform(F.array_distinct(known(keys)), lambda k: token(0, k))
    marks = [token(n, F.lit(None)) for n in (1, 2)]
    if first:
        return F.when(keys.isNull(), F.array(*marks)).otherwise(F.concat(own, F.array(marks[0])))
    return F.when(keys.isNull(), F.array(marks[0])).otherwise(F.concat(own, F.array(marks[1])))


def element_of(df: DataFrame, keys: Column) -> T.DataType:
    """The type of a key list's elements."""
    kind = df.select(keys).schema[0].dataType.elementType
    return T.StringType() if isinstance(kind, T.NullType) else kind


def shared(a: str, b: str) -> Column:
    """Two tokens are the same."""
    return (F.col(f"{a}.kind") == F.col(f"{b}.kind")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))


def shared_first(token: str, a: Column, b: Column) -> Column:
    """The token is the first that both lists share: true for one token of each pair of rows that share any."""
    return (F.col(f"{token}.kind") != 0) | F.get(F.array_intersect(F.array_distinct(known(a)), known(b)), F.lit(0)).eqNullSafe(F.col(f"{token}.key"))
