"""What a run asked: one row of counters, computed from the frames that hold the inputs and answers.

Counters are aggregates over those frames, not accumulators: a task that a LIMIT ends early, or that runs twice, can't
make them wrong. They are computed when they are asked for, and at no other time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semweave.functions.keys import known

#: Columns in order. Names and types of the report.
COLUMNS = (
    "requests long, pairs long, records long, cache_hits long, input_tokens long, errors long, clients_created long, client_reuses long, "
    "request_ms double, send_ms double, cascade_requests long, cascade_items long, cascade_cache_hits long, calibration_items long, band_items long, "
    "cascade_errors long, cascade_input_tokens long, cascade_clients_created long, cascade_client_reuses long, cascade_request_ms double, "
    "cascade_send_ms double, cascade_last_low double, cascade_last_high double, candidate_left_rows long, candidate_right_rows long, "
    "candidate_left_retained long, candidate_right_retained long, index_posting_visits long, index_candidate_pairs long, cross_product_pairs long, "
    "retries long, cascade_retries long"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


@dataclass
class Work:
    """Counters that are known, and those that are computed when they are asked for."""

    known: dict[str, Any] = field(default_factory=dict)
    todo: list[Callable[[], dict[str, Any]]] = field(default_factory=list)
    #: For each question the keys of the inputs of its rows: frames, or the two sides of a product.
    inputs: dict[tuple, list[tuple[DataFrame, ...]]] = field(default_factory=dict)
    pairwise: dict[tuple, bool] = field(default_factory=dict)
    used: bool = False
    done: Work | None = None

    def add(self, found: dict[str, Any]) -> None:
        for k, v in found.items():
            self.known[k] = v if k.startswith("cascade_last") else self.known.get(k, 0) + (v or 0)

    def note(self, identity: tuple, pairwise: bool, *frames: DataFrame) -> None:
        self.used, self.done = True, None
        self.inputs.setdefault(identity, []).append(frames)
        self.pairwise[identity] = pairwise

    def rows(self, keys: DataFrame, identity: tuple, pairwise: bool) -> None:
        self.note(identity, pairwise, keys)

    def product(self, left: DataFrame, right: DataFrame, identity: tuple) -> None:
        self.note(identity, True, left, right)

    def asked(self, answers: DataFrame) -> None:
        self.used, self.done = True, None
        self.todo.append(lambda: self.batches(answers, ""))

    def asked_second(self, answers: DataFrame) -> None:
        self.todo.append(lambda: self.batches(answers, "cascade_"))

    @staticmethod
    def batches(answers: DataFrame, prefix: str) -> dict[str, Any]:
        per = answers.groupBy("batch").agg(*(F.max(c).alias(c) for c in ("tokens", "retries", "micros", "sends", "clients", "reuses")))
        r = per.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in per.columns[1:])).first()
        failed = answers.where("status <> 'ok'").count()
        return {
            f"{prefix}requests": r["n"],
            f"{prefix}input_tokens": r["tokens"],
            f"{prefix}retries": r["retries"],
            f"{prefix}request_ms": (r["micros"] or 0) / 1000,
            f"{prefix}send_ms": (r["sends"] or 0) / 1000,
            f"{prefix}clients_created": r["clients"],
            f"{prefix}client_reuses": r["reuses"],
            f"{prefix}errors": failed,
        }

    def cascade(self, band: DataFrame, sample: DataFrame | None, low: float, high: float) -> None:
        def count() -> dict[str, Any]:
            n, s = band.count(), sample.count() if sample is not None else 0
            keys = [c for c in band.columns if c != "p"]
            again = band.join(sample.select(*keys), keys, "left_semi").count() if sample is not None else 0
            return {"band_items": n, "calibration_items": s, "cascade_items": n + s - again, "cascade_cache_hits": again}

        self.todo.append(count)
        self.add({"cascade_last_low": low, "cascade_last_high": high})

    def join(self, a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str], lists: list[tuple[DataFrame, DataFrame]], pairs: DataFrame | None) -> None:
        """``pairs``: the candidates of an index on the key lists, if there is one."""

        def count() -> dict[str, Any]:
            if pairs is None:
                return {"cross_product_pairs": a.count() * b.count()}
            out = {"candidate_left_rows": a.count(), "candidate_right_rows": b.count(), "index_candidate_pairs": pairs.count()}
            out["candidate_left_retained"], out["candidate_right_retained"] = n_retained(a, b, a_keys, b_keys), n_retained(b, a, b_keys, a_keys)
            tokens = [f.select(F.explode(F.array_distinct(known(F.col("k")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias(n)) for f, n in zip(lists[0], "xy", strict=True)]
            visits = tokens[0].join(tokens[1], "t").agg(F.sum(F.col("x") * F.col("y")).alias("n")).first()["n"] or 0
            return out | {"index_posting_visits": visits}

        self.todo.append(count)

    def settled(self) -> Work:
        """All counters as numbers; computed once."""
        if self.done is None:
            done = Work(dict(self.known), used=self.used)
            for f in self.todo:
                done.add(f())
            for identity, frames in self.inputs.items():
                n, distinct = n_inputs(frames)
                done.add({"pairs" if self.pairwise[identity] else "records": distinct, "cache_hits": n - distinct})
            self.done = done
        return self.done


def n_inputs(frames: list[tuple[DataFrame, ...]]) -> tuple[int, int]:
    """Inputs and distinct inputs of one question. A product is counted by its sides; only if it has to be compared with
    other inputs of the question, their distinct keys are paired."""
    if len(frames) == 1 and len(frames[0]) == 2:
        a, b = frames[0]
        return a.count() * b.count(), a.distinct().count() * b.distinct().count()
    n = sum(f[0].count() * (f[1].count() if len(f) == 2 else 1) for f in frames)
    every = [f[0].distinct() if len(f) == 1 else f[0].distinct().crossJoin(f[1].distinct()) for f in frames]
    union = every[0]
    for f in every[1:]:
        union = union.unionByName(f)
    return n, union.distinct().count()


def n_retained(rows: DataFrame, other: DataFrame, keys: list[str], other_keys: list[str]) -> int:
    """Rows that, for each key list on its own, may have a partner on the other side."""
    if other.isEmpty():
        return 0
    kept = rows.select(F.monotonically_increasing_id().alias("id"), *(F.col(f"`{k}`").alias(f"x{i}") for i, k in enumerate(keys)))
    partners = other.select(*(F.col(f"`{k}`").alias(f"y{i}") for i, k in enumerate(other_keys)))
    for i in range(len(keys)):
        if not partners.where(F.col(f"y{i}").isNull()).isEmpty():
            continue  # an unknown list is everyone's partner
        tokens = partners.select(F.explode(known(F.col(f"y{i}"))).alias("t")).distinct()
        hit = kept.select("id", F.explode(known(F.col(f"x{i}"))).alias("t")).join(tokens, "t", "left_semi").select("id")
        kept = kept.join(hit.union(kept.where(F.col(f"x{i}").isNull()).select("id")).distinct(), "id", "left_semi")
    return kept.count()


def stats_frame(spark: SparkSession, work: Work) -> DataFrame:
    found = work.settled().known
    row = [found.get(n) if n.startswith("cascade_last") else float(found.get(n) or 0) if n.endswith("_ms") else int(found.get(n) or 0) for n in NAMES]
    return spark.createDataFrame([row], COLUMNS)


