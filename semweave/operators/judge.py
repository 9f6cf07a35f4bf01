"""The judge stage: distinct inputs in, one answer each out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from semweave.config import SemConfig
from semweave.decision import CHOICE, SCORE, Decision
from semweave.operators.scorers import is_native

#: Columns of a question on its way to the judge, and of the key by which its answer is found again.
RECORD = ("input",)
PAIR = ("left_input", "right_input")
RECORD_KEY = ("k1", "k2")
PAIR_KEY = ("l1", "l2", "r1", "r2")
ASKED = "p double, label string, score double, verdict boolean, status string, batch string, tokens long, retries long, micros long, sends long, clients long, reuses long"


#: What a local scorer sends: nothing.
NO_TRAFFIC = {"tokens": 0, "retries": 0, "micros": 0, "sends": 0, "clients": 0, "reuses": 0}


class AnswerError(RuntimeError):
    """A batch failed, or an answer is not one of those that the decision allows."""


def keys_of(decision: Decision) -> tuple[str, ...]:
    return PAIR_KEY if decision.pairwise else RECORD_KEY


def sides_of(decision: Decision, inputs: Sequence[Column], n_fields: int) -> list[Column]:
    """Texts that a native scorer sees: both sides, or the values of the record's fields."""
    return list(inputs) if decision.pairwise else [inputs[0][i]["value"] for i in range(n_fields)]


def native_answer(decision: Decision, scorer: Any, texts: Sequence[Column]) -> Column:
    return scorer.answer(decision, texts)


def checked(decision: Decision, value: Any, second: bool = False) -> dict[str, Any]:
    """An answer's columns; raises for one that the decision does not allow. None is no answer."""
    out: dict[str, Any] = {"p": None, "label": None, "score": None, "verdict": None, "status": "ok"}
    if value is None:
        if decision.mode in (CHOICE, SCORE):
            raise AnswerError(f"no answer to {decision.mode}")
        return out | {"status": "failed"}
    if second:
        if not isinstance(value, bool):
            raise AnswerError("a second-stage answer must be true or false")
        return out | {"verdict": value}
    if decision.mode == CHOICE:
        if value not in decision.labels:
            raise AnswerError(f"{value!r} is not one of the labels")
        return out | {"label": value}
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value in (float("inf"), float("-inf")):
        raise AnswerError(f"{value!r} is not a finite number")
    if decision.mode == SCORE:
        if not 0 <= value <= len(decision.criteria) - 1:
            raise AnswerError(f"score {value} is out of range")
        return out | {"score": float(value)}
    if not 0 <= value <= 1:
        raise AnswerError(f"probability {value} is out of range")
    return out | {"p": float(value)}


def questions(decision: Decision, rows: pd.DataFrame) -> list[Any]:
    if decision.pairwise:
        return list(zip(rows[PAIR[0]], rows[PAIR[1]], strict=True))
    return [[(f["name"], f["value"]) for f in r] for r in rows[RECORD[0]]]


def n_tasks(spark: SparkSession) -> int:
    """Local work goes to the whole cluster; ``threads`` only bounds the connections to a service."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def gathered(parts: Iterator[pd.DataFrame], by: str, size: int, most: int = 50_000) -> Iterator[pd.DataFrame]:
    """The rows of ``parts``, those of one text of ``by`` by ``size`` together as far as ``most`` rows that wait allow."""
    rest = None
    for part in parts:
        rest = part if rest is None else pd.concat([rest, part], ignore_index=True)
        groups = rest.groupby(by, sort=False)[by]
        ready = groups.cumcount() < groups.transform("size") // size * size
        if len(rest) - ready.sum() > most:
            ready[:] = True
        if ready.any():
            yield rest[ready].reset_index(drop=True)
            rest = rest[~ready]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def ask_batches(inputs: Any, decision: Decision, scorer: Any, config: SemConfig, second: bool = False, keep: bool = False) -> DataFrame:
    """One row an input: its key, its answer, its batch, and its texts if they are to be kept. A batch scorer runs as a plan
    node of its own, which no filter can be pushed through, so each distinct input is asked once; ``persist`` keeps the
    answers for all their uses. ``inputs`` are a frame or ``GroupedPairs``, which are dealt to tasks as they are."""
    keys, texts = keys_of(decision), PAIR if decision.pairwise else RECORD
    whole = isinstance(inputs, DataFrame)
    dealt = inputs.select(*keys, *texts) if whole else inputs.dealt()
    left = keys + (texts if keep else ())
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.select(*left).schema.fields)}, {ASKED}"
    size = config.cascade_batch_size if second else config.k
    plan = getattr(scorer, "plan", None)
    how, together = None, None
    if plan is not None:
        dealt, how, together = plan(dealt if whole else inputs, decision, config, second)
    elif whole:
        dealt = dealt.repartition(n_tasks(dealt.sparkSession), *keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for i, part in enumerate(parts if together is None else gathered(parts, together, size)):
            n = f"{task}-{i}"
            asked = questions(decision, part)
            if how is not None:
                rows = how(asked, n)
            else:
                rows = []
                for at in range(0, len(asked), size):
                    batch = asked[at : at + size]
                    answers = scorer.ask(decision, batch)
                    if len(answers) != len(batch):
                        raise AnswerError(f"{len(answers)} answers to {len(batch)} questions")
                    rows += [checked(decision, a, second) | {"batch": f"{n}-{at}", **NO_TRAFFIC} for a in answers]
            if any(r["status"] == "failed" for r in rows) and config.on_error == "error":
                raise AnswerError("a question has no answer")
            out = part[list(left)].reset_index(drop=True)
            answers = pd.DataFrame(rows, columns=[c.split()[0] for c in ASKED.split(", ")])
            yield pd.concat([out, answers], axis=1)

    return dealt.mapInPandas(run, schema).persist(StorageLevel.MEMORY_AND_DISK)


def ask_list(asked: list[Any], decision: Decision, scorer: Any, config: SemConfig) -> list[Any]:
    """Answers of a batch scorer to a list of distinct questions, outside a judge stage."""
    if getattr(scorer, "plan", None) is not None:
        how = {"layout": config.layout if config.layout != "auto" else "pack", "anchor": config.anchor}
        return [r[decision.answer] for r in scorer.answerer(decision, config, how, False)(asked, "sql")]
    out: list[Any] = []
    for at in range(0, len(asked), config.k):
        answers = [checked(decision, a)[decision.answer] for a in scorer.ask(decision, asked[at : at + config.k])]
        if config.on_error == "error" and None in answers:
            raise AnswerError("a question has no answer")
        out += answers
    return out


__all__ = ["AnswerError", "RECORD", "PAIR", "ask_batches", "ask_list", "checked", "is_native", "keys_of", "native_answer", "questions", "sides_of"]
