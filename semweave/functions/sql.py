"""The decision functions in SQL.

For native scorers they are SQL functions: Catalyst inlines their bodies, so filters, joins, EXISTS, HAVING, windows and
pushdown work on plain ``spark.sql`` strings with no Python at all. For batch scorers they are Arrow functions that ask
each distinct input of a batch once and remember what a worker has asked; the DataFrame surface, which asks every distinct
input once a run, is the better way there, and the only one for EXISTS.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from semweave import decision as D
from semweave.config import SemConfig
from semweave.functions.media import MARK
from semweave.operators.judge import ask_list
from semweave.operators.scorers import KeywordScorer, SharedPrefixScorer


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Options of a call that a native scorer's functions know.
OPTIONS = "options map<string, string> default cast(map() as map<string, string>)"


def register(spark: SparkSession, scorer: KeywordScorer | None = None, threshold: float = 0.5) -> None:
    """Create the temporary functions sem_holds, sem_probability (one input), sem_holds_pair, sem_probability_pair,
    sem_choose, sem_score, sem_keys_overlap, sem_media and sem_shared_prefix. The holds functions take a map of options
    as a last argument, in which ``threshold`` is known."""
    s = scorer or KeywordScorer()
    if not isinstance(s, KeywordScorer):
        raise ValueError(f"{type(s).__name__} has no SQL form: use the DataFrame surface, or register_batch for a batch scorer")
    known = "if(forall(map_keys(options), k -> lower(k) = 'threshold'), cast(coalesce(element_at(transform_keys(options, (k, v) -> lower(k)), 'threshold'), {0}) as double), raise_error('unknown option'))"
    at = known.format(f"'{threshold}'")
    p = lambda *texts: "if(" + " or ".join(f"contains(lower({t}), {literal(s.token)})" for t in texts) + f", {s.high}D, {s.low}D)"
    one = f"case when input is not null then {p('input')} end"
    two = f"case when a is not null and b is not null then {p('a', 'b')} end"
    first = "array_position(zip_with(split(hex(encode(a, 'utf-8')), ''), split(hex(encode(b, 'utf-8')), ''), (x, y) -> x <=> y), false)"
    longer = "greatest(octet_length(a), octet_length(b))"
    prefix = f"if({first} = 0, {longer}, ({first} - 1) div 2)"
    clean = lambda x: f"filter({x}, v -> v is not null)"
    bodies = {
        "sem_probability(condition string, input string) returns double": one,
        f"sem_holds(condition string, input string, {OPTIONS}) returns boolean": f"({one}) >= {at}",
        "sem_probability_pair(condition string, a string, b string) returns double": two,
        f"sem_holds_pair(condition string, a string, b string, {OPTIONS}) returns boolean": f"({two}) >= {at}",
        "sem_choose(condition string, input string, labels array<string>) returns string": "case when input is not null then coalesce(get(filter(labels, l -> contains(input, l)), 0), element_at(labels, -1)) end",
        "sem_score(condition string, input string, levels array<string>) returns double": f"cast(least(length(input) - length(replace(input, {literal(s.mark)}, '')), size(levels) - 1) as double)",
        "sem_keys_overlap(a array<string>, b array<string>) returns boolean": f"a is null or b is null or coalesce(arrays_overlap({clean('a')}, {clean('b')}), false)",
        f"sem_media(kind string, path string) returns struct<{MARK}:string,path:string>": f"case when path is not null and kind = 'image' then named_struct('{MARK}', kind, 'path', path) end",
        "sem_shared_prefix(a string, b string) returns double": f"case when octet_length(a) = 0 and octet_length(b) = 0 then 1D else cast({prefix} as double) / greatest(octet_length(a), octet_length(b)) end",
    }
    for head, body in bodies.items():
        spark.sql(f"drop temporary function if exists {head.partition('(')[0]}")  # a batch scorer's can't be replaced
        spark.sql(f"create or replace temporary function {head} return {body}")


#: Answers that a worker remembers for SQL functions, within one stage of one query.
REMEMBERED = 100_000
_memo: dict[Any, Any] = {}
_memo_stage: list[int | None] = [None]


def scope_memo() -> None:
    """Forget the answers of another stage: none outlives its query."""
    context = TaskContext.get()
    stage = None if context is None else context.stageId()
    if stage != _memo_stage[0]:
        _memo.clear()
        _memo_stage[0] = stage


def answers_of(scorer: Any, config: SemConfig, asked: list[tuple[D.Decision, Any] | None]) -> list[Any]:
    """Answers of a batch of rows; None where an input is NULL. Each distinct question is asked once."""
    scope_memo()
    new: dict[D.Decision, dict[Any, None]] = {}
    for x in asked:
        if x is not None and (scorer.identity, x[0].identity, x[1]) not in _memo:
            new.setdefault(x[0], {})[x[1]] = None
    if len(_memo) > REMEMBERED:
        _memo.clear()
        return answers_of(scorer, config, asked)
    for decision, questions in new.items():
        real = list(questions) if decision.pairwise else [list(x) for x in questions]
        for question, answer in zip(questions, ask_list(real, decision, scorer, config), strict=True):
            _memo[scorer.identity, decision.identity, question] = answer
    return [None if x is None else _memo[scorer.identity, x[0].identity, x[1]] for x in asked]


def register_batch(spark: SparkSession, scorer: Any, config: SemConfig | None = None) -> None:
    """The decision functions of a batch or HTTP scorer: sem_holds, sem_probability, their pair forms, sem_choose, sem_score."""
    config = config or SemConfig()

    def records(column: Any) -> list[Any]:
        """A text as one field ``document``; a struct as its fields. None where any part is NULL."""
        if isinstance(column, pd.DataFrame):
            rows = zip(*(column[n] for n in column.columns), strict=True)
            return [None if any(v is None for v in r) else tuple(zip(column.columns, map(str, r), strict=True)) for r in rows]
        return [None if x is None else (("document", x),) for x in column]

    def ask(make: Any, condition: pd.Series, inputs: list[Any], *more: pd.Series) -> list[Any]:
        rows = [None if x is None else (make(c, *rest), x) for c, x, *rest in zip(condition, inputs, *more, strict=True)]
        return answers_of(scorer, config, rows)

    def pairs(a: pd.Series, b: pd.Series) -> list[Any]:
        return [None if x is None or y is None else (x, y) for x, y in zip(a, b, strict=True)]

    def over(values: list[Any], options: tuple[pd.Series, ...]) -> pd.Series:
        at = [config.with_options(dict(o or {})).threshold for o in options[0]] if options else [config.threshold] * len(values)
        return pd.Series([None if v is None else v >= t for v, t in zip(values, at, strict=True)], dtype=object)

    pairwise = lambda c: D.probability(c, True)

    def probability(*args: pd.Series) -> pd.Series:
        c, x, *_ = args
        return pd.Series(ask(D.probability, c, records(x)), dtype="float64")

    def holds(*args: pd.Series) -> pd.Series:
        c, x, *options = args
        return over(ask(D.probability, c, records(x)), tuple(options))

    def probability_pair(*args: pd.Series) -> pd.Series:
        c, a, b, *_ = args
        return pd.Series(ask(pairwise, c, pairs(a, b)), dtype="float64")

    def holds_pair(*args: pd.Series) -> pd.Series:
        c, a, b, *options = args
        return over(ask(pairwise, c, pairs(a, b)), tuple(options))

    def choose(*args: pd.Series) -> pd.Series:
        c, x, labels, *_ = args
        return pd.Series(ask(lambda c, some: D.choose(c, list(some)), c, records(x), labels), dtype=object)

    def score(*args: pd.Series) -> pd.Series:
        c, x, levels, *_ = args
        return pd.Series(ask(lambda c, some: D.score(c, list(some)), c, records(x), levels), dtype="float64")

    kinds = {"sem_probability": (probability, "double"), "sem_holds": (holds, "boolean"), "sem_probability_pair": (probability_pair, "double"), "sem_holds_pair": (holds_pair, "boolean"), "sem_choose": (choose, "string"), "sem_score": (score, "double")}
    for name, (function, kind) in kinds.items():
        spark.sql(f"drop temporary function if exists {name}")
        spark.udf.register(name, F.pandas_udf(function, kind))


__all__ = ["SharedPrefixScorer", "register", "register_batch"]
