"""Semantic operators on DataFrames.

``SemanticSession`` holds the settings, the scorers and the answers of one run. Every distinct input of a decision is
asked once a run; decisions that ask the same question (``holds`` at any threshold, ``probability``) share its answers.
Native scorers are expressions and become part of the plan; batch scorers run in the judge stage. Inputs meet their answers
by a 128-bit key: the texts themselves are exchanged only on their way to the judge.

Columns that an operator adds for itself have names that the user's frames don't have.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semweave import decision as D
from semweave.config import SemConfig
from semweave.decision import Decision
from semweave.functions.keys import keys_overlap, known
from semweave.functions.media import has_media
from semweave.functions.render import fields_of, record, side_text
from semweave.operators.cascade import calibrate
from semweave.operators.judge import PAIR, RECORD, ask_batches, is_native, keys_of, n_tasks, native_answer, sides_of
from semweave.operators.pairs import GroupedPairs, element_of, grouped, shared, shared_first, small_side, tokens
from semweave.operators.scorers import KeywordScorer
from semweave.stats import Work, stats_frame


@dataclass
class Run:
    """Answers and work of one query run."""

    answers: dict[tuple, DataFrame] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)
    work: Work = field(default_factory=Work)
    told: list[str] = field(default_factory=list)

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept = []


@dataclass(frozen=True)
class Ask:
    """A decision about inputs of a row, to become a column."""

    decision: Decision
    inputs: tuple
    config: SemConfig

    @property
    def cascaded(self) -> bool:
        return self.config.cascaded and self.decision.mode == D.HOLDS


def fresh(names: Sequence[str], *frames: DataFrame) -> list[str]:
    """Column names like ``names`` that none of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    n = next(i for i in range(len(taken) + 2) if not any(f"{x}_{i}".lower() in taken for x in names))
    return [f"{x}_{n}" for x in names]


def hashed(text: Column) -> list[Column]:
    """The two halves of an input's key; null for a null input."""
    return [F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(F.lit(1), text))]


def columns_of(df: DataFrame, side: str = "") -> list[Column]:
    return [F.col(f"{side}`{c.replace('`', '``')}`") for c in df.columns]


class SemanticSession:
    def __init__(self, spark: SparkSession, scorer: Any = None, second: Any = None, config: SemConfig | None = None):
        self.spark = spark
        self.scorer = scorer if scorer is not None else KeywordScorer()
        self.second = second
        self.config = config or SemConfig.of_session(spark)
        self.current = Run()
        self.last = Run()

    # --- runs -------------------------------------------------------------------------------------------------------
    @contextlib.contextmanager
    def run(self) -> Iterator[SemanticSession]:
        """One query run: answers are shared inside and dropped at its end."""
        self.close()
        try:
            yield self
        finally:
            self.close()

    def close(self) -> None:
        """End the run. Its answers stay for ``stats`` until the next run ends; no job is started."""
        if self.current.work.used:
            self.last.release()
            self.last = self.current
        else:
            self.current.release()
        self.current = Run()

    def stats(self) -> DataFrame:
        """One row: what the last run with a decision asked."""
        return stats_frame(self.spark, (self.current if self.current.work.used else self.last).work)

    def explain(self) -> str:
        """The semantic operators of this run, in the order in which they were planned."""
        return "\n".join(self.current.told)

    # --- decisions as columns ---------------------------------------------------------------------------------------
    def holds(self, condition: str, *inputs: Any, options: Mapping | None = None) -> Ask:
        return self._ask(D.holds(condition, len(self._inputs(inputs)[0]) == 2), inputs, options)

    def probability(self, condition: str, *inputs: Any, options: Mapping | None = None) -> Ask:
        return self._ask(D.probability(condition, len(self._inputs(inputs)[0]) == 2), inputs, options)

    def choose(self, condition: str, value: Any, choices: Any, options: Mapping | None = None) -> Ask:
        return self._ask(D.choose(condition, choices), (value,), options)

    def score(self, condition: str, value: Any, levels: Sequence, options: Mapping | None = None) -> Ask:
        return self._ask(D.score(condition, levels), (value,), options)

    @staticmethod
    def _inputs(inputs: tuple) -> tuple[tuple, Mapping | None]:
        """A last mapping with an option name is the options, as in the call's SQL form."""
        from semweave.config import is_options

        if len(inputs) > 1 and is_options(inputs[-1]):
            return inputs[:-1], inputs[-1]
        if not 1 <= len(inputs) <= 2:
            raise ValueError("a decision takes one or two inputs")
        return inputs, None

    def _ask(self, decision: Decision, inputs: tuple, options: Mapping | None) -> Ask:
        inputs, found = self._inputs(inputs)
        config = self.config.with_options(found).with_options(options)
        if config.cascaded and self.second is None and decision.mode == D.HOLDS:
            raise ValueError("a cascade needs a second scorer")
        return Ask(decision, inputs, config)

    def with_decisions(self, df: DataFrame, **asks: Ask) -> DataFrame:
        """``df`` with a column for each decision: NULL where an input is NULL. Decisions that ask the same about the same
        inputs share one pass to the judge and one join."""
        groups: list[list[tuple[str, Ask]]] = []
        for name, ask in asks.items():
            if ask.config.cascade_calibrate and ask.cascaded:
                raise ValueError("calibration needs a filter or a join")
            for group in groups:
                if self._shared(group[0][1], ask):
                    group.append((name, ask))
                    break
            else:
                groups.append([(name, ask)])
        order = [c for c in df.columns if c not in asks] + list(asks)
        out = df.select(*(c for c, n in zip(columns_of(df), df.columns, strict=True) if n not in asks or any(n == i for a in asks.values() for i in a.inputs)))
        for group in groups:
            out = self._columns(out, group)
        return out.select(*(F.col(f"`{c}`") for c in order))

    @staticmethod
    def _shared(a: Ask, b: Ask) -> bool:
        plain = not a.cascaded and not b.cascaded and all(isinstance(x, str) for x in (*a.inputs, *b.inputs))
        return plain and (a.decision.identity, a.inputs, a.config.on_error) == (b.decision.identity, b.inputs, b.config.on_error)

    def _columns(self, df: DataFrame, group: list[tuple[str, Ask]]) -> DataFrame:
        names, ask = [n for n, _ in group], group[0][1]
        kept = [c for c, n in zip(columns_of(df), df.columns, strict=True) if n not in names]
        texts, n_fields = self._texts(df, ask)
        for _, x in group:
            self._note(df, texts, x, "project")
        if is_native(self.scorer) and not ask.cascaded:
            answer = native_answer(ask.decision, self.scorer, sides_of(ask.decision, texts, n_fields))
            return df.select(*kept, *(F.when(present(texts), self._value(answer, x)).alias(n) for n, x in group))
        keys = fresh([f"key{i}" for i in range(2 * len(texts))], df)
        value, *own = fresh(["value", *(f"answer_{k}" for k in keys_of(ask.decision))], df)
        keyed = df.withColumns(dict(zip(keys, (h for t in texts for h in hashed(t)), strict=True)))
        answers = self._answers(self._inputs_of(df, texts, ask), ask, n_fields)
        if ask.cascaded:
            found = self._verdicts(answers, ask, n_fields).withColumnRenamed("holds", value)
        else:
            found = answers.select(*keys_of(ask.decision), F.col(ask.decision.answer).alias(value))
        found = found.withColumnsRenamed(dict(zip(keys_of(ask.decision), own, strict=True)))
        test = all_of(F.col(k) == F.col(o) for k, o in zip(keys, own, strict=True))
        there = F.col(own[0]).isNotNull()
        values = [F.col(value) if x.cascaded else F.when(there, self._value(F.col(value), x)) for _, x in group]
        return keyed.join(found, test, "left").select(*kept, *(v.alias(n) for n, v in zip(names, values, strict=True)))

    @staticmethod
    def _value(answer: Column, ask: Ask) -> Column:
        """The answer to a present input."""
        return F.coalesce(answer >= F.lit(ask.config.threshold), F.lit(False)) if ask.decision.mode == D.HOLDS else answer

    def _texts(self, df: DataFrame, ask: Ask) -> tuple[list[Column], int]:
        """The decision's inputs as texts: both sides, or one record."""
        for v in ask.inputs:
            self._check_media(df, v, ask)
        if ask.decision.pairwise:
            return [side_text(df, v) for v in ask.inputs], 0
        return [record(df, ask.inputs[0])], len(fields_of(df, ask.inputs[0]))

    def _check_media(self, df: DataFrame, value: Any, ask: Ask) -> None:
        """Images go to the decision service alone: no cascade, no other scorer."""
        if has_media(df.select(value).schema[0].dataType):
            if ask.cascaded:
                raise ValueError("media can't be decided by a cascade")
            if getattr(self.scorer, "kind", "") != "decision":
                raise ValueError("media needs the decision service")

    @staticmethod
    def _inputs_of(df: DataFrame, texts: list[Column], ask: Ask) -> DataFrame:
        """The distinct inputs: their keys and texts."""
        shown = PAIR if ask.decision.pairwise else RECORD
        keys = keys_of(ask.decision)
        rows = df.where(present(texts)).select(*(h.alias(k) for h, k in zip((h for t in texts for h in hashed(t)), keys, strict=True)), *(t.alias(n) for t, n in zip(texts, shown, strict=True)))
        return rows.dropDuplicates(list(keys))

    # --- answers ----------------------------------------------------------------------------------------------------
    def _answers(self, inputs: DataFrame, ask: Ask, n_fields: int, group: Callable[[DataFrame], GroupedPairs] | None = None) -> DataFrame:
        """Keys and answer of distinct ``inputs``; a batch scorer is asked only for those that this run has not asked. With
        ``group`` the inputs are keys alone, which may repeat, and it groups those that are to be asked."""
        decision = ask.decision
        keys = list(keys_of(decision))
        shown = [F.col(c) for c in (PAIR if decision.pairwise else RECORD)]
        if is_native(self.scorer):
            rows = inputs if group is None else group(inputs).dealt()
            return rows.withColumn(decision.answer, native_answer(decision, self.scorer, sides_of(decision, shown, n_fields)))
        identity = (*decision.identity, self.scorer.identity, ask.config.on_error)
        before = self.current.answers.get(identity)
        new = inputs if before is None else inputs.join(before.select(*keys), keys, "left_anti")
        texts = [c for c in (PAIR if decision.pairwise else RECORD)] if ask.cascaded else []
        asked = ask_batches(new if group is None else group(new), decision, self.scorer, ask.config, keep=bool(texts))
        self.current.kept.append(asked)
        self.current.work.asked(asked)
        if before is None:
            self.current.answers[identity] = asked
            return asked
        both = before.unionByName(asked, allowMissingColumns=True)
        self.current.answers[identity] = both
        if not ask.cascaded:
            return both.join(inputs.select(*keys), keys, "left_semi")
        return both.drop(*texts).join(inputs.select(*keys, *texts), keys)

    def _verdicts(self, answers: DataFrame, ask: Ask, n_fields: int) -> DataFrame:
        """Keys and ``holds`` of answered inputs."""
        keys = list(keys_of(ask.decision))
        if not ask.config.cascaded:
            return answers.select(*keys, F.coalesce(F.col("p") >= F.lit(ask.config.threshold), F.lit(False)).alias("holds"))
        return self._cascade(answers, ask, n_fields)

    def _cascade(self, answers: DataFrame, ask: Ask, n_fields: int) -> DataFrame:
        """The second stage decides the band [low, high) and inputs without a probability; its answers go first."""
        config, keys = ask.config, list(keys_of(ask.decision))
        texts = list(PAIR if ask.decision.pairwise else RECORD)
        low, high = config.cascade_low, config.cascade_high
        sample = None
        if config.cascade_calibrate:
            # a hash-ordered sample of bounded size; its verdicts are all that the driver gets
            first = answers.where("p is not null").orderBy(*keys).limit(config.cascade_calibrate).select(*keys, *texts, "p")
            sample = self._second(first, ask, n_fields)
            low, high = calibrate([(r["p"], r["verdict"]) for r in sample.select("p", "verdict").collect()], config.cascade_recall_loss, config.cascade_precision_loss, low, high)
        band = answers.where(F.col("p").isNull() | ((F.col("p") >= F.lit(low)) & (F.col("p") < F.lit(high)))).select(*keys, *texts, "p")
        rest = band if sample is None else band.join(sample.select(*keys), keys, "left_anti")
        second = self._second(rest, ask, n_fields)
        verdicts = second if sample is None else second.unionByName(sample)
        self.current.work.cascade(band.drop(*texts), sample, low, high)
        joined = answers.select(*keys, "p").join(verdicts.select(*keys, "verdict"), keys, "left")
        return joined.select(*keys, F.coalesce("verdict", F.col("p") >= F.lit(high), F.lit(False)).alias("holds"))

    def _second(self, inputs: DataFrame, ask: Ask, n_fields: int) -> DataFrame:
        keys = list(keys_of(ask.decision))
        shown = [F.col(c) for c in (PAIR if ask.decision.pairwise else RECORD)]
        if is_native(self.second):
            answer = native_answer(ask.decision, self.second, sides_of(ask.decision, shown, n_fields))
            return inputs.select(*keys, "p", (answer >= F.lit(0.5)).alias("verdict"))
        asked = ask_batches(inputs, ask.decision, self.second, ask.config, second=True)
        self.current.kept.append(asked)
        self.current.work.asked_second(asked)
        return inputs.select(*keys, "p").join(asked.select(*keys, F.coalesce("verdict", F.lit(False)).alias("verdict")), keys)

    # --- operators --------------------------------------------------------------------------------------------------
    def filter(self, df: DataFrame, condition: str, *inputs: Any, where: Column | str | None = None, options: Mapping | None = None) -> DataFrame:
        """Rows for which the condition holds. ``where``, the ordinary part of the condition, is applied first."""
        ask = self.holds(condition, *inputs, options=options)
        rows = df if where is None else df.where(where)
        texts, n_fields = self._texts(rows, ask)
        self._note(rows, texts, ask, "filter")
        if is_native(self.scorer) and not ask.cascaded:
            return rows.where(present(texts) & self._value(native_answer(ask.decision, self.scorer, sides_of(ask.decision, texts, n_fields)), ask))
        keys = fresh([f"key{i}" for i in range(2 * len(texts))], df)
        own = fresh([f"answer_{k}" for k in keys_of(ask.decision)], df)
        keyed = rows.withColumns(dict(zip(keys, (h for t in texts for h in hashed(t)), strict=True)))
        answers = self._answers(self._inputs_of(rows, texts, ask), ask, n_fields)
        accepted = self._verdicts(answers, ask, n_fields).where("holds").withColumnsRenamed(dict(zip(keys_of(ask.decision), own, strict=True)))
        return keyed.join(accepted, all_of(F.col(k) == F.col(o) for k, o in zip(keys, own, strict=True)), "left_semi").select(*columns_of(df))

    def filter_or(self, df: DataFrame, cheap: Column, condition: str, *inputs: Any, options: Mapping | None = None) -> DataFrame:
        """Rows with ``cheap OR holds``: only those that the cheap side doesn't take are asked about."""
        (taken,) = fresh(["taken"], df)
        marked = df.withColumn(taken, F.coalesce(cheap, F.lit(False)))
        rest = self.filter(marked.where(~F.col(taken)), condition, *inputs, options=options)
        return marked.where(F.col(taken)).select(*columns_of(df)).unionByName(rest.select(*columns_of(df)))

    def join(
        self,
        left: DataFrame,
        right: DataFrame,
        condition: str,
        left_input: Any,
        right_input: Any,
        *,
        how: str = "inner",
        on: Column | None = None,
        keys: Sequence[tuple[str, str]] = (),
        options: Mapping | None = None,
    ) -> DataFrame:
        """Inner, semi or anti join on a pairwise decision.

        ``on`` is the ordinary part of the condition. ``keys`` names pairs of nullable key lists, one of each side: pairs
        whose lists are known and disjoint are never candidates. An anti join keeps rows with a NULL input. In ``on``, and
        on the result, columns that both sides have are called ``l.name`` and ``r.name``; so a frame can be joined with itself.
        """
        how = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
        if how not in ("inner", "left_semi", "left_anti"):
            raise ValueError("semantic joins are inner, semi or anti")
        ask = self.holds(condition, left_input, right_input, options=options)
        config, calibrated = ask.config, bool(ask.config.cascaded and ask.config.cascade_calibrate)
        self._check_media(left, left_input, ask)
        self._check_media(right, right_input, ask)
        x, l1, l2, y, r1, r2 = fresh(["left", "l1", "l2", "right", "r1", "r2"], left, right)
        a = with_key(left, x, (l1, l2), side_text(left, left_input)).alias("l")
        b = with_key(right, y, (r1, r2), side_text(right, right_input)).alias("r")
        pairs_of_keys = [(F.col(f"l.`{k}`"), F.col(f"r.`{m}`")) for k, m in keys]
        ordinary = all_of([*([on] if on is not None else []), *(keys_overlap(k, m) for k, m in pairs_of_keys)])
        some_a, some_b = a.where(F.col(x).isNotNull()), b.where(F.col(y).isNotNull())
        base = some_a if how != "left_anti" else a
        out = columns_of(left, "l.") + (columns_of(right, "r.") if how == "inner" else [])
        indexed = bool(keys) and not calibrated
        self._note_join(some_a, some_b, ask, how, on, keys, indexed, ordinary, (l1, l2, r1, r2))
        if is_native(self.scorer) and not config.cascaded and not keys:
            test = F.col(x).isNotNull() & self._value(native_answer(ask.decision, self.scorer, [F.col(x), F.col(y)]), ask)
            return base.join(some_b, test if ordinary is None else ordinary & test, how).select(*out)
        small = None if config.cascaded else small_side(some_a, some_b)
        # the texts of the candidates, on their way to the judge
        side = lambda f, h, k, text, name: f.select(F.col(h[0]).alias(k[0]), F.col(h[1]).alias(k[1]), F.col(text).alias(name)).dropDuplicates(list(k))
        names = keys_of(ask.decision)
        texts = {"left": side(some_a, (l1, l2), names[:2], x, PAIR[0]), "right": side(some_b, (r1, r2), names[2:], y, PAIR[1])}
        group = None
        if small is not None and is_native(self.scorer) and how == "inner":
            near_a, near_b, test, once = near(some_a, some_b, small, pairs_of_keys, on)
            answer = self._value(native_answer(ask.decision, self.scorer, [F.col(x), F.col(y)]), ask)
            return near_a.join(near_b, test & once & answer).select(*out)
        if small is not None:
            n = n_tasks(self.spark)
            dealt = {"left": some_a.repartition(n, l1, l2), "right": some_b} if small == "right" else {"left": some_a, "right": some_b.repartition(n, r1, r2)}
            near_a, near_b, test, _ = near(dealt["left"], dealt["right"], small, pairs_of_keys, on)
            found = (near_a.crossJoin(near_b) if test is None else near_a.join(near_b, test)).select(l1, l2, r1, r2).toDF(*names)
            group = lambda pairs: grouped(pairs, texts, small, n)
        elif indexed and on is None:
            found = candidates(some_a, some_b, (l1, l2, r1, r2), keys).toDF(*names)
        elif ordinary is None:
            found = some_a.select(l1, l2).distinct().crossJoin(some_b.select(r1, r2).distinct()).toDF(*names)
        else:
            found = some_a.join(some_b, ordinary).select(l1, l2, r1, r2).distinct().toDF(*names)
        inputs = found if group else found.join(texts["left"], list(names[:2])).join(texts["right"], list(names[2:]))
        accepted = self._verdicts(self._answers(inputs, ask, 0, group), ask, 0).where("holds")
        k1, k2, m1, m2 = fresh([f"answer_{n}" for n in names], left, right)
        accepted = accepted.select(*(F.col(n).alias(f) for n, f in zip(names, (k1, k2, m1, m2), strict=True)))
        met = (F.broadcast(some_b) if small == "right" else some_b).join(accepted, (F.col(r1) == F.col(m1)) & (F.col(r2) == F.col(m2)))
        test = (F.col(l1) == F.col(k1)) & (F.col(l2) == F.col(k2))
        base = F.broadcast(base) if small == "left" and how == "inner" else base
        return base.join(met, test if ordinary is None else test & ordinary, how).select(*out)

    def top_decisions(self, df: DataFrame, order: Sequence[Column], n: int, **asks: Ask) -> DataFrame:
        """``ORDER BY … LIMIT n`` first, then the decisions of the rows that are left."""
        top = df.orderBy(*order).limit(n)
        if not is_native(self.scorer):
            top = top.persist()  # a limit that is evaluated again could take other rows
            self.current.kept.append(top)
        return self.with_decisions(top, **asks).orderBy(*order)

    # --- notes ------------------------------------------------------------------------------------------------------
    def _note(self, df: DataFrame, texts: list[Column], ask: Ask, what: str) -> None:
        identity = (*ask.decision.identity, self.scorer.identity)
        keys = [h.alias(k) for h, k in zip((h for t in texts for h in hashed(t)), keys_of(ask.decision), strict=True)]
        self.current.work.rows(df.where(present(texts)).select(*keys), identity, ask.decision.pairwise)
        self.current.told.append(f"Semantic {what}: {ask.decision.mode}({ask.decision.condition!r}) by {self.scorer.identity[0]}" + (" with cascade" if ask.config.cascaded else ""))

    def _note_join(self, a: DataFrame, b: DataFrame, ask: Ask, how: str, on: Column | None, keys: Sequence[tuple[str, str]], indexed: bool, ordinary: Column | None, names: tuple[str, ...]) -> None:
        identity = (*ask.decision.identity, self.scorer.identity)
        shown = keys_of(ask.decision)
        if ordinary is None:  # a product: counted without being made
            self.current.work.product(a.select(*names[:2]).toDF(*shown[:2]), b.select(*names[2:]).toDF(*shown[2:]), identity)
            pairs = None
        else:
            pairs = a.join(b, ordinary).select(*names).toDF(*shown)
            self.current.work.rows(pairs, identity, True)
        lists = [(a.select(F.col(f"l.`{k}`").alias("k")), b.select(F.col(f"r.`{m}`").alias("k"))) for k, m in keys]
        self.current.work.join(a, b, [k for k, _ in keys], [m for _, m in keys], lists, pairs if indexed else None)
        self.current.told.append(f"Semantic {how} join: {ask.decision.condition!r} by {self.scorer.identity[0]}" + (f", index on {len(keys)} key lists" if indexed else ""))


def present(texts: Sequence[Column]) -> Column:
    return all_of(t.isNotNull() for t in texts)


def all_of(tests: Any) -> Column | None:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def with_key(df: DataFrame, name: str, keys: tuple[str, str], text: Column) -> DataFrame:
    """``df`` with a side's text and its key."""
    return df.withColumns({name: text, **dict(zip(keys, hashed(text), strict=True))})


def candidates(a: DataFrame, b: DataFrame, names: tuple[str, ...], keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct pairs of text keys whose key lists may overlap: an equi-join on the elements of the first list, and the rows
    whose list is unknown against all partners. Further lists are tested on what the first one leaves."""
    a = a.select(*names[:2], *(F.col(f"l.`{k}`").alias(f"a{i}") for i, (k, _) in enumerate(keys))).distinct()
    b = b.select(*names[2:], *(F.col(f"r.`{m}`").alias(f"b{i}") for i, (_, m) in enumerate(keys))).distinct()
    more = all_of(keys_overlap(f"a{i}", f"b{i}") for i in range(1, len(keys)))
    by_a = a.where("a0 is not null").withColumn("token_a", F.explode(F.array_distinct(known(F.col("a0")))))
    by_b = b.where("b0 is not null").withColumn("token_b", F.explode(F.array_distinct(known(F.col("b0")))))
    same = F.col("token_a") == F.col("token_b")
    parts = [by_a.join(by_b, same if more is None else same & more)]
    rest = more if more is not None else F.lit(True)
    parts += [a.where("a0 is null").join(b, rest), a.where("a0 is not null").join(b.where("b0 is null"), rest)]
    out = parts[0].select(*names)
    for p in parts[1:]:
        out = out.union(p.select(*names))
    return out.distinct()


def near(a: DataFrame, b: DataFrame, small: str, keys: Sequence[tuple[Column, Column]], on: Column | None) -> tuple[DataFrame, DataFrame, Column | None, Column]:
    """The sides of a join, the small one broadcast, and its condition: equal tokens of the first key lists, the other lists
    and ``on``. Rows that share several tokens meet as often; once, if the second condition holds too."""
    test, once = on, F.lit(True)
    if keys:
        ta, tb = fresh(["token_a", "token_b"], a, b)
        (x, y), *more = keys
        a, b = (f.withColumn(t, F.explode(tokens(k, element_of(f, k), t == ta))) for f, t, k in ((a, ta, x), (b, tb, y)))
        test = all_of([shared(ta, tb), *(keys_overlap(k, m) for k, m in more), *([on] if on is not None else [])])
        once = shared_first(ta, x, y)
    return (F.broadcast(a), b, test, once) if small == "left" else (a, F.broadcast(b), test, once)


#: Environment variables with the keys of services that settings name.
KEY, SECOND_KEY = "SEMWEAVE_API_KEY", "SEMWEAVE_CASCADE_API_KEY"


def connect(spark: SparkSession, **settings: Any) -> SemanticSession:
    """A session with the settings given; nothing is asked. Without a scorer the settings ``backend`` and ``endpoint`` name the
    service of the first stage, and ``cascade_endpoint`` that of the second."""
    from semweave.sources.http_scorers import ChatScorer, DecisionScorer, env_key

    scorer, second = settings.pop("scorer", None), settings.pop("second", None)
    config = SemConfig.of_session(spark, **settings)
    if scorer is None and config.endpoint:
        kind = ChatScorer if config.backend == "llm" else DecisionScorer
        scorer = kind(config.endpoint, config.model, key=env_key(KEY))
    if second is None and config.cascade_endpoint:
        second = ChatScorer(config.cascade_endpoint, config.cascade_model, key=env_key(SECOND_KEY))
    return SemanticSession(spark, scorer, second, config)
