"""Where answers come from.

* A native scorer is a Column expression: it stays in whole-stage codegen and can be pushed to the scan.
* A batch scorer is a Python function over batches of distinct questions (local models, HTTP services).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from semweave.decision import CHOICE, SCORE, Decision


class Native(Protocol):
    """Answers as expressions over the texts of a record's fields, or of both sides of a pair."""

    identity: tuple

    def answer(self, decision: Decision, texts: Sequence[Column]) -> Column: ...


@dataclass(frozen=True)
class KeywordScorer:
    """A deterministic stand-in for a model: high where a token occurs in the lower-cased input, else low; the first label
    that occurs, else the last; the number of marks, capped by the levels."""

    token: str = "good"
    high: float = 0.9
    low: float = 0.1
    mark: str = "!"

    @property
    def identity(self) -> tuple:
        return ("keyword", self.token, self.high, self.low, self.mark)

    def answer(self, decision: Decision, texts: Sequence[Column]) -> Column:
        if decision.mode == CHOICE:
            *first, last = decision.labels
            found = F.lit(last)
            for label in reversed(first):
                found = F.when(self.anywhere(texts, F.lit(label)), F.lit(label)).otherwise(found)
            return found
        if decision.mode == SCORE:
            marks = sum((F.length(t) - F.length(F.replace(t, F.lit(self.mark), F.lit(""))) for t in texts[1:]), F.length(texts[0]) - F.length(F.replace(texts[0], F.lit(self.mark), F.lit(""))))
            return F.least(marks, F.lit(len(decision.criteria) - 1)).cast("double")
        return F.when(self.anywhere([F.lower(t) for t in texts], F.lit(self.token)), F.lit(self.high)).otherwise(F.lit(self.low))

    @staticmethod
    def anywhere(texts: Sequence[Column], token: Column) -> Column:
        found = texts[0].contains(token)
        for t in texts[1:]:
            found = found | t.contains(token)
        return found


@dataclass(frozen=True)
class SharedPrefixScorer:
    """Pairs: common prefix over the longer length, in bytes; 1 for two empty texts."""

    @property
    def identity(self) -> tuple:
        return ("shared-prefix",)

    def answer(self, decision: Decision, texts: Sequence[Column]) -> Column:
        if not decision.pairwise:
            raise ValueError("the shared-prefix scorer takes pairs")
        a, b = (F.hex(t.cast("binary")) for t in texts)
        # the first place, from 1, where the digits differ; the shorter text ends in nulls
        first = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), F.lit(False))
        longer = F.greatest(F.length(a), F.length(b)) / 2
        same = F.when(first == 0, longer).otherwise(F.floor((first - 1) / 2))
        return F.when(longer == 0, F.lit(1.0)).otherwise(same.cast("double") / longer)


@dataclass(frozen=True)
class BatchScorer:
    """``ask(decision, batch) -> answers`` over a list of records ({name: value} items in order) or of (left, right) pairs.

    An answer is a number, a label or None (no answer). ``batch`` questions go together."""

    name: str
    ask: Callable[[Decision, list[Any]], list[Any]]

    @property
    def identity(self) -> tuple:
        return ("batch", self.name)


def is_native(scorer: Any) -> bool:
    return hasattr(scorer, "answer")
