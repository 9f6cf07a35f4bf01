"""A semantic decision: what is asked, of how many inputs, and what the answers may be."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

HOLDS, PROBABILITY, CHOICE, SCORE = "holds", "probability", "choose", "score"
#: Modes that ask the same question share answers.
QUESTION = {HOLDS: "noul", PROBABILITY: "noul", CHOICE: "choice", SCORE: "score"}
RESULT = {HOLDS: "boolean", PROBABILITY: "double", CHOICE: "string", SCORE: "double"}
#: Answer column of each question.
ANSWER = {"noul": "p", "choice": "label", "score": "score"}


@dataclass(frozen=True)
class Decision:
    mode: str
    condition: str
    #: Labels of a choice with descriptions, or levels of a score as JSON texts.
    criteria: tuple = ()
    pairwise: bool = False

    def __post_init__(self) -> None:
        if self.mode not in QUESTION:
            raise ValueError(f"unknown decision {self.mode!r}")
        if not isinstance(self.condition, str):
            raise ValueError("the condition must be a constant, non-NULL text")
        if self.pairwise and self.mode in (CHOICE, SCORE):
            raise ValueError(f"{self.mode} takes one input")

    @property
    def kind(self) -> str:
        return QUESTION[self.mode]

    @property
    def answer(self) -> str:
        return ANSWER[self.kind]

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(c[0] for c in self.criteria) if self.mode == CHOICE else ()

    @property
    def identity(self) -> tuple:
        """Decisions with one identity share answers; threshold, layout and mode are no part of it."""
        return (self.kind, self.condition, self.criteria, self.pairwise)


def holds(condition: str, pairwise: bool = False) -> Decision:
    return Decision(HOLDS, condition, pairwise=pairwise)


def probability(condition: str, pairwise: bool = False) -> Decision:
    return Decision(PROBABILITY, condition, pairwise=pairwise)


def choose(condition: str, choices: Mapping[str, str] | Sequence[Any]) -> Decision:
    """Choices: label -> description, a list of labels, or a list of (label, description)."""
    if isinstance(choices, Mapping):
        pairs = [(k, v) for k, v in choices.items()]
    else:
        pairs = [(c, None) if isinstance(c, str) else tuple(c) for c in choices]
    if not 2 <= len(pairs) <= 255:
        raise ValueError("a choice needs 2 to 255 labels")
    if any(len(p) != 2 or not isinstance(p[0], str) for p in pairs):
        raise ValueError("choices must be labels or (label, description)")
    if len({p[0] for p in pairs}) != len(pairs):
        raise ValueError("labels must be unique")
    return Decision(CHOICE, condition, tuple(pairs))


def score(condition: str, levels: Sequence[Any]) -> Decision:
    if isinstance(levels, str) or not 2 <= len(levels) <= 10:
        raise ValueError("a score needs 2 to 10 ordered levels")
    return Decision(SCORE, condition, tuple(level_json(x) for x in levels))


def level_json(level: Any) -> str:
    if level is None or (isinstance(level, (list, tuple)) and any(x is None for x in level)) or (isinstance(level, Mapping) and any(v is None for v in level.values())):
        raise ValueError("levels must not be NULL")
    return json.dumps(level, ensure_ascii=False)
