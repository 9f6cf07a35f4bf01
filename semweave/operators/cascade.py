"""Bounds of the two-stage cascade: below ``low`` false, from ``high`` on true, in between the second stage decides."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

STEP = 1e-6


def calibrate(sample: Iterable[tuple[float, bool]], recall_loss: float, precision_loss: float, low: float, high: float) -> tuple[float, float]:
    """Bounds from probabilities with the second stage's verdicts; an empty sample leaves the bounds given.

    ``low`` rises while the positives below it stay within ``recall_loss`` of all; ``high`` falls while the negatives
    from it on stay within ``precision_loss`` of what lies there.
    """
    groups = [(p, [v for _, v in g]) for p, g in groupby(sorted(sample, key=lambda x: x[0]), key=lambda x: x[0])]
    if not groups:
        return low, high
    positives = sum(sum(v) for _, v in groups)
    lost, low = 0, groups[-1][0] + STEP
    for p, verdicts in groups:
        if lost + sum(verdicts) > recall_loss * positives:
            low = p
            break
        lost += sum(verdicts)
    wrong = above = 0
    high = 1 + STEP
    for p, verdicts in reversed(groups):
        wrong += len(verdicts) - sum(verdicts)
        above += len(verdicts)
        if wrong > precision_loss * above:
            break
        high = p
    return min(low, high), max(low, high)
