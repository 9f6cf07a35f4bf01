"""Which questions go in one request."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

BYTES_PER_TOKEN = 3.5
MAX_BYTES = 24 * 1024 * 1024


@dataclass(frozen=True)
class Batch:
    """Places of the questions, and the side that they share, if any."""

    items: tuple[int, ...]
    shared: str | None = None


def n_bytes(text: str) -> int:
    return len(text.encode())


def choose_layout(layout: str, n: int, left: int, right: int, auto_min_group: int) -> str:
    """``auto``: a star pays if its groups are large enough."""
    if layout != "auto":
        return layout
    return "star" if n >= auto_min_group * min(left, right) else "pack"


def choose_anchor(anchor: str, left: int, right: int, left_bytes: int, right_bytes: int) -> str:
    """``auto``: the side with fewer distinct texts, on a tie the longer one."""
    if anchor != "auto":
        return anchor
    return "left" if (left, -left_bytes) <= (right, -right_bytes) else "right"


NO_MORE: Callable[[str], int] = lambda text: 0


def cut(order: Sequence[int], size: Callable[[int], int], k: int, budget: float, start: int = 0, more: Callable[[int], int] = lambda i: 0, start_more: int = 0) -> list[tuple[int, ...]]:
    """Greedy cuts: a batch ends before the item that would exceed k items, the token budget or the byte limit; an item that
    exceeds them alone is still sent. ``more`` are bytes beside the text, those of images."""
    out: list[tuple[int, ...]] = []
    batch: list[int] = []
    used, heavy = start, start_more
    for i in order:
        n, m = size(i), more(i)
        if batch and (len(batch) == k or (used + n) / BYTES_PER_TOKEN > budget or used + n + heavy + m > MAX_BYTES):
            out.append(tuple(batch))
            batch, used, heavy = [], start, start_more
        batch.append(i)
        used += n
        heavy += m
    return [*out, tuple(batch)] if batch else out


def pair_batches(
    pairs: Sequence[tuple[str, str]], *, layout: str, anchor: str, k: int, budget: float, auto_min_group: int, more: Callable[[str], int] = NO_MORE
) -> list[Batch]:
    if not pairs:
        return []
    lefts, rights = {a for a, _ in pairs}, {b for _, b in pairs}
    layout = choose_layout(layout, len(pairs), len(lefts), len(rights), auto_min_group)
    both = lambda i: n_bytes(pairs[i][0]) + n_bytes(pairs[i][1])
    if layout == "sep":
        return [Batch((i,), "both") for i in range(len(pairs))]
    if layout == "pack":
        return [Batch(b) for b in cut(range(len(pairs)), both, k, budget, more=lambda i: more(pairs[i][0]) + more(pairs[i][1]))]
    side = choose_anchor(anchor, len(lefts), len(rights), sum(map(n_bytes, lefts)), sum(map(n_bytes, rights)))
    at = 0 if side == "left" else 1
    groups: dict[str, list[int]] = {}
    for i, p in enumerate(pairs):
        groups.setdefault(p[at], []).append(i)
    out = []
    for text in sorted(groups, key=str.encode):
        parts = cut(groups[text], lambda i: n_bytes(pairs[i][1 - at]), k, budget, n_bytes(text), lambda i: more(pairs[i][1 - at]), more(text))
        out += [Batch(b, side) for b in parts]
    return out


def record_batches(records: Sequence[Sequence[tuple[str, str]]], *, layout: str, k: int, budget: float, criteria: int, more: Callable[[str], int] = NO_MORE) -> list[Batch]:
    """The criteria are counted for every record."""
    size = lambda i: criteria + sum(n_bytes(n) + n_bytes(v) for n, v in records[i])
    return [Batch(b) for b in cut(range(len(records)), size, 1 if layout == "sep" else k, budget, more=lambda i: sum(more(v) for _, v in records[i]))]


def even_batches(n: int, size: int, threads: int, fill: bool) -> int:
    """Without filling, the second stage spreads few questions over all threads."""
    return -(-n // threads) if not fill and threads * size > n >= threads else size


def question_bytes(question: Any) -> int:
    return sum(n_bytes(a) + n_bytes(b) for a, b in [question] if isinstance(a, str)) if isinstance(question, tuple) else sum(n_bytes(n) + n_bytes(v) for n, v in question)
