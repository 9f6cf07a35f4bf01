"""Settings of semantic decisions: one immutable object, with per-call overrides and the validation of every value."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import SparkSession

PREFIX = "semweave."
CHOICES = {
    "backend": ("decision", "llm"),
    "on_error": ("error", "reject"),
    "layout": ("auto", "star", "pack", "sep"),
    "anchor": ("auto", "left", "right"),
    "optimizer_mode": ("explicit", "late", "early"),
}
POSITIVE = ("k", "budget_tokens", "auto_min_group", "threads", "timeout", "cascade_batch_size", "cascade_threads", "cascade_timeout")
NOT_NEGATIVE = ("max_retries", "retry_max_delay", "retry_after_max", "cascade_calibrate")
SHARES = ("threshold", "cascade_recall_loss", "cascade_precision_loss")
SESSION_ONLY = ("reduce_inputs", "optimizer_mode")
MAX_BUDGET = 50_000


@dataclass(frozen=True)
class SemConfig:
    backend: str = "decision"
    max_retries: int = 7
    retry_max_delay: float = 60.0
    retry_after_max: float = 300.0
    on_error: str = "error"
    endpoint: str = ""
    model: str = ""
    layout: str = "auto"
    anchor: str = "auto"
    k: int = 100
    threshold: float = 0.5
    budget_tokens: int = MAX_BUDGET
    auto_min_group: int = 8
    threads: int = 8
    prefetch: bool = True
    timeout: float = 120.0
    ca_cert_file: str = ""
    dump_path: str = ""
    raw_dump_path: str = ""
    cascade_model: str = ""
    cascade_endpoint: str = ""
    cascade_low: float = 0.5
    cascade_high: float = 0.9
    cascade_calibrate: int = 0
    cascade_recall_loss: float = 0.05
    cascade_precision_loss: float = 0.05
    cascade_batch_size: int = 16
    cascade_fill_batches: bool = True
    cascade_numbered: bool = True
    cascade_threads: int = 8
    cascade_timeout: float = 120.0
    cascade_ca_cert_file: str = ""
    reduce_inputs: bool = True
    optimizer_mode: str = "explicit"

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, float) and not math.isfinite(value):
                raise ValueError(f"{f.name} must be finite")
        for name in POSITIVE:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in NOT_NEGATIVE:
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in SHARES:
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        if self.budget_tokens > MAX_BUDGET:
            raise ValueError(f"budget_tokens must be at most {MAX_BUDGET}")
        if self.cascade_low > self.cascade_high:
            raise ValueError("cascade_low must not exceed cascade_high")

    @property
    def cascaded(self) -> bool:
        return bool(self.cascade_model)

    def with_options(self, options: Mapping[str, Any] | None) -> SemConfig:
        """Per-call options: names in any case, no nulls, no session-only names."""
        named = {}
        for name, value in (options or {}).items():
            known = option_name(name)
            if known is None:
                raise ValueError(f"unknown option {name!r}")
            if value is None:
                raise ValueError(f"option {known} must not be NULL")
            named[known] = convert(known, value)
        return replace(self, **named) if named else self

    @classmethod
    def of_session(cls, spark: SparkSession, **more: Any) -> SemConfig:
        """What ``SET semweave.<name> = …`` has set, then ``more``."""
        found = {f.name: convert(f.name, v) for f in fields(cls) if (v := spark.conf.get(PREFIX + f.name, None)) is not None}
        return cls(**found | more)


KINDS = {f.name: type(f.default) for f in fields(SemConfig)}


def option_name(name: str) -> str | None:
    known = name.lower()
    return known if known in KINDS and known not in SESSION_ONLY else None


def is_options(value: Any) -> bool:
    """A third argument is options if it is a struct with a recognised option name, else it is a second input."""
    return isinstance(value, Mapping) and any(option_name(str(n)) for n in value)


def convert(name: str, value: Any) -> Any:
    kind = KINDS[name]
    if kind is bool:
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "false"):
            return str(value).lower() == "true"
        raise ValueError(f"{name} must be true or false")
    try:
        if kind is int and isinstance(value, float) and value != int(value):
            raise ValueError
        return kind(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be {kind.__name__}") from None
