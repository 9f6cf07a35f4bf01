"""Decisions over a stream: each micro-batch goes through the same operators, and answers are kept between batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from semweave.session import SemanticSession


def decide_stream(stream: DataFrame, sem: SemanticSession, decide: Callable[[SemanticSession, DataFrame], DataFrame], sink: Callable[[DataFrame, int], Any]) -> DataStreamWriter:
    """``decide`` is applied to every micro-batch in a run of its own, and ``sink`` gets the result and the batch's number.

    With a native scorer the decision is an expression, and ``stream.where`` with it needs no micro-batch function at all.
    A sink that writes by batch number makes the output exactly once; a batch scorer may be asked again after a failure."""

    def each(batch: DataFrame, number: int) -> None:
        with sem.run() as run:
            sink(decide(run, batch), number)

    return stream.writeStream.foreachBatch(each)
