"""Connected components of a graph of links, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.shared import drop_staged, stage_table


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, label) of every node of ``links`` (a, b: long); the label is the smallest id of the component.

    A round lets each node, and the label that it had, take the smallest label among its neighbours, and then the label's
    label; the number of rounds is about the logarithm of the longest path. Nothing but one sum a round reaches the
    driver. Both sides of every join are written first, so that a hub, or a label with many nodes, can be split.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b")
    edges = stage_table(both.distinct(), f"{name}-links")
    labels = stage_table(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{name}-0")
    total = lambda t: t.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first()["s"]
    before, n = None, 0
    while (now := total(labels)) != before:
        before, n = now, n + 1
        near = stage_table(edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("label").alias("near")), f"{name}-near")
        own = labels.join(near, labels.id == near.a).select("id", "label", F.least("label", "near").alias("new"))
        both = own.select("id", F.col("new")).union(own.select(F.col("label").alias("id"), "new"))
        hooked = stage_table(both.groupBy("id").agg(F.min("new").alias("label")), f"{name}-hooked")
        up = hooked.select(F.col("id").alias("up"), F.col("label").alias("jump"))
        done = (labels, near, hooked)
        labels = stage_table(hooked.join(up, hooked.label == up.up).select("id", F.least("label", "jump").alias("label")), f"{name}-{n}")
        for table in done:
            drop_staged(table)
    drop_staged(edges)
    return labels
