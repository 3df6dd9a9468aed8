"""Connected components of an edge table by label propagation with pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, rows_of, written


def components(edges: DataFrame, rows: int | None = None, most_rounds: int = 200) -> DataFrame:
    """v, component (the smallest v reachable) for every end of the edges a, b; self-loops are harmless.

    Each round takes the smallest label among a vertex and its neighbours, then that label's own label, so paths halve. Rounds are written
    tables, which cuts lineage and survives lost executors. rows: a bound on twice the number of edges, if it is known.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "cc-edges", most_rows=rows)
    n = rows_of(both)
    held = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "v"), "cc", most_rows=n)
    for _ in range(most_rounds):
        labels = held.select("v", "component")
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("v") == F.col("a"), "left").select("v", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("component").alias("root"))
        new = step.join(jump, "c", "left").select("v", "was", F.least("c", F.coalesce("root", "c")).alias("component"))
        new = written(new, "cc", most_rows=n)
        discard(held)
        held = new
        if new.where("was <> component").isEmpty():
            discard(both)
            return new.select("v", "component")
    raise RuntimeError("components did not settle")
