"""Style clusters: connected components of the colourway graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.tables import written


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to links with the same components, fewer than there are vertices: each vertex with the smallest it reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        least = np.minimum(low[x], low[y])
        for of in (x, y, low[x], low[y]):
            np.minimum.at(new, of, least)
        while (new != new[new]).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    far = low != np.arange(len(ids))
    return ids[far], ids[low[far]]


def components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """v, component (the smallest v reachable) of every vertex; edges (a, b) count where both ends are vertices.

    Smallest label among the neighbours, then that label's label, so that paths halve each round. Rounds are written tables.
    """
    v = vertices.select("v").distinct()
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = both.join(v.withColumnRenamed("v", "a"), "a", "left_semi").join(v.withColumnRenamed("v", "b"), "b", "left_semi")
    both = written(both, "graph-edges")
    labels = written(v.withColumn("c", F.col("v")), "graph")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("c").alias("near"))
        low = labels.join(near, F.col("v") == F.col("a"), "left").select("v", F.col("c").alias("was"), F.least("c", "near").alias("low"))
        root = labels.select(F.col("v").alias("low"), F.col("c").alias("root"))
        labels = written(low.join(root, "low").select("v", "was", F.least("low", "root").alias("c")), "graph")
        if labels.where("was <> c").isEmpty():
            return labels.select("v", F.col("c").alias("component"))
        labels = labels.select("v", "c")
    raise RuntimeError("components did not settle")


def style_clusters(items: DataFrame, restrict: DataFrame | None = None) -> DataFrame:
    """item_id, style_id from product_id, colour_variants; restrict (product_id) limits both ends to some items."""
    rows = items if restrict is None else items.join(restrict.select("product_id"), "product_id", "left_semi")
    edges = rows.select(F.col("product_id").alias("a"), F.explode("colour_variants").alias("b"))
    return components(rows.select(F.col("product_id").alias("v")), edges).select(F.col("v").alias("item_id"), F.col("component").alias("style_id"))
