"""The harvest as a stream: sitemap files arrive, products are emitted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions import text as X


def product_stream(spark: SparkSession, folder: str, pattern: str, categories: tuple[str, ...] | None = None) -> DataFrame:
    """Refs of products as sitemap files arrive in folder; the state holds the ids seen."""
    lines = spark.readStream.format("text").option("wholetext", True).load(folder)
    refs = lines.select(F.explode(X.locations(F.col("value"))).alias("url")).where(F.col("url").rlike(pattern)).withColumns(X.product_parts(F.col("url"), pattern))
    refs = refs if categories is None else refs.where(F.col("category").isin(*categories))
    return refs.dropDuplicates(["product_id"])


def harvest_once(spark: SparkSession, folder: str, pattern: str, out: str, state: str, categories: tuple[str, ...] | None = None) -> StreamingQuery:
    """Everything that arrived since the last call, appended to out; state is the checkpoint folder that makes it exactly once."""
    stream = product_stream(spark, folder, pattern, categories)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
