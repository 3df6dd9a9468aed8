"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A document's key is -ln(u)/w for a uniform u from its id and a weight w from its quality scores; ascending keys are a weighted sample
without replacement. A source's target is complete epochs and a rest; the rest goes to the smallest keys while their sizes fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import NO_ID, source_columns, written
from tessella.llm.quality_rules import measured

#: Ranges of keys for each octave; see mix.
OCTAVE = 1024


def quality_weight(m: Column, least: float = 0.05) -> Column:
    """From the quality rules' scores: the squared product of the shares of characters that aren't symbols, of lines that don't repeat another and of
    words outside repeated windows, at least `least`; 1 for a text without words."""
    whole = F.lit(1000.0)
    q = (whole - m["symbols_permille"]) * (whole - m["dup_lines_permille"]) * (whole - m["repeat_words_permille"]) / F.lit(1e9)
    return F.greatest(F.lit(least), q * q)


def uniform(seed: int, name: Column) -> Column:
    """In (0, 1), from 52 bits of md5 of seed and name: any engine draws the same."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: list[float], share: float, epochs: float) -> DataFrame:
    """source, source_size, target: total * share dealt by weight, each at most epochs * its size, the excess dealt anew to the others.

    The fixed point is target = min(cap, level * weight) for one level: sources in order of cap / weight, the first that exceed their
    deal are at their caps and the others share what is left. One row for each source is ordered here, no more.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    s = s.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weight_from", F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    s = s.withColumn("at", level.over(every).getField("level"))
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("at") * F.col("weight")), "cap").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies (how often the whole document enters the mix) of every row.

    Sizes are words (null text: 0). Sources weigh by code point order, null last. Each document is in every complete epoch; the rest of
    the target goes by ascending key, the document on the boundary joining when that comes nearer. A row without id draws by its text. Rows
    of one id break ties by a hash of their texts; equal rows are interchangeable. A row of size 0 takes 0 and one copy for each complete epoch.
    Empty table: empty result. Other columns are not read.

    Prefix sums at any size: keys fall in ranges, OCTAVE to each doubling, a source's range totals are summed first (partial sums before
    the shuffle), and only the rows of the range where the target is crossed are ordered. The logarithm of an exponential key has a density
    below 1/e wherever its weight shifts it, so whatever the weights are a range is expected to hold no more than ln(2) / e / OCTAVE, one in
    4,000, of a source's rows.
    """
    rows = measured(source_columns(docs, "doc_id", "source", "text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    rows = rows.select("doc_id", "source", F.col("m.n_words").alias("size"), (-F.log(uniform(seed, name)) / quality_weight(F.col("m"))).alias("key"), F.xxhash64("text").alias("mark"))
    rows = rows.withColumn("bin", F.floor(F.log2("key") * OCTAVE).cast("int"))
    rows = written(rows, "mix")
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), list(weights), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0))
    plan = written(plan.withColumn("epochs", whole.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    upto = Window.partitionBy("source").orderBy("bin")
    before = F.sum("n").over(upto) - F.col("n")
    edge = sums.withColumn("before", before).join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    edge = edge.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).groupBy("s").agg(F.max("bin").alias("edge"), F.max_by("before", "bin").alias("before"))
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s")
    all_rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s") if bounded(plan) else rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    split = F.coalesce((F.col("bin") == F.col("edge")) & (F.col("size") > 0), F.lit(False))
    order = Window.partitionBy("source").orderBy("key", F.coalesce("doc_id", F.lit(NO_ID)), "mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = all_rows.where(split).withColumn("upto", F.col("before") + F.sum("size").over(order))
    at_edge = at_edge.withColumn("more", (F.col("upto") - F.col("size") / 2.0 <= F.col("rest")).cast("long")).drop("upto")
    # without an edge the rest is 0 or all of the source: rest < source_size, so it is 0 unless all sizes are
    others = all_rows.where(~split).withColumn("more", F.when((F.col("size") > 0) & (F.col("bin") < F.col("edge")), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    out = at_edge.unionByName(others).withColumn("copies", F.col("epochs") + F.col("more"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "epochs", "mark")


def bounded(plan: DataFrame, most: int = 100_000) -> bool:
    """Whether the plan, a row for each source, is small enough to broadcast."""
    return len(plan.limit(most + 1).select(F.lit(1)).take(most + 1)) <= most


def _same(doc_id: Column, source: Column, mark: Column) -> list[Column]:
    """Two hashes that rows equal in id, source and text share; nulls count as values."""
    parts = [doc_id.isNull(), doc_id, source.isNull(), source, mark]
    return [F.xxhash64(F.lit(salt), *parts).alias(name) for salt, name in ((1, "same"), (2, "too"))]


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each row as often as mix takes it; same columns.

    Rows equal in id, source and text are told apart by a hash of all their columns: of such a group every row enters each complete epoch,
    and as many as mix lets into the rest enter once more. Rows that mix takes no copy of are left out; nulls, repeated rows and empty tables as there.
    """
    taken = mix(docs, **options).select(*_same(F.col("doc_id"), F.col("source"), F.col("mark")), "copies", "epochs")
    taken = taken.groupBy("same", "too").agg(F.max("epochs").alias("epochs"), F.sum(F.col("copies") - F.col("epochs")).alias("more")).where("epochs + more > 0")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", *_same(F.col("row.doc_id"), F.col("row.source"), F.xxhash64("row.text")))
    number = F.row_number().over(Window.partitionBy("same", "too").orderBy(F.xxhash64("row")))
    rows = rows.join(taken, ["same", "too"]).withColumn("copies", F.col("epochs") + (number <= F.col("more")).cast("long")).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
