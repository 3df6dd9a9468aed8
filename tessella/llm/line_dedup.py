"""Line dedup on levelled sorted runs of line hashes, in DataFrame functions only.

The index is a log-structured set of runs in the shared folder. A run holds a line hash, the documents that hold the line and the largest
doc_id among them (its owner), sorted by hash. A batch of documents is merge-anti-joined with the runs: hashes that no run has are new and
enter with their owner; hashes that a run has enter as an increment alone. When a level holds `fanout` runs they are merged into one run of
the next level. Batches come in descending doc_id order, so the owner that came first is the largest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import FILE_ROWS, NO_ID, SPACE, new_path, rows_of, source_columns, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Has a letter that lower() would change besides A-Z.
_FOREIGN_CASE = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. lower() does it unless the line has other capital letters."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(bare.rlike(_FOREIGN_CASE), F.translate(bare, _UPPER, _UPPER.lower())).otherwise(F.lower(bare))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(line: Column, least: int) -> Column:
    """A 128-bit hash of the key, null for keys of fewer than `least` code points. One evaluation of the key for each line."""
    key = line_key(line)
    # md5 as text: array functions compare strings by hash sets
    return F.element_at(F.transform(F.array(key), lambda k: F.when(F.char_length(k) >= least, F.md5(k))), 1)


def line_entries(docs: DataFrame, least: int) -> DataFrame:
    """did, h: the distinct long-enough keys of each row."""
    rows = source_columns(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id"), F.lit(-NO_ID)).alias("did"),  # the owner is the largest id, so null is the smallest
        F.explode(F.array_distinct(F.filter(F.transform(lines(F.col("text")), lambda x: key_hash(x, least)), lambda h: h.isNotNull()))).alias("h"),
    )
    return rows.select("did", F.unhex("h").alias("h"))


@dataclass
class LineRuns:
    """Runs by level; each is a Parquet folder sorted by hash within its files."""

    spark: SparkSession
    fanout: int = 3
    levels: list[list[str]] = field(default_factory=list)
    rows: int = 0

    SCHEMA = "h binary, n_docs long, owner long"

    def runs(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else None

    def add(self, entries: DataFrame, most: int) -> None:
        """entries: did, h of a batch whose ids no earlier batch has and which are all smaller; most bounds their number."""
        batch = entries.groupBy("h").agg(F.count_distinct("did").alias("n_docs"), F.max("did").alias("owner"))
        held = self.runs()
        if held is not None:
            # a hash's owner lies in one run: the one that saw it first
            batch = written(batch, "line-batch", most_rows=most)
            seen = held.where(F.col("owner").isNotNull()).select("h")
            new = batch.join(seen.hint("merge"), "h", "left_anti")
            old = batch.join(seen.hint("merge"), "h", "left_semi").withColumn("owner", F.lit(None).cast("long"))
            batch = new.unionByName(old)
        self.rows += most
        self._put(batch, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = new_path(self.spark, f"line-run-{level}")
        files = max(1, -(-self.rows // FILE_ROWS))
        run.select("h", "n_docs", "owner").coalesce(files).sortWithinPartitions("h").write.parquet(path)
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            held = self.spark.read.schema(self.SCHEMA).parquet(*self.levels[level])
            self.levels[level] = []
            self._put(merged(held), level + 1)

    def totals(self) -> DataFrame:
        """h, n_docs, owner over all runs."""
        held = self.runs()
        return merged(held) if held is not None else self.spark.createDataFrame([], self.SCHEMA)


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))


def batched(entries: DataFrame, docs: DataFrame, batches: int) -> tuple[list[DataFrame], int]:
    """The entries in batches of about equal documents by descending id, and how many there are in all."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] or []
    number = sum((F.col("did") <= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    table = written(entries.withColumn("batch", number), "line-entries", partition_by=["batch"])
    return [table.where(F.col("batch") == i).drop("batch") for i in range(len(cuts) + 1)], rows_of(table)


def repeated_elsewhere(entries: DataFrame, totals: DataFrame, least_docs: int, most_hot: int = 50_000, entries_rows: int | None = None) -> DataFrame:
    """did, h of the lines to drop: held by at least least_docs documents, another one being the owner.

    A line that more than (entries / most_hot) documents hold is hot; there are fewer than most_hot of these, so they are broadcast. The
    others meet by a merge join, where a key has at most that many rows.
    """
    common = written(totals.where(F.col("n_docs") >= least_docs), "line-common", most_rows=entries_rows)
    n = common.agg(F.sum("n_docs")).first()[0] or 0
    limit = max(1000, n // most_hot)
    hot = common.where(F.col("n_docs") > limit)
    others = common.where(F.col("n_docs") <= limit)
    cold = entries.join(F.broadcast(hot.select("h")), "h", "left_anti").join(others, "h")
    return entries.join(F.broadcast(hot), "h").unionByName(cold).where(F.col("did") != F.col("owner")).select("did", "h")


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text and kept_sha256 of every row.

    Texts split at \\n (null or empty: one empty line). Keys of at least least_chars code points that at least least_docs documents hold lose
    all their lines but in the largest doc_id holding them; other lines stay, joined by \\n. Rows of one doc_id count as one document, and
    all of them keep what it owns; a null doc_id is a document whose id is the smallest. A repeat inside a document alone is kept. Empty
    table: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    index = LineRuns(spark, fanout)
    parts, n = batched(line_entries(docs, least_chars), docs, batches)
    for part in parts:
        index.add(part, -(-n // len(parts)))
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    drop = repeated_elsewhere(entries, index.totals(), least_docs, entries_rows=n)
    lost = drop.groupBy("did").agg(F.collect_set(F.lower(F.hex("h"))).alias("lost"))
    rows = source_columns(docs, "doc_id", "text").withColumn("did", F.coalesce("doc_id", F.lit(-NO_ID))).join(lost, "did", "left")
    kept = F.filter(lines(F.col("text")), lambda x: ~F.coalesce(F.array_contains(F.col("lost"), key_hash(x, least_chars)), F.lit(False)))
    some = F.col("lost").isNotNull()
    rows = rows.select(
        "doc_id",
        F.size(lines(F.col("text"))).cast("long").alias("n_lines"),
        F.when(some, F.array_join(kept, "\n")).otherwise(F.coalesce("text", F.lit(""))).alias("kept_text"),
        F.when(some, F.size(kept)).otherwise(F.lit(-1)).alias("n_kept"),
    )
    dropped = F.when(F.col("n_kept") < 0, F.lit(0)).otherwise(F.col("n_lines") - F.col("n_kept")).cast("long")
    return rows.select("doc_id", "n_lines", dropped.alias("n_dropped"), "kept_text", F.sha2("kept_text", 256).alias("kept_sha256"))
