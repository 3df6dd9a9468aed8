"""Token-ID output: Parquet list columns with dictionary or delta encoding, controlled row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import NO_ID, new_path, partitions, ship, source_columns
from tessella.llm.token_counts import text_encoder


@dataclass(frozen=True)
class Layout:
    """How the files are written. Ids: a dictionary of the vocabulary (encoding="dictionary") or delta (encoding="delta").

    Row groups hold about row_group_bytes, pages about page_bytes and at most page_rows rows; Parquet's column and offset indexes
    are per page, so that a reader that wants some documents, or only the metadata columns, skips the other pages.
    """

    encoding: str = "dictionary"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2000

    def options(self) -> dict[str, str]:
        return {
            "compression": "zstd",
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": str(self.encoding == "dictionary").lower(),
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.dictionary.page.size": str(1 << 20),
            "parquet.page.row.count.limit": str(self.page_rows),
        }


def encoder(path: str, end_id: int, words_held: int, slice_bytes: int = 1 << 20):
    """(did, text) sorted by did in each partition, to rows of the file; first_at counts the partition's ids before the row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, part, end = None, 0, TaskContext.get().partitionId(), np.array([end_id], "<i4").tobytes()
        for batch in batches:
            words = words or text_encoder(path, words_held)
            low, lengths = 0, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            while low < len(lengths):
                high, held = low, 0
                while high < len(lengths) and (high == low or held + lengths[high] <= slice_bytes):
                    held += lengths[high]
                    high += 1
                found = words.encode([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).slice(low, high - low)])
                sizes = np.array([len(one) // 4 + 1 for one in found], np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                flat = pa.py_buffer(end.join(found) + end)
                values = pa.Array.from_buffers(pa.int32(), int(starts[-1]), [None, flat])
                yield pa.record_batch(
                    [batch.column(0).slice(low, high - low), pa.array([part] * (high - low), pa.int32()), pa.array(at + starts[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)],
                    ["did", "part", "first_at", "n_tokens", "ids"],
                )
                at += int(starts[-1])
                low = high

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, layout: Layout = Layout(), words_held: int = 600_000) -> None:
    """Every whole text's ids and the end id, written to path in ascending doc_id order (null ids last, then by text).

    Files: part-00000, part-00001, ... are consecutive id ranges; in a file rows ascend. One range shuffle moves the texts; a task
    encodes its range as it streams by, so memory is bounded by an Arrow batch, and a lost task is redone alone.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = source_columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "text")
    ordered = rows.repartitionByRange(partitions(spark), "did").sortWithinPartitions("did", "text")
    out = ordered.mapInArrow(encoder(tokenizer, end_id, words_held), "did long, part int, first_at long, n_tokens long, ids array<int>")
    writer = out.write
    for k, v in layout.options().items():
        writer = writer.option(k, v)
    writer.parquet(path)


def with_start(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Adds start, the ids of all files and rows before a row. index: the metadata columns alone, one total a file is all that is gathered."""
    from pyspark.sql import Window

    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("first_at"))  # a row for each file


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Metadata only, ids unread: did, part, first_at, n_tokens."""
    return spark.read.parquet(path).select("did", "part", "first_at", "n_tokens")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(4)
        flat, off = ids.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.record_batch([*batch.columns[:4], pa.array((off[1:] - off[:-1]).astype(np.int64)), pa.array(crc, pa.int64())], ["did", "part", "first_at", "n_tokens", "n_read", "ids_crc32"])


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files' own rows (n_tokens counts the ids read back)."""
    ship(spark)
    rows = spark.read.parquet(path).select("did", "part", "first_at", "n_tokens", "ids")
    read = rows.mapInArrow(_digest, "did long, part int, first_at long, n_tokens long, n_read long, ids_crc32 long")
    return with_start(read, read_index(spark, path)).select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "start", F.col("n_read").alias("n_tokens"), "ids_crc32"
    )


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, layout: Layout = Layout(), words_held: int = 600_000) -> DataFrame:
    """Writes the token files and returns their digest.

    Null or empty text: the end id alone. Repeated ids keep all their rows, in order of text; null ids come last. An empty table gives
    an empty result. Other columns are not read. words_held: how many words a worker remembers, memory against time; it changes no result.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, layout, words_held)
    if not [f for f in spark.read.parquet(path).inputFiles()]:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return token_file_digest(spark, path)
