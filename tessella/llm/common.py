"""What the corpus operators share: shared-folder tables, paths and batch hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators, so that null ids order last.
NO_ID = 2**63 - 1
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows of a narrow table that one file holds; see written.
FILE_ROWS = 250_000


def written(df: DataFrame, label: str, partition_by: list[str] | None = None, most_rows: int | None = None) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again.

    most_rows: a bound on the rows of a narrow table, which is then written in as few files as FILE_ROWS asks for. The last stage has as many
    tasks, so pass it only where that stage is light.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    out = df if most_rows is None else df.coalesce(max(1, -(-most_rows // FILE_ROWS)))
    writer = out.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(table: DataFrame) -> int:
    """Rows of a written table, from its files' footers."""
    return table.count()


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing still reads; what was made from them is written itself."""
    for t in tables:
        spark = t.sparkSession
        for folder in {m[1] for f in t.inputFiles() if (m := _WRITTEN.match(f))}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_WRITTEN = re.compile(r"(.*/[a-z0-9-]+-[0-9a-f]{32})/")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by sys.path alone."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, so that others of any name can't clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_ids(docs: DataFrame) -> tuple[Column, int]:
    """A column over docs: doc_id, or where that is null an id from the text's hash above all others; and the least id of that kind.

    Rows without an id are one only where their texts are equal. Only the column doc_id is read for it.
    """
    top = docs.agg(F.max("doc_id")).first()[0]
    least = min(max(-1 if top is None else top, -1) + 1, NO_ID)
    hashed = F.lit(least).cast("long") + F.pmod(F.xxhash64("text"), F.lit(max(1, NO_ID - least)).cast("long"))
    return F.coalesce(F.col("doc_id").cast("long"), hashed), least


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants from a seed."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & _MASK)
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return splitmix(start + steps) | np.uint64(1)


class Powers:
    """B**i and B**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])


_BYTES = seeded(256, 11)
_POWERS = Powers(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of one text's UTF-8 bytes, A-Z lower-cased."""
    solid = ~_BLANK[data]
    if not solid.any():
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    _POWERS.to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[data]] * _POWERS.up[: len(data)], out=total[1:])
    return splitmix((total[end] - total[start]) * _POWERS.down[start] + (end - start).astype(np.uint64))


def shingle_set(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words than width, of the whole sequence; empty without words."""
    words = word_hashes(data)
    if not len(words):
        return words
    take = min(width, len(words))
    out = np.full(len(words) - take + 1, take, np.uint64)
    for i in range(take):
        out = out * np.uint64(0xD1342543DE82EF95) + words[i : len(words) - take + 1 + i]
    return np.unique(splitmix(out))


def text_bytes(value) -> np.ndarray:
    """UTF-8 bytes of an Arrow string scalar; null counts as empty."""
    buf = value.as_buffer() if value.is_valid else None
    return np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
