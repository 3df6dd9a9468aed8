"""Sources and sinks: JSON lines, CSV, gzip or plain text, images, index and state tables, and tables in the shared folder."""

from __future__ import annotations

import gzip
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REFS = "product_id LONG, category STRING, brand STRING, slug STRING, url STRING"
ITEMS = (
    "product_id LONG, name STRING, brand STRING, base_colour STRING, article_type STRING, sub_category STRING, master_category STRING, gender STRING, "
    "images ARRAY<STRING>, colour_variants ARRAY<LONG>, related_styles ARRAY<LONG>, source_url STRING, fetched_at STRING"
)
VIEWS = "item_id LONG, view_id INT, mirrored BOOLEAN, emb ARRAY<FLOAT>"
INDEX_META = "backbone STRING, image_size INT, pooling STRING, whiten_dim INT"
# The columns of a manifest of labelled photos, in order.
MANIFEST = ("photo_id", "filename", "item_id", "kind", "split", "conditions", "occludes_logo", "sku_confidence", "notes")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file systems, so that it holds for any store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing path is an empty table."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Writes JSON lines and returns how many, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def append_new(df: DataFrame, path: str, key: str, schema: str, limit: int | None = None) -> int:
    """Appends the rows whose key isn't there yet, in key order up to limit: a run that was cut short goes on where it stopped."""
    todo = df.join(read_jsonl(df.sparkSession, path, schema).select(key), key, "left_anti")
    return write_jsonl(todo if limit is None else todo.orderBy(key).limit(limit), path, append=True)


def read_text_any(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files, gzip or plain by their first bytes, whatever the name says."""
    def plain(content: pd.Series) -> pd.Series:
        return content.map(lambda b: (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace"))

    return spark.read.format("binaryFile").load(path).select("path", F.pandas_udf(plain, "string")("content").alias("text"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, image (the struct of Spark's image source); files that don't decode are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select(F.col("image.origin").alias("path"), "image")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's text columns and line, the file's line that a row starts on (the header is line 1; blank lines and quoted cells of several lines count).

    A manifest is a list of photos labelled by hand: a file of it is read whole in one task.
    """
    import csv
    import io

    names = spark.read.option("header", True).option("multiLine", True).csv(path).columns
    missing = sorted(set(MANIFEST) - set(names))
    if missing:
        raise ValueError(f"manifest is missing columns: {missing}")

    def parse(frames: Iterable) -> Iterable:
        for f in frames:
            out = []
            for text in f["value"]:
                rows = csv.reader(io.StringIO(text, newline=""))
                head = [h.strip().lstrip("\ufeff") for h in next(rows, [])]
                at = {c: head.index(c) for c in MANIFEST if c in head}
                begins = rows.line_num + 1
                for row in rows:
                    if row:
                        out.append((*[(row[at[c]] or None) if c in at and at[c] < len(row) else None for c in MANIFEST], begins))
                    begins = rows.line_num + 1
            yield pd.DataFrame(out, columns=[*MANIFEST, "line"])

    whole = spark.read.text(path, wholetext=True)
    return whole.mapInPandas(parse, ", ".join(f"{c} string" for c in MANIFEST) + ", line long")


def write_ids(ids: DataFrame, path: str) -> None:
    """An exclusion list: one JSON array of the distinct ids, ascending. A list of held-out items, made by hand or by a draw."""
    first = ids.columns[0]
    one = ids.select(F.col(first).cast("long").alias("id")).distinct().agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str, name: str = "product_id") -> DataFrame:
    """The ids of such a file; a missing one is an empty list."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{name} long")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<long>")).alias(name))


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """filename (relative to root) and length of the non-empty files under root, without their contents."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length").where("length > 0")
    base = root.split("://", 1)[-1].rstrip("/")
    return listed.select(F.regexp_replace(F.expr(f"substring_index(path, '{base}/', -1)"), "^/", "").alias("filename"), "length")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_template(spark: SparkSession, path: str) -> None:
    """An empty manifest with one example row."""
    row = ("p0001", "hard/IMG_0001.jpg", "1", "hard", "test", "low_light|motion_blur", "false", "exact", "example")
    write_csv(spark.createDataFrame([row], ", ".join(f"{c} STRING" for c in MANIFEST)), path)


def save_index(views: DataFrame, meta: dict, path: str) -> None:
    """Views bucketed by nothing but sorted by item within files, and one row about the encoder."""
    views.sortWithinPartitions("item_id", "view_id").write.mode("overwrite").parquet(f"{path}/views")
    views.sparkSession.createDataFrame([Row(**{c.split()[0]: meta.get(c.split()[0]) for c in INDEX_META.split(", ")})], INDEX_META).write.mode("overwrite").parquet(f"{path}/index_meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/views"), spark.read.parquet(f"{path}/index_meta").first().asDict()


def save_state(spark: SparkSession, state: dict, schema: str, path: str) -> None:
    """One row: a whitening step, a calibrator's parameters, or conformal scores."""
    spark.createDataFrame([Row(**state)], schema).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> dict:
    return spark.read.parquet(path).first().asDict(recursive=True)


def download(jobs: DataFrame, root: str, fetch: Callable[[str], bytes], min_interval: float = 0.0, tries: int = 3) -> DataFrame:
    """item_id, view_id, url to item_id, view_id, url, status: files root/<shard>/<id>/<view>.jpg that exist and aren't empty are skipped.

    root is a folder that all executors mount. A file is written beside its place and renamed, so a lost task leaves no half file.
    """
    import time

    def write(frames: Iterable) -> Iterable:
        last = 0.0
        for f in frames:
            status = []
            for item, view, url in zip(f["item_id"], f["view_id"], f["url"], strict=True):
                path = f"{root}/{item % 100:02d}/{item}/{view}.jpg"
                if os.path.exists(path) and os.path.getsize(path):
                    status.append("skipped")
                    continue
                done = "failed"
                for k in range(tries):
                    wait = last + min_interval * 2**k - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    last = time.monotonic()
                    try:
                        body = fetch(url)
                    except Exception:  # noqa: BLE001  any failure of a fetch is one more try
                        continue
                    if body:
                        os.makedirs(os.path.dirname(path), exist_ok=True)
                        part = f"{path}.{uuid.uuid4().hex}"
                        with open(part, "wb") as fh:
                            fh.write(body)
                        os.replace(part, path)
                        done = "ok"
                        break
                status.append(done)
            yield f.assign(status=status)[["item_id", "view_id", "url", "status"]]

    return jobs.select("item_id", "view_id", "url").mapInPandas(write, "item_id long, view_id int, url string, status string")


def download_summary(done: DataFrame) -> DataFrame:
    """n and failed urls for each status."""
    failed = F.collect_list(F.when(F.col("status") == "failed", F.col("url")))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.array_sort(failed).alias("failed_urls"))
