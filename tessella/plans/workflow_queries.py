"""Sources, sinks, guards, preparation, encoding, images and learning as queries over the supplied tables, each with its DuckDB SQL.

Where a result depends on a fit or on random draws, the query returns what must hold of it: a gradient of zero, unit covariance, shapes and ranges.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.functions import images as I
from tessella.functions import text as X
from tessella.operators import calibrate, catalogue, confidence, encode, evaluate, guards, search
from tessella.operators import stats as S
from tessella.operators.search import ship
from tessella.operators.vector_index import Whitening
from tessella.plans.catalogue_queries import HELD, LABEL, on_pictures, pictures, query, r6, vectors
from tessella.sources import tables, web
from tessella.sources.tables import read
from tessella.streaming import harvest as stream

SITE = "https://www.example.com"


def place(spark, label):
    return f"{tables.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Sources and sinks


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, d):
    """Half of the rows is written, the rest appended by a run that goes on."""
    rows, path, schema = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), place(spark, "jsonl"), "doc_id long, lang string, source string, n_chars long"
    tables.write_jsonl(rows.where("doc_id % 2 = 0"), path)
    tables.append_new(rows, path, "doc_id", schema)
    return tables.read_jsonl(spark, path, schema)


@query("SELECT url, (2 * count(*))::BIGINT AS n FROM pages GROUP BY url")
def text_any_locations(spark, d):
    """Sitemap files, plain and gzipped."""
    text, path = read(spark, d, "pages").select(F.concat(F.lit("<loc>"), "url", F.lit("</loc>"))), place(spark, "maps")
    text.write.text(f"{path}/plain")
    text.write.option("compression", "gzip").text(f"{path}/gz")
    both = tables.read_text_any(spark, f"{path}/plain").unionByName(tables.read_text_any(spark, f"{path}/gz"))
    return both.select(F.explode(X.locations(F.col("text"))).alias("url")).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT url, CASE WHEN length(url) % 5 = 0 THEN 'missing' WHEN length(url) % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN length(url) % 5 <> 0 AND length(url) % 7 <> 0 THEN '<p>' || url END AS html FROM pages")
def fetch_status(spark, d):
    def fetch(url):
        if len(url) % 5 == 0:
            raise web.NotFound(url)
        if len(url) % 7 == 0:
            raise OSError(url)
        return f"<p>{url}"

    ship(spark)
    return web.fetch_pages(read(spark, d, "pages").select("url").distinct(), web.Fetcher(fetch, 0.0, sleep=lambda s: None)).select("url", "status", "html")


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN 'failed' ELSE 'ok' END AS status FROM supplier), t AS (SELECT k, 1 AS run, status FROM s UNION ALL SELECT k, 2, CASE WHEN status = 'ok' THEN 'skipped' ELSE status END FROM s)
SELECT run, status, count(*)::BIGINT AS n, coalesce(string_agg('u' || k, ',' ORDER BY 'u' || k) FILTER (status = 'failed'), '') AS failed FROM t GROUP BY run, status""")
def download_status(spark, d):
    """Images downloaded, and a second run that skips what is there."""
    ship(spark)
    jobs = read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("item_id"), F.lit(0).alias("view_id"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("url"))
    root = place(spark, "images").split("://", 1)[-1]
    fetch = lambda url: b"" if int(url[1:]) % 9 == 0 else url.encode()
    runs = [tables.written(tables.download_summary(tables.download(jobs, root, fetch)).select(F.lit(i).alias("run"), "status", "n", F.array_join("failed_urls", ",").alias("failed")), "downloads") for i in (1, 2)]
    return runs[0].unionByName(runs[1])


@query("SELECT label::BIGINT AS item_id, vec_id::INT AS view_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm, 'none' AS backbone, 64 AS dim FROM embeddings")
def index_round_trip(spark, d):
    e, path = read(spark, d, "embeddings"), place(spark, "index")
    tables.save_index(e.select(F.col("label").cast("long").alias("item_id"), F.col("vec_id").cast("int").alias("view_id"), F.lit(False).alias("mirrored"), F.col("embedding").alias("emb")), {"backbone": "none", "image_size": 8}, path)
    views, meta = tables.load_index(spark, path)
    norm = F.aggregate("emb", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return views.select("item_id", "view_id", r6(norm).alias("norm"), F.lit(meta["backbone"]).alias("backbone"), F.lit(search.check_index(views)).alias("dim"))


@query("SELECT (row_number() OVER (ORDER BY value) - 1)::BIGINT AS place, round(value, 6) AS score, 0.2::DOUBLE AS alpha FROM events WHERE event_type = 'error'")
def conformal_state(spark, d):
    """Calibration scores, fitted, saved and read again."""
    model, path = confidence.Conformal(0.2).fit(read(spark, d, "events").where("event_type = 'error'").select(F.col("value").alias("score"))), place(spark, "state")
    tables.save_state(spark, {"alpha": model.alpha, "cal": model.cal}, "alpha DOUBLE, cal ARRAY<DOUBLE>", path)
    return spark.read.parquet(path).select("alpha", F.posexplode("cal").alias("place", "score")).select(F.col("place").cast("long").alias("place"), r6("score").alias("score"), "alpha")


@query("""SELECT (s_suppkey * 2 + 2)::BIGINT AS line, 'p' || s_suppkey AS photo_id, s_suppkey::BIGINT AS item_id, CASE WHEN s_suppkey % 3 = 0 THEN 'clean' ELSE 'hard' END AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split,
CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'low_light,defocus' END AS conditions, s_suppkey % 5 = 0 AS occludes_logo FROM supplier""")
def manifest_round_trip(spark, d):
    """A manifest written, read and typed; notes take two lines, so that row and line numbers differ."""
    k = F.col("s_suppkey")
    rows = read(spark, d, "supplier").select(
        F.concat(F.lit("p"), k.cast("string")).alias("photo_id"), F.lit("a.jpg").alias("filename"), k.cast("string").alias("item_id"), F.when(k % 3 == 0, "clean").otherwise("hard").alias("kind"),
        F.when(k % 2 == 0, "dev").otherwise("test").alias("split"), F.when(k % 3 == 0, "").otherwise("low_light| defocus").alias("conditions"), F.when(k % 5 == 0, "yes").otherwise("no").alias("occludes_logo"),
        F.lit("exact").alias("sku_confidence"), F.lit("two\nlines").alias("notes"),
    )
    path = place(spark, "manifest")
    tables.write_csv(rows.orderBy(F.substring("photo_id", 2, 20).cast("long")).coalesce(1), path)
    held = tables.read_manifest(spark, path)
    typed = guards.load_manifest(held, rows.select("item_id"))
    return typed.join(held.select("photo_id", "line"), "photo_id").select("line", "photo_id", "item_id", "kind", "split", F.array_join("conditions", ",").alias("conditions"), "occludes_logo")


@query("SELECT DISTINCT c_nationkey::BIGINT AS item_id FROM customer WHERE c_acctbal > 5000")
def id_list_round_trip(spark, d):
    path = place(spark, "ids")
    tables.write_ids(read(spark, d, "customer").where("c_acctbal > 5000").select("c_nationkey"), path)
    return tables.read_ids(spark, path, "item_id")


def refs(spark, d):
    """Sitemaps made from part: two products an item, some of them twice."""
    k = F.col("p_partkey")
    url = lambda i: F.concat(F.lit(f"<loc>{SITE}/"), F.when(k % 3 == 0, "Hats").otherwise("Boots"), F.lit("/Maker+"), (k % 7).cast("string"), F.lit("/slug/"), F.expr(f"(p_partkey + {i}) div 2").cast("string"), F.lit("/buy</loc>"))
    return read(spark, d, "part").select(k.cast("long").alias("sitemap_no"), F.concat(url(0), F.lit("<loc>https://other/x</loc>"), url(1)).alias("text"))


REFS = """WITH u AS (SELECT p_partkey AS s, 0 AS pos, p_partkey // 2 AS id, p_partkey AS k FROM part UNION ALL SELECT p_partkey, 2, (p_partkey + 1) // 2, p_partkey FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, pos) AS rn FROM u WHERE k % 3 <> 0)
"""


@query(REFS + "SELECT id::BIGINT AS product_id, 'Boots' AS category, 'Maker ' || (k % 7) AS brand FROM f WHERE rn = 1 ORDER BY s, pos LIMIT 50")
def harvest_first(spark, d):
    """The first 50 products of the sitemaps, after the category filter."""
    return catalogue.harvest(catalogue.parse_sitemap(refs(spark, d), X.product_pattern(SITE)), limit=50).select("product_id", "category", "brand")


@query(REFS + "SELECT DISTINCT id::BIGINT AS product_id FROM f")
def streaming_harvest(spark, d):
    """The same as a stream of sitemap files; a second run finds nothing new."""
    path = place(spark, "stream")
    refs(spark, d).select("text").write.text(f"{path}/in")
    for _ in range(2):
        stream.harvest_once(spark, f"{path}/in", X.product_pattern(SITE), f"{path}/out", f"{path}/state", ("Boots",)).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("product_id")


@query("SELECT (generate_subscripts(l, 1) - 1)::INT AS sitemap_no, unnest(l) AS url FROM (SELECT list(url ORDER BY page_id) AS l FROM pages WHERE page_id < 30)")
def sitemap_index(spark, d):
    """The files that an index lists, 30 of them."""
    urls = read(spark, d, "pages").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("l"))
    index = urls.select(F.array_join(F.transform("l", lambda x: F.concat(F.lit("<loc>"), x["url"], F.lit("</loc>"))), "").alias("text"))
    return catalogue.list_sitemaps(index, 30)


# Scalars, joins, limits


@query("SELECT event_id, lower(trim(CASE event_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN '1' WHEN 2 THEN 'TRUE ' WHEN 3 THEN 'no' WHEN 4 THEN '' ELSE 'y' END)) IN ('1', 'true', 'yes', 'y') AS flag, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def flags_and_times(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in (" Yes", "1", "TRUE ", "no", "", "y")]), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", X.truthy(raw).alias("flag"), X.utc_seconds(F.col("ts")).alias("at"))


@query("SELECT label::BIGINT AS item_id, vec_id::BIGINT AS view_id FROM embeddings WHERE vec_id % 3 = 0")
def present_views(spark, d):
    views = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("item_id"), F.col("vec_id").alias("view_id"))
    files = views.where("view_id % 3 = 0").select(F.format_string("images/%02d/%d/%d.jpg", F.col("item_id") % 100, "item_id", "view_id").alias("filename"))
    return catalogue.present_views(views, files)


@query("SELECT o_custkey::BIGINT AS item_id, count(*)::BIGINT AS n_views FROM orders GROUP BY o_custkey HAVING count(*) >= 12 ORDER BY o_custkey LIMIT 200")
def usable_items(spark, d):
    return catalogue.usable_items(read(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("item_id")), 12, 200)


@query("SELECT c::BIGINT AS item_id, (row_number() OVER (PARTITION BY c ORDER BY o) - 1)::INT AS view_id, o AS url FROM (SELECT o_custkey AS c, o_orderkey::VARCHAR AS o FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 100))")
def first_items(spark, d):
    """All views of the first 100 items."""
    items = read(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("product_id")).agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("images"))
    return catalogue.item_views(items, first_items=100)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_all(spark, d):
    return catalogue.pending(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("""WITH i AS (SELECT vec_id AS item_id, vec_id // 4 AS style_id FROM embeddings), p AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || item_id), item_id) <= 30 AS picked FROM i)
SELECT item_id, CASE WHEN picked THEN 'picked' ELSE 'catalogue' END AS side FROM p WHERE picked OR style_id NOT IN (SELECT style_id FROM p WHERE picked)""")
def out_of_catalogue(spark, d):
    i = read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.expr("vec_id div 4").alias("style_id"))
    picked, rest = catalogue.out_of_catalogue(i, 30, 3)
    return picked.select("item_id", F.lit("picked").alias("side")).unionByName(rest.select("item_id", F.lit("catalogue").alias("side")))


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / ((SELECT stddev_pop(value) FROM events) + 1e-9), 6) AS z FROM events")
def standardised(spark, d):
    out, _ = calibrate.standardise(read(spark, d, "events").select("event_id", F.col("value").alias("z")), ["z"])
    return out.select("event_id", r6("z").alias("z"))


@query("""SELECT * FROM (VALUES ('index of one dimension', '64'), ('index without rows', 'ValueError'), ('index of two dimensions', 'ValueError'), ('index without item', 'ValueError'), ('dimensions without whitening', 'ValueError'), ('dimensions', 'None'),
('whitening', 'None'), ('whitening of others', 'ValueError'), ('splits', 'ManifestError'), ('indexed', 'TestSetError'), ('enough', 'None'), ('not enough', 'TestSetError'), ('calibration points', 'ValueError'), ('encoder', 'ValueError'), ('corruption', 'KeyError'), ('severity', 'ValueError')) t(guard, outcome)""")
def guard_outcomes(spark, d):
    """What each check says about tables that pass and that don't."""
    v = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("item_id"), F.col("vec_id").alias("view_id"), F.col("embedding").alias("emb"))
    odd = v.withColumn("emb", F.when(F.col("view_id") == 1, F.slice("emb", 1, 3)).otherwise(F.col("emb")))
    splits = v.select("item_id", F.when(F.col("view_id") % 2 == 0, "dev").otherwise("test").alias("split"))
    img = np.zeros((16, 16, 3), np.uint8)
    checks = {
        "index of one dimension": lambda: search.check_index(v), "index without rows": lambda: search.check_index(v.limit(0)), "index of two dimensions": lambda: search.check_index(odd),
        "index without item": lambda: search.check_index(v.withColumn("item_id", F.nullif("item_id", F.lit(3).cast("long")))), "dimensions without whitening": lambda: search.check_dimensions(128, 64),
        "dimensions": lambda: search.check_dimensions(64, 64), "whitening": lambda: search.check_dimensions(128, 64, 128, 64), "whitening of others": lambda: search.check_dimensions(96, 64, 128, 64),
        "splits": lambda: guards.check_split_disjoint(splits), "indexed": lambda: guards.check_indexed(v, v.where("item_id < 8")), "enough": lambda: guards.check_enough(v, 20, "views"),
        "not enough": lambda: guards.check_enough(v.where("item_id < 0"), 20, "views"), "calibration points": lambda: confidence.Conformal().fit(v.limit(3).select(F.lit(0.5).alias("score"))),
        "encoder": lambda: encode.encoder("no such encoder"), "corruption": lambda: I.corrupt(img, "fog", 1), "severity": lambda: I.corrupt(img, "defocus", 9),
    }
    out = []
    for name, check in checks.items():
        try:
            out.append((name, str(check())))
        except (ValueError, KeyError) as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "guard string, outcome string")


# Preparing an index


@query("""WITH m AS (SELECT i, avg(x) AS m FROM (SELECT generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id % 5 <> 0) GROUP BY i)
SELECT 'mean' AS kind, i::INT AS i, 0 AS j, round(m, 5) + 0.0 AS value FROM m UNION ALL SELECT 'components', i::INT, j::INT, (i = j)::INT::DOUBLE FROM range(16) a(i), range(16) b(j) UNION ALL SELECT 'covariance', i::INT, j::INT, (i = j)::INT::DOUBLE FROM range(16) a(i), range(16) b(j)""")
def whitening_state(spark, d):
    """What whitening must do: the views' mean, orthonormal components, and unit covariance of what they project to (before the length is made 1; eps aside)."""
    _, v = vectors(spark, d)
    w = Whitening(16, eps=0.0).fit(v)
    by = w.components * w.scale[:, None]
    schema, mean = "n long, s array<double>", w.mean

    def moments(frames):
        for f in frames:
            y = (np.stack(f["emb"].to_numpy()).astype(np.float64) - mean) @ by.T
            yield pd.DataFrame({"n": [len(y)], "s": [(y.T @ y).ravel().tolist()]})

    ship(spark)
    parts = v.select("emb").mapInPandas(moments, schema)
    n = F.broadcast(parts.agg((F.sum("n") - 1).alias("n")))  # one row
    cov = parts.select(F.posexplode("s").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).crossJoin(n)
    cov = cov.select(F.lit("covariance").alias("kind"), F.expr("at div 16").cast("int").alias("i"), F.expr("at % 16").alias("j"), (F.round(F.col("x") / F.col("n"), 5) + F.lit(0.0)).alias("value"))
    gram = w.components @ w.components.T
    rows = [("mean", i, 0, round(float(x), 5) + 0.0) for i, x in enumerate(w.mean)] + [("components", i, j, round(float(gram[i, j]), 5) + 0.0) for i in range(16) for j in range(16)]
    return spark.createDataFrame(rows, "kind string, i int, j int, value double").unionByName(cov)


_CAP = """WITH e AS (SELECT label::BIGINT AS item_id, vec_id AS view_id, embedding::DOUBLE[] AS emb FROM embeddings WHERE vec_id % 5 <> 0), c AS (SELECT item_id, list(m ORDER BY i) AS m FROM (SELECT item_id, i, avg(x) AS m FROM (SELECT item_id, generate_subscripts(emb, 1) AS i, unnest(emb) AS x FROM e) GROUP BY ALL) GROUP BY item_id),
k1 AS (SELECT item_id, view_id, emb FROM (SELECT e.*, row_number() OVER (PARTITION BY item_id ORDER BY round(list_inner_product(emb, m), 12) DESC, view_id) AS rn FROM e JOIN c USING (item_id)) WHERE rn = 1)"""
for _n in (2, 3, 4):
    _CAP += f""", k{_n} AS (SELECT * FROM k{_n - 1} UNION ALL SELECT item_id, view_id, emb FROM (SELECT e.item_id, e.view_id, any_value(e.emb) AS emb, row_number() OVER (PARTITION BY e.item_id ORDER BY round(max(list_inner_product(e.emb, k.emb)), 12), e.view_id) AS rn
FROM e JOIN k{_n - 1} k USING (item_id) WHERE (e.item_id, e.view_id) NOT IN (SELECT (item_id, view_id) FROM k{_n - 1}) GROUP BY e.item_id, e.view_id) WHERE rn = 1)"""


@query(_CAP + " SELECT item_id, view_id FROM k4")
def capped_views(spark, d):
    from tessella.operators.vector_index import cap_views

    _, v = vectors(spark, d)
    return cap_views(v, 4).select("item_id", "view_id")


# Encoding and pictures

_V = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), v AS (SELECT vec_id, list_transform(x, lambda y: floor(255 * (y - list_min(x)) / greatest(list_max(x) - list_min(x), 1e-9))) AS v FROM e)"
_PIXELS = _V + ", p AS (SELECT vec_id, v, y, x, CASE WHEN y BETWEEN 8 AND 39 AND x BETWEEN 8 AND 39 THEN v[(y - 8) // 4 * 8 + (x - 8) // 4 + 1] ELSE 255.0 END AS g FROM v, range(48) a(y), range(48) b(x))"


def image_rows(spark, d):
    """The pictures as Spark image structs: item_id, view_id, image."""
    ship(spark)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"item_id": f["vec_id"], "view_id": 0, "image": [I.to_struct(p) for p in pictures(f["embedding"])]})

    return read(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "item_id long, view_id int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


@query(_PIXELS + """, t AS (SELECT vec_id, avg(g) / 255 AS m, stddev_pop(g) / 255 AS s FROM p GROUP BY vec_id, y // 12, x // 12), u AS (SELECT vec_id, avg(m) AS m, avg(s) AS s FROM t GROUP BY vec_id)
SELECT u.vec_id AS item_id, mirrored, 12 AS dim, round((m / sqrt(6 * (m * m + s * s)))::FLOAT::DOUBLE, 5) AS colour, round((s / sqrt(6 * (m * m + s * s)))::FLOAT::DOUBLE, 5) AS spread FROM u, (VALUES (FALSE), (TRUE)) f(mirrored)""")
def encoded_views(spark, d):
    """Catalogue encoding: a global token and the mean of 4 x 4 patches, at unit length; a mirrored copy of each, which this encoder tells the same."""
    out = encode.encode_views(image_rows(spark, d), encode.encoder("colour-grid"), encode.Config(48), mirrored=True, trim=False)
    return out.select("item_id", "mirrored", F.size("emb").alias("dim"), F.round(F.col("emb")[0].cast("double"), 5).alias("colour"), F.round(F.col("emb")[9].cast("double"), 5).alias("spread"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), t AS (SELECT vec_id, x[1:16] AS a, list_transform(range(1, 17), lambda i: (x[16 + i] + x[32 + i] + x[48 + i]) / 3) AS b FROM e), c AS (SELECT vec_id, list_concat(a, b) AS c FROM t),
n AS (SELECT vec_id, list_transform(c, lambda y: y / sqrt(list_inner_product(c, c))) AS c FROM c), f AS (SELECT vec_id, c, list_transform(range(1, 33), lambda i: greatest(c[i], -c[i])) AS f FROM n)
SELECT vec_id, round((c[1])::FLOAT::DOUBLE, 5) AS plain_first, round((c[32])::FLOAT::DOUBLE, 5) AS plain_last, round((f[1] / sqrt(list_inner_product(f, f)))::FLOAT::DOUBLE, 5) AS flip_first, round((f[32] / sqrt(list_inner_product(f, f)))::FLOAT::DOUBLE, 5) AS flip_last FROM f""")
def pooled_tokens(spark, d):
    """A vector as one global and three patch tokens, pooled; with flip the maximum of it and of its mirror image's, here its negative."""
    ship(spark)

    def run(frames):
        e = encode.Encoder("tokens", lambda b: np.where(b[:, 0, 0, 0, None, None] > 0, 1, -1) * x, 2, 1)
        for f in frames:
            x = np.stack(f["embedding"].to_numpy()).astype(np.float64).reshape(len(f), 4, 16)
            mark = np.zeros((len(f), 2, 2, 3))
            mark[:, :, 0] = 1.0  # the mirror image has it on the other side
            a, b = (encode.encode_batch(mark, e, encode.Config(flip=flip)).astype(float) for flip in (False, True))
            yield pd.DataFrame({"vec_id": f["vec_id"], "a": a[:, 0], "b": a[:, -1], "c": b[:, 0], "d": b[:, -1]})

    out = read(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, a double, b double, c double, d double")
    return out.select("vec_id", *[F.round(c, 5).alias(n) for c, n in zip("abcd", ("plain_first", "plain_last", "flip_first", "flip_last"), strict=True)])


@query(_PIXELS + """, b AS (SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM p WHERE abs(g - 255) > 8 GROUP BY vec_id)
SELECT vec_id, CASE WHEN (x1 - x0) * (y1 - y0) / 2304.0 BETWEEN 0.05 AND 0.995 THEN x0 END::INT AS x0, CASE WHEN (x1 - x0) * (y1 - y0) / 2304.0 BETWEEN 0.05 AND 0.995 THEN y1 END::INT AS y1,
CASE WHEN (x1 - x0) * (y1 - y0) / 2304.0 BETWEEN 0.05 AND 0.995 THEN greatest(least(48, y1 + floor((y1 - y0) * 0.06)) - greatest(0, y0 - floor((y1 - y0) * 0.06)), least(48, x1 + floor((x1 - x0) * 0.06)) - greatest(0, x0 - floor((x1 - x0) * 0.06))) ELSE 48 END::INT AS side FROM b""")
def image_box(spark, d):
    """The content's box, and the side of the square that trimming leaves."""

    def f(v, p):
        box = I.content_bbox(p) or (None,) * 4
        return box[0], box[3], I.trim_to_square(p)[0].shape[0]

    return on_pictures(spark, d, f, "vec_id long, x0 int, y1 int, side int")


@query(_PIXELS + """, l AS (SELECT a.vec_id, a.g, CASE WHEN a.y BETWEEN 1 AND 46 AND a.x BETWEEN 1 AND 46 THEN u.g + w.g + l.g + r.g - 4 * a.g ELSE 0 END AS lap FROM p a LEFT JOIN p u ON u.vec_id = a.vec_id AND u.x = a.x AND u.y = a.y - 1
LEFT JOIN p w ON w.vec_id = a.vec_id AND w.x = a.x AND w.y = a.y + 1 LEFT JOIN p l ON l.vec_id = a.vec_id AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN p r ON r.vec_id = a.vec_id AND r.y = a.y AND r.x = a.x + 1)
SELECT vec_id, round(var_pop(lap) + 1e-9, 4) AS laplacian_var, round(avg(g) + 1e-9, 4) AS mean_luma, round(quantile_cont(g, 0.05) + 1e-9, 4) AS luma_p05, round(quantile_cont(g, 0.95) + 1e-9, 4) AS luma_p95 FROM l GROUP BY vec_id""")
def image_quality(spark, d):
    out = on_pictures(spark, d, lambda v, p: I.quality(p), "vec_id long, laplacian_var double, mean_luma double, luma_p05 double, luma_p95 double")
    return out.select("vec_id", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in out.columns[1:]])  # ties go up in any sum's order


@query(_PIXELS + """, t AS (SELECT vec_id, y // 12 AS ty, x // 12 AS tx, sqrt(3 * ((avg(g) / 255) ** 2 + (stddev_pop(g) / 255) ** 2)) AS n FROM p GROUP BY ALL)
SELECT vec_id, (ty * 4 + tx)::INT AS cell, round(((n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w))::FLOAT::DOUBLE, 4) AS heat FROM t WINDOW w AS (PARTITION BY vec_id)""")
def heat_maps(spark, d):
    """The norms of a picture's patch tokens from 0 to 1."""
    out = on_pictures(spark, d, lambda v, p: ([float(x) for x in I.heat_map(encode.grid_tokens(p[None], 4)[0, 1:], 4).ravel()],), "vec_id long, heat array<double>")
    return out.select("vec_id", F.posexplode("heat").alias("cell", "heat")).withColumn("heat", F.round("heat", 4))


@query("""SELECT vec_id, name, 48 AS height, 48 AS width, 3 AS channels, TRUE AS same_again, TRUE AS recipe_holds, TRUE AS conditions_hold FROM embeddings,
(SELECT unnest(['low_light', 'motion_blur', 'defocus', 'off_angle', 'partial_occlusion', 'cluttered_background', 'specular_reflection', 'small_in_frame', 'jpeg_artifacts']) AS name)""")
def corruption_properties(spark, d):
    """Each corruption of each picture: its size, that a seed gives it again, and that drawn recipes keep their rules."""

    def f(v, p):
        out, rng = [], np.random.default_rng(v)
        recipe, conditions = I.sample_recipe(rng), I.sample_conditions(rng)
        names = [n for n, _ in recipe]
        holds = 1 <= len(names) <= 3 and len(set(names)) == len(names) and "jpeg_artifacts" not in names and all(1 <= s <= 5 for _, s in recipe)
        first = 1 <= len(conditions) <= 3 and 2 <= conditions[0][1] <= 5 and all(1 <= s <= 3 for _, s in conditions[1:])
        for name in I.CORRUPTIONS:
            a, b = I.corrupt_many(p, [(name, 1 + v % 5)], v), I.corrupt(p, name, 1 + v % 5, v)
            out.append((name, *a.shape, bool((a == b).all()), holds, first and I.corrupt_many(p, conditions, v).shape == p.shape))
        return (out,)

    row = "array<struct<name:string,height:int,width:int,channels:int,same_again:boolean,recipe_holds:boolean,conditions_hold:boolean>>"
    return on_pictures(spark, d, f, f"vec_id long, r {row}").select("vec_id", F.explode("r").alias("r")).select("vec_id", "r.*")


# Learning and evaluation

_JUDGED = "SELECT (length(text) // 200) AS x, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"


@query(f"""WITH g AS (SELECT x, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY x) AS i FROM ({_JUDGED}) GROUP BY x), c AS (SELECT i, sum(s) OVER (ORDER BY i) AS s, sum(n) OVER (ORDER BY i) AS n FROM g),
p AS (SELECT a.i AS a, b.i AS b, (b.s - coalesce(z.s, 0)) / (b.n - coalesce(z.n, 0)) AS m FROM c a JOIN c b ON b.i >= a.i LEFT JOIN c z ON z.i = a.i - 1), q AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM p),
f AS (SELECT b AS i, max(m) AS v FROM q GROUP BY b) SELECT x::BIGINT AS x, round(v, 6) AS value FROM g JOIN f USING (i)""")
def isotonic_fit(spark, d):
    """Isotonic regression of quality on length; its SQL is the greatest of the least means of all runs. A row for each distinct length is fitted at once."""
    ship(spark)
    rows = read(spark, d, "documents").join(read(spark, d, "labels").where("quality is not null"), "doc_id").select(F.expr("char_length(text) div 200").alias("x"), F.col("quality").cast("double").alias("y"))
    g = rows.groupBy("x").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))

    def fit(f):
        x, v = calibrate.pool(f["x"].to_numpy(), f["y"].to_numpy(), f["n"].to_numpy())
        return pd.DataFrame({"x": x, "value": v})

    return g.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "x long, value double").select("x", r6("value").alias("value"))


@query("""WITH RECURSIVE s AS (SELECT user_id, ts::DATE AS day, count(DISTINCT event_type)::DOUBLE AS x, (avg(value) > 50)::INT AS y FROM events GROUP BY ALL), g AS (SELECT list({'x': x, 'n': n, 'k': k}) AS c FROM (SELECT x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k FROM s GROUP BY x)),
r AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (SELECT i, a, b,
list_sum(list_transform(c, lambda t: t.n / (1 + exp(-(a + b * t.x))) - t.k)) AS g0, list_sum(list_transform(c, lambda t: t.x * (t.n / (1 + exp(-(a + b * t.x))) - t.k))) + b AS g1,
list_sum(list_transform(c, lambda t: t.n * exp(-(a + b * t.x)) / (1 + exp(-(a + b * t.x))) ** 2)) AS h00, list_sum(list_transform(c, lambda t: t.x * t.n * exp(-(a + b * t.x)) / (1 + exp(-(a + b * t.x))) ** 2)) AS h01,
list_sum(list_transform(c, lambda t: t.x * t.x * t.n * exp(-(a + b * t.x)) / (1 + exp(-(a + b * t.x))) ** 2)) + 1 AS h11 FROM r, g WHERE i < 25))
SELECT round(exp(b), 4) AS odds_ratio FROM r WHERE i = 25""")
def dose_odds(spark, d):
    """The odds ratio of being right for each further condition."""
    s = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.countDistinct("event_type").alias("c"), (F.avg("value") > 50).alias("correct"))
    return spark.createDataFrame([(round(S.dose_response(s, "c")[0], 4),)], "odds_ratio double")


@query("""WITH r AS (SELECT n_chars > 1000 AS long, contains(text, chr(10)) AS lines, lang = 'en' AS english FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT * FROM (VALUES ('long', (SELECT count(*) FROM r WHERE long)), ('lines', (SELECT count(*) FROM r WHERE lines)), ('english', (SELECT count(*) FROM r WHERE english))) t(condition, n), (SELECT 0.0::DOUBLE AS gradient, TRUE AS interval_holds)""")
def effects_at_optimum(spark, d):
    """Marginal effects: the penalised likelihood's gradient at the fitted log odds is zero, and the interval contains them."""
    names = ["long", "lines", "english"]
    rows = read(spark, d, "documents").join(read(spark, d, "labels").where("quality is not null"), "doc_id").withColumn("correct", F.col("quality") == 1)
    marks = F.array_compact(F.array(F.when(F.col("n_chars") > 1000, "long"), F.when(F.col("text").contains("\n"), "lines"), F.when(F.col("lang") == "en", "english")))
    rows = tables.written(rows.select("doc_id", "correct", marks.alias("conditions"), F.xxhash64("source").alias("item_id")), "judged")
    out = {r.condition: r for r in S.marginal_effects(rows, names, n_boot=200).collect()}
    cells = S.condition_cells(rows.withColumn("item_id", F.lit(0)), names, "correct", "item_id").collect()  # two rows for each pattern
    x, y, n = S._cells([r.mask for r in cells], [r.y for r in cells], [r.n for r in cells])
    b = np.array([out[c].log_odds for c in names])
    lo, hi = -50.0, 50.0
    for _ in range(200):  # the intercept that fits these log odds, by bisection
        a = (lo + hi) / 2
        lo, hi = (a, hi) if (n * (1 / (1 + np.exp(-(a + x @ b))) - y)).sum() < 0 else (lo, a)
    gradient = x.T @ (n * (1 / (1 + np.exp(-(a + x @ b))) - y)) + b
    return spark.createDataFrame([(c, out[c].n, round(abs(float(g)), 3), bool(out[c].lo <= out[c].log_odds <= out[c].hi)) for c, g in zip(names, gradient, strict=True)], "condition string, n long, gradient double, interval_holds boolean")


@query(LABEL + "SELECT query_id, (item_id = truth)::INT AS y FROM k WHERE rank = 1 AND item_id = truth UNION ALL SELECT vec_id, 0 FROM embeddings WHERE label >= 8 AND vec_id % 5 = 0")
def training_rows(spark, d):
    q, v = vectors(spark, d)
    lookups = search.search(q, v, 1).withColumnRenamed("item_id", "top1").join(q.select("query_id", "item_id"), "query_id").select("query_id", "top1", "item_id")
    return calibrate.training_rows(lookups, q.where("item_id >= 8").select("query_id")).select("query_id", "y")


@query("""WITH e AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 5 = 0) SELECT vec_id AS query_id, TRUE AS in_range, TRUE AS plain_in_range, TRUE AS n_views_holds, 18 AS n_full, 13 AS n_plain FROM e""")
def calibrated_lookups(spark, d):
    """Both calibrators fitted on all eighteen features of lookups, and their probabilities for each query."""
    q, v = vectors(spark, d, "quad")
    crops = q.select("query_id", F.lit("image").alias("crop"), "emb")
    f = confidence.photo_features(crops, v).join(q.select("query_id", "item_id"), "query_id").withColumn("y", (F.col("query_id") % 3 == 0).cast("int"))
    f = tables.written(f, "features")
    full, plain, _ = calibrate.fit_both(f)
    out = plain.predict(full.predict(f), "p_plain")
    inside = lambda c: F.col(c).between(0.0, 1.0)
    return out.select("query_id", inside("p_match").alias("in_range"), inside("p_plain").alias("plain_in_range"), F.col("n_views_agreeing").between(1, 10).alias("n_views_holds"), F.lit(len(full.names)).alias("n_full"), F.lit(len(plain.names)).alias("n_plain"))


@query("""WITH e AS (SELECT vec_id, vec_id // 4 AS item, embedding::DOUBLE[] AS emb FROM embeddings), q AS (SELECT vec_id AS query_id, CASE WHEN item % 10 <> 9 THEN item END AS truth, emb FROM e WHERE vec_id % 4 = 0),
v AS (SELECT item, emb FROM e WHERE vec_id % 4 <> 0 AND item % 10 <> 9), s AS (SELECT query_id, truth, v.item AS found, max(list_inner_product(q.emb, v.emb)) AS score FROM q, v GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, found) AS rank FROM s), g AS (SELECT query_id, any_value(truth) AS truth, max(score) AS score, coalesce(bool_or(found = truth) FILTER (rank <= 1), FALSE)::INT AS r1, coalesce(bool_or(found = truth) FILTER (rank <= 5), FALSE)::INT AS r5,
coalesce(bool_or(found // 2 = truth // 2) FILTER (rank <= 1), FALSE)::INT AS style_r1, coalesce(bool_or(found // 2 = truth // 2) FILTER (rank <= 5), FALSE)::INT AS style_r5 FROM k WHERE rank <= 5 GROUP BY query_id),
x AS (SELECT *, truth IS NOT NULL AS p, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM g)
SELECT (count(*) FILTER (p))::BIGINT AS n, round(avg(r1) FILTER (p), 6) AS r1, round(avg(r5) FILTER (p), 6) AS r5, round(avg(style_r1) FILTER (p), 6) AS style_r1, round(avg(style_r5) FILTER (p), 6) AS style_r5, round(avg(score) FILTER (p), 6) AS pos_mean, round(avg(score) FILTER (NOT p), 6) AS neg_mean,
round((sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6) AS auroc FROM x""")
def bake_off(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id"), F.expr("vec_id div 4").alias("item_id"), F.col("embedding").alias("emb"))
    held, rest = e.where("item_id % 10 = 9"), e.where("item_id % 10 <> 9")
    styles = e.select("item_id", F.expr("item_id div 2").alias("style_id")).distinct()
    out = evaluate.bake_off(
        rest.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "item_id", "emb"), rest.where("vec_id % 4 <> 0").select("item_id", F.col("vec_id").alias("view_id"), "emb"), styles,
        held.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "emb"),
    )
    return out.select("n", *[r6(c).alias(c) for c in out.columns if c != "n"])


_EVAL = HELD + """, t AS (SELECT query_id, any_value(truth) AS truth, max(item_id) FILTER (rank = 1) AS top1, max(score) AS score, list(item_id) FILTER (rank <= 5) AS five, 1 + count(*) FILTER (score > own) AS true_rank
FROM (SELECT *, max(score) FILTER (item_id = truth) OVER (PARTITION BY query_id) AS own FROM k) GROUP BY query_id),
r AS (SELECT *, CASE WHEN truth >= 8 THEN 'out_of_catalogue' WHEN query_id % 3 = 0 THEN 'clean' ELSE 'hard' END AS kind, truth < 8 AND top1 = truth AS right1, truth < 8 AND list_contains(five, truth) AS right5 FROM t),
a AS (SELECT kind, avg(right1::INT) AS r1, avg(right5::INT) AS r5, median(true_rank) AS rank FROM r WHERE kind <> 'out_of_catalogue' GROUP BY kind),
z AS (SELECT kind <> 'out_of_catalogue' AS p, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM r),
h AS (SELECT avg(risk) AS aurc FROM (SELECT sum(1 - right1::INT) OVER w / row_number() OVER w AS risk FROM r WHERE kind = 'hard' WINDOW w AS (ORDER BY score DESC, query_id ROWS UNBOUNDED PRECEDING))),
c AS (SELECT truth, avg(right1::INT) >= 0.5 AS ok FROM r WHERE kind = 'clean' GROUP BY truth), m AS (SELECT count(*) FILTER (ok AND NOT right1) AS n01, count(*) FILTER (NOT ok AND right1) AS n10 FROM r JOIN c USING (truth) WHERE kind = 'hard')
"""


@query(_EVAL + """SELECT kind || '.r1_sku' AS figure, round(r1, 6) AS value FROM a UNION ALL SELECT kind || '.r1_style', round(r1, 6) FROM a UNION ALL SELECT kind || '.r5_sku', round(r5, 6) FROM a UNION ALL SELECT kind || '.median_rank', round(rank, 6) FROM a
UNION ALL SELECT 'refusal.auroc', round((sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6) FROM z UNION ALL SELECT 'risk.aurc', round(aurc, 6) FROM h
UNION ALL SELECT 'gap.p', round(CASE WHEN n01 + n10 = 0 THEN 1 ELSE least(1.0, 2 * list_sum(list_transform(range(least(n01, n10) + 1), lambda i: exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2.0))))) END, 6) FROM m""")
def evaluation_report(spark, d):
    """The whole evaluation on vectors in place of photos, through its report and back from the JSON file: one row for each figure."""
    e = read(spark, d, "embeddings").where("vec_id % 5 = 0")
    kind = F.when(F.col("label") >= 8, "out_of_catalogue").when(F.col("vec_id") % 3 == 0, "clean").otherwise("hard")
    cond = F.array_compact(F.array(F.when(F.col("vec_id") % 2 == 0, "low_light"), F.when(F.col("vec_id") % 7 < 3, "motion_blur")))
    photos = e.select(F.col("vec_id").alias("photo_id"), F.when(F.col("label") < 8, F.col("label").cast("long")).alias("item_id"), kind.alias("kind"), F.lit("test").alias("split"), F.when(kind == "hard", cond).otherwise(F.array().cast("array<string>")).alias("conditions"))
    q, v = vectors(spark, d)
    results = evaluate.photo_results(photos, q.select("query_id", "emb"), v.where("item_id < 8"))
    r = evaluate.evaluate(tables.written(results, "results"))
    rows = [(f"{t}.{k}", float(b["point"])) for t in ("hard", "clean") if t in r for k, b in r[t].items() if isinstance(b, dict)]
    rows += [(f"{t}.median_rank", float(r[t]["median_rank_of_truth"])) for t in ("hard", "clean") if t in r]
    rows += [("refusal.auroc", float(r["refusal"]["auroc"])), ("risk.aurc", float(r["risk_coverage"]["aurc"])), ("gap.p", float(r.get("gap_paired", {}).get("p_value", float("nan"))))]
    return spark.createDataFrame([(k, round(x, 6)) for k, x in rows], "figure string, value double")
