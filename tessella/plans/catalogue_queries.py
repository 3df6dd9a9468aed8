"""The catalogue operators as queries over the supplied tables, each with its DuckDB SQL where SQL can express it.

In the search queries a view is a row of embeddings, its item the label (or vec_id div 4 where many items are needed). Plain searches ask with every
fiftieth vector against all rows; where a figure needs queries that aren't indexed, every fifth vector is a query and the others are the index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import images as I
from tessella.functions import text as X
from tessella.functions import vectors as V
from tessella.operators import catalogue, confidence, evaluate, graph, guards, search
from tessella.operators import stats as S
from tessella.operators.search import ship
from tessella.operators.vector_index import Whitening
from tessella.sources.tables import read

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def r6(c):
    return F.round(c, 6)


def vectors(spark, d, item="label"):
    """(queries: query_id, truth, emb; views: item_id, view_id, emb)"""
    e = read(spark, d, "embeddings").withColumn("item", F.col("label").cast("long") if item == "label" else F.expr("vec_id div 4"))
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("item").alias("item_id"), F.col("embedding").alias("emb"))
    return q, e.where("vec_id % 5 <> 0").select(F.col("item").alias("item_id"), F.col("vec_id").alias("view_id"), F.col("embedding").alias("emb"))


def whole(spark, d):
    """The stated query set, ids divisible by 50, against all rows."""
    e = read(spark, d, "embeddings").withColumn("item_id", F.col("label").cast("long"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("emb")), e.select("item_id", F.col("vec_id").alias("view_id"), F.col("embedding").alias("emb"))


def sql_scores(item="label::BIGINT") -> str:
    return f"""WITH e AS (SELECT vec_id, {item} AS item, embedding::DOUBLE[] AS emb FROM embeddings),
q AS (SELECT vec_id AS query_id, item AS truth, emb FROM e WHERE vec_id % 5 = 0), v AS (SELECT vec_id AS view_id, item AS item_id, emb FROM e WHERE vec_id % 5 <> 0),
p AS (SELECT query_id, truth, item_id, view_id, list_inner_product(q.emb, v.emb) AS score FROM q, v),
s AS (SELECT query_id, any_value(truth) AS truth, item_id, max(score) AS score, max(view_id) FILTER (score = m) AS best_view FROM (SELECT *, max(score) OVER (PARTITION BY query_id, item_id) AS m FROM p) GROUP BY query_id, item_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)
"""


LABEL, QUAD = sql_scores(), sql_scores("vec_id // 4")
WHOLE = LABEL.replace("FROM e WHERE vec_id % 5 = 0)", "FROM e WHERE vec_id % 50 = 0)").replace("FROM e WHERE vec_id % 5 <> 0)", "FROM e)")


@query(WHOLE + "SELECT query_id, rank, item_id, round(score, 6) AS score, best_view FROM k WHERE rank <= 5")
def search_topk(spark, d):
    q, v = whole(spark, d)
    return search.search(q, v, 5).select("query_id", "rank", "item_id", r6("score").alias("score"), "best_view")


@query(WHOLE + "SELECT query_id, rank, item_id, round(score, 6) AS score, best_view FROM k WHERE rank <= 3")
def search_topk_builtin(spark, d):
    q, v = whole(spark, d)
    return search.search_sql(q, v, 3).select("query_id", "rank", "item_id", r6("score").alias("score"), "best_view")


@query(WHOLE + "SELECT query_id, item_id, round(score, 6) AS score, best_view FROM s")
def search_best_view(spark, d):
    return search.item_scores(*whole(spark, d)).select("query_id", "item_id", r6("score").alias("score"), "best_view")


@query(LABEL + "SELECT a.query_id, a.truth AS item_id, 1 + sum((b.score > a.score)::BIGINT)::BIGINT AS rank FROM s a JOIN s b USING (query_id) WHERE a.item_id = a.truth GROUP BY ALL")
def rank_of_truth(spark, d):
    return search.rank_of_truth(*vectors(spark, d))


@query(LABEL + "SELECT count(*)::BIGINT AS n, round(avg((t <= 1)::INT), 6) AS r1, round(avg((t <= 5)::INT), 6) AS r5, round(avg(score), 6) AS top_mean FROM (SELECT query_id, coalesce(min(rank) FILTER (item_id = truth), 1000000) AS t, max(score) AS score FROM k GROUP BY query_id)")
def recall_at_k(spark, d):
    q, v = vectors(spark, d)
    best = search.search(q, v, 5).join(q.select("query_id", F.col("item_id").alias("truth")), "query_id")
    each = best.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("item_id") == F.col("truth"), F.col("rank"))), F.lit(1000000)).alias("t"), F.max("score").alias("score"))
    hit = lambda n: r6(F.avg((F.col("t") <= n).cast("double")))
    return each.agg(F.count(F.lit(1)).alias("n"), hit(1).alias("r1"), hit(5).alias("r5"), r6(F.avg("score")).alias("top_mean"))


HELD = LABEL.replace("v AS (SELECT vec_id AS view_id, item AS item_id, emb FROM e WHERE vec_id % 5 <> 0)", "v AS (SELECT vec_id AS view_id, item AS item_id, emb FROM e WHERE vec_id % 5 <> 0 AND item < 8)")
AUROC = """, x AS (SELECT {score} AS s, {pos} AS p FROM {rows}), r AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM x)
SELECT round((sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6) AS auroc, (count(*) FILTER (p))::BIGINT AS n_pos, (count(*) FILTER (NOT p))::BIGINT AS n_neg FROM r"""


@query(HELD + AUROC.format(score="score", pos="truth < 8", rows="k WHERE rank = 1"))
def open_set_auroc(spark, d):
    q, v = vectors(spark, d)
    best = search.search(q, v.where("item_id < 8"), 1).join(q.select("query_id", (F.col("item_id") < 8).alias("positive")), "query_id")
    return S.auroc(best).select(r6("auroc").alias("auroc"), "n_pos", "n_neg")


@query(QUAD + """, a AS (SELECT query_id, avg(score) AS mu, stddev_pop(score) AS sd FROM s GROUP BY query_id),
t AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, avg(score) FILTER (rank BETWEEN 2 AND 10) AS m10, avg(score) FILTER (rank BETWEEN 2 AND 100) AS m100, stddev_pop(score) FILTER (rank <= 10) AS sd10 FROM k GROUP BY query_id),
w AS (SELECT query_id, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.05) AS w FROM k WHERE rank <= 10),
h AS (SELECT query_id, -sum((w / (z + 1e-12)) * ln(w / (z + 1e-12) + 1e-12)) AS h FROM (SELECT query_id, w, sum(w) OVER (PARTITION BY query_id) AS z FROM w) GROUP BY query_id)
SELECT query_id, round(s1, 6) AS s1, round(s1 - s2, 6) AS margin_12, round(s1 / (s2 + 1e-9), 6) AS ratio_12, round(s1 - m10, 6) AS s1_minus_mean10, round(s1 - m100, 6) AS s1_minus_mean100, round((s1 - mu) / (sd + 1e-9), 6) AS zscore_q, round(sd10, 6) AS std_top10, round(h, 6) AS entropy_top10 FROM t JOIN a USING (query_id) JOIN h USING (query_id)""")
def score_features(spark, d):
    f = confidence.search_features(*vectors(spark, d, "quad"))
    return f.select("query_id", *[r6(c).alias(c) for c in f.columns if c != "query_id"])


@query(LABEL + """, b AS (SELECT query_id, max(score) AS s1 FROM s WHERE item_id < 8 GROUP BY query_id), z AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn FROM s WHERE item_id >= 8),
c AS (SELECT query_id, max(score) AS mx, avg(score) AS mean FROM z WHERE rn <= 10 GROUP BY query_id)
SELECT query_id, round(mx, 6) AS distractor_max, round(s1 - mx, 6) AS s1_minus_distractor_max, round(s1 - mean, 6) AS s1_minus_distractor_mean10 FROM b JOIN c USING (query_id)""")
def distractor_features(spark, d):
    q, v = vectors(spark, d)
    best = search.search(q, v.where("item_id < 8"), 1).select("query_id", F.col("score").alias("s1"))
    f = confidence.distractor_features(best, search.search(q, v.where("item_id >= 8"), 10))
    return f.select("query_id", *[r6(c).alias(c) for c in f.columns if c != "query_id"])


CROPS = """WITH e AS (SELECT vec_id, label::BIGINT AS item, embedding::DOUBLE[] AS emb FROM embeddings), v AS (SELECT vec_id, item, emb FROM e WHERE vec_id % 5 IN (3, 4)),
c AS (SELECT (vec_id // 5) * 5 AS query_id, vec_id % 5 AS crop, emb FROM e WHERE vec_id % 5 < 3),
p AS (SELECT query_id, crop, v.item AS item_id, max(list_inner_product(c.emb, v.emb)) AS score FROM c, v GROUP BY ALL),
f AS (SELECT query_id, item_id, max(score) AS score FROM p GROUP BY ALL)
"""


def crop_tables(spark, d):
    e = read(spark, d, "embeddings").withColumn("item_id", F.col("label").cast("long")).withColumnRenamed("embedding", "emb")
    crops = e.where("vec_id % 5 < 3").select(F.expr("(vec_id div 5) * 5").alias("query_id"), F.expr("vec_id % 5").alias("crop"), "emb")
    return crops, e.where("vec_id % 5 >= 3").select("item_id", F.col("vec_id").alias("view_id"), "emb")


@query(CROPS + "SELECT query_id, rank, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 5")
def crop_lookup(spark, d):
    crops, views = crop_tables(spark, d)
    return search.lookup(crops, views, 5).select("query_id", "rank", "item_id", r6("score").alias("score"))


@query(CROPS + """, cb AS (SELECT query_id, crop, item_id, row_number() OVER (PARTITION BY query_id, crop ORDER BY score DESC, item_id) AS rn FROM p), fb AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn FROM f)
SELECT cb.query_id, round(avg((cb.item_id = fb.item_id)::INT), 6) AS crop_agreement FROM cb JOIN fb USING (query_id) WHERE cb.rn = 1 AND fb.rn = 1 GROUP BY cb.query_id""")
def crop_agreement(spark, d):
    crops, views = crop_tables(spark, d)
    keyed = crops.select(F.expr("query_id * 10 + crop").alias("query_id"), "emb")
    crop_best = search.search(keyed, views, 1).withColumn("query_id", F.expr("query_id div 10"))
    final = search.lookup(crops, views, 1)
    return confidence.crop_agreement(crop_best, final).select("query_id", r6("crop_agreement").alias("crop_agreement"))


@query(CROPS + """SELECT query_id, list(item_id ORDER BY rank) AS top_ids FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f) WHERE rank <= 3 GROUP BY query_id""")
def lookup_records(spark, d):
    crops, views = crop_tables(spark, d)
    return search.as_record(search.lookup(crops, views, 3)).select("query_id", "top_ids")


RISK = LABEL + """, c AS (SELECT query_id AS id, score AS confidence, 1.0 - (item_id = truth)::INT AS err FROM k WHERE rank = 1),
u AS (SELECT id, row_number() OVER a AS place, row_number() OVER a / count(*) OVER () AS coverage, sum(err) OVER a / row_number() OVER a AS risk, sum(err) OVER b / row_number() OVER b AS oracle_risk FROM c
WINDOW a AS (ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING), b AS (ORDER BY err, id ROWS UNBOUNDED PRECEDING))
"""


def answered(spark, d):
    q, v = vectors(spark, d)
    best = search.search(q, v, 1).join(q.select("query_id", F.col("item_id").alias("truth")), "query_id")
    return best.select(F.col("query_id").alias("id"), F.col("score").alias("confidence"), (F.col("item_id") == F.col("truth")).alias("correct"))


@query(RISK + "SELECT id, place::BIGINT AS place, round(coverage, 6) AS coverage, round(risk, 6) AS risk, round(oracle_risk, 6) AS oracle_risk FROM u")
def risk_coverage(spark, d):
    return S.risk_curve(answered(spark, d)).select("id", "place", *[r6(c).alias(c) for c in ("coverage", "risk", "oracle_risk")])


@query(RISK + "SELECT round(avg(risk), 6) AS aurc, round(avg(risk) - avg(oracle_risk), 6) AS e_aurc FROM u")
def aurc(spark, d):
    return S.aurc(answered(spark, d)).select(r6("aurc").alias("aurc"), r6("e_aurc").alias("e_aurc"))


@query(HELD + """, c AS (SELECT truth < 8 AS inc, score <= 0.35 AS refused, item_id = truth AS ok FROM k WHERE rank = 1)
SELECT (count(*) FILTER (inc AND NOT refused AND ok))::BIGINT AS in_accepted_correct, (count(*) FILTER (inc AND NOT refused AND NOT ok))::BIGINT AS in_accepted_wrong, (count(*) FILTER (inc AND refused))::BIGINT AS in_refused,
round(avg((NOT refused)::INT) FILTER (NOT inc), 6) AS far, round(avg(refused::INT) FILTER (inc), 6) AS frr, round(avg((NOT refused AND NOT ok)::INT) FILTER (inc), 6) AS wrong_accept FROM c""")
def three_way_outcome(spark, d):
    q, v = vectors(spark, d)
    best = search.search(q, v.where("item_id < 8"), 1).join(q.select("query_id", F.col("item_id").alias("truth")), "query_id")
    rows = best.select((F.col("truth") < 8).alias("in_catalogue"), (F.col("score") <= 0.35).alias("refused"), (F.col("item_id") == F.col("truth")).alias("correct"))
    out = S.three_way(rows)
    return out.select("in_accepted_correct", "in_accepted_wrong", "in_refused", *[r6(c).alias(c) for c in ("far", "frr", "wrong_accept")])


CONF = LABEL + """, cal AS (SELECT score FROM k WHERE rank = 1 AND (query_id // 5) % 2 = 0), n AS (SELECT count(*) AS n FROM cal), t AS (SELECT query_id, rank, item_id, score, max(score) OVER (PARTITION BY query_id) AS top FROM k WHERE rank <= 5 AND (query_id // 5) % 2 = 1),
pv AS (SELECT query_id, rank, item_id, top, ((SELECT count(*) FROM cal WHERE cal.score < top * (CASE WHEN top > 0 THEN t.score / top ELSE 0 END)) + 1) / ((SELECT n FROM n) + 1) AS p FROM t)
"""


def cal_test(spark, d):
    q, v = vectors(spark, d)
    best = search.search(q, v, 5)
    half = F.expr("(query_id div 5) % 2")
    return best.where((half == 0) & (F.col("rank") == 1)).select("score"), best.where(half == 1).withColumn("p_match", F.max("score").over(Window.partitionBy("query_id")))


@query(CONF + "SELECT query_id, item_id, round(p, 6) AS p_value FROM pv")
def conformal_pvalue(spark, d):
    cal, test = cal_test(spark, d)
    top = F.max("score").over(Window.partitionBy("query_id"))
    own = test.withColumn("own", F.col("p_match") * F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)))
    return confidence.p_values(own, cal, "own").select("query_id", "item_id", r6("p_value").alias("p_value"))


@query(CONF + "SELECT query_id, (count(*) FILTER (p > 0.1))::BIGINT AS set_size, count(*) FILTER (p > 0.1) = 0 AS refused, round(any_value(top), 4) AS p_match, coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY rank) FILTER (p > 0.1), '') AS items FROM pv GROUP BY query_id")
def conformal_sets(spark, d):
    cal, test = cal_test(spark, d)
    s = confidence.prediction_sets(test, cal, 0.1)
    return s.select("query_id", F.size("items").cast("long").alias("set_size"), "refused", "p_match", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query(QUAD + "SELECT query_id, round(max(score) FILTER (item_id = truth), 6) AS same, round(max(score) FILTER (item_id <> truth), 6) AS other, round(max(score) FILTER (item_id = truth) - max(score) FILTER (item_id <> truth), 6) AS gap FROM s GROUP BY query_id")
def separability_gap(spark, d):
    return evaluate.search_separability(*vectors(spark, d, "quad")).select("query_id", *[r6(c).alias(c) for c in ("same", "other", "gap")])


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: 9 * x * x))), 5) AS norm_before, 1.0::DOUBLE AS norm_after, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS first FROM embeddings")
def l2_normalise(spark, d):
    e = read(spark, d, "embeddings").withColumn("v", F.transform(V.as_double(F.col("embedding")), lambda x: x * 3))
    u = e.withColumn("u", V.l2_normalise(F.col("v")))
    return u.select("vec_id", F.round(V.norm(F.col("v")), 5).alias("norm_before"), F.round(V.norm(F.col("u")), 5).alias("norm_after"), F.round(F.col("u")[0], 5).alias("first"))


@query()
def pca_whiten(spark, d):
    _, v = vectors(spark, d)
    return Whitening(16).fit(v).transform(v).select("item_id", "view_id", F.transform("emb", lambda x: F.round(F.abs(x), 4)).alias("size_of"))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS v, embedding::DOUBLE[] AS emb FROM embeddings), g AS (SELECT a.v AS a, b.v AS b FROM e a, e b WHERE a.v <> b.v AND round(list_inner_product(a.emb, b.emb), 6) >= 0.38),
r(v, u) AS (SELECT v, v FROM e UNION SELECT r.v, g.b FROM r JOIN g ON r.u = g.a)
SELECT v AS vec_id, min(u) AS component FROM r GROUP BY v""")
def style_components(spark, d):
    """Scores from 0.3799995 on are 0.38 at six places."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("emb"))
    return graph.components(e.select("v"), search.links(e, 0.3799995)).select(F.col("v").alias("vec_id"), "component")


URL = r"^(https?)://([^/]+)/([a-z]{2})/(\d+)"


@query(f"SELECT page_id, regexp_extract(url, '{URL}', 2) AS host, regexp_extract(url, '{URL}', 3) AS section, try_cast(regexp_extract(url, '{URL}', 4) AS BIGINT) AS number FROM pages WHERE regexp_matches(url, '{URL}')")
def url_parts(spark, d):
    p = read(spark, d, "pages").where(F.col("url").rlike(URL))
    part = lambda i: F.regexp_extract("url", URL, i)
    return p.select("page_id", part(2).alias("host"), part(3).alias("section"), part(4).cast("long").alias("number"))


@query(f"SELECT page_id, regexp_extract(url, '{URL}', 3) AS section FROM pages WHERE regexp_extract(url, '{URL}', 3) IN ('de', 'fr')")
def url_filter(spark, d):
    p = read(spark, d, "pages").withColumn("section", F.regexp_extract("url", URL, 3))
    return p.where(F.col("section").isin("de", "fr")).select("page_id", "section")


_HREF_SQL = '<a href="([^"]*)"'


@query(f"SELECT page_id, generate_subscripts(l, 1)::INT - 1 AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '{_HREF_SQL}', 1) AS l FROM pages)")
def html_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_HREF_SQL), 1)).alias("pos", "href"))


@query("WITH s AS (SELECT page_id, '<loc> ' || url || ' </loc><loc>' || url || '/x</loc>' AS t FROM pages) SELECT page_id, unnest(regexp_extract_all(t, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1)) AS loc FROM s")
def sitemap_locations(spark, d):
    t = F.concat(F.lit("<loc> "), "url", F.lit(" </loc><loc>"), "url", F.lit("/x</loc>"))
    return read(spark, d, "pages").select("page_id", F.explode(X.locations(t)).alias("loc"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE json_valid(props)")
def script_block_json(spark, d):
    e = read(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return e.where("v is not null").select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"))


def product_pages(spark, d):
    """Synthetic product pages around the rows of part, in the form that the parser reads."""
    p = read(spark, d, "part")
    body = F.to_json(
        F.struct(
            F.struct(
                F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"),
                F.struct(F.col("p_type").alias("articleType"), F.lit("x").alias("gender")).alias("analytics"),
                F.struct(
                    F.array(
                        F.struct(F.lit("default").alias("name"), F.array(F.struct(F.concat(F.lit("http://img/h_($height),q_($qualityPercentage),w_($width)/"), F.col("p_partkey").cast("string")).alias("src"))).alias("images")),
                        F.struct(F.lit("animated").alias("name"), F.array(F.struct(F.lit("http://img/no").alias("src"))).alias("images")),
                    ).alias("albums")
                ).alias("media"),
                F.array(F.struct((F.col("p_partkey") + 1).cast("string").alias("styleId"))).alias("colours"),
                F.array(F.col("p_partkey") + 2).alias("relatedStyles"),
            ).alias("pdpData")
        )
    )
    return p.select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("url"), F.concat(F.lit("<script>window.__myx = "), body, F.lit(";</script>")).alias("html"))


@query("SELECT p_partkey::BIGINT AS product_id, p_name AS name, p_brand AS brand, p_type AS article_type, 'https://img/h_1440,q_90,w_1080/' || p_partkey AS image, 1::BIGINT AS n_images, p_partkey::BIGINT + 1 AS colour, p_partkey::BIGINT + 2 AS related FROM part")
def parse_products(spark, d):
    out = catalogue.parse_products(product_pages(spark, d))
    return out.select("product_id", "name", "brand", "article_type", F.col("images")[0].alias("image"), F.size("images").cast("long").alias("n_images"), F.col("colour_variants")[0].alias("colour"), F.col("related_styles")[0].alias("related"))


@query("SELECT min(doc_id)::BIGINT AS doc_id, count(*)::BIGINT AS copies, md5(text) AS digest FROM documents GROUP BY text")
def dedupe_first_seen(spark, d):
    x = read(spark, d, "documents").withColumn("digest", F.md5("text"))
    first = catalogue.first_seen(x.select("doc_id", "digest"), ["digest"], ["doc_id"])
    return first.join(x.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "digest").select("doc_id", "copies", "digest")


@query("SELECT regexp_extract(url, '//([^/]+)', 1) AS host, min(page_id)::BIGINT AS page_id FROM pages GROUP BY 1")
def first_page_of_host(spark, d):
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    return catalogue.first_seen(p, ["host"], ["page_id"]).select("host", "page_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100")
def resume_antijoin(spark, d):
    return catalogue.pending(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id", 100)


@query("SELECT vec_id FROM embeddings WHERE label NOT IN (3, 7)")
def exclude_antijoin(spark, d):
    e = read(spark, d, "embeddings")
    out = spark.createDataFrame([(3,), (7,)], "label int")
    return e.join(out, "label", "left_anti").select("vec_id")


@query("""WITH i AS (SELECT vec_id AS item_id, label::BIGINT AS style_id FROM embeddings), x AS (SELECT * FROM i WHERE style_id < 7 AND item_id % 3 = 0)
SELECT item_id FROM i WHERE item_id NOT IN (SELECT item_id FROM x) AND style_id NOT IN (SELECT style_id FROM x)""")
def absent_styles(spark, d):
    i = read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("style_id"))
    indexed = i.where("style_id < 7 and item_id % 3 = 0").select("item_id")
    return catalogue.absent_items(i.select("item_id"), indexed, i).select("item_id")


@query("""WITH i AS (SELECT vec_id AS item_id, vec_id // 4 AS style_id FROM embeddings), p AS (SELECT *, row_number() OVER (ORDER BY md5('11:' || item_id), item_id) AS place FROM i), h AS (SELECT DISTINCT style_id FROM p WHERE place <= 20)
SELECT item_id, style_id IN (SELECT style_id FROM h) AS held FROM i""")
def hold_out_styles(spark, d):
    i = read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.expr("vec_id div 4").alias("style_id"))
    held, rest = catalogue.hold_out(i, 20, 11)
    return held.select("item_id", F.lit(True).alias("held")).unionByName(rest.select("item_id", F.lit(False).alias("held")))


@query("""WITH i AS (SELECT vec_id AS item_id FROM embeddings), p AS (SELECT item_id, row_number() OVER (ORDER BY md5('5:' || item_id), item_id) AS place, count(*) OVER () AS n FROM i)
SELECT item_id, CASE WHEN place <= greatest(1, n // 4) THEN 'dev' ELSE 'test' END AS split FROM p""")
def dev_test_split(spark, d):
    return catalogue.dev_test(read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id")), 5)


TOKENS = """WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS t FROM benchmark), d AS (SELECT doc_id AS item_id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS t FROM documents),
qe AS (SELECT query_id, len(t) AS nq, unnest(t) AS tok FROM q), de AS (SELECT item_id, len(t) AS nt, unnest(t) AS tok FROM d),
p AS (SELECT query_id, item_id, count(*) / any_value(nq) - 0.0005 * greatest(0, any_value(nt) - any_value(nq)) AS score FROM qe JOIN de USING (tok) GROUP BY query_id, item_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM p), b AS (SELECT query_id FROM k WHERE rank = 1 AND score >= 0.5)
"""


def token_tables(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")


@query(TOKENS + "SELECT query_id, rank, item_id, round(score, 6) AS score FROM k WHERE rank <= 3 AND query_id IN (SELECT query_id FROM b)")
def token_overlap_topk(spark, d):
    return catalogue.resolve_titles(*token_tables(spark, d), per_extra=0.0005)[0].select("query_id", "rank", "item_id", r6("score").alias("score"))


@query(TOKENS + "SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM b)")
def token_unmatched(spark, d):
    return catalogue.resolve_titles(*token_tables(spark, d), per_extra=0.0005)[1]


@query("SELECT page_id, printf('images/%02d/%d/%d.jpg', page_id % 100, page_id, 0) AS path FROM pages")
def shard_path(spark, d):
    return read(spark, d, "pages").select("page_id", X.shard_path(F.col("page_id"), F.lit(0).cast("long")).alias("path"))


DAY = "SELECT user_id, ts::DATE AS day, list_sort(list_distinct(list(event_type))) AS types FROM events GROUP BY user_id, ts::DATE"


def day_sets(spark, d):
    e = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    return e.agg(F.array_sort(F.collect_set("event_type")).alias("types")).withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")))


@query(f"WITH s AS ({DAY}) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, array_to_string(types, '|') AS packed, len(types)::BIGINT AS n FROM s")
def array_split_conditions(spark, d):
    packed = day_sets(spark, d).select("user_id", F.col("day").cast("string").alias("day"), F.concat(F.lit(" "), F.array_join("types", " | "), F.lit("|")).alias("raw"))
    parts = X.split_list(F.col("raw"))
    return packed.select("user_id", "day", F.array_join(parts, "|").alias("packed"), F.size(parts).cast("long").alias("n"))


@query(f"WITH s AS ({DAY}) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, list_contains(types, 'click')::INT::DOUBLE AS click, list_contains(types, 'error')::INT::DOUBLE AS error FROM s")
def one_hot(spark, d):
    return day_sets(spark, d).select("user_id", F.col("day").cast("string").alias("day"), *X.one_hot(F.col("types"), ["click", "error"]))


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def status_counts(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), r6(F.avg("value")).alias("mean"))


@query(f"WITH s AS ({DAY}) SELECT count(*)::BIGINT AS photos, count(DISTINCT user_id)::BIGINT AS items, round(sum(len(types)) FILTER (user_id % 2 = 0) / greatest(count(*) FILTER (user_id % 2 = 0), 1), 6) AS mean_conditions_hard FROM s")
def manifest_summary(spark, d):
    hard = F.col("user_id") % 2 == 0
    return day_sets(spark, d).agg(
        F.count(F.lit(1)).alias("photos"), F.countDistinct("user_id").alias("items"),
        r6(F.sum(F.when(hard, F.size("types"))) / F.greatest(F.count(F.when(hard, 1)), F.lit(1))).alias("mean_conditions_hard"),
    )


#: Replicates of the bootstrap query.
BOOT = 10_000


def judged_events(spark, d):
    return read(spark, d, "events").withColumn("correct", F.col("value") > 50)


@query("""WITH g AS (SELECT event_type, count(*)::BIGINT AS n, sum((value > 50)::INT)::BIGINT AS k FROM events GROUP BY event_type)
SELECT event_type, n, k, round(k / n, 6) AS acc, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM g""")
def wilson_by_type(spark, d):
    return S.accuracy(judged_events(spark, d), "event_type").select("event_type", "n", "k", *[r6(c).alias(c) for c in ("acc", "lo", "hi")])


@query(f"""WITH g AS (SELECT user_id AS g, sum((value > 50)::INT)::DOUBLE AS s, count(*) AS n FROM events GROUP BY user_id),
p AS (SELECT b, s, n, substr(md5('b-' || b // 4 || '-' || g), 1 + 8 * (b % 4)::INT, 8) AS u FROM g, range({BOOT}) x(b)),
w AS (SELECT *, len(list_filter({list(S.POISSON)!r}, lambda c: u >= c)) AS times FROM p),
t AS (SELECT b, sum(times * s) / sum(times * n) AS m FROM w WHERE times > 0 GROUP BY b)
SELECT round((SELECT sum(s) / sum(n) FROM g), 6) AS point, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, (SELECT sum(n) FROM g)::BIGINT AS n FROM t""")
def cluster_bootstrap(spark, d):
    out = S.cluster_bootstrap(judged_events(spark, d), "correct", "user_id", BOOT)
    return out.select(*[r6(c).alias(c) for c in ("point", "lo", "hi")], "n")


@query("""WITH h AS (SELECT user_id, avg(value) > 50 AS b FROM events WHERE event_type = 'error' GROUP BY user_id), c AS (SELECT user_id, avg((value > 50)::INT) >= 0.5 AS a FROM events WHERE event_type = 'click' GROUP BY user_id),
p AS (SELECT a, b FROM h JOIN c USING (user_id)), n AS (SELECT count(*) AS n_pairs, count(*) FILTER (a AND NOT b) AS n01, count(*) FILTER (b AND NOT a) AS n10, avg(a::INT) - avg(b::INT) AS delta FROM p)
SELECT n01::BIGINT AS n01, n10::BIGINT AS n10, round(CASE WHEN n01 + n10 = 0 THEN 1 ELSE least(1.0, 2 * list_sum(list_transform(range(least(n01, n10) + 1), lambda i: exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2.0))))) END, 6) AS p_value,
round(CASE WHEN n01 + n10 = 0 THEN 0 ELSE delta END, 6) AS delta, n_pairs::BIGINT AS n_pairs FROM n""")
def mcnemar_paired(spark, d):
    e = judged_events(spark, d)
    hard = e.where("event_type = 'error'").groupBy("user_id").agg((F.avg("value") > 50).alias("correct"))
    both = S.paired(hard, e.where("event_type = 'click'"), "user_id")
    return S.mcnemar(both, "clean_correct", "hard_correct").select("n01", "n10", r6("p_value").alias("p_value"), r6("delta").alias("delta"), "n_pairs")


@query(f"""WITH s AS ({DAY}), e AS (SELECT user_id, day, unnest(types) AS v FROM s), n AS (SELECT v, count(*) AS n FROM e GROUP BY v), b AS (SELECT x.v AS a, y.v AS b, count(*) AS c FROM e x JOIN e y USING (user_id, day) GROUP BY ALL)
SELECT x.v AS a, y.v AS b, coalesce(c, 0)::BIGINT AS together, round(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0)), 6) AS jaccard FROM n x CROSS JOIN n y LEFT JOIN b ON b.a = x.v AND b.b = y.v""")
def cooccurrence_jaccard(spark, d):
    out = S.cooccurrence(day_sets(spark, d), "key", F.col("types"))
    return out.select("a", "b", F.col("both").alias("together"), r6("jaccard").alias("jaccard"))


@query(f"WITH s AS ({DAY}), c AS (SELECT len(types)::BIGINT AS n_conditions, count(*) AS n FROM s GROUP BY 1) SELECT i::BIGINT AS n_conditions, coalesce(n, 0)::BIGINT AS n FROM range((SELECT max(n_conditions) + 1 FROM c)) r(i) LEFT JOIN c ON c.n_conditions = i")
def condition_histogram(spark, d):
    return S.condition_histogram(day_sets(spark, d), "types")


def day_outcomes(spark, d):
    """user_id, day, c (how many event types) and correct: whether the mean value is above 50.

    Values are added one by one in order of event_id, as the SQL reads the table: where the exact mean is 50, doubles may end on either side of it in
    another order, and countDistinct beside a mean makes Spark add type by type.
    """
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("user_id", "day").orderBy("event_id", "ts", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.select("user_id", "day", "event_type", "value", F.sum("value").over(w).alias("upto"), F.row_number().over(w).alias("place"))
    g = e.groupBy("user_id", "day").agg(F.size(F.collect_set("event_type")).cast("long").alias("c"), F.max_by("upto", "place").alias("total"), F.count("value").alias("n"))
    return g.select("user_id", "day", "c", (F.try_divide("total", "n") > 50).alias("correct"))


@query("""WITH s AS (SELECT user_id, ts::DATE AS day, count(DISTINCT event_type)::BIGINT AS level, avg(value) > 50 AS ok FROM events GROUP BY ALL), g AS (SELECT level, count(*)::BIGINT AS n, sum(ok::INT)::BIGINT AS k FROM s GROUP BY level)
SELECT level, n, k, round(k / n, 6) AS acc FROM g""")
def dose_response(spark, d):
    return S.dose_response(day_outcomes(spark, d), "c")[1].select("level", "n", "k", r6("acc").alias("acc"))


@query()
def marginal_effects(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").withColumn("correct", F.col("quality") == 1)
    marks = F.array_compact(F.array(F.when(F.col("n_chars") > 1000, "long"), F.when(F.col("text").contains("\n"), "lines"), F.when(F.col("lang") == "en", "english")))
    rows = rows.withColumn("conditions", marks).withColumn("item_id", F.xxhash64("source"))
    out = S.marginal_effects(rows, ["long", "lines", "english"])
    return out.select("condition", *[F.round(c, 4).alias(c) for c in ("log_odds", "lo", "hi", "marginal_pp")], "n")


@query()
def isotonic_calibration(spark, d):
    from tessella.operators.calibrate import Calibrator

    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(
        "doc_id", F.xxhash64("source").alias("item_id"), F.col("quality").alias("y"), F.log1p("n_chars").alias("size"), (F.size(F.split("text", "\n")) / F.col("n_chars")).alias("lines"),
        (F.col("lang") == "en").cast("double").alias("english"),
    )
    model = Calibrator().fit(rows, "y", "item_id", ("size", "lines", "english"))
    return model.predict(rows).select("doc_id", F.round("p_match", 4).alias("p_match"))


@query("SELECT DISTINCT label::BIGINT AS item_id FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id % 5 <> 0 AND label < 8)")
def guard_unindexed(spark, d):
    q, v = vectors(spark, d)
    everything = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("item_id"))
    return guards.unindexed(everything, v.where("item_id < 8"))


@query("SELECT DISTINCT user_id AS item_id FROM events WHERE event_type = 'click' AND value > 60 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 60")
def guard_split_overlap(spark, d):
    e = read(spark, d, "events").where("value > 60").withColumn("split", F.when(F.col("event_type") == "click", "dev").when(F.col("event_type") == "error", "test"))
    return guards.split_overlap(e.select(F.col("user_id").alias("item_id"), "split"))


@query("""WITH m AS (SELECT event_id, event_id + 2 AS line, CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN 'p' ELSE 'p' || event_id END AS pid, CASE WHEN event_id % 10 = 2 THEN 'odd' WHEN event_id % 10 = 3 THEN 'clean' WHEN event_id % 10 = 4 THEN 'out_of_catalogue' ELSE 'hard' END AS kind,
CASE WHEN event_id % 10 = 5 THEN 'train' ELSE 'test' END AS split, CASE WHEN event_id % 10 = 6 THEN 'x' ELSE user_id::VARCHAR END AS item FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY line) > 1 AS again FROM m)
SELECT rule, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter([CASE WHEN pid = '' THEN 'empty photo_id' END, CASE WHEN pid <> '' AND again THEN 'duplicate photo_id' END, CASE WHEN kind = 'odd' AND pid <> '' THEN 'kind' END, CASE WHEN split = 'train' THEN 'split' END,
CASE WHEN kind = 'out_of_catalogue' THEN 'item of out_of_catalogue' END, CASE WHEN item = 'x' THEN 'item is no integer' END, CASE WHEN kind = 'clean' THEN 'clean with conditions' END, CASE WHEN pid <> '' AND event_id % 10 = 7 THEN 'unknown condition' END], lambda x: x IS NOT NULL)) AS rule FROM d) GROUP BY rule""")
def manifest_violations(spark, d):
    k = F.col("event_id") % 10
    rows = read(spark, d, "events").select(
        (F.col("event_id") + 2).alias("line"), F.when(k == 0, "").when(k == 1, "p").otherwise(F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("photo_id"), F.lit("a.jpg").alias("filename"),
        F.when(k == 6, "x").otherwise(F.col("user_id").cast("string")).alias("item_id"), F.when(k == 2, "odd").when(k == 3, "clean").when(k == 4, "out_of_catalogue").otherwise("hard").alias("kind"),
        F.when(k == 5, "train").otherwise("test").alias("split"), F.when(k == 7, "low_light|fog").otherwise("low_light").alias("conditions"), F.lit("false").alias("occludes_logo"), F.lit("exact").alias("sku_confidence"), F.lit("").alias("notes"),
    )
    return guards.manifest_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(value)::BIGINT AS n, round(median(value), 6) AS median, round(list_sort(list(value))[least(floor(count(value) * 0.9)::BIGINT + 1, count(value))], 6) AS p90 FROM events")
def latency_quantiles(spark, d):
    return S.latency(read(spark, d, "events"), "value").select("n", r6("median").alias("median"), r6("p90").alias("p90"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (SELECT k FROM c) AND n_nationkey IN (SELECT k FROM s) THEN 'both' WHEN n_nationkey IN (SELECT k FROM c) THEN 'customer' WHEN n_nationkey IN (SELECT k FROM s) THEN 'supplier' ELSE 'neither' END AS side FROM nation""")
def union_sets(spark, d):
    c, s = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct(), read(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    tag = lambda x, name: x.withColumn("side", F.lit(name))
    return tag(c.intersect(s), "both").unionByName(tag(c.subtract(s), "customer")).unionByName(tag(s.subtract(c), "supplier")).unionByName(tag(n.subtract(c.union(s).distinct()), "neither"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_difference(spark, d):
    return read(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).subtract(read(spark, d, "supplier").where("s_acctbal > 9000").select("s_nationkey"))


@query("SELECT p_partkey::BIGINT AS p_partkey, p_brand || ' — ' || p_name AS label FROM part")
def item_labels(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), X.label(F.col("p_brand"), F.col("p_name")).alias("label"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)))::BIGINT AS n_tokens FROM documents")
def token_sets(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("SELECT label::BIGINT AS item_id, vec_id AS view_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings WHERE label <> 3) WHERE rn <= 6")
def first_views(spark, d):
    e = read(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("product_id")).agg(F.array_sort(F.collect_list("vec_id")).alias("images"))
    out = catalogue.item_views(e, 6, spark.createDataFrame([(3,)], "product_id long"))
    return out.select("item_id", F.col("url").alias("view_id"))


# Images are made from vectors: 8 x 8 grey pixels, each 4 x 4 large, on a white frame.


def pictures(emb) -> list[np.ndarray]:
    out = []
    for e in emb:
        x = np.asarray(e, float)[:64].reshape(8, 8)
        x = (255 * (x - x.min()) / max(float(np.ptp(x)), 1e-9)).astype(np.uint8)
        out.append(np.pad(np.repeat(np.repeat(np.repeat(x[..., None], 3, axis=2), 4, axis=0), 4, axis=1), ((8, 8), (8, 8), (0, 0)), constant_values=255))
    return out


def on_pictures(spark, d, f, schema):
    ship(spark)

    def run(frames):
        for g in frames:
            yield pd.DataFrame([(int(v), *f(int(v), p)) for v, p in zip(g["vec_id"], pictures(g["embedding"]), strict=True)], columns=[c.split()[0] for c in schema.split(", ")])

    return read(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, schema)


@query()
def image_trim(spark, d):
    def f(v, p):
        box, (square, trimmed) = I.content_bbox(p), I.trim_to_square(p, size=32)
        return (*(box or (None,) * 4), trimmed, int(square.sum()))

    return on_pictures(spark, d, f, "vec_id long, x0 int, y0 int, x1 int, y1 int, trimmed boolean, pixel_sum long")


@query()
def image_corruptions(spark, d):
    ship(spark)

    def f(v, p):
        recipe = I.sample_recipe(np.random.default_rng(v))
        return "|".join(f"{n}:{s}" for n, s in recipe), int(I.corrupt_many(p, recipe, v).sum())

    return on_pictures(spark, d, f, "vec_id long, recipe string, pixel_sum long")


@query()
def image_salient_box(spark, d):
    def f(v, p):
        from tessella.operators.encode import grid_tokens

        crop, box, area = I.localise(p, grid_tokens(p[None], 4)[0, 1:], 4)
        return (*[round(b, 4) for b in box], round(area, 4), crop.shape[0], crop.shape[1])

    return on_pictures(spark, d, f, "vec_id long, x0 double, y0 double, x1 double, y1 double, area double, height int, width int")
