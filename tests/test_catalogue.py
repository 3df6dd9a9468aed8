"""The catalogue operators: the properties that the reference tests, and edge cases."""

import gzip
import json
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import images as I
from tessella.functions import text as X
from tessella.functions import vectors as V
from tessella.operators import calibrate, catalogue, confidence, encode, evaluate, graph, guards, search
from tessella.operators import stats as S
from tessella.operators.vector_index import Whitening, cap_views, chosen
from tessella.sources import tables, web

SITE = X.product_pattern("https://www.example.com")


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def vec(x):
    return [float(v) for v in x]


def test_sitemap(spark):
    t = "<urlset><loc>https://www.example.com/Casual-Shoes/Big+Fox/big-fox-shoe/16427724/buy</loc><loc> https://www.example.com/shoes </loc><loc>https://www.example.com/Boots/A%20b/100%zz/7/buy/</loc></urlset>"
    out = catalogue.parse_sitemap(rows(spark, [(0, t)], "sitemap_no int, text string"), SITE).orderBy("pos").collect()
    assert [(r.product_id, r.category, r.brand, r.slug) for r in out] == [(16427724, "Casual-Shoes", "Big Fox", "big-fox-shoe"), (7, "Boots", "A b", "100%zz")]


def test_harvest_first_seen_limit_and_pending(spark):
    refs = rows(spark, [(0, 0, 5, "Boots"), (0, 1, 6, "Hats"), (1, 0, 5, "Boots"), (1, 1, 4, "Heels")], "sitemap_no int, pos int, product_id long, category string")
    assert [r.product_id for r in catalogue.harvest(refs).orderBy("sitemap_no", "pos").collect()] == [5, 4]
    assert [r.product_id for r in catalogue.harvest(refs, None, 2).collect()] == [5, 6]
    assert [r.product_id for r in catalogue.pending(refs.select("product_id").distinct(), rows(spark, [(4,)], "product_id long"), "product_id", 1).collect()] == [5]


def test_sitemap_index(spark):
    index = rows(spark, [("<loc>a</loc><loc>b</loc><loc>c</loc>",)], "text string")
    assert [r.url for r in catalogue.list_sitemaps(index, 2).orderBy("sitemap_no").collect()] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        catalogue.list_sitemaps(index.limit(0))


def test_image_url(spark):
    u = spark.range(1).select(X.image_url(F.lit("http://x/h_($height),q_($qualityPercentage),w_($width)/a.jpg")).alias("u")).first().u
    assert u == "https://x/h_1440,q_90,w_1080/a.jpg"


def test_product_pages(spark):
    body = {
        "pdpData": {
            "id": 9, "name": "Shoe", "brand": None, "baseColour": "Red", "analytics": {"brand": "B", "gender": "Men"},
            "media": {"albums": [{"name": "default", "images": [{"src": "http://i/1"}, {"src": "http://i/1"}, {"src": ""}]}, {"name": "spin", "images": [{"src": "http://i/2"}]}, {"images": [{"src": "http://i/3"}]}]},
            "colours": [1, "2", {"styleId": "3"}, {"id": 4, "styleid": None}, {"productId": "x5"}, None, True, {"styleid": "a", "id": "6"}], "relatedStyles": {"id": 1},
        }
    }
    page = lambda b: f"<html><script>window.__myx = {b};</script>"
    data = [("u", page(json.dumps(body))), ("junk", "<html></html>"), ("bad", page("{oops}")), ("text id", page('{"pdpData": {"id": "7"}}')), ("none", None)]
    out = catalogue.parse_products(rows(spark, data, "url string, html string")).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.product_id, r.brand, r.gender, r.article_type) == (9, "B", "Men", None)
    assert r.images == ["https://i/1", "https://i/3"] and r.colour_variants == [1, 3, 4, 1, 6] and r.related_styles == []


def test_text_columns(spark):
    r = spark.range(1).select(
        X.tokens(F.lit("The the Cat-9!")).alias("t"), X.split_list(F.lit(" a | |b|")).alias("s"), X.truthy(F.lit(" Yes")).alias("y"), X.truthy(F.lit(None)).alias("n"),
        X.shard_path(F.lit(12345).cast("long"), F.lit(2).cast("long")).alias("p"), X.label(F.lit(""), F.lit("N")).alias("l"), X.utc_seconds(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("ts"),
        X.coverage_score(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))).alias("c"),
    ).first()
    assert r.t == ["the", "cat", "9"] and r.s == ["a", "b"] and r.y and not r.n and r.p == "images/45/12345/2.jpg" and r.l == "N" and r.ts == "2024-01-02T03:04:05+00:00"
    assert math.isclose(r.c, 0.48)


def test_jsonl_and_resume(spark, tmp_path):
    path, schema = f"file://{tmp_path}/items", "product_id long, name string"
    assert tables.read_jsonl(spark, path, schema).count() == 0
    assert tables.write_jsonl(rows(spark, [(1, "a")], schema), path) == 1
    assert tables.append_new(rows(spark, [(1, "z"), (3, "c"), (2, "b")], schema), path, "product_id", schema, 1) == 1
    (tmp_path / "items" / "more.json").write_text('\n{"product_id": 9}\n\n')
    assert sorted((r.product_id, r.name) for r in tables.read_jsonl(spark, path, schema).collect()) == [(1, "a"), (2, "b"), (9, None)]


def test_gzip_by_content(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(gzip.compress(b"<loc>x</loc>"))
    (tmp_path / "b.xml.gz").write_bytes(b"<loc>y</loc>")
    assert sorted(r.text for r in tables.read_text_any(spark, f"file://{tmp_path}").collect()) == ["<loc>x</loc>", "<loc>y</loc>"]


def test_index_and_state_round_trip(spark, tmp_path):
    views = rows(spark, [(1, 0, False, [0.5, 0.5])], tables.VIEWS)
    tables.save_index(views, {"backbone": "colour-grid", "image_size": 32, "pooling": "cls", "whiten_dim": 2}, f"file://{tmp_path}/ix")
    back, meta = tables.load_index(spark, f"file://{tmp_path}/ix")
    assert back.collect() == views.collect() and meta["backbone"] == "colour-grid"
    w = Whitening(1).fit(rows(spark, [(vec([0, 1]),), (vec([1, 0]),), (vec([2, -1]),)], "emb array<float>"))
    tables.save_state(spark, w.state(), Whitening.SCHEMA, f"file://{tmp_path}/w")
    assert np.allclose(Whitening.of(tables.load_state(spark, f"file://{tmp_path}/w")).components, w.components)


def fake_fetch(url):
    if "bad" in url:
        raise OSError(url)
    return url.encode()


def test_download(spark, tmp_path):
    jobs = rows(spark, [(105, 0, "u1"), (105, 1, "bad")], "item_id long, view_id int, url string")
    first = {r.status: r.n for r in tables.download_summary(tables.download(jobs, str(tmp_path), fake_fetch)).collect()}
    assert first == {"ok": 1, "failed": 1} and (tmp_path / "05" / "105" / "0.jpg").read_bytes() == b"u1"
    again = {r.status: (r.n, r.failed_urls) for r in tables.download_summary(tables.download(jobs, str(tmp_path), fake_fetch)).collect()}
    assert again == {"skipped": (1, []), "failed": (1, ["bad"])}


def test_fetcher_retries_and_waits():
    calls, naps = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return "page"

    assert web.Fetcher(flaky, sleep=naps.append).get("u") == "page" and naps == [1.0, 2.0]

    def missing(url):
        raise web.NotFound

    assert web.Fetcher(missing).get("u") is None
    now = [0.0]
    gate = web.RateLimiter(0.5, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(4):
        gate.wait()
    assert now[0] == 1.5


def test_streaming_harvest(spark, tmp_path):
    from tessella.streaming.harvest import harvest_once

    src, out, state = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/state"
    src.mkdir()
    loc = lambda i: f"<loc>https://www.example.com/Boots/B/s/{i}/buy</loc>"
    (src / "1.xml").write_text(loc(1) + "\n" + loc(2) + loc(1))
    harvest_once(spark, str(src), SITE, out, state).awaitTermination()
    (src / "2.xml").write_text(loc(2) + loc(3))
    harvest_once(spark, str(src), SITE, out, state).awaitTermination()
    assert sorted(r.product_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def view_rows(spark, items, emb):
    return rows(spark, [(int(i), k, vec(e)) for k, (i, e) in enumerate(zip(items, emb, strict=True))], "item_id long, view_id long, emb array<float>")


def test_capping_keeps_diverse_views(spark):
    rng = np.random.default_rng(0)
    items = np.repeat(np.arange(20), rng.integers(1, 9, 20))
    emb = unit(rng.normal(size=(20, 32))[items] + 0.1 * rng.normal(size=(len(items), 32)))
    out = cap_views(view_rows(spark, items, emb), 4).groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in out} == {i: min(4, int((items == i).sum())) for i in range(20)}
    x = unit(np.array([[1, 0], [1, 0.01], [0, 1], [0.7, 0.7], [1, 0]]))
    assert len(set(chosen(x, 3))) == 3 and 2 in chosen(x, 3)


def test_search_finds_itself_and_agrees_with_built_ins(spark, monkeypatch):
    rng = np.random.default_rng(1)
    emb = unit(rng.normal(size=(60, 32)))
    views = view_rows(spark, np.arange(60) // 2, emb)
    q = rows(spark, [(i, vec(emb[i])) for i in (0, 17, 59)], "query_id long, emb array<float>")
    a = search.search(q, views, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id, r.best_view) for r in a if r["rank"] == 1] == [(0, 0, 0), (17, 8, 17), (59, 29, 59)]
    b = search.search_sql(q, views, 3).orderBy("query_id", "rank").collect()
    assert [(r.item_id, r.best_view) for r in a] == [(r.item_id, r.best_view) for r in b]
    monkeypatch.setattr(search, "BLOCK_FLOATS", 32)
    c = search.search(q, views, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id, r.best_view, round(r.score, 9)) for r in c] == [(r.query_id, r.item_id, r.best_view, round(r.score, 9)) for r in a]
    assert search.search(q, views, 100).count() == 3 * 30
    assert search.search(q.limit(0), views, 3).count() == 0


def test_ties_go_to_the_last_view_and_the_first_item(spark):
    views = rows(spark, [(2, 0, [1.0]), (1, 5, [1.0]), (1, 9, [1.0]), (3, 1, [0.5])], "item_id long, view_id long, emb array<float>")
    out = search.search(rows(spark, [(0, [1.0])], "query_id long, emb array<float>"), views, 2).orderBy("rank").collect()
    assert [(r.item_id, r.best_view) for r in out] == [(1, 9), (2, 0)]


def test_whitening_widens_the_gap(spark):
    rng = np.random.default_rng(2)
    shared, own = rng.normal(size=64), rng.normal(size=(200, 64))
    make = lambda: unit(4 * shared + 0.3 * own + 0.05 * rng.normal(size=(200, 64)))
    a, b = make(), make()
    w = Whitening(32).fit(view_rows(spark, np.arange(200), a))
    white = lambda x: np.array([r.emb for r in w.transform(view_rows(spark, np.arange(200), x)).orderBy("view_id").collect()])

    def gap(p, q):
        s = p @ q.T
        same = np.diag(s).copy()
        np.fill_diagonal(s, -9)
        return (same - s.max(axis=1)).mean()

    assert gap(white(a), white(b)) > gap(a, b)
    u, sv, vt = np.linalg.svd(a - a.mean(0), full_matrices=False)
    eig = sv**2 / 199
    x = unit((a - a.mean(0)) @ vt[:32].T / np.sqrt(eig[:32] + 1e-3 * eig[0]))
    assert np.allclose(np.abs(white(a)), np.abs(x), atol=1e-3)
    with pytest.raises(RuntimeError):
        Whitening(2).transform(view_rows(spark, [0], a[:1]))


def test_dimension_guard(spark):
    with pytest.raises(ValueError, match="whitening"):
        search.check_dimensions(1536, 256)
    search.check_dimensions(1536, 256, 1536, 256)
    with pytest.raises(ValueError):
        search.check_index(rows(spark, [(1, 0, [1.0]), (1, 1, [1.0, 2.0])], "item_id long, view_id long, emb array<float>"))


def test_components(spark):
    items = rows(spark, [(1, [2]), (2, []), (3, [4, 99]), (4, [5]), (5, []), (6, [6]), (7, None)], "product_id long, colour_variants array<long>")
    out = {r.item_id: r.style_id for r in graph.style_clusters(items).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    some = graph.style_clusters(items, rows(spark, [(3,), (5,), (1,)], "product_id long"))
    assert {r.item_id: r.style_id for r in some.collect()} == {1: 1, 3: 3, 5: 5}
    line = rows(spark, [(i, [i + 1]) for i in range(64)], "product_id long, colour_variants array<long>")
    assert {r.style_id for r in graph.style_clusters(line).collect()} == {0}


def test_hold_out_is_the_sequential_rule(spark):
    items = rows(spark, [(i, i // 3) for i in range(60)], "item_id long, style_id long")
    order = [r.item_id for r in catalogue.shuffled(items, "item_id", 4).orderBy("place").collect()]
    held, styles = [], set()
    for i in order:  # while the quota is open an item is held and its style with it; later items follow their style
        if len(held) < 10:
            held.append(i)
            styles.add(i // 3)
    want = set(held) | {i for i in order if i // 3 in styles}
    h, rest = catalogue.hold_out(items, 10, 4)
    assert {r.item_id for r in h.collect()} == want and {r.item_id for r in rest.collect()} == set(range(60)) - want
    picked, inside = catalogue.out_of_catalogue(items, 5, 4)
    assert picked.count() == 5 and not {r.style_id for r in picked.collect()} & {r.style_id for r in inside.collect()}
    split = {r.split: r["count"] for r in catalogue.dev_test(items, 1).groupBy("split").count().collect()}
    assert split == {"dev": 15, "test": 45}


def test_views_of_items(spark):
    items = rows(spark, [(1, ["a", "b", "c"]), (2, ["d"]), (3, []), (4, ["e"])], "product_id long, images array<string>")
    out = catalogue.item_views(items, 2, rows(spark, [(4,)], "product_id long"), 2).orderBy("item_id", "view_id").collect()
    assert [(r.item_id, r.view_id, r.url) for r in out] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "d")]


def test_titles(spark):
    q = rows(spark, [(0, "red big shoe"), (1, "nothing like it"), (2, "")], "query_id long, text string")
    t = rows(spark, [(10, "Big red shoe!"), (11, "red"), (12, "big shoe of some other colour")], "item_id long, text string")
    best, lost = catalogue.resolve_titles(q, t, 2)
    assert [(r.item_id, r["rank"]) for r in best.orderBy("rank").collect()] == [(10, 1), (12, 2)] and sorted(r[0] for r in lost.collect()) == [1, 2]


def dist(spark, name, scores):
    return [(name, i, float(s)) for i, s in enumerate(scores)]


def test_confidence_separates_present_from_absent(spark):
    rng = np.random.default_rng(3)
    data = dist(spark, 1, [0.95, *rng.normal(0.30, 0.05, 499)]) + dist(spark, 0, [0.50, *rng.normal(0.47, 0.05, 499)]) + dist(spark, 2, [0.7])
    f = {r.query_id: r for r in confidence.score_features(rows(spark, data, "query_id long, item_id long, score double")).collect()}
    assert f[1].margin_12 > f[0].margin_12 and f[1].zscore_q > f[0].zscore_q
    s = np.sort([x[2] for x in data if x[0] == 0])[::-1]
    p = np.exp((s[:10] - s[0]) / 0.05)
    p /= p.sum()
    assert math.isclose(f[0].entropy_top10, -(p * np.log(p)).sum(), rel_tol=1e-6) and math.isclose(f[0].std_top10, s[:10].std(), rel_tol=1e-9)
    assert math.isclose(f[0].s1_minus_mean100, s[0] - s[1:100].mean(), rel_tol=1e-9)
    assert f[2].margin_12 == pytest.approx(0.7) and f[2].s1_minus_mean10 == 0.0 and f[2].std_top10 == 0.0
    assert len(confidence.feature_names(True)) == 18 and len(confidence.feature_names(False)) == 13


@pytest.mark.parametrize("alpha", [0.05, 0.1, 0.2])
def test_conformal_coverage(spark, alpha):
    rng = np.random.default_rng(4)
    cal, fresh = rng.beta(6, 2, 800), rng.beta(6, 2, 2000)
    c = rows(spark, [(float(x),) for x in cal], "score double")
    cand = rows(spark, [(i, 1, 7, 0.5, float(x)) for i, x in enumerate(fresh)], "query_id long, rank long, item_id long, score double, p_match double")
    out = confidence.prediction_sets(cand, c, alpha)
    assert abs(out.agg(F.avg((~F.col("refused")).cast("double"))).first()[0] - (1 - alpha)) < 0.05


def test_conformal_needs_points_and_counts_strictly_below(spark):
    two = rows(spark, [(0.1,), (0.2,), (float("nan"),)], "score double")
    with pytest.raises(ValueError):
        confidence.Conformal().fit(two)
    many = rows(spark, [(i / 20,) for i in range(20)], "score double")
    model = confidence.Conformal().fit(many)
    x = rows(spark, [(0.5,), (-1.0,), (2.0,)], "score double")
    want = [11 / 21, 1 / 21, 1.0]
    got = {r.score: r.p_value for r in confidence.p_values(x, many).collect()}  # in no order
    assert [got[0.5], got[-1.0], got[2.0]] == pytest.approx(want)
    assert [r.p for r in x.select(model.p_value(F.col("score")).alias("p")).collect()] == pytest.approx(want)


def test_wilson(spark):
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in rows(spark, [(0, 10), (10, 10), (0, 23), (8, 12), (0, 0)], "k long, n long").select(lo, hi).collect()]
    assert abs(got[0][0]) < 1e-9 and got[0][1] < 0.35 and got[1][0] > 0.65 and abs(got[1][1] - 1) < 1e-9
    assert got[2][1] == pytest.approx(0.143, abs=5e-4) and got[3] == pytest.approx((0.391, 0.862), abs=5e-4) and math.isnan(got[4][0])


def test_bootstrap_is_wider_for_clusters(spark):
    data = [(i, float(i % 2)) for i in range(10) for _ in range(6)]
    t = rows(spark, data, "g long, y double").withColumn("each", F.monotonically_increasing_id())
    a, b = S.cluster_bootstrap(t, "y", "g", 300).first(), S.cluster_bootstrap(t, "y", "each", 300).first()
    assert a.point == b.point == 0.5 and a.hi - a.lo > b.hi - b.lo and a.n == 60
    e = S.cluster_bootstrap(t.limit(0), "y", "g", 10).first()
    assert math.isnan(e.point) and e.n == 0


def test_auroc(spark):
    t = lambda p, n: rows(spark, [(float(x), True) for x in p] + [(float(x), False) for x in n], "score double, positive boolean")
    assert S.auroc(t([3, 4, 5], [0, 1, 2])).first().auroc == 1.0 and S.auroc(t([0, 1, 2], [3, 4, 5])).first().auroc == 0.0
    assert S.auroc(t([1, 1], [1, 1, 1])).first().auroc == 0.5 and math.isnan(S.auroc(t([1], [])).first().auroc)


def test_mcnemar(spark):
    t = rows(spark, [(True, False)] * 40 + [(True, True)] * 50, "a boolean, b boolean")
    x, y = S.mcnemar(t, "a", "b").first(), S.mcnemar(t, "b", "a").first()
    assert x.p_value == y.p_value == pytest.approx(1.8189894035458565e-12, rel=1e-6) and x.n01 == 40 and y.n10 == 40
    assert S.mcnemar(t.where("b"), "a", "b").first().p_value == 1.0


def test_risk(spark):
    t = rows(spark, [(1, 0.9, True), (2, 0.8, False), (3, 0.7, True), (4, 0.7, False)], "id long, confidence double, correct boolean")
    r = S.aurc(t).first()
    risk, best = np.mean([0, 1 / 2, 1 / 3, 2 / 4]), np.mean([0, 0, 1 / 3, 2 / 4])
    assert r.aurc == pytest.approx(risk) and r.e_aurc == pytest.approx(risk - best)
    assert math.isnan(S.aurc(t.limit(0)).first().aurc)


def test_cooccurrence_and_histogram(spark):
    t = rows(spark, [(1, ["a", "b"]), (2, ["a"]), (3, [])], "k long, v array<string>")
    j = {(r.a, r.b): r.jaccard for r in S.cooccurrence(t, "k", F.col("v"), ["a", "b", "c"]).collect()}
    assert j[("a", "b")] == 0.5 and j[("a", "a")] == 1.0 and j[("c", "a")] == 0.0 and j[("c", "c")] == 0.0
    assert [(r.n_conditions, r.n) for r in S.condition_histogram(t, "v").orderBy("n_conditions").collect()] == [(0, 1), (1, 1), (2, 1)]


def test_effects_and_dose(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(600):
        c = [n for n in ("low_light", "defocus") if rng.random() < 0.5]
        p = 0.9 - 0.5 * ("low_light" in c)
        data.append((i // 3, c, bool(rng.random() < p)))
    t = rows(spark, data, "item_id long, conditions array<string>, correct boolean")
    e = {r.condition: r for r in S.marginal_effects(t, ["low_light", "defocus"], n_boot=60).collect()}
    assert e["low_light"].hi < 0 and -60 < e["low_light"].marginal_pp < -35 and abs(e["defocus"].log_odds) < 0.7 and e["defocus"].lo < e["defocus"].log_odds < e["defocus"].hi
    odds, levels = S.dose_response(t.withColumn("n", F.size("conditions")), "n")
    assert odds < 1 and levels.count() == 3
    x = np.array([[1.0, 0], [0, 1], [1, 1], [0, 0], [1, 0]])
    y = np.array([1.0, 0, 1, 0, 0])
    b = S.logistic(x, y, 1.0)
    p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    assert np.allclose(np.hstack([np.ones((5, 1)), x]).T @ (p - y) + [0, *b[1:]], 0, atol=1e-5)
    one = S.marginal_effects(t.where("correct"), ["low_light"], n_boot=2).first()
    assert math.isnan(one.log_odds)


@pytest.mark.parametrize("n", [300, 1500])
def test_calibration(spark, n, tmp_path):
    rng = np.random.default_rng(6)
    y = rng.random(n) < 0.4
    data = [(i // 3, float(rng.normal(1.5 * v, 1)), float(rng.normal()), int(v)) for i, v in enumerate(y)]
    t = rows(spark, data, "item_id long, s1 double, noise double, y int")
    c = calibrate.Calibrator().fit(t, columns=("s1", "noise"))
    p = np.array([r.p_match for r in c.predict(t).collect()])
    assert p.min() >= 0 and p.max() <= 1 and abs(p.mean() - y.mean()) < 0.06 and p[y].mean() > p[~y].mean() + 0.2
    assert c.coefficients()[0][0] == "s1" and bool(c.models[0]["knots"]) == (n >= 1000)
    tables.save_state(spark, c.state(), calibrate.Calibrator.SCHEMA, f"file://{tmp_path}/c")
    back = calibrate.Calibrator.of(tables.load_state(spark, f"file://{tmp_path}/c"))
    assert np.allclose([r.p_match for r in back.predict(t).collect()], p)


def manifest(spark, data):
    return spark.createDataFrame([(i + 2, *d) for i, d in enumerate(data)], "line long, " + ", ".join(f"{c} string" for c in tables.MANIFEST))


def test_manifest(spark, tmp_path):
    ok = ("p1", "a.jpg", "7", "hard", "test", "low_light|defocus", "yes", None, " n ")
    photos = guards.load_manifest(manifest(spark, [ok, ("p2", "", "", "out_of_catalogue", "dev", "", "", "exact", "")]))
    r = photos.orderBy("photo_id").collect()
    assert (r[0].item_id, r[0].conditions, r[0].occludes_logo, r[0].sku_confidence, r[0].notes, r[1].item_id) == (7, ["low_light", "defocus"], True, "exact", "n", None)
    bad = [
        ("", "", "x", "odd", "", "", "", "", ""), ("p1", "no.jpg", "8", "clean", "train", "fog", "", "sure", ""), ("p1", "a.jpg", "x9", "hard", "dev", "", "", "", ""), ("p3", "a.jpg", "1", "out_of_catalogue", "dev", "", "", "", ""), ("p4", "a.jpg", "7", "photo", "dev", "", "", "", ""),
    ]
    found = sorted((v.line, v.rule) for v in guards.manifest_violations(manifest(spark, bad), rows(spark, [(7,)], "item_id long"), rows(spark, [("a.jpg",)], "filename string")).collect())
    assert found == sorted(
        [(2, "empty photo_id"), (3, "split"), (3, "unknown condition"), (3, "clean with conditions"), (3, "sku_confidence"), (3, "item not in catalogue"), (3, "file not found"), (4, "duplicate photo_id"), (4, "item is no integer"), (5, "item of out_of_catalogue"), (6, "kind")]
    )
    with pytest.raises(guards.ManifestError, match="empty photo_id"):
        guards.load_manifest(manifest(spark, bad))
    tables.write_template(spark, f"file://{tmp_path}/t")
    assert guards.load_manifest(tables.read_manifest(spark, f"file://{tmp_path}/t")).count() == 1
    (tmp_path / "short.csv").write_text("photo_id,kind\n1,hard\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_manifest(spark, f"file://{tmp_path}/short.csv")


def test_split_and_index_guards(spark):
    s = "item_id long, split string"
    with pytest.raises(guards.ManifestError):
        guards.check_split_disjoint(rows(spark, [(1, "dev"), (1, "test")], s))
    guards.check_split_disjoint(rows(spark, [(1, "dev"), (2, "test"), (None, "dev"), (None, "test")], s))
    views = rows(spark, [(111,)], "item_id long")
    with pytest.raises(guards.TestSetError):
        guards.check_indexed(rows(spark, [(111,), (999,), (None,)], "item_id long"), views)
    guards.check_indexed(rows(spark, [(111,), (None,)], "item_id long"), views)
    with pytest.raises(guards.TestSetError):
        guards.check_enough(views, 2, "items")


def test_evaluation(spark, tmp_path):
    rng = np.random.default_rng(8)
    base = unit(rng.normal(size=(40, 16)))
    views = view_rows(spark, np.repeat(np.arange(30), 2), unit(np.repeat(base[:30], 2, axis=0) + 0.05 * rng.normal(size=(60, 16))))
    photos, q = [], []
    for n in range(120):
        kind = ("hard", "clean", "hard", "out_of_catalogue")[n % 4]
        item = 30 + n % 10 if kind == "out_of_catalogue" else n // 2 % 30
        noise = 0.5 if kind == "hard" and n % 8 == 0 else 0.05
        photos.append((n, None if kind == "out_of_catalogue" else item, kind, "test" if n < 110 else "dev", ["low_light"] if noise > 0.1 else ["defocus"] if kind == "hard" else []))
        q.append((n, vec(unit(base[item] + noise * rng.normal(size=16)))))
    p = rows(spark, photos, "photo_id long, item_id long, kind string, split string, conditions array<string>")
    styles = rows(spark, [(i, i // 2 * 2) for i in range(30)], "item_id long, style_id long")
    results = evaluate.photo_results(p, rows(spark, q, "query_id long, emb array<float>"), views, styles).withColumn("refused", F.col("score") < 0.6).withColumn("p_match", F.col("score"))
    r = evaluate.evaluate(results, n_boot=40)
    assert r["n_photos"] == 110 and r["clean"]["r1_sku"]["point"] > 0.95 and r["refusal"]["auroc"] > 0.9 and r["hard"]["r1_style"]["point"] >= r["hard"]["r1_sku"]["point"]
    assert set(r["per_condition"]) == {"low_light", "defocus"} and r["gap_paired"]["n_pairs"] > 0 and "three_way" in r["refusal"]
    evaluate.save_report(r, results, str(tmp_path))
    md = (tmp_path / "report.md").read_text()
    assert "| low_light |" in md and "AUROC" in md and json.loads((tmp_path / "report.json").read_text())["n_photos"] == 110
    assert spark.read.json(f"file://{tmp_path}/per_photo").count() == 120
    bake = evaluate.bake_off(
        rows(spark, [(i, i % 30, q[i][1]) for i in range(0, 120, 5) if photos[i][1] is not None], "query_id long, item_id long, emb array<float>"), views, styles, rows(spark, [(i, q[i][1]) for i in range(3, 120, 4)], "query_id long, emb array<float>")
    ).first()
    assert bake.r5 >= bake.r1 and bake.auroc > 0.8


def picture(h, w, box=None, value=245):
    a = np.full((h, w, 3), value, np.uint8)
    if box:
        a[box[0] : box[1], box[2] : box[3]] = (30, 60, 90)
    return a


def test_trim():
    out, trimmed = I.trim_to_square(picture(200, 200, value=255), size=64)
    assert not trimmed and out.shape == (64, 64, 3)
    a = picture(400, 300, (100, 300, 80, 200))
    assert I.content_bbox(a) == (80, 100, 200, 300)
    out, trimmed = I.trim_to_square(a, size=128)
    assert trimmed and out.shape == (128, 128, 3)
    assert I.content_bbox(picture(6, 6)) is None and I.content_bbox(picture(100, 100, (50, 52, 50, 52))) is None


@pytest.mark.parametrize("name", sorted(I.CORRUPTIONS))
def test_corruptions(name):
    a = np.random.default_rng(0).integers(0, 256, (128, 96, 3)).astype(np.uint8)
    for severity in range(1, 6):
        out = I.corrupt(a, name, severity, 3)
        assert out.dtype == np.uint8 and out.ndim == 3 and out.shape[2] == 3 and out.size and (out != np.resize(a, out.shape)).any()
        assert (out == I.corrupt(a, name, severity, 3)).all()


def test_corruption_arguments_and_recipes():
    a = picture(64, 64, (10, 40, 10, 40))
    with pytest.raises(KeyError):
        I.corrupt(a, "rain", 1)
    with pytest.raises(ValueError):
        I.corrupt(a, "defocus", 9)
    rng = np.random.default_rng(1)
    for _ in range(60):
        r, c = I.sample_recipe(rng), I.sample_conditions(rng)
        assert 1 <= len(dict(r)) == len(r) <= 3 and 1 <= len(c) <= 3 and 2 <= c[0][1] <= 5
        assert I.corrupt_many(a, r, 2).ndim == 3


def test_saliency_and_quality():
    heat = np.zeros((8, 8))
    heat[2:5, 3:6] = 1.0
    heat[7, 0] = 1.0
    box = I.salient_box(heat, 0.9)
    assert box == pytest.approx((3 / 8 - 0.045, 2 / 8 - 0.045, 6 / 8 + 0.045, 5 / 8 + 0.045))
    assert I.heat_map(np.ones((16, 4)), 4).min() == 1.0 and I.heat_map(np.ones((3, 4)), 4).shape == (4, 4)
    assert I.crop_to_box(picture(10, 10), (0.5, 0.5, 0.5, 0.5)).shape == (1, 1, 3)
    flat, busy = picture(40, 40), np.random.default_rng(0).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    assert I.quality(flat)[0] == 0.0 and I.quality(busy)[0] > 100 and I.quality(flat)[1] == 245.0


def test_encoding(spark):
    a = picture(40, 40, (8, 30, 8, 30))
    data = [(1, 0, ("", 40, 40, 3, 16, bytearray(a[..., ::-1].tobytes()))), (1, 1, None)]
    images = rows(spark, data, "item_id long, view_id int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    e = encode.encoder("colour-grid")
    out = encode.encode_views(images, e, encode.Config(flip=True), mirrored=True).collect()
    assert [(r.item_id, r.view_id) for r in out] == [(1, 0), (1, 0)] and {r.mirrored for r in out} == {True, False}
    assert all(abs(np.linalg.norm(r.emb) - 1) < 1e-5 and len(r.emb) == 12 for r in out)
    assert np.allclose(out[0].emb, out[1].emb, atol=0.02)
    with pytest.raises(ValueError):
        encode.encoder("none")


def test_vector_columns(spark):
    r = spark.range(1).select(
        V.l2_normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), V.l2_normalise(F.array(F.lit(0.0))).alias("z"), V.concat_mean(F.array(F.lit(1.0)), F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0)))).alias("c"),
        V.flip_max(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("f"),
    ).first()
    assert r.u == [0.6, 0.8] and r.z == [0.0] and r.c == [1.0, 2.0] and r.f == pytest.approx([2**-0.5] * 2)


def test_lookup_records(spark):
    crops = rows(spark, [(1, "image", [1.0, 0.0]), (1, "mirror", [0.0, 1.0])], "query_id long, crop string, emb array<float>")
    views = rows(spark, [(5, 0, [0.0, 1.0]), (6, 0, [0.8, 0.6])], "item_id long, view_id long, emb array<float>")
    out = search.as_record(search.lookup(crops, views, 2)).first()
    assert out.top_ids == [5, 6] and out.candidates[0]["rank"] == 0 and out.candidates[1]["score"] == 0.8
    assert search.crops_of(crops.select("query_id").distinct(), True).count() == 3


class Sent:
    """Stands for a broadcast."""

    def __init__(self, value):
        self.value = value


def peak_mb(task, views, items, batch=10_000):
    """Rows that a task returns, and the most MB of arrays that it holds, over views in Arrow batches of the usual size."""
    emb = list(np.random.default_rng(8).normal(size=(views, 8)).astype(np.float32))
    frames = [pd.DataFrame({"item_id": items[i : i + batch], "view_id": np.arange(views)[i : i + batch], "emb": emb[i : i + batch]}) for i in range(0, views, batch)]
    tracemalloc.start()
    try:
        n = sum(len(f) for f in task(iter(frames)))
        return n, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def block_of(queries, crops=1):
    vectors = np.random.default_rng(9).normal(size=(queries * crops, 8))
    return Sent(search.Block(np.arange(queries), vectors, np.arange(0, queries * crops, crops), np.full(queries, np.nan)))


def test_task_memory_one_item_of_many_views_aurc():
    n, mb = peak_mb(search._scorer(block_of(6000), 1), 10_000, np.zeros(10_000, np.int64))
    assert n == 6000 and mb < 120


def test_task_memory_many_queries_bake_off():
    n, mb = peak_mb(search._scorer(block_of(6000), 5), 10_000, np.arange(10_000) // 3)
    assert n == 30_000 and mb < 200


def test_tiles_don_t_change_a_risk_curve(spark, monkeypatch):
    rng = np.random.default_rng(12)
    emb = rng.integers(-2, 3, (90, 4)).astype(float)
    views = view_rows(spark, np.arange(90) // 20, emb)
    q = rows(spark, [(i, vec(e)) for i, e in enumerate(emb[:30])], "query_id long, emb array<float>")
    curve = lambda: [tuple(r) for r in S.risk_curve(search.search(q, views, 1).select(F.col("query_id").alias("id"), F.col("score").alias("confidence"), (F.col("item_id") == F.expr("query_id div 20")).alias("correct"))).orderBy("place").collect()]
    want = curve()
    monkeypatch.setattr(search, "TILE_QUERIES", 7)
    monkeypatch.setattr(search, "TILE_VIEWS", 3)
    assert len(want) == 30 and curve() == want


def test_copies_of_a_query_and_a_view_are_as_good_risk_coverage(spark):
    """Copies at the edge of a product are equals too: of items the first counts, and answers come in order of their ids."""
    emb = np.random.default_rng(15).normal(size=(40, 64))
    views = view_rows(spark, np.arange(263), np.repeat(emb[:1], 263, axis=0))
    q = rows(spark, [(i, vec(emb[i % 40])) for i in range(2089)], "query_id long, emb array<float>")
    best = search.search(q, views, 3)
    assert {(r.rank, r.item_id) for r in best.select("rank", "item_id").distinct().collect()} == {(1, 0), (2, 1), (3, 2)}
    assert best.select("score").distinct().count() == 40
    curve = S.risk_curve(best.where("rank = 1").select(F.col("query_id").alias("id"), F.col("score").alias("confidence"), F.lit(True).alias("correct")))
    ids = [r.id for r in curve.orderBy("place").collect()]
    assert len(ids) == 2089 and all(b > a for a, b in zip(ids, ids[1:], strict=False) if a % 40 == b % 40)
    few = search.search(q.where("query_id < 3"), views, 2)
    assert sorted((r.query_id, r.item_id) for r in few.collect()) == [(i, k) for i in range(3) for k in range(2)]


def test_separability_makes_no_pairs(spark):
    rng = np.random.default_rng(13)
    emb = rng.normal(size=(120, 8))
    views, q = view_rows(spark, np.arange(120) // 4, emb), rows(spark, [(i, i // 4 if i != 7 else None, vec(e + 0.1)) for i, e in enumerate(emb[:40])] + [(99, 1000, vec(emb[0]))], "query_id long, item_id long, emb array<float>")
    plain = lambda t: sorted(tuple(None if x is None else round(x, 9) for x in r) for r in t.select("query_id", "same", "other", "gap").collect())
    want = plain(evaluate.separability(q.select("query_id", "item_id"), search.item_scores(q, views)))
    assert plain(evaluate.search_separability(q, views)) == want and len(want) == 41
    n, mb = peak_mb(search._separator(Sent(search.Block.of([(i, np.ones((1, 8)), 0.0, i) for i in range(6000)]))), 10_000, np.arange(10_000) // 3)
    assert n == 6000 and mb < 120


def test_task_memory_ranks_of_candidates_conformal_pvalue():
    n, mb = peak_mb(search._scorer(block_of(12_000), 5), 5000, np.arange(5000) // 500)
    assert n == 60_000 and mb < 200


def test_best_items_in_order_with_ties_conformal_sets():
    best = search._Best(3, 2)
    for item in range(0, 40, 4):
        best.add(slice(0, 2), np.arange(item, item + 4), np.array([[1.0, item], [2.0, item], [2.0, item], [0.0, item]]), None)
    best.merge()
    assert best.item[:2].tolist() == [[1, 2], [36, 37]] and best.n.tolist() == [2, 2, 0]


def test_copies_of_a_query_score_equally_conformal_sets():
    """Strictly lower scores are counted for a p-value, so a copy that is a last bit better or worse would change sets."""
    block = Sent(search.Block(np.arange(2049), np.repeat(np.random.default_rng(16).normal(size=(1, 8)), 2049, axis=0), np.arange(2049), np.full(2049, np.nan)))
    emb = list(np.random.default_rng(17).normal(size=(50, 8)).astype(np.float32))
    out = pd.concat(search._scorer(block, 5)(iter([pd.DataFrame({"item_id": np.arange(50), "view_id": np.arange(50), "emb": emb})])))
    assert len(out) == 5 * 2049 and out.groupby("item_id")["score"].nunique().tolist() == [1] * 5


def test_task_memory_crops_crop_agreement():
    n, mb = peak_mb(search._scorer(block_of(4000, 3), 1), 10_000, np.arange(10_000) // 1000)
    assert n == 4000 and mb < 120


def test_task_memory_summaries_score_features():
    n, mb = peak_mb(search._summariser(block_of(4000), 20), 10_000, np.arange(10_000) // 3)
    assert n == 4000 and mb < 200


def test_task_memory_merges_of_many_kept_items_score_features():
    n, mb = peak_mb(search._summariser(block_of(10_000), 100), 1000, np.arange(1000))
    assert n == 10_000 and mb < 120


def test_merges_keep_what_a_sort_keeps_score_features(monkeypatch):
    """With ties, scores that aren't numbers, a query that nothing reaches and one that gets most of what waits."""
    monkeypatch.setattr(search, "WAITING", 90)
    monkeypatch.setattr(search, "CELLS", 40)
    rng = np.random.default_rng(18)
    s = rng.integers(0, 9, (60, 7)).astype(float)
    s[rng.random(s.shape) < 0.1] = np.nan
    s[:, 3] = np.arange(60)
    best = search._Best(8, 6)
    for at in range(0, 60, 5):
        best.add(slice(0, 4), np.arange(at, at + 5), s[at : at + 5, :4], None)
        best.add(slice(4, 7), np.arange(at, at + 5), s[at : at + 5, 4:], np.full((5, 3), at))
    best.merge()
    want = np.argsort(-s, axis=0, kind="stable")[:6]
    assert best.n.tolist() == [6] * 7 + [0] and (best.item[:7] == want.T).all()
    assert np.array_equal(best.score[:7], np.take_along_axis(s, want, 0).T, equal_nan=True) and (best.who[4:7] == want.T[4:] // 5 * 5).all()


def test_links_are_stars_with_the_components_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "WAITING", 50)
    rng = np.random.default_rng(14)
    emb = unit(rng.normal(size=(300, 6)))
    emb[100:200] = emb[100]  # copies: 10,000 pairs
    n, mb = peak_mb(search._linker(block_of(3000), -np.inf), 3000, np.arange(3000))
    assert n == 2999 and mb < 120
    v = rows(spark, [(i, vec(e)) for i, e in enumerate(emb)], "v long, emb array<double>")
    links = search.links(v, 0.93)
    assert links.count() <= 300 * links.rdd.getNumPartitions()
    low = np.arange(300)
    near = emb @ emb.T >= 0.93
    for _ in range(300):
        low = np.array([low[near[i]].min() for i in range(300)])
    assert {r.v: r.component for r in graph.components(v.select("v"), links).collect()} == dict(enumerate(low.tolist()))


def test_task_memory_each_view_an_item_calibrated_lookups():
    n, mb = peak_mb(search._scorer(block_of(4000), 10), 10_000, np.arange(10_000))
    assert n == 40_000 and mb < 200
