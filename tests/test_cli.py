"""The commands end to end on a handful of small pictures."""

import struct
import zlib

import numpy as np
import pytest

from tessella import cli
from tessella.sources import tables


def png(path, a):
    path.parent.mkdir(parents=True, exist_ok=True)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def picture(seed, noise=0):
    a = np.random.default_rng(seed).integers(0, 256, (4, 4, 3)).repeat(10, axis=0).repeat(10, axis=1)
    return np.clip(a + np.random.default_rng(seed + noise).integers(-noise, noise + 1, a.shape), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for i in range(1, 9):
        for v in range(2):
            png(root / "images" / f"{i:02d}" / str(i) / f"{v}.png", picture(i, 5 * v))
    (root / "images" / "01" / "1" / "9.png").write_bytes(b"broken")
    return root


def test_harvest_and_parse(spark, tmp_path):
    (tmp_path / "maps").mkdir()
    loc = lambda c, i: f"<loc>https://www.example.com/{c}/B+C/s/{i}/buy</loc>"
    (tmp_path / "maps" / "0.xml").write_text(loc("Boots", 1) + loc("Hats", 2))
    (tmp_path / "maps" / "1.xml").write_text(loc("Boots", 1) + loc("Boots", 3))
    out = f"file://{tmp_path}/refs"
    assert cli.main(["harvest", "--sitemaps", f"file://{tmp_path}/maps", "--site", "https://www.example.com", "--out", out, "--category", "Boots"], spark) == 2
    assert sorted(r.product_id for r in tables.read_jsonl(spark, out, tables.REFS).collect()) == [1, 3]
    pages = spark.createDataFrame([(f"u{i}", f'<script>window.__myx = {{"pdpData": {{"id": {i}, "name": "N"}}}}</script>') for i in (1, 3)], "url string, html string")
    pages.write.parquet(f"file://{tmp_path}/pages")
    args = ["parse", "--pages", f"file://{tmp_path}/pages", "--out", f"file://{tmp_path}/items", "--fetched-at", "2024-01-01T00:00:00+00:00"]
    assert cli.main(args, spark) == 2 and cli.main(args, spark) == 0


@pytest.mark.parametrize("whiten", [None, 4])
def test_index_query_bench_eval(spark, shop, tmp_path, whiten):
    where = f"file://{tmp_path}/index"
    tables.write_ids(spark.createDataFrame([(8,), (8,)], "id long"), f"file://{tmp_path}/out.json")
    args = ["index", "--images", f"file://{shop}/images", "--out", where, "--exclude", f"file://{tmp_path}/out.json"]
    assert cli.main(args + (["--whiten", str(whiten)] if whiten else []), spark) == 14
    for i in (2, 5):
        png(tmp_path / "photos" / f"p{i}.png", picture(i, 3))
    png(tmp_path / "photos" / "p8.png", picture(8, 3))
    ask = ["--images", f"file://{tmp_path}/photos", "--index", where]
    first = {r["path"].rsplit("/", 1)[1]: r["item_id"] for r in cli.main(["query", *ask, "--k", "2"], spark) if r["rank"] == 1}
    assert first["p2.png"] == 2 and first["p5.png"] == 5
    assert cli.main(["bench", *ask, "--rounds", "2"], spark)["n"] == 2
    head = ",".join(tables.MANIFEST)
    (tmp_path / "m.csv").write_text(f"{head}\na,p2.png,2,hard,test,low_light,,,\nb,p5.png,5,clean,test,,,,\nc,p8.png,,out_of_catalogue,test,,,,\n")
    more = ["--photos", f"file://{tmp_path}/photos", "--index", where, "--out", f"{tmp_path}/report", "--boot", "20"]
    report = cli.main(["eval", "--manifest", f"file://{tmp_path}/m.csv", *more], spark)
    assert report["n_photos"] == 3 and report["hard"]["r1_sku"]["point"] == 1.0 and "refusal" in report
    (tmp_path / "bad.csv").write_text(f"{head}\na,p2.png,8,hard,test,,,,\n")
    with pytest.raises(ValueError):
        cli.main(["eval", "--manifest", f"file://{tmp_path}/bad.csv", *more], spark)
    if whiten:
        import shutil

        shutil.rmtree(tmp_path / "index" / "whiten")
        with pytest.raises(FileNotFoundError):
            cli.main(["query", *ask], spark)


@pytest.fixture(scope="module")
def catalogue_of_60(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("large")
    for i in range(1, 61):
        for v in range(3):
            png(root / "images" / f"{i:02d}" / str(i) / f"{v}.png", picture(i, 4 * v))
    colours = {i: [i + 1] if i % 10 == 0 else [] for i in range(1, 61)}
    items = [(i, f"Model {i}", "Maker", "red", "Boots", "", "", "", [], colours[i], [], f"u{i}", "") for i in range(1, 61)]
    tables.write_jsonl(spark.createDataFrame(items, tables.ITEMS), f"file://{root}/items.jsonl")
    return root


def test_all_commands_of_an_evaluation(spark, catalogue_of_60, tmp_path):
    """testset, index, calibrate and eval in a row; query and eval agree on the first item, its probability and the refusal."""
    import json

    given = ["--items", f"file://{catalogue_of_60}/items.jsonl", "--images", f"file://{catalogue_of_60}/images"]
    out = cli.main(["all", *given, "--out", str(tmp_path), "--n-items", "12", "--n-ooc", "8", "--least", "5", "--boot", "50"], spark)
    assert out["testset"] == {"clean": 12, "hard": 36, "out_of_catalogue": 8}
    held = {r[0] for r in tables.read_ids(spark, f"file://{tmp_path}/testset/exclude_from_index.json").collect()}
    assert len(held) >= 8 and out["index"] == 3 * (60 - len(held))
    assert out["calibrate"]["n"] == 60 and out["calibrate"]["with_quality"]["auroc_calibrated"] > 0.6
    three = out["eval"]["refusal"]["three_way"]
    assert set(three) >= {"far", "frr", "wrong_accept"} and 0 <= three["frr"] <= 1 and out["eval"]["clean"]["latency_ms_median"] > 0
    rows = [json.loads(x) for p in (tmp_path / "report" / "per_photo").glob("*.json") for x in p.read_text().splitlines()]
    assert len(rows) == 56 and all(r["set_size"] is not None and (r["set_size"] == 0) == r["refused"] for r in rows)
    ask = cli.main(["query", "--images", f"file://{tmp_path}/testset/hard", "--index", f"file://{tmp_path}/index", "--calibrator", f"file://{tmp_path}/calibrator", "--k", "5"], spark)
    key = lambda r: (r["top1"], round(r["p_match"], 9), r["refused"])
    first = sorted((r["item_id"], round(r["p_match"], 9), r["refused"]) for r in ask if r["rank"] == 1)
    assert first == sorted(key(r) for r in rows if r["kind"] == "hard")


def test_bakeoff_shotlist_and_images(spark, catalogue_of_60, tmp_path, monkeypatch):
    given = ["--items", f"file://{catalogue_of_60}/items.jsonl"]
    rows = cli.main(["bakeoff", *given, "--images", f"file://{catalogue_of_60}/images", "--encoder", "colour-grid", "--held", "5"], spark)
    assert rows[0]["clean_r1"] > 0.9 and rows[0]["clean_n"] >= 50 and 0 <= rows[0]["hard_auroc"] <= 1
    (tmp_path / "have.txt").write_text("maker MODEL 7\n\nnothing of that kind\n")
    out = cli.main(["shotlist", "--have", f"file://{tmp_path}/have.txt", *given, "--out", f"file://{tmp_path}/shots"], spark)
    assert out == {"resolved": 1, "photos_each": 8, "missing": ["nothing of that kind"]}
    best = spark.read.option("header", True).csv(f"file://{tmp_path}/shots/shotlist.csv").where("rank = 1").first()
    assert best.item_id == "7" and spark.read.option("header", True).csv(f"file://{tmp_path}/shots/shot_plan.csv").count() == 8
    items = spark.createDataFrame([(1, ["http://a/0", "http://a/1", "http://a/2"])], "product_id long, images array<string>")
    tables.write_jsonl(items, f"file://{tmp_path}/two.jsonl")
    monkeypatch.setattr(cli.web, "http_get", lambda url: b"x" + url.encode())
    args = ["images", "--items", f"file://{tmp_path}/two.jsonl", "--root", str(tmp_path / "got"), "--views", "2", "--delay", "0"]
    assert cli.main(args, spark) == {"ok": {"n": 2, "failed_urls": []}} and cli.main(args, spark)["skipped"]["n"] == 2
    assert (tmp_path / "got" / "01" / "1" / "1.jpg").read_bytes() == b"xhttp://a/1"


def test_present_views_usable_items_and_summary(spark, shop):
    from tessella.operators import catalogue, guards

    files = tables.files_below(spark, f"file://{shop}")
    views = spark.createDataFrame([(1, 0), (1, 7), (2, 1)], "item_id long, view_id int")
    jpg = files.selectExpr("regexp_replace(filename, 'png$', 'jpg') as filename")
    assert sorted(tuple(r) for r in catalogue.present_views(views, jpg).collect()) == [(1, 0), (2, 1)]
    assert [tuple(r) for r in catalogue.usable_items(views, 2, 5).collect()] == [(1, 2)]
    photos = spark.createDataFrame([(1, "hard", "test", ["low_light"]), (None, "out_of_catalogue", "dev", [])], "item_id long, kind string, split string, conditions array<string>")
    s = guards.summarise(photos)
    assert s["photos"] == 2 and s["items"] == 1 and s["mean_conditions_per_hard_photo"] == 1.0 and s["conditions"] == {"low_light": 1} and s["by_kind"]["hard"] == 1
    assert tables.read_ids(spark, f"file://{shop}/none").count() == 0
