"""Commands over folders: harvest, parse, images, index, query, bench, testset, calibrate, eval, bakeoff, shotlist, all. `python -m tessella.cli COMMAND --help`."""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import catalogue, confidence, encode, evaluate, graph, guards, search, stats
from tessella.operators.calibrate import Calibrator, fit_both
from tessella.operators.vector_index import Whitening, cap_views
from tessella.sources import tables, web


def harvest(spark: SparkSession, a: argparse.Namespace) -> int:
    """Sitemap files to refs: JSON lines."""
    files = tables.read_text_any(spark, a.sitemaps).withColumn("sitemap_no", F.dense_rank().over(Window.orderBy("path")))
    refs = catalogue.harvest(catalogue.parse_sitemap(files, X.product_pattern(a.site)), tuple(a.category) or None, a.limit)
    return tables.write_jsonl(refs.select("product_id", "category", "brand", "slug", "url"), a.out)


def parse(spark: SparkSession, a: argparse.Namespace) -> int:
    """Fetched pages (Parquet: url, html) to items, appended: those already there stay."""
    return tables.append_new(catalogue.parse_products(spark.read.parquet(a.pages), a.fetched_at), a.out, "product_id", tables.ITEMS)


def index(spark: SparkSession, a: argparse.Namespace) -> int:
    """Images root/<shard>/<id>/<view>.<suffix> to an index folder, whitened if a dimension is given, fitted before views are capped."""
    images = item_images(spark, a.images)
    images = images.join(tables.read_ids(spark, a.exclude, "item_id"), "item_id", "left_anti") if a.exclude else images
    e = encode.encoder(a.encoder)
    views = tables.written(encode.encode_views(images, e), "views")
    search.check_index(views)
    if a.whiten:
        w = Whitening(a.whiten).fit(views)
        views = tables.written(w.transform(views), "views")
        tables.save_state(spark, w.state(), Whitening.SCHEMA, f"{a.out}/whiten")
    views = cap_views(views, a.views)
    tables.save_index(views, {"backbone": e.name, "image_size": e.size, "pooling": encode.Config().pooling, "whiten_dim": a.whiten}, a.out)
    return spark.read.parquet(f"{a.out}/views").count()


def images(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The first views of the items in a JSON lines file, downloaded to root/<shard>/<id>/<view>.jpg; files that are there are skipped."""
    views = catalogue.item_views(tables.read_jsonl(spark, a.items, tables.ITEMS), a.views, None, a.limit)
    done = tables.download(views.repartition(a.workers), a.root, web.http_get, a.delay * a.workers)
    return {r.status: {"n": r.n, "failed_urls": r.failed_urls} for r in tables.download_summary(done).collect()}


def whitened(spark: SparkSession, vectors: DataFrame, where: str, meta: dict) -> DataFrame:
    if not meta["whiten_dim"]:
        return vectors
    if not tables.exists(spark, f"{where}/whiten"):
        raise FileNotFoundError(f"{where}/whiten: the index is whitened, its whitening is missing")
    return Whitening.of(tables.load_state(spark, f"{where}/whiten")).transform(vectors)


def asked(spark: SparkSession, photos: DataFrame, where: str, localised: bool = True) -> tuple[DataFrame, DataFrame]:
    """Crop vectors (query_id, crop, emb) as the index has them, and each photo's own features, from query_id, image."""
    _, meta = tables.load_index(spark, where)
    found = tables.written(encode.encode_queries(photos, encode.encoder(meta["backbone"]), encode.Config(meta["image_size"], meta["pooling"]), localised), "crops")
    crops = whitened(spark, found.select("query_id", "crop", "emb"), where, meta)
    return tables.written(crops, "crops"), found.select("query_id", *confidence.QUALITY)


def crop_vectors(spark: SparkSession, path: str, where: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, query_id), crop vectors as the index has them, and the photos' own features."""
    photos = tables.read_images(spark, path).withColumn("query_id", F.xxhash64("path"))
    return photos.select("query_id", "path"), *asked(spark, photos, where)


def calibration(spark: SparkSession, where: str | None) -> tuple[Calibrator | None, DataFrame | None, float]:
    """The calibrator and conformal scores that the calibrate command left in a folder."""
    if not where or not tables.exists(spark, f"{where}/with_quality"):
        return None, None, 0.1
    model = Calibrator.of(tables.load_state(spark, f"{where}/with_quality"))
    if not tables.exists(spark, f"{where}/conformal"):
        return model, None, 0.1
    return model, spark.read.parquet(f"{where}/conformal/scores"), tables.load_state(spark, f"{where}/conformal/state")["alpha"]


def query(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """The k best items for each image, with the probability that the first is right and the conformal decision where there is a calibrator."""
    views, _ = tables.load_index(spark, a.index)
    paths, crops, own = crop_vectors(spark, a.images, a.index)
    found = tables.written(search.lookup(crops, views, a.k), "found")
    model, cal, alpha = calibration(spark, a.calibrator)
    if model is not None:
        p = tables.written(model.predict(confidence.photo_features(crops, views, own)).select("query_id", "p_match"), "p-match")
        found = found.join(p, "query_id")
        if cal is not None:
            sets = confidence.prediction_sets(found, cal, alpha)
            found = found.join(sets.select("query_id", "refused", F.size("items").alias("set_size")), "query_id", "left")
    found = found.join(paths, "query_id")
    if a.items:
        names = tables.read_jsonl(spark, a.items, tables.ITEMS).select(F.col("product_id").alias("item_id"), X.label(F.col("brand"), F.col("name")).alias("label"))
        found = found.join(names, "item_id", "left")
    rows = found.orderBy("path", "rank").drop("query_id").collect()  # k for each photo that was asked about
    return [r.asDict() for r in rows]


def bench(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Seconds of whole lookups of the photos, again and again: n, median, and the value at place int(0.9 n)."""
    views, _ = tables.load_index(spark, a.index)
    _, crops, _ = crop_vectors(spark, a.images, a.index)
    times = []
    for _ in range(a.rounds):
        began = time.perf_counter()
        search.lookup(crops, views, 5).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    times.sort()
    return {"n": len(times), "median": times[len(times) // 2], "p90": times[min(int(0.9 * len(times)), len(times) - 1)]}


def evaluation(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A manifest and its photos against an index: guards, results of the whole lookup (all crops, calibrator, refusal), report.

    latency_ms is the time of encoding and searching all photos, shared equally: photos are looked up together.
    """
    views, _ = tables.load_index(spark, a.index)
    photos = guards.load_manifest(tables.read_manifest(spark, a.manifest), files=tables.files_below(spark, a.photos))
    guards.check_split_disjoint(photos)
    guards.check_indexed(photos, views)
    began = time.perf_counter()
    paths, crops, own = crop_vectors(spark, a.photos, a.index)
    named = photos.join(paths, F.expr("endswith(path, concat('/', filename))"))  # a labelled set, made by hand
    ids = tables.written(named.select("query_id", F.xxhash64("photo_id").alias("photo")), "named")
    keyed = lambda d: d.join(ids, "query_id").drop("query_id").withColumnRenamed("photo", "query_id")
    crops, own = keyed(crops), keyed(own)
    queries = tables.written(search.by_query(crops), "queries")
    model, cal, alpha = calibration(spark, a.calibrator)
    p = None if model is None else tables.written(model.predict(confidence.photo_features(crops, views, own)), "p-match")
    styles = graph.style_clusters(tables.read_jsonl(spark, a.items, tables.ITEMS)) if a.items else None
    rows = photos.withColumn("photo_id", F.xxhash64("photo_id"))
    results = tables.written(evaluate.photo_results(rows, queries, views, styles, a.k, p, cal, alpha), "results")
    each = 1000 * (time.perf_counter() - began) / max(1, ids.count())
    results = results.withColumn("latency_ms", F.lit(each))
    report = evaluate.evaluate(results, a.split, a.boot)
    evaluate.save_report(report, results, a.out)
    return report


def item_images(spark: SparkSession, root: str) -> DataFrame:
    """item_id, view_id, image of the files root/<shard>/<id>/<view>.<suffix>."""
    place = r"/\d{2}/(\d+)/(\d+)\.\w+$"
    found = tables.read_images(spark, root).withColumns({"item_id": F.regexp_extract("path", place, 1).try_cast("long"), "view_id": F.regexp_extract("path", place, 2).try_cast("int")})
    return found.where("item_id is not null").select("item_id", "view_id", "image")


def calibrate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Fits the calibrators and the conformal step on corrupted catalogue pictures: of indexed items, and of items of which no colourway is indexed.

    A row counts as right where the lookup's first item is its own. Folds are disjoint in items. Writes with_quality, no_quality and conformal below out.
    """
    views, _ = tables.load_index(spark, a.index)
    items = tables.read_jsonl(spark, a.items, tables.ITEMS)
    pictures = item_images(spark, a.images)
    styles = tables.written(graph.style_clusters(items), "styles")
    ids = items.select(F.col("product_id").alias("item_id")).distinct().join(pictures.select("item_id").distinct(), "item_id", "left_semi")
    indexed = views.select("item_id").distinct()
    absent = tables.written(catalogue.absent_items(ids, indexed, styles).select("item_id"), "absent")
    guards.check_enough(absent, a.least, "items of which nothing is indexed")
    present = ids.join(indexed, "item_id", "left_semi")
    first = lambda d, n, there: catalogue.first_drawn(d, "item_id", a.seed, n).withColumn("present", F.lit(there))
    picked = tables.written(first(present, a.positives, True).unionByName(first(absent, a.negatives, False)), "picked")
    one = catalogue.first_seen(pictures.join(picked, "item_id"), ["item_id"], [F.xxhash64(F.lit(a.seed), "item_id", "view_id")])
    photos = tables.written(encode.corrupted(one.select(F.col("item_id").alias("query_id"), "image"), a.seed), "corrupted")
    crops, own = asked(spark, photos, a.index, a.localise)
    top = search.lookup(crops, views, 1).select("query_id", F.col("item_id").alias("top1"), "score")
    rows = confidence.photo_features(crops, views, own).join(top, "query_id").join(picked.withColumnRenamed("item_id", "query_id"), "query_id")
    rows = rows.withColumn("item_id", F.col("query_id")).withColumn("y", (F.col("present") & (F.col("top1") == F.col("item_id"))).cast("int"))
    rows = tables.written(rows, "calibration")
    full, plain, scores = fit_both(rows)
    tables.save_state(spark, full.state(), Calibrator.SCHEMA, f"{a.out}/with_quality")
    tables.save_state(spark, plain.state(), Calibrator.SCHEMA, f"{a.out}/no_quality")
    scores.write.mode("overwrite").parquet(f"{a.out}/conformal/scores")
    tables.save_state(spark, {"alpha": a.alpha}, "alpha DOUBLE", f"{a.out}/conformal/state")
    area = lambda d, c: stats.auroc(d.withColumn("positive", F.col("y") == 1), c).first().auroc
    out = {"n": rows.count(), "pos_rate": rows.agg(F.avg("y")).first()[0], "conformal": {"alpha": a.alpha, "n_calibration": rows.where("y = 1").count()}}
    for name, model in (("with_quality", full), ("no_quality", plain)):
        out[name] = {"auroc_calibrated": area(model.predict(rows), "p_match"), "auroc_raw": area(rows, "score"), "top_coefficients": model.coefficients()[:8]}
    return out


def testset(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A test set made from catalogue pictures: clean and corrupted photos of items, corrupted ones of items that are to be left out of the index.

    Writes the photos as PNG files (out is a folder that all executors mount), manifest.csv and exclude_from_index.json. Whole styles are held out.
    """
    items = tables.read_jsonl(spark, a.items, tables.ITEMS)
    pictures = item_images(spark, a.images).where(F.col("view_id") < 5)
    usable = tables.written(catalogue.usable_items(pictures.select("item_id", "view_id"), a.least_views, a.limit), "usable")
    guards.check_enough(usable, a.n_items + a.n_ooc, "usable items")
    only = usable.select(F.col("item_id").alias("product_id"))
    styles = graph.style_clusters(items, only)
    usable = usable.select("item_id").join(styles, "item_id", "left").withColumn("style_id", F.coalesce("style_id", "item_id"))
    out_of, rest = catalogue.out_of_catalogue(usable, a.n_ooc, a.seed)
    out_of = tables.written(out_of, "ooc")
    inside = tables.written(catalogue.dev_test(catalogue.first_drawn(rest, "item_id", a.seed + 1, a.n_items), a.seed + 2), "inside")

    # view 0 of an item's views is the clean control, hard photos take the others in turn
    at = Window.partitionBy("item_id").orderBy("view_id")
    numbered = pictures.withColumn("no", F.row_number().over(at) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    hard = inside.select("item_id", "split", F.explode(F.sequence(F.lit(0), F.lit(a.per_item - 1))).alias("j"))
    hard = hard.join(numbered, "item_id").where(F.col("no") == 1 + F.pmod(F.col("j"), F.greatest(F.lit(1), F.col("n") - 1)))
    of = lambda d, kind, split, name: d.select(F.lit(kind).alias("kind"), split.alias("split"), "item_id", name.alias("filename"), "image")
    jobs = of(inside.join(numbered.where("no = 0"), "item_id"), "clean", F.col("split"), F.format_string("clean/%d.png", "item_id"))
    jobs = jobs.unionByName(of(hard, "hard", F.col("split"), F.format_string("hard/%d_%d.png", "item_id", "j")))
    jobs = jobs.unionByName(of(out_of.join(numbered.where("no = 0"), "item_id"), "out_of_catalogue", F.lit("test"), F.format_string("ooc/%d.png", "item_id")))
    jobs = tables.written(jobs.withColumn("query_id", F.xxhash64("filename")), "photos")
    made = encode.corrupted(jobs.where("kind <> 'clean'"), a.seed, encode.I.sample_conditions)
    done = tables.written(made.unionByName(jobs.where("kind = 'clean'").select("query_id", F.lit("").alias("recipe"), "image")).join(jobs.drop("image"), "query_id"), "photos")
    encode.write_pngs(done.select("filename", "image"), a.out).write.format("noop").mode("overwrite").save()
    conditions = F.array_join(F.transform(X.split_list(F.col("recipe")), lambda x: F.split_part(x, F.lit(":"), F.lit(1))), "|")
    item = F.when(F.col("kind") == "out_of_catalogue", "").otherwise(F.col("item_id").cast("string"))
    manifest = done.select(
        F.regexp_replace("filename", r"[/.]", "-").alias("photo_id"), "filename", item.alias("item_id"), "kind", "split", conditions.alias("conditions"), F.lit("false").alias("occludes_logo"), F.lit("exact").alias("sku_confidence"),
        F.when(F.col("kind") == "out_of_catalogue", "style left out of the index").otherwise(F.replace(F.col("recipe"), F.lit("|"), F.lit(";"))).alias("notes"),
    )
    where = a.out if "://" in a.out else f"file://{os.path.abspath(a.out)}"
    tables.write_csv(manifest.orderBy("photo_id").coalesce(1), f"{where}/manifest.csv")
    tables.write_ids(usable.join(out_of.select("style_id").distinct(), "style_id", "left_semi").select("item_id"), f"{where}/exclude_from_index.json")
    return {r.kind: r["count"] for r in manifest.groupBy("kind").count().collect()}


def bakeoff(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """Encoders against each other: the first view of each item asks for it in an index of the others, clean and corrupted; held-out styles give the absent."""
    items = tables.read_jsonl(spark, a.items, tables.ITEMS)
    pictures = item_images(spark, a.images)
    styles = tables.written(graph.style_clusters(items), "styles")
    held, _ = catalogue.hold_out(styles, a.held, a.seed)
    rows = []
    for name in a.encoder or sorted(encode.REGISTRY):
        began = time.perf_counter()
        e = encode.encoder(name)
        views = tables.written(encode.encode_views(pictures.where("view_id > 0").join(held.select("item_id"), "item_id", "left_anti"), e), "views")
        row = {"backbone": name, "dim": search.check_index(views), "image_size": e.size, "pooling": encode.Config().pooling, "n_index_rows": views.count(), "index_seconds": round(time.perf_counter() - began, 1)}
        asking = pictures.where("view_id = 0").select(F.col("item_id").alias("query_id"), "image")
        for tag, photos in (("clean", asking), ("hard", encode.corrupted(asking, a.seed))):
            emb = encode.encode_queries(photos, e, localised=False).where("crop = 'image'").select("query_id", F.col("query_id").alias("item_id"), "emb")
            emb = tables.written(emb, "asked")
            there, absent = emb.join(views.select("item_id").distinct(), "item_id", "left_semi"), emb.join(held.select("item_id"), "item_id", "left_semi")
            row |= {f"{tag}_{k}": v for k, v in evaluate.bake_off(there, views, styles, absent).first().asDict().items()}
        rows.append(row | {"total_seconds": round(time.perf_counter() - began, 1)})
    return rows


#: A photo of each kind for an item on the list: single conditions are what tells their effects apart.
PLAN = (("clean", ""), *(("hard", c) for c in ("low_light", "motion_blur", "off_angle", "partial_occlusion hand_or_foot_in_frame", "cluttered_background small_in_frame", "specular_reflection", "low_light motion_blur")))


def shotlist(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Titles in a text file, one a line, to the catalogue items that they may be, and the photos to take of each; lines that match nothing are returned."""
    lines = spark.read.text(a.have).select(F.trim("value").alias("text")).where("text <> ''").distinct().withColumn("query_id", F.xxhash64("text"))
    items = tables.read_jsonl(spark, a.items, tables.ITEMS)
    titles = items.select(F.col("product_id").alias("item_id"), F.concat_ws(" ", "brand", "name").alias("text"))
    best, lost = catalogue.resolve_titles(lines, titles, a.k)
    found = best.join(lines, "query_id").join(items.withColumnRenamed("product_id", "item_id"), "item_id")
    found = found.select(F.col("text").alias("title"), "rank", F.round("score", 3).alias("score"), "item_id", "brand", "name", F.col("base_colour").alias("colour"), F.col("source_url").alias("url"))
    tables.write_csv(found.orderBy("title", "rank").coalesce(1), f"{a.out}/shotlist.csv")
    plan = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(PLAN)], "shot int, kind string, conditions string")
    tables.write_csv(found.where("rank = 1").select("title").crossJoin(F.broadcast(plan)).orderBy("title", "shot").coalesce(1), f"{a.out}/shot_plan.csv")  # a few rows
    lost = [r.text for r in lost.join(lines, "query_id").orderBy("text").collect()]  # lines of a list made by hand
    return {"resolved": found.where("rank = 1").count(), "photos_each": len(PLAN), "missing": lost}


def everything(spark: SparkSession, a: argparse.Namespace) -> dict:
    """testset, index without what it holds out, calibrate, eval, one after the other below out."""
    where = a.out if "://" in a.out else f"file://{os.path.abspath(a.out)}"
    run = lambda *argv: COMMANDS[argv[0]](spark, parser().parse_args([str(x) for x in argv]))
    given = ("--items", a.items, "--images", a.images)
    out = {"testset": run("testset", *given, "--out", f"{a.out}/testset", "--n-items", a.n_items, "--n-ooc", a.n_ooc, "--seed", a.seed)}
    whiten = ("--whiten", a.whiten) if a.whiten else ()
    out["index"] = run("index", "--images", a.images, "--out", f"{where}/index", "--exclude", f"{where}/testset/exclude_from_index.json", *whiten)
    out["calibrate"] = run("calibrate", *given, "--index", f"{where}/index", "--out", f"{where}/calibrator", "--least", a.least, "--seed", a.seed)
    out["eval"] = run("eval", "--manifest", f"{where}/testset/manifest.csv", "--photos", f"{where}/testset", "--index", f"{where}/index", "--items", a.items, "--calibrator", f"{where}/calibrator", "--out", f"{a.out}/report", "--boot", a.boot)
    return out


COMMANDS = {
    "harvest": harvest, "parse": parse, "images": images, "index": index, "query": query, "bench": bench, "testset": testset, "calibrate": calibrate, "eval": evaluation,
    "bakeoff": bakeoff, "shotlist": shotlist, "all": everything,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *required: [c := sub.add_parser(name), [c.add_argument(f"--{r}", required=True) for r in required]][0]
    c = add("harvest", "sitemaps", "site", "out")
    c.add_argument("--category", action="append", default=[])
    c.add_argument("--limit", type=int)
    add("parse", "pages", "out").add_argument("--fetched-at", default="")
    c = add("index", "images", "out")
    c.add_argument("--encoder", default="colour-grid")
    c.add_argument("--whiten", type=int)
    c.add_argument("--views", type=int, default=4)
    c.add_argument("--exclude")
    c = add("images", "items", "root")
    c.add_argument("--views", type=int)
    c.add_argument("--limit", type=int)
    c.add_argument("--workers", type=int, default=8)
    c.add_argument("--delay", type=float, default=0.05)
    c = add("query", "images", "index")
    c.add_argument("--k", type=int, default=5)
    c.add_argument("--items")
    c.add_argument("--calibrator")
    c = add("testset", "items", "images", "out")
    for name, n in (("n-items", 40), ("per-item", 3), ("n-ooc", 20), ("least-views", 3), ("seed", 0)):
        c.add_argument(f"--{name}", type=int, default=n)
    c.add_argument("--limit", type=int)
    c = add("calibrate", "items", "images", "index", "out")
    for name, n in (("positives", 900), ("negatives", 600), ("least", 30), ("seed", 0)):
        c.add_argument(f"--{name}", type=int, default=n)
    c.add_argument("--alpha", type=float, default=0.1)
    c.add_argument("--localise", action="store_true")
    c = add("bakeoff", "items", "images")
    c.add_argument("--encoder", action="append")
    c.add_argument("--held", type=int, default=20)
    c.add_argument("--seed", type=int, default=0)
    add("shotlist", "have", "items", "out").add_argument("--k", type=int, default=5)
    c = add("all", "items", "images", "out")
    for name, n in (("n-items", 40), ("n-ooc", 20), ("least", 30), ("seed", 0), ("boot", 10_000)):
        c.add_argument(f"--{name}", type=int, default=n)
    c.add_argument("--whiten", type=int)
    add("bench", "images", "index").add_argument("--rounds", type=int, default=10)
    c = add("eval", "manifest", "photos", "index", "out")
    c.add_argument("--items")
    c.add_argument("--calibrator")
    c.add_argument("--split", default="test")
    c.add_argument("--k", type=int, default=5)
    c.add_argument("--boot", type=int, default=10_000)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(argv)
    out = COMMANDS[a.command](spark or SparkSession.builder.getOrCreate(), a)
    print(json.dumps(out, indent=1, default=str))
    return out


if __name__ == "__main__":
    main()
