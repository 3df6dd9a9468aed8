"""From URL lists and pages to catalogue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.ordered import running
from tessella.sources.tables import written

# The article types that count as footwear.
FOOTWEAR = ("Casual-Shoes", "Sports-Shoes", "Sneakers", "Formal-Shoes", "Boots", "Sandals", "Sports-Sandals", "Flip-Flops", "Heels", "Flats")
# Fixed value: the variable that holds a page's record.
BLOB = r"(?s)window\.__myx\s*=\s*(\{.*?\})\s*;?\s*</script>"


def list_sitemaps(index: DataFrame, first: int | None = None) -> DataFrame:
    """sitemap_no, url of an index file's text; an index without a row is an error."""
    rows = index.select(F.posexplode(X.locations(F.col("text"))).alias("sitemap_no", "url"))
    if index.isEmpty():
        raise FileNotFoundError("the sitemap index is missing")
    return rows if first is None else rows.where(F.col("sitemap_no") < first)


def parse_sitemap(sitemaps: DataFrame, pattern: str) -> DataFrame:
    """sitemap_no, text to sitemap_no, pos and the parts of each product URL; other URLs are dropped."""
    rows = sitemaps.select("sitemap_no", F.posexplode(X.locations(F.col("text"))).alias("pos", "url"))
    return rows.where(F.col("url").rlike(pattern)).withColumns(X.product_parts(F.col("url"), pattern))


def harvest(refs: DataFrame, categories: tuple[str, ...] | None = FOOTWEAR, limit: int | None = None) -> DataFrame:
    """The first ref of each product in source order, after the category filter."""
    rows = refs if categories is None else refs.where(F.col("category").isin(*categories))
    out = first_seen(rows, ["product_id"], ["sitemap_no", "pos"])
    return out if limit is None else out.orderBy("sitemap_no", "pos").limit(limit)


def first_seen(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key. Partial minima, no sort: one row for each key and task is shuffled."""
    by = [c if isinstance(c, Column) else F.col(c) for c in order]
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), key).alias("first")).select("first.*")


def pending(refs: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """What isn't done yet; the limit counts after that."""
    out = refs.join(done.select(key).distinct(), key, "left_anti")
    return out if limit is None else out.orderBy(key).limit(limit)


def parse_products(pages: DataFrame, fetched_at: str = "", width: int = 1080, height: int = 1440, quality: int = 90) -> DataFrame:
    """url, html to catalogue records; pages without a well-formed record or with an id that isn't a number are dropped."""
    blob = F.try_parse_json(F.nullif(F.regexp_extract("html", BLOB, 1), F.lit("")))
    rows = pages.select("url", blob.alias("v")).where("v is not null")
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    album = "array<struct<name:string,images:array<struct<src:string>>>>"
    kept = F.filter(F.coalesce(get("$.pdpData.media.albums", album), F.array().cast(album)), lambda a: X.filled(a["name"]).isin("", "default"))
    src = F.flatten(F.transform(kept, lambda a: F.coalesce(a["images"]["src"], F.array().cast("array<string>"))))
    src = F.filter(src, lambda s: X.filled(s) != "")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.pdpData.id", "variant"))
    return rows.where(kind == "BIGINT").select(
        get("$.pdpData.id", "long").alias("product_id"),
        X.filled(get("$.pdpData.name")).alias("name"),
        X.filled(get("$.pdpData.brand.name"), get("$.pdpData.analytics.brand")).alias("brand"),
        get("$.pdpData.baseColour").alias("base_colour"),
        get("$.pdpData.analytics.articleType").alias("article_type"),
        get("$.pdpData.analytics.subCategory").alias("sub_category"),
        get("$.pdpData.analytics.masterCategory").alias("master_category"),
        get("$.pdpData.analytics.gender").alias("gender"),
        F.array_distinct(F.transform(src, lambda s: X.image_url(s, width, height, quality))).alias("images"),
        X.loose_ids(F.try_variant_get("v", "$.pdpData.colours", "variant")).alias("colour_variants"),
        X.loose_ids(F.try_variant_get("v", "$.pdpData.relatedStyles", "variant")).alias("related_styles"),
        F.col("url").alias("source_url"),
        F.lit(fetched_at).alias("fetched_at"),
    )


def item_views(items: DataFrame, k: int | None = None, excluded: DataFrame | None = None, first_items: int | None = None) -> DataFrame:
    """item_id, view_id (from 0), url: at most k views of each item that isn't excluded; first_items counts items, all their views stay."""
    rows = items.select(F.col("product_id").alias("item_id"), "images")
    if excluded is not None:
        rows = rows.join(excluded.select(F.col("product_id").alias("item_id")).distinct(), "item_id", "left_anti")
    if first_items is not None:
        rows = rows.where(F.size("images") > 0).orderBy("item_id").limit(first_items)
    views = F.col("images") if k is None else F.slice("images", 1, k)
    return rows.select("item_id", F.posexplode(views).alias("view_id", "url"))


def present_views(views: DataFrame, files: DataFrame, root: str = "images") -> DataFrame:
    """The views (item_id, view_id) whose sharded file is there; files: filename relative to the folder above root."""
    path = X.shard_path(F.col("item_id"), F.col("view_id").cast("long"), root)
    return views.join(files.select(F.col("filename").alias("__file")).distinct(), path == F.col("__file"), "left_semi")


def usable_items(views: DataFrame, least: int = 3, first: int | None = None) -> DataFrame:
    """item_id, n_views of the items with enough views, the first of them by id."""
    out = views.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_views")).where(F.col("n_views") >= least)
    return out if first is None else out.orderBy("item_id").limit(first)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds place from 1 in an order that a hash of seed and key draws: the same on any cluster."""
    return running(rows, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)])


def first_drawn(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The first n rows of that order, without ordering the others."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def hold_out(items: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(held, rest) of item_id, style_id: whole styles of the first n items drawn are held."""
    styles = first_drawn(items, "item_id", seed, n).select("style_id").distinct()
    return items.join(styles, "style_id", "left_semi"), items.join(styles, "style_id", "left_anti")


def out_of_catalogue(items: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(picked, in_catalogue): the first n items drawn, and the items of other styles."""
    picked = first_drawn(items, "item_id", seed, n)
    return picked, items.join(picked.select("style_id").distinct(), "style_id", "left_anti")


def dev_test(items: DataFrame, seed: int) -> DataFrame:
    """Adds split: the first max(1, n / 4) items drawn are dev."""
    n = F.broadcast(items.agg(F.count(F.lit(1)).alias("__n")))  # one row
    dev = F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 4))
    return shuffled(items, "item_id", seed).crossJoin(n).withColumn("split", F.when(dev, "dev").otherwise("test")).drop("place", "__n")


def absent_items(wanted: DataFrame, indexed: DataFrame, styles: DataFrame) -> DataFrame:
    """Items that aren't indexed and of whose style nothing is; an item without a style is its own."""
    style = lambda d: d.join(styles, "item_id", "left").withColumn("style_id", F.coalesce("style_id", "item_id"))
    out = style(wanted).join(indexed.select("item_id"), "item_id", "left_anti")
    return out.join(style(indexed).select("style_id").distinct(), "style_id", "left_anti")


def resolve_titles(queries: DataFrame, titles: DataFrame, k: int = 3, least: float = 0.5, per_extra: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """query_id, text and item_id, text to (query_id, rank, item_id, score of the k best by token overlap; the queries whose best is below least).

    A title that scores s covers that share of the query's tokens at least, so it shares one of the query's rarest tokens, all but the
    ceil(s * n) - 1 commonest. With s = least these find whether a query has a title, and its k-th best score among them; with that as s they
    find its k best, exactly. So common words join nothing, but for queries of which fewer than k titles are near.
    """
    t = titles.select("item_id", X.tokens(F.col("text")).alias("t"))
    t = written(t.select("item_id", F.size("t").alias("nt"), "t"), "titles")
    words = t.select("item_id", F.explode("t").alias("token"))
    whole = queries.select("query_id", X.tokens(F.col("text")).alias("q")).withColumn("nq", F.size("q"))
    asked = whole.select("query_id", "nq", F.explode("q").alias("token"))
    counts = words.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    place = Window.partitionBy("query_id").orderBy(F.coalesce("c", F.lit(0)), "token")
    asked = written(asked.join(counts, "token", "left").select("query_id", "nq", "token", F.row_number().over(place).alias("place")), "title-tokens")

    def near(seeds: DataFrame, s: Column) -> DataFrame:
        """Every title that scores s or more for a query, and others, with score and rank. seeds: asked, with what s needs."""
        rare = seeds.where(F.col("place") <= F.col("nq") - F.ceil(F.col("nq") * s - 1e-9) + 1)
        pairs = words.join(rare.select("query_id", "token"), "token").select("query_id", "item_id").distinct()
        score = F.size(F.array_intersect("t", "q")) / F.col("nq") - F.lit(per_extra) * F.greatest(F.lit(0), F.col("nt") - F.col("nq"))
        scored = pairs.join(t, "item_id").join(whole, "query_id").select("query_id", "item_id", score.alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    first = near(asked, F.lit(least)).groupBy("query_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).where(F.col("best") >= least)
    found = written(first.select("query_id", F.when(F.col("n") < k, F.lit(0.0)).otherwise(F.greatest("last", F.lit(0.0))).alias("s")), "resolved")
    best = near(asked.join(found, "query_id"), F.least(F.lit(1.0), F.greatest("s", 1 / F.col("nq"))))
    return best.select("query_id", "rank", "item_id", "score"), queries.select("query_id").join(found, "query_id", "left_anti")
