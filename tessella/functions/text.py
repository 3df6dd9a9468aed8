"""Column functions on strings, URLs and loosely typed JSON; all run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a product URL is scheme://host/<category>/<brand>/<slug>/<id>/buy, one optional slash at its end.
PRODUCT_PATH = r"/([^/]+)/([^/]+)/([^/]+)/(\d+)/buy/?$"
LOC = r"<loc>\s*([^<\s]+)\s*</loc>"
# Keys under which a related item's id may stand, in order of preference.
ID_KEYS = ("styleid", "styleId", "id", "productId")


def product_pattern(site: str) -> str:
    """The pattern of one site's product URLs, e.g. site="https://www.example.com"."""
    return "^" + site.replace(".", r"\.") + PRODUCT_PATH


def locations(text: Column) -> Column:
    """All <loc> URLs of a sitemap."""
    return F.regexp_extract_all(text, F.lit(LOC), 1)


def url_text(part: Column) -> Column:
    """+ is a space, percent escapes are decoded where they are well formed, spaces trimmed."""
    spaced = F.replace(part, F.lit("+"), F.lit(" "))
    return F.trim(F.coalesce(F.try_url_decode(spaced), spaced))


def product_parts(url: Column, pattern: str) -> dict[str, Column]:
    """product_id, category, brand and slug of a product URL; null product_id where it isn't one."""
    part = lambda i: F.regexp_extract(url, pattern, i)
    return {"product_id": F.when(url.rlike(pattern), part(4).cast("long")), "category": url_text(part(1)), "brand": url_text(part(2)), "slug": url_text(part(3))}


def filled(*values: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def image_url(src: Column, width: int = 1080, height: int = 1440, quality: int = 90) -> Column:
    """Fills the ($width), ($height) and ($qualityPercentage) places and forces https."""
    for name, value in (("width", width), ("height", height), ("qualityPercentage", quality)):
        src = F.replace(src, F.lit(f"(${name})"), F.lit(str(value)))
    return F.regexp_replace(src, "^http://", "https://")


def loose_ids(blob: Column) -> Column:
    """Ids of a JSON array (a VARIANT): integers, or the first usable id of an object; a digit string counts inside objects alone.

    As in the data this parses, true and false count as 1 and 0 where a number may stand.
    """
    entries = F.try_variant_get(blob, "$", "array<variant>")

    def number(v: Column, inside: bool) -> Column:
        kind = F.schema_of_variant(v)
        text = F.try_variant_get(v, "$", "string")
        out = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "long")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("long"))
        return out.when((kind == "STRING") & text.rlike("^[0-9]+$"), text.cast("long")) if inside else out

    def one(v: Column) -> Column:
        return F.coalesce(number(v, False), *[number(F.try_variant_get(v, f"$.{k}", "variant"), True) for k in ID_KEYS])

    return F.filter(F.transform(F.coalesce(entries, F.array().cast("array<variant>")), one), lambda x: x.isNotNull())


def tokens(text: Column) -> Column:
    """Distinct [a-z0-9]+ runs of the lower-cased text, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1))


def split_list(text: Column, sep: str = "|") -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), f"[{sep}]"), lambda x: F.trim(x)), lambda x: x != "")


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def utc_seconds(ts: Column) -> Column:
    """ISO text to the second, UTC sessions assumed; pass a fixed timestamp for repeatable runs."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def one_hot(values: Column, names: list[str]) -> list[Column]:
    return [F.array_contains(values, n).cast("double").alias(n) for n in names]


def coverage_score(query: Column, title: Column, per_extra: float = 0.02) -> Column:
    """Share of the query's tokens in the title, less a little for each token that the title has more."""
    nq, nt = F.size(query), F.size(title)
    return F.size(F.array_intersect(query, title)) / nq - F.lit(per_extra) * F.greatest(F.lit(0), nt - nq)


def shard_path(item: Column, view: Column, root: str = "images") -> Column:
    """root/<id % 100, two digits>/<id>/<view>.jpg"""
    return F.format_string("%s/%02d/%d/%d.jpg", F.lit(root), F.pmod(item, F.lit(100)), item, view)


def label(brand: Column, name: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(brand, F.lit("")), F.nullif(name, F.lit("")))
