"""Small rules: colours, verdicts, retries, sitemaps' names, screenshot arithmetic; as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url as U

#: Sitemap names that say nothing, those that list single pages, sections of posts, size of a collection.
GENERIC_SITEMAP = ("", "sitemap", "index", "main", "pages", "page", "misc", "home", "sitemaps", "wp", "core")
PAGE_SITEMAPS = ("page", "pages")
POST_SECTIONS = r"(?i)^(blog|news|posts?|articles?|press|stories|insights|events?|updates|journal|resources)$"
NUMERIC_SEGMENT = r"^(\d+|\d{4}-\d{2}(-\d{2})?)$"
MIN_COLLECTION = 5
#: Waits in seconds; retries.
RETRY_FLOOR, RETRY_CAP, MAX_RETRIES = 5, 120, 4
#: What a picture may hold to be read unscaled.
PATCH, EDGE, TOKENS, MAX_STRIPS = 28, 2048, 4784, 40


def normalize_color(value: Column) -> Column:
    """#rrggbb, with @alpha where it is under 1; null for other notations."""
    v = F.lower(F.trim(value))
    rgba = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*([0-9.]+)\s*)?\)"
    channel = lambda i: F.lpad(F.lower(F.hex(F.regexp_extract(v, rgba, i).try_cast("int"))), 2, "0")
    alpha = F.regexp_extract(v, rgba, 4)
    hexed = F.concat(F.lit("#"), channel(1), channel(2), channel(3))
    short = F.regexp_replace(F.regexp_extract(v, r"^#([0-9a-f]{3})$", 1), "(.)", "$1$1")
    full = F.regexp_extract(v, r"^#([0-9a-f]{6})", 1)
    return (
        F.when(v.rlike(rgba), F.when((alpha != "") & (alpha.try_cast("double") < 1), F.concat(hexed, F.lit("@"), alpha)).otherwise(hexed))
        .when(short != "", F.concat(F.lit("#"), short))
        .when(full != "", F.concat(F.lit("#"), full))
    )


def family_names(families: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(families, F.lit("")), ","), lambda f: F.trim(f) != ""), lambda f: F.regexp_replace(F.trim(f), "^['\"]+|['\"]+$", ""))


def verdict(status: Column, hops: Column, noindex: Column) -> Column:
    return F.when((status == 200) & noindex, "noindex").when((status == 200) & (hops <= 1), "ok").when(status == 200, "chain").when(status.isin(404, 410), "missing").otherwise("error")


def retry_seconds(header: Column) -> Column:
    """Seconds that a Retry-After header in seconds asks for; null where it is absent or unreadable."""
    seconds = F.trim(header).try_cast("double")
    return F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0)))


def throttled(status: Column, header: Column) -> Column:
    return (status == 429) | ((status == 503) & retry_seconds(header).isNotNull())


def backoff(attempt: Column, header: Column, jitter: Column) -> Column:
    floor = RETRY_FLOOR * F.pow(F.lit(2.0), attempt - 1)
    return F.least(F.lit(float(RETRY_CAP)), F.greatest(F.coalesce(retry_seconds(header), F.lit(0.0)), floor) + jitter)


def sitemap_words(sitemap: Column) -> Column:
    """A sitemap's file name as words: post-sitemap2.xml is post."""
    last = F.lower(F.element_at(F.split(U.path(F.coalesce(sitemap, F.lit(""))), "/"), -1))
    name = F.regexp_replace(last, r"\.xml(\.gz)?$", "")
    parts = F.split(name, "-")
    core = F.when((F.size(parts) > 3) & F.get(parts, 2).isin("posts", "taxonomies", "users"), F.get(parts, 3)).otherwise("")
    name = F.when(name.startswith("wp-sitemap-"), core).otherwise(name)
    w = F.transform(F.split(name, "[-_.]+"), lambda x: F.regexp_replace(x, r"\d+$", ""))
    return F.array_join(F.filter(w, lambda x: (x != "") & (x != "sitemap")), "-")


def sitemap_label(sitemap: Column) -> Column:
    w = sitemap_words(sitemap)
    return F.when(~w.isin(*GENERIC_SITEMAP), w)


def norm_segment(segment: Column) -> Column:
    return F.when(segment.rlike(NUMERIC_SEGMENT), "{n}").otherwise(F.lower(segment))


def is_collection(template: Column) -> Column:
    return ~template.startswith("/") | template.contains("*") | template.contains("{n}")


def strip_height(width: Column) -> Column:
    """Tallest strip that is read unscaled at a width."""
    columns = F.ceil(width / PATCH)
    return (F.least(F.lit(EDGE // PATCH), F.floor(F.lit(TOKENS) / columns)) * PATCH).cast("int")


def overview_scale(width: Column, height: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(float(EDGE)) / F.greatest(width, height), PATCH * F.sqrt(F.lit(float(TOKENS)) / (width * height)) * 0.98)


def strip_plan(height: Column, strip: int, most: int = MAX_STRIPS) -> Column:
    """struct(strips, cut): (y, h) of each strip of a page, and whether some were left out."""
    h = F.greatest(F.lit(1), height.cast("int"))
    n = F.least(F.lit(most), F.ceil(h / strip).cast("int"))
    strips = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * strip).alias("y"), F.least(F.lit(strip), h - i * strip).alias("h")))
    return F.struct(strips.alias("strips"), (h > n * strip).alias("cut"))


def edge_groups(bands: Column) -> Column:
    """Bands by left edge: edges within 2 of a group's first are one; empty where all start on one line."""
    ordered = F.array_sort(F.transform(bands, lambda b, i: F.struct(b["x"].alias("x"), i.alias("i"), b["band"].alias("band"))))
    none = F.array().cast("array<struct<x:int,bands:array<string>>>")

    def grow(groups: Column, b: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        joined = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.struct(last["x"].alias("x"), F.concat(last["bands"], F.array(b["band"])).alias("bands"))))
        return F.when((F.size(groups) > 0) & (b["x"] - last["x"] <= 2), joined).otherwise(F.concat(groups, F.array(F.struct(b["x"].cast("int").alias("x"), F.array(b["band"]).alias("bands")))))

    return F.aggregate(ordered, none, grow, lambda g: F.when(F.size(g) > 1, g).otherwise(none))
