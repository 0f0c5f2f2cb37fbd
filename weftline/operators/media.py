"""Pictures of a site by identity: occurrences folded, classified, selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import media as M
from ..functions import url as U


def rollup(seen: DataFrame) -> DataFrame:
    """seen(site, url, ord, step, pos, src, alt, srcset, chrome, background, og, width, height, shown, row, video, autoplay, heading, beside): one row per picture.

    chrome holds if every occurrence is chrome, background and og if any is; the first width counts, the largest shown size and row; pages list each page once.
    """
    v = M.variant(F.col("src"))
    rows = seen.where("src is not null and src != '' and not startswith(src, 'data:')").withColumn("v", v)
    at = F.struct("ord", "step", "pos")
    rows = rows.select("site", F.col("v.key").alias("key"), F.col("v.original").alias("original"), at.alias("at"), *[c for c in seen.columns if c not in ("site", "ord", "step", "pos")])

    def once(values: DataFrame, name: str) -> DataFrame:
        """values(site, key, at, v): distinct ones of a picture as first seen; copies are gone before they meet."""
        seen_at = values.groupBy("site", "key", "v").agg(F.min("at").alias("at"))
        return seen_at.groupBy("site", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(name))

    words = lambda c: rows.where(F.col(c).isNotNull() & (F.col(c) != "")).select("site", "key", F.struct("at", F.lit(0).alias("sub")).alias("at"), F.col(c).alias("v"))
    sizes = rows.select("site", "key", "at", F.posexplode("srcset").alias("sub", "v")).select("site", "key", F.struct("at", "sub").alias("at"), "v")
    page = rows.where("not og").groupBy("site", "key", "url").agg(F.min(F.struct("at", "heading", "beside")).alias("p"))
    pages = page.groupBy("site", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("p.at", "url", "p.heading", "p.beside"))), lambda x: F.struct(x["url"].alias("url"), x["heading"].alias("heading"), x["beside"].alias("beside"))).alias("pages"))
    sized = F.when(F.col("width").isNotNull() & (F.col("width") != 0), F.col("at"))
    body = rows.groupBy("site", "key").agg(
        F.min("at").alias("at"), F.min_by("original", "at").alias("original"),
        F.bool_and("chrome").alias("chrome"), F.bool_or("background").alias("background"), F.bool_or("og").alias("og"), F.min_by("width", sized).alias("width"), F.min_by("height", sized).alias("height"),
        F.max("shown").alias("shown"), F.max("row").alias("row"), F.coalesce(F.bool_or("video"), F.lit(False)).alias("video"), F.coalesce(F.bool_or("autoplay"), F.lit(False)).alias("autoplay"),
    )
    kinds = {"pages": "array<struct<url:string,heading:string,beside:string>>", "seen": "array<string>", "alts": "array<string>", "srcset": "array<struct<url:string,w:int>>"}
    for part in (pages, once(words("src"), "seen"), once(words("alt"), "alts"), once(sizes, "srcset")):
        body = body.join(part, ["site", "key"], "left")
    return body.withColumns({name: F.coalesce(name, F.array().cast(kind)) for name, kind in kinds.items()})


def classify(items: DataFrame, logos: DataFrame | None = None) -> DataFrame:
    """items with `kind`. logos(site, logo_src): the picture a site's header shows. Another's logo is a mark."""
    guess = M.guess_kind(F.col("original"), F.coalesce(F.get("alts", 0), F.lit("")), F.col("width"), F.col("height"), F.when(F.col("chrome"), "header"), F.col("shown"), F.col("row"))
    items = items.withColumn("kind", guess)
    if logos is not None:
        items = items.join(logos.select("site", M.variant(F.col("logo_src"))["key"].alias("_logo")), "site", "left")
    else:
        items = items.withColumn("_logo", F.lit(None).cast("string"))
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    name = letters(F.get(F.split("site", r"\."), 0))
    own = (F.length(name) >= 3) & letters(U.path(F.col("original"))).contains(name)
    kind = F.when(F.col("video"), "video").when(F.col("key") == F.col("_logo"), "logo").when((F.col("kind") == "logo") & ~own, "mark").otherwise(F.col("kind"))
    return items.withColumn("kind", kind).drop("_logo")


def select(items: DataFrame, mode: str) -> DataFrame:
    """Pictures to fetch: none, brand, content or all."""
    if mode == "none":
        return items.limit(0)
    if mode == "all":
        return items
    if mode == "content":
        return items.where("kind = 'logo' or not chrome")
    area = F.coalesce(F.col("width") * F.col("height"), F.lit(0))
    shown = F.size("pages")
    by = lambda *order: F.row_number().over(Window.partitionBy("site", "kind").orderBy(*order))
    ranked = items.withColumns({"_seen": by("at"), "_best": by(F.desc(shown), F.desc(area), "at")})
    page = F.get("pages", 0)["url"]
    lone = ranked.where("kind = 'photo'").where(shown == 1).select("site", "key", page.alias("page"), area.alias("area"), "_best")
    galleries = lone.groupBy("site", "page").agg(F.count("*").alias("n"), F.min("_best").alias("gallery")).where(F.col("n") >= M.GALLERY_MIN)
    inside = lone.join(galleries, ["site", "page"]).withColumn("turn", F.row_number().over(Window.partitionBy("site", "page").orderBy(F.desc("area"), "_best")))
    # a gallery deeper than the number kept cannot add to it
    inside = inside.where(F.col("turn") <= M.GALLERY_PHOTOS).withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("turn", "gallery")))
    taken = inside.where(F.col("place") <= M.GALLERY_PHOTOS).select("site", "key", F.lit(True).alias("_gallery"))
    kept = (
        (F.col("kind") == "logo") | F.col("og") | F.coalesce("_gallery", F.lit(False)) | ((F.col("kind") == "mark") & (F.col("_seen") <= M.MARKS_KEPT))
        | ((F.col("kind") == "video") & (F.col("_seen") <= M.VIDEOS_KEPT)) | ((F.col("kind") == "photo") & (F.col("_best") <= M.BRAND_PHOTOS))
    )
    return ranked.join(taken, ["site", "key"], "left").where(kept).drop("_seen", "_best", "_gallery")


def same_bytes(files: DataFrame) -> DataFrame:
    """files(site, ord, url, data): the first of byte-identical files stands for all."""
    hashed = files.select("site", "ord", "url", F.sha2("data", 256).alias("sha256"))
    return hashed.join(hashed.groupBy("site", "sha256").agg(F.min_by("url", "ord").alias("kept_url")), ["site", "sha256"]).withColumn("kept", F.col("url") == F.col("kept_url"))
