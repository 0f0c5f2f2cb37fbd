"""Launch check: old URLs against a new host's answers, and the new sitemap against the old pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import url as U

VERDICTS = ("ok", "missing", "chain", "noindex", "error")
NEW_SHOWN = 40


def eligible(inventory: DataFrame) -> DataFrame:
    """Rows worth asking for: read, or answered 200."""
    unread = F.coalesce(F.col("reason").isin("unread", "robots"), F.lit(False))
    return inventory.where(~unread & (F.col("file").isNotNull() | F.coalesce(F.col("status") == 200, F.lit(False))))


def check(inventory: DataFrame, answers: DataFrame, base: Column) -> DataFrame:
    """inventory(url, title, ...) and answers(url, status, hops, final_url, title, h1_count, meta_description, noindex, error): one row per old URL."""
    old = eligible(inventory).select(F.col("url").alias("old_url"), F.col("title").alias("old_title"), U.map_to(F.col("url"), base).alias("new_url"))
    rows = old.join(answers.withColumnRenamed("url", "new_url"), "new_url", "left")
    hops = F.coalesce(F.size("hops"), F.lit(0))
    rows = rows.withColumn("verdict", R.verdict(F.col("status"), F.greatest(hops, F.lit(0)), F.coalesce("noindex", F.lit(False))))
    h1 = F.coalesce("h1_count", F.lit(0))
    found = F.filter(
        F.array(F.when(F.coalesce("title", F.lit("")) == "", "no title"), F.when(h1 != 1, F.concat(h1.cast("string"), F.lit(" h1"))), F.when(F.coalesce("meta_description", F.lit("")) == "", "no description")),
        lambda x: x.isNotNull(),
    )
    none = F.array().cast("array<string>")
    return rows.select("old_url", "new_url", "verdict", "status", F.coalesce("hops", none).alias("chain"), "final_url", F.coalesce("title", F.lit("")).alias("title"), "old_title", F.when(F.col("verdict") == "ok", found).otherwise(none).alias("findings"), "error")


def counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def sitemap_differences(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, side): kept pages missing from the new sitemap, and paths new in it. Empty where the sitemap is."""
    some = listed.limit(1).select(F.lit(1).alias("some"))  # one row, or none
    paths = listed.select(U.path_key(F.col("url")).alias("path")).distinct()
    kept = rows.where((F.col("verdict") == "ok") & (F.size("chain") == 0)).select(U.path_key(F.col("old_url")).alias("path")).distinct()
    old = rows.select(U.path_key(F.col("old_url")).alias("path")).distinct()
    missing = kept.join(paths, "path", "left_anti").join(some, F.lit(1) == F.col("some"), "left_semi").select("path", F.lit("missing_from_sitemap").alias("side"))
    return missing.unionByName(paths.join(old, "path", "left_anti").select("path", F.lit("new_in_sitemap").alias("side")))


def report_order() -> list[Column]:
    """Missing rows first, then errors, then by URL."""
    return [F.col("verdict") != "missing", F.col("verdict") != "error", F.col("old_url")]
