"""The inventory: one row per known URL, and the reasons pages are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def skip_reason(robots_ok: Column, admitted: Column, status: Column, redirected: Column, body: Column, bot_check: Column, markdown: Column, duplicate: Column, all_repeated: Column) -> Column:
    """Why a page is not kept; the first rule that holds."""
    return (
        F.when(~robots_ok, "robots")
        .when(~admitted, "sampled_out")
        .when(status.isNull(), "fetch_failed")
        .when(redirected, "redirect")
        .when(status != 200, F.concat(F.lit("http_"), status.cast("string")))
        .when(F.coalesce(body, F.lit("")) == "", "fetch_failed")
        .when(bot_check, "bot_check")
        .when(F.trim(markdown) == "", "empty")
        .when(duplicate.isNotNull(), duplicate)
        .when(all_repeated, "boilerplate_only")
    )


def reason_counts(records: DataFrame) -> DataFrame:
    return records.where("reason is not null").groupBy("site", "reason").agg(F.count("*").alias("n"))


def order() -> list[Column]:
    """Pages with a file first, then by URL."""
    return [F.col("file").isNull(), F.col("url")]


def markdown_rows(records: DataFrame) -> DataFrame:
    """(site, ord, line): table lines of inventory.md."""
    from pyspark.sql.window import Window

    yes = lambda c: F.when(F.col(c), "yes").otherwise("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [F.col("url"), text("status"), X.cell(F.col("title")), X.cell(F.col("h1")), text("word_count"), text("body_links"), text("sitewide_links"), yes("in_sitemap"), yes("noindex"), F.when(F.col("forms") > 0, F.col("forms").cast("string")).otherwise(""), F.array_join(F.array_sort(F.array_distinct("embed_kinds")), ", "), F.coalesce("file", "reason", F.lit(""))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return records.select("site", F.row_number().over(Window.partitionBy("site").orderBy(*order())).alias("ord"), line.alias("line"))


def tracking_summary(found: DataFrame) -> DataFrame:
    """found(site, kind, value): sorted distinct values by kind."""
    return found.groupBy("site", "kind").agg(F.array_sort(F.collect_set("value")).alias("values"))
