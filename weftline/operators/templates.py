"""URL templates, the order pages are read in, and sampling by template and section.

Templates are judged over the whole set of known URLs, so the result does not depend on the order of discovery.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import url as U

START, NAV, HOME_BODY, FOOTER, SITEMAP, FOUND = range(6)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "/")


def assign(urls: DataFrame) -> DataFrame:
    """urls(site, url[, sitemap][, in_nav]) with `template`."""
    given = urls.columns
    for name, value in (("sitemap", F.lit(None).cast("string")), ("in_nav", F.lit(False))):
        urls = urls if name in urls.columns else urls.withColumn(name, value)
    raw = U.segments(F.col("url"))
    rows = urls.withColumn("_raw", raw).withColumn("_segs", F.transform("_raw", R.norm_segment))
    parent = lambda c: _joined(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))))
    rows = rows.withColumn("_parent", parent(F.col("_segs")))
    children = rows.where(F.size("_raw") > 0).groupBy("site", "_parent").agg(F.count_distinct(F.lower(F.element_at("_raw", -1))).alias("_children"))
    paged = (F.size("_segs") >= 2) & (F.element_at("_segs", -1) == "{n}") & F.try_element_at("_segs", F.lit(-2)).isin("page", "p")
    # a listing's later pages take the template of their first page
    rows = rows.withColumn("_paged", paged).withColumn("_base", F.when(F.col("_paged"), F.slice("_segs", F.lit(1), F.greatest(F.size("_segs") - 2, F.lit(0)))).otherwise(F.col("_segs")))
    rows = rows.withColumn("_base_parent", parent(F.col("_base")))
    counted = rows.join(children.withColumnRenamed("_parent", "_base_parent"), ["site", "_base_parent"], "left")
    own = F.concat(F.lit("/"), _joined(F.col("_base")))
    collection = (F.coalesce(F.col("_children"), F.lit(0)) >= R.MIN_COLLECTION) | F.array_contains("_base", "{n}")
    single = F.col("in_nav") | F.coalesce(R.sitemap_words(F.col("sitemap")).isin(*R.PAGE_SITEMAPS), F.lit(False))
    label = F.when(F.col("sitemap").isNotNull(), R.sitemap_label(F.col("sitemap")))
    star = F.concat(F.lit("/"), F.when(F.col("_base_parent") != "", F.concat(F.col("_base_parent"), F.lit("/"))).otherwise(""), F.lit("*"))
    shape = F.when(collection, star).otherwise(own)
    head = F.when(F.size("_base") == 0, F.lit("")).otherwise(shape)
    template = (
        F.when(F.size("_segs") == 0, F.lit("/"))
        .when(F.col("_paged"), F.concat(head, F.lit("/"), F.element_at("_segs", -2), F.lit("/{n}")))
        .when(single, own)
        .when(label.isNotNull(), label)
        .otherwise(shape)
    )
    return counted.withColumn("template", template).select(*given, "template")


def report(records: DataFrame) -> DataFrame:
    """records(site, url, ord, template, file, reason, word_count, fingerprint): one row per site and template, biggest first in its site."""
    read = F.col("file").isNotNull()
    shapes = records.where(read & (F.coalesce("fingerprint", F.lit("")) != "")).groupBy("site", "template", "fingerprint").count()
    shapes = shapes.groupBy("site", "template").agg(F.count("*").alias("shapes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("fingerprint", "count")))).alias("shape_counts"))
    body = records.where("template is not null").groupBy("site", "template").agg(
        F.count("*").alias("count"),
        F.count_if(read).alias("read"),
        F.count_if(~read & F.col("reason").isin("unread", "sampled_out")).alias("not_read"),
        F.bround(F.sum(F.when(read, F.coalesce("word_count", F.lit(0)))) / F.nullif(F.count_if(read), F.lit(0)), 0).cast("long").alias("avg_words"),
    )
    # three rows of each template leave a task
    turn = F.row_number().over(Window.partitionBy("site", "template").orderBy(F.asc_nulls_last("ord"), "url"))
    shown = records.where("template is not null").select("site", "template", "ord", "url", turn.alias("turn")).where("turn <= 3")
    examples = shown.groupBy("site", "template").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "url"))), lambda x: x["url"]).alias("examples"))
    return body.join(examples, ["site", "template"]).join(shapes, ["site", "template"], "left").fillna(0, ["shapes"]).withColumn("collection", R.is_collection(F.col("template")))


def frontier(found: DataFrame) -> DataFrame:
    """found(site, url, tier, seq): each URL once, in reading order: best tier first, in the order of entry into that tier."""
    best = found.groupBy("site", "url").agg(F.min(F.struct("tier", "seq")).alias("at")).select("site", "url", "at.tier", "at.seq")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("tier", "seq", "url")))


def admit(ordered: DataFrame, per_template: int | None, per_section: int | None) -> DataFrame:
    """ordered(site, url, rank, template, in_nav) with `admitted`: caps by template for collections and by section; navigation pages skip the section cap; a page refused by one cap does not count for the other.

    The decision depends on all earlier ones of its site, so a site is folded in one task; only names and flags go there.
    """
    slim = ordered.select("site", "rank", "template", "in_nav", U.section(F.col("url")).alias("section"))
    slim = slim.withColumns({"collection": R.is_collection(F.col("template")), "posts": F.col("section").rlike(R.POST_SECTIONS)})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, templates, sections = None, {}, {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.site != site:
                    site, templates, sections = r.site, {}, {}
                cap = per_template if r.posts and per_section is not None and per_template is not None else per_section
                full = per_template is not None and r.collection and templates.get(r.template, 0) >= per_template
                full = full or cap is not None and not r.in_nav and bool(r.section) and sections.get(r.section, 0) >= cap
                if not full:
                    templates[r.template] = templates.get(r.template, 0) + 1
                    sections[r.section] = sections.get(r.section, 0) + 1
                out.append(not full)
            yield pd.DataFrame({"site": batch["site"], "rank": batch["rank"], "admitted": out})

    folded = slim.repartition("site").sortWithinPartitions("site", "rank").mapInPandas(fold, "site string, rank int, admitted boolean")
    return ordered.join(folded, ["site", "rank"])


def nav_urls(parsed: DataFrame) -> DataFrame:
    """(site, url): what the home page's header and menus link to, outside its main part."""
    home = F.regexp_replace(U.path(F.col("url")), "/+$", "") == ""
    link = parsed.where(home).select("site", F.explode("internal_links").alias("l")).where(F.col("l.landmark").isin("header", "nav") & ~F.col("l.in_main"))
    return link.select("site", U.normalize(F.col("l.href")).alias("url")).where("url is not null").distinct()


def uses_wordpress(parsed: DataFrame) -> DataFrame:
    """(site, wordpress): whether any page of a site names WordPress as its generator or shows pictures from its folder."""
    made = F.lower(F.coalesce(F.try_element_at("meta", F.lit("generator")), F.lit(""))).contains("wordpress")
    files = F.exists("images", lambda i: F.coalesce(i["src"].contains("/wp-content/"), F.lit(False)))
    return parsed.groupBy("site").agg(F.bool_or(made | files).alias("wordpress"))
