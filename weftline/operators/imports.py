"""Feed items and their import: sources by precedence, dates, selection, and pages made of items."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.vectorised import vectorised

PRECEDENCE = ("wp-rest", "rss", "shopify")


@vectorised("string")
def plain(text: pd.Series) -> pd.Series:
    """Character references decoded."""
    return text.map(html.unescape, na_action="ignore")


ITEM = "url string, title string, date string, author string, categories array<string>, html string, source string, front struct<vendor:string,product_type:string,tags:array<string>,price:string>"


def escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def merged(items: DataFrame) -> DataFrame:
    """One item per URL: the source that comes first in PRECEDENCE, and the first of its items by `ord`."""
    rank = F.array_position(F.array(*[F.lit(s) for s in PRECEDENCE]), F.col("source"))
    best = items.withColumn("url", U.normalize(F.col("url"))).where("url is not null")
    whole = F.struct(*[c for c in best.columns])
    return best.groupBy("url").agg(F.min_by(whole, F.struct(rank, "ord")).alias("i")).select("i.*")


def choose(inventory: DataFrame, items: DataFrame, template: str | None = None, source: str = "auto", since: str | None = None, limit: int = 0) -> DataFrame:
    """URLs to import, newest first: those of a template, or, without one, all WordPress items. Undated ones stay out if `since` is given."""
    items = items if source == "auto" else items.where(F.col("source") == {"wp": "wp-rest"}.get(source, source))
    known = inventory.select("url", "template", "lastmod", F.col("ord").alias("known_ord"))
    item = items.select("url", F.struct(*[c for c in items.columns if c != "url"]).alias("item"))
    if template is not None:
        rows = known.where(F.col("template") == template).join(item, "url", "left")
    else:
        rows = item.where("item.source = 'wp-rest'").join(known, "url", "left")
    rows = rows.withColumn("date", F.coalesce("item.date", "lastmod"))
    if since:
        rows = rows.where(F.substring("date", 1, 10) >= since)
    rows = rows.orderBy(F.desc(F.coalesce("date", F.lit(""))), F.coalesce("known_ord", "item.ord"))
    return rows.limit(limit) if limit else rows


def item_html(title: Column, html: Column) -> Column:
    """A page of an item: its title as the heading, its own markup beneath."""
    t = escape(title)
    return F.concat(F.lit("<html><head><title>"), t, F.lit("</title></head><body><main><h1>"), t, F.lit("</h1>"), F.coalesce(html, F.lit("")), F.lit("</main></body></html>"))


def from_wordpress(posts: DataFrame, users: DataFrame, categories: DataFrame) -> DataFrame:
    """posts(ord, link, date, author, categories, title, content) with names of authors and categories."""
    named = posts.join(users.select(F.col("id").alias("author"), F.col("name").alias("author_name")), "author", "left")
    each = posts.select("ord", "link", F.posexplode("categories").alias("pos", "id")).join(categories.select("id", F.col("name").alias("category")), "id", "left")
    listed = each.groupBy("ord", "link").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("category", F.col("id").cast("string")).alias("c")))), lambda x: x["c"]).alias("category_names"))
    rows = named.join(listed, ["ord", "link"], "left")
    return rows.select(
        "ord", U.normalize(F.col("link")).alias("url"), plain(F.regexp_replace("title.rendered", "<[^>]+>", "")).alias("title"), F.nullif(F.substring("date", 1, 10), F.lit("")).alias("date"),
        F.coalesce("author_name", F.lit("")).alias("author"), F.coalesce("category_names", F.array().cast("array<string>")).alias("categories"), "content.rendered", F.lit("wp-rest").alias("source"),
    ).withColumnRenamed("rendered", "html").where("url is not null")


def from_shopify(products: DataFrame, base: str) -> DataFrame:
    """products(ord, handle, title, vendor, product_type, tags, published_at, body_html, variants, images) as items; a price is one number or least-greatest."""
    prices = F.array_sort(F.array_distinct(F.transform(F.filter("variants", lambda v: F.coalesce(v["price"], F.lit("")) != ""), lambda v: v["price"].cast("double"))))
    low, high = F.array_min(prices).cast("string"), F.array_max(prices).cast("string")
    price = F.when(F.size(prices) == 1, low).when(F.size(prices) > 1, F.concat(low, F.lit("-"), high))
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    shown = F.filter(F.coalesce("images", F.array().cast("array<struct<src:string,alt:string>>")), lambda i: F.coalesce(i["src"], F.lit("")) != "")
    photos = F.array_join(F.transform(shown, lambda i: F.concat(F.lit('<img src="'), escape(i["src"]), F.lit('" alt="'), escape(F.coalesce(F.nullif(i["alt"], F.lit("")), F.col("title"), F.lit(""))), F.lit('">'))), "")
    front = F.struct(F.nullif(F.col("vendor"), F.lit("")).alias("vendor"), F.nullif(F.col("product_type"), F.lit("")).alias("product_type"), tags.alias("tags"), price.alias("price"))
    return products.select(
        "ord", U.normalize(F.concat(F.lit(base.rstrip("/") + "/products/"), F.coalesce("handle", F.lit("")))).alias("url"), F.coalesce("title", F.lit("")).alias("title"),
        F.nullif(F.substring("published_at", 1, 10), F.lit("")).alias("date"), F.lit("").alias("author"), F.array().cast("array<string>").alias("categories"),
        F.concat(F.coalesce("body_html", F.lit("")), photos).alias("html"), F.lit("shopify").alias("source"), front.alias("front"),
    )
