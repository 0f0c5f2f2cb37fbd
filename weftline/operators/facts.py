"""Contact facts with their sources, and reviews. Pages carry `site`, `url`, `ord` and `template`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import url as U

KINDS = ("phone", "email", "address", "hours", "social", "action")


def _row(kind, value, where, key=None, score=None, words=None):
    null = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), where.alias("where"), (null if key is None else key).alias("key"), (F.lit(None).cast("int") if score is None else score).alias("score"), (null if words is None else words).alias("text"))


def from_blocks(blocks: DataFrame, pages: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Facts in the text of headers and footers, and of a site's own pages; blocks that hold a review's quote are left out."""
    own = pages.select("site", "url", "ord", "template")
    rows = blocks.where("tag != 'img' and text != ''").select("site", "url", "pos", "text", "chrome").join(own, ["site", "url"])
    rows = rows.where(F.col("chrome") | X.own_page(F.col("url"), F.col("template")))
    if reviews is not None:
        quotes = reviews.where("quote != ''").select("url", "quote").distinct()
        rows = rows.join(quotes, (rows["url"] == quotes["url"]) & rows["text"].contains(quotes["quote"]), "left_anti")
    where = F.when(F.col("chrome"), "header/footer").otherwise("page")
    t = X.plain_links(F.col("text"))
    each = F.concat(
        F.transform(X.phones(t), lambda v: _row("phone", v, where, F.right(X.digits(v), F.lit(10)))),
        F.transform(X.emails(t), lambda v: _row("email", v, where)),
        F.transform(X.addresses(t), lambda v: _row("address", v, where)),
        F.transform(X.hours(t), lambda v: _row("hours", v, where)),
    )
    return rows.select("site", "url", "ord", F.lit(1).alias("step"), "pos", F.posexplode(each).alias("sub", "fact")).select("site", "url", "ord", "step", "pos", "sub", "fact.*")


def from_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts in links: telephone, mail and social ones of landmarks and own pages; actions anywhere."""
    rows = links.select("site", "url", "pos", "href", "text", "landmark").join(pages.select("site", "url", "ord", "template"), ["site", "url"])
    href = F.col("href")
    gate = F.col("landmark").isNotNull() | X.own_page(F.col("url"), F.col("template"))
    link, score = F.lit("link"), X.action_score(href, F.col("text"))
    bare = F.regexp_replace(F.get(F.split(href, r"\?"), 0), "/+$", "")
    target = F.lower(F.regexp_replace(F.get(F.split(href, "#"), 0), "/+$", ""))
    contact = (
        F.when(~gate, None)
        .when(href.startswith("tel:"), _row("phone", F.substring(href, 5, 1 << 30), link, F.right(X.digits(href), F.lit(10))))
        .when(href.startswith("mailto:"), _row("email", F.get(F.split(F.substring(href, 8, 1 << 30), r"\?"), 0), link))
        .when(U.host(href).rlike(X.SOCIAL_HOST), _row("social", bare, link))
    )
    action = F.when(score > 0, _row("action", href, F.when(score == 1, "link").otherwise("booking host"), target, score, F.col("text")))
    each = F.filter(F.array(contact, action), lambda x: x.isNotNull())
    return rows.select("site", "url", "ord", F.lit(2).alias("step"), "pos", F.posexplode(each).alias("sub", "fact")).select("site", "url", "ord", "step", "pos", "sub", "fact.*")


def from_business(business: DataFrame) -> DataFrame:
    """business(site, url, field, ord, value): facts a site's markup states; address lines are joined from their parts beforehand."""
    kinds = F.create_map(*[F.lit(x) for kv in {"telephone": "phone", "email": "email", "address": "address", "openingHours": "hours", "sameAs": "social"}.items() for x in kv])
    rows = business.withColumn("kind", F.try_element_at(kinds, F.col("field"))).where("kind is not null and value is not null")
    key = F.when(F.col("kind") == "phone", F.right(X.digits(F.col("value")), F.lit(10)))
    null = F.lit(None)
    return rows.select("site", "url", F.lit(-1).cast("bigint").alias("ord"), F.lit(0).alias("step"), "ord", F.lit(0).alias("sub"), "kind", "value", F.lit("jsonld").alias("where"), key.alias("key"), null.cast("int").alias("score"), null.cast("string").alias("text")).toDF("site", "url", "ord", "step", "pos", "sub", "kind", "value", "where", "key", "score", "text")


def merge(facts: DataFrame) -> DataFrame:
    """One row per site, kind and key: first spelling, distinct sources, last score, first text; with the rank in its kind."""
    v = X.squash(F.col("value"))
    default = F.when(F.col("kind") == "address", F.trim(F.regexp_replace(F.lower(v), r"[^\p{L}\p{N}_]+", " "))).otherwise(F.lower(v))
    at = F.struct("ord", "step", "pos", "sub")
    rows = facts.where(v != "").select("site", "kind", F.coalesce("key", default).alias("key"), v.alias("value"), "url", "where", "score", "text", at.alias("at"))
    seen = rows.groupBy("site", "kind", "key", "url", "where").agg(F.min("at").alias("at"), F.min_by("value", "at").alias("value"), F.max_by("score", "at").alias("score"), F.max("at").alias("till"), F.min_by("text", "at").alias("text"))
    one = seen.groupBy("site", "kind", "key").agg(
        F.min_by("value", "at").alias("value"), F.max_by("score", "till").alias("score"), F.min_by("text", "at").alias("text"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "url", "where"))), lambda s: F.struct(s["url"].alias("url"), s["where"].alias("where"))).alias("sources"),
    )
    order = Window.partitionBy("site", "kind").orderBy(F.desc(F.coalesce("score", F.lit(0))), F.desc(F.size("sources")), "value")
    return one.withColumn("rank", F.row_number().over(order))


def several(merged: DataFrame) -> DataFrame:
    """Kinds of which a site states more than one value."""
    return merged.where(F.col("kind").isin("phone", "email", "address")).groupBy("site", "kind").agg(F.count("*").alias("n")).where("n > 1")


def first_reviews(reviews: DataFrame) -> DataFrame:
    """reviews(site, ord, pos, quote, ...): each quote of a site once, the page's own before its markup's."""
    order = Window.partitionBy("site", "quote").orderBy("ord", "pos")
    return reviews.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def first_ratings(ratings: DataFrame) -> DataFrame:
    order = Window.partitionBy("site", "value", "count").orderBy("ord", "pos")
    return ratings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
