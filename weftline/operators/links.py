"""Links of parsed pages: tables, edges and degrees. Pages carry `site` (host without www) and `ord` (reading order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U

SITEWIDE = ("header", "nav", "footer", "aside")


def links(parsed: DataFrame) -> DataFrame:
    """One row per link: site, url, ord, pos and the link's fields."""
    return parsed.select("site", "url", "ord", F.posexplode("links").alias("pos", "link")).select("site", "url", "ord", "pos", "link.*")


def blocks(parsed: DataFrame) -> DataFrame:
    return parsed.select("site", "url", "ord", F.posexplode("blocks").alias("pos", "block")).select("site", "url", "ord", "pos", "block.*")


def images(parsed: DataFrame) -> DataFrame:
    return parsed.select("site", "url", "ord", F.posexplode("images").alias("pos", "image")).select("site", "url", "ord", "pos", "image.*")


def edges(parsed: DataFrame) -> DataFrame:
    """Crawlable links between pages of one site: from_url, to_url, sitewide, and where first seen."""
    internal = parsed.select("site", "url", "ord", F.posexplode("internal_links").alias("pos", "link"))
    to = internal.select("site", U.normalize(F.col("url")).alias("from_url"), U.normalize(F.col("link.href")).alias("to_url"), F.coalesce(F.col("link.landmark").isin(*SITEWIDE), F.lit(False)).alias("sitewide"), "ord", "pos")
    to = to.where("to_url is not null and from_url is not null and to_url != from_url").where(U.crawlable(F.col("to_url")))
    first = F.min(F.struct("ord", "pos"))
    return to.groupBy("site", "from_url", "to_url", "sitewide").agg(first.alias("first")).select("site", "from_url", "to_url", "sitewide", "first.ord", "first.pos")


def _ordered(name: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", name))), lambda x: x[name])


def inbound(edges_: DataFrame, known: DataFrame) -> DataFrame:
    """Degrees of known URLs by place of the link. Edges to unknown URLs are dropped. Which pages they come from is `sources`: a home page has as many as its site has pages."""
    met = edges_.select("site", "from_url", "to_url", "sitewide").distinct().join(known.select(F.col("url").alias("to_url")).distinct(), "to_url")
    return met.groupBy(F.col("to_url").alias("url")).agg(F.count_if(F.col("sitewide")).alias("sitewide_links"), F.count_if(~F.col("sitewide")).alias("body_links"))


def sources(edges_: DataFrame, known: DataFrame) -> DataFrame:
    """(url, sitewide, from_url, ord, pos) of links to known URLs: one row per linking page and place."""
    return edges_.join(known.select(F.col("url").alias("to_url")).distinct(), "to_url").select(F.col("to_url").alias("url"), "sitewide", "from_url", "ord", "pos")


def outbound(edges_: DataFrame) -> DataFrame:
    """Each page's targets once, in order."""
    once = edges_.groupBy("from_url", "to_url").agg(F.min("ord").alias("ord"), F.min("pos").alias("pos"))
    return once.groupBy(F.col("from_url").alias("url")).agg(_ordered("to_url").alias("outbound_internal"))


def documents(parsed: DataFrame) -> DataFrame:
    """Linked documents, each with the first page that links it."""
    doc = links(parsed).where(U.is_document(F.col("href")))
    return doc.groupBy("site", F.col("href").alias("document")).agg(F.min_by("url", F.struct("ord", "pos")).alias("linked_from"))
