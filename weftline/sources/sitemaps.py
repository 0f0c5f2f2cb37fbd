"""robots.txt and sitemaps as tables."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectorised import vectorised
from ..functions import url as U
from ..parse.page_parser import join
from ..plans.written import written

MAX_SITEMAPS = 50


def entries(xml: Column) -> Column:
    """(loc, lastmod) of a sitemap or an index, by pattern; where no entry is whole, any loc counts."""
    parts = F.regexp_extract_all(xml, F.lit(r"(?s)<url>.*?</url>|<sitemap>.*?</sitemap>"), F.lit(0))
    get = lambda x, tag: F.nullif(F.regexp_extract(x, rf"<{tag}>\s*([^<\s]+)\s*</{tag}>", 1), F.lit(""))
    whole = F.filter(F.transform(parts, lambda x: F.struct(get(x, "loc").alias("loc"), get(x, "lastmod").alias("lastmod"))), lambda e: e["loc"].isNotNull())
    bare = F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), lambda u: F.struct(u.alias("loc"), F.lit(None).cast("string").alias("lastmod")))
    return F.when(F.size(whole) > 0, whole).otherwise(bare)


def robots_sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


@vectorised("boolean")
def _allowed(robots: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    parsed: dict[str, RobotFileParser] = {}
    out = []
    for text, name, u in zip(robots, agent, url):
        rules = parsed.get(text or "")
        if rules is None:
            rules = parsed[text or ""] = RobotFileParser()
            rules.parse((text or "User-agent: *\nAllow: /").splitlines())
        out.append(rules.can_fetch(name, u))
    return pd.Series(out)


def can_fetch(robots: Column, agent: Column, url: Column) -> Column:
    """Whether robots.txt lets an agent read a URL; a missing file allows all."""
    return _allowed(robots, agent, url)


def expand(files: DataFrame, starts: DataFrame, most: int = MAX_SITEMAPS) -> DataFrame:
    """files(sitemap_url, xml), starts(site, sitemap_url): (site, url, lastmod, sitemap) of the pages that a site's sitemaps list, indexes followed breadth first, at most `most` files a site."""
    todo = starts.where(U.site(F.col("sitemap_url")) == F.col("site")).select("site", "sitemap_url").distinct()
    seen, pages, depth = None, None, 0
    while depth < most and not todo.isEmpty():
        read = todo.join(files, "sitemap_url").select("site", "sitemap_url", F.explode(entries(F.col("xml"))).alias("e")).select("site", "sitemap_url", "e.*")
        index = F.lower("loc").rlike(r"\.xml(\.gz)?$") & F.lower("loc").contains("sitemap")
        mine = read.where(U.site(F.col("loc")) == F.col("site"))
        found = mine.where(~index).select("site", F.col("loc").alias("url"), "lastmod", F.col("sitemap_url").alias("sitemap"))
        pages = found if pages is None else pages.unionByName(found)
        seen = todo if seen is None else seen.unionByName(todo)
        todo = written(mine.where(index).select("site", F.col("loc").alias("sitemap_url")).distinct().join(seen, ["site", "sitemap_url"], "left_anti"), "sitemaps")
        depth += 1
    return pages


@vectorised("string")
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """href as an absolute URL."""
    return pd.Series([join(b or "", h) if h is not None else None for b, h in zip(base, href)])


def audit_entries(files: DataFrame) -> DataFrame:
    """files(site, netloc, start_url, xml): entries of the site's own host in audit form, relative ones resolved."""
    rows = files.select("site", "netloc", "start_url", F.explode(entries(F.col("xml"))).alias("e"))
    return rows.select("site", "netloc", U.audit_norm(resolve(F.col("start_url"), F.col("e.loc"))).alias("url")).where(U.netloc(F.col("url")) == F.col("netloc")).select("site", "url")


def on_origin(xml: Column, origin: Column) -> Column:
    """Pages of a sitemap at another origin, each once."""
    path = lambda u: F.when(U.path(u) == "", F.lit("/")).otherwise(U.path(u))
    return F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), lambda u: F.concat(origin, path(u))))
