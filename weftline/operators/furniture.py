"""Header and footer as structure: menu, call to action, footer groups, social and legal links, logo, badges; per page and per site.

Trees are kept flat: each entry of a menu has its order, depth and its parent's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as K
from ..functions import url as U


def _pair(link: Column) -> Column:
    return F.struct(link["text"].alias("label"), link["href"].alias("href"))


def _unique(items: Column, key: str) -> Column:
    """Items with a key, each key once, the first."""
    return F.get(F.transform(F.array(F.filter(items, lambda x: F.coalesce(x[key], F.lit("")) != "")), lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, lambda y: y[key]), x[key]) == i + 1)), 0)


def nav_tree(links: Column) -> Column:
    """Flat tree of links: an entry's parent is the last earlier one with a smaller depth."""
    depth = lambda l: F.coalesce(l["depth"], F.lit(0))
    return F.get(
        F.transform(
            F.array(links),
            lambda all_: F.transform(
                all_,
                lambda l, i: F.struct(
                    l["text"].alias("label"), l["href"].alias("href"), i.alias("order"), depth(l).alias("depth"),
                    F.array_max(F.transform(F.filter(F.transform(all_, lambda x, j: F.struct(j.alias("j"), depth(x).alias("d"))), lambda x: (x["j"] < i) & (x["d"] < depth(l))), lambda x: x["j"])).alias("parent_order"),
                ),
            ),
        ),
        0,
    )


def page_furniture(parsed: DataFrame) -> DataFrame:
    header = F.filter("links", lambda l: l["landmark"].isin("header", "nav"))
    footer = F.filter("links", lambda l: l["landmark"] == "footer")
    contact = lambda l: l["href"].rlike("^(tel|mailto):")
    call = lambda l: K.looks_like_cta(l["text"], l["classes"])
    nav = F.filter(header, lambda l: (l["text"] != "") & ~contact(l) & (U.site(l["href"]) == F.col("site")) & ~call(l) & ~K.is_skip_link(l["text"], l["href"]))
    cta = F.coalesce(F.get(F.filter(header, lambda l: contact(l) | call(l)), 0), F.get(F.filter(footer, lambda l: l["href"].startswith("tel:")), 0))
    grouped = F.filter(footer, lambda l: ~K.is_social(l["href"]) & ~K.is_legal(l["text"], l["href"]))
    names = F.array_distinct(F.transform(grouped, lambda l: F.coalesce(l["group"], F.lit(""))))
    groups = F.transform(names, lambda g: F.struct(g.alias("heading"), F.transform(F.filter(grouped, lambda l: F.coalesce(l["group"], F.lit("")) == g), _pair).alias("links")))
    shown = lambda i: F.coalesce(i["src"], F.lit("")) != ""
    logo = F.get(F.filter("images", lambda i: i["landmark"].isin("header", "nav") & shown(i) & (F.coalesce(i["in_link"], F.lit(False)) | F.lower(F.concat(i["alt"], i["src"])).contains("logo"))), 0)
    badges = F.filter("images", lambda i: i["landmark"].isin("footer", "header", "aside") & shown(i) & F.concat(i["alt"], F.lit(" "), i["src"]).rlike(K.BADGE))
    picture = lambda i: F.struct(i["src"].alias("src"), i["alt"].alias("alt"))
    rows = parsed.withColumns({"_logo": F.when(logo.isNotNull(), picture(logo)), "_nav": nav, "_cta": cta})
    copyright_ = F.get(F.filter(F.coalesce(F.try_element_at("landmark_lines", F.lit("footer")), F.array().cast("array<string>")), lambda t: t.rlike(K.COPYRIGHT)), 0)
    return rows.select(
        "site", "url", "ord", "has_landmarks", F.col("_logo").alias("logo"), nav_tree(F.col("_nav")).alias("nav"), F.when(F.col("_cta").isNotNull(), _pair(F.col("_cta"))).alias("primary_cta"),
        groups.alias("footer_groups"), _unique(F.transform(F.filter("links", lambda l: K.is_social(l["href"])), _pair), "href").alias("social"),
        _unique(F.transform(F.filter(footer, lambda l: K.is_legal(l["text"], l["href"])), _pair), "href").alias("legal"), F.coalesce(copyright_, F.lit("")).alias("copyright"),
        _unique(F.transform(F.filter(badges, lambda i: F.col("_logo").isNull() | (i["src"] != F.col("_logo.src"))), picture), "src").alias("badges"), F.array_sort(F.map_keys("landmark_lines")).alias("landmarks"),
    )


def _first_seen(rows: DataFrame, column: str, key: str) -> DataFrame:
    """(site, _column): the distinct items of a column over a site, as first seen; copies are gone before they meet."""
    each = rows.select("site", "ord", F.posexplode(column).alias("pos", "item")).where(F.coalesce(F.col(f"item.{key}"), F.lit("")) != "")
    once = each.groupBy("site", F.col(f"item.{key}").alias("key")).agg(F.min(F.struct("ord", "pos")).alias("at"), F.min_by("item", F.struct("ord", "pos")).alias("item"))
    return once.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias(f"_{column}"))


def _listed(column: str) -> Column:
    return F.coalesce(F.col(f"_{column}"), F.filter(F.col(f"best.{column}"), lambda x: F.lit(False))).alias(column)


def site_furniture(pages: DataFrame) -> DataFrame:
    """One row per site: furniture of the page that shows the most of it, unions of social and legal links and badges, and the pages whose menu differs."""
    size = F.size("nav") + F.aggregate(F.transform("footer_groups", lambda g: F.size(g["links"])), F.lit(0), lambda a, x: a + x)
    hrefs = F.transform("nav", lambda n: n["href"])
    rows = pages.where("has_landmarks").withColumns({"_hrefs": hrefs, "_size": size})
    best = rows.groupBy("site").agg(F.max_by(F.struct("url", "logo", "nav", "primary_cta", "footer_groups", "copyright", "_hrefs", "social", "legal", "badges"), F.struct("_size", -F.col("ord"))).alias("best"))
    first = lambda c, ok: F.min_by(F.col(c), F.when(ok, F.col("ord")))
    told = rows.groupBy("site").agg(
        first("logo", F.col("logo").isNotNull()).alias("_logo"), first("primary_cta", F.col("primary_cta").isNotNull()).alias("_cta"), first("copyright", F.col("copyright") != "").alias("_copyright"),
    )
    for column, key in (("social", "href"), ("legal", "href"), ("badges", "src")):
        told = told.join(_first_seen(rows, column, key), "site", "left")
    differ = rows.join(best.select("site", F.col("best._hrefs").alias("_best")), "site").where(F.col("_hrefs") != F.col("_best"))
    differ = differ.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"]).alias("pages_with_a_different_nav"))
    counts = pages.groupBy("site").agg(F.count("*").alias("pages"), F.bool_or("has_landmarks").alias("has_landmarks"))
    out = counts.join(best, "site", "left").join(told, "site", "left").join(differ, "site", "left")
    return out.select(
        "site", "pages", "has_landmarks", F.col("best.url").alias("from"), F.coalesce("best.logo", "_logo").alias("logo"), F.col("best.nav").alias("nav"), F.coalesce("best.primary_cta", "_cta").alias("primary_cta"),
        F.col("best.footer_groups").alias("footer_groups"), _listed("social"), _listed("legal"),
        F.coalesce(F.nullif(F.col("best.copyright"), F.lit("")), "_copyright", F.lit("")).alias("copyright"), _listed("badges"),
        F.coalesce("pages_with_a_different_nav", F.array().cast("array<string>")).alias("pages_with_a_different_nav"),
    )
