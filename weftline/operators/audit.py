"""Audit of a site: a union of rules over page answers, parsed pages, link targets and sitemaps; every rule gives (site, kind, subject, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import url as U
from ..parse.stage import a11y_findings
from ..plans.written import written

MAX_HTML, MAX_IMAGE, EXTERNAL, DRIFT, SOURCES_CHARS = 1_000_000, 1_500_000, 100, 50, 200
#: Characters that a URL in a list takes at least, with the comma behind it.
SHORTEST_URL = 10


def _issue(df: DataFrame, kind: str, subject: Column, detail: Column) -> DataFrame:
    return df.select("site", F.lit(kind).alias("kind"), subject.alias("subject"), detail.alias("detail"))


def page_findings(pages: DataFrame) -> DataFrame:
    """pages(site, url, html, body_len and the parsed fields): `findings`, in rule order. Titles and descriptions are compared within a site."""
    of = lambda c: Window.partitionBy("site", c)
    twice = lambda c: F.when(F.col(c) != "", F.count("*").over(of(c)) > 1)
    no_alt = F.size(F.filter("images", lambda i: (F.coalesce(i["src"], F.lit("")) != "") & F.coalesce(i["alt_missing"], F.lit(False))))
    raw = F.filter("jsonld_raw", lambda r: F.trim(r) != "")
    rows = pages.withColumns({"_title_again": twice("title"), "_description_again": twice("meta_description"), "_no_alt": no_alt})
    elsewhere = F.col("canonical").isNotNull() & (U.audit_norm(F.col("canonical")) != U.audit_norm(F.col("url")))
    rules = [
        F.when(F.col("title") == "", "no title"),
        F.when(F.col("meta_description") == "", "no meta description"),
        F.when(F.col("h1_count") == 0, "no h1").when(F.col("h1_count") > 1, F.concat(F.col("h1_count").cast("string"), F.lit(" h1 headings"))),
        F.when(elsewhere, F.concat(F.lit("canonical points at "), F.col("canonical"))),
        F.when(F.col("noindex"), "noindex"),
        F.when(F.col("_no_alt") > 0, F.concat(F.col("_no_alt").cast("string"), F.lit(" image(s) without alt text"))),
        F.when(F.col("body_len") > MAX_HTML, F.concat(F.lit("page is "), F.floor(F.col("body_len") / 1024).cast("string"), F.lit(" KB of HTML"))),
        F.when(F.exists(raw, lambda r: F.coalesce(F.try_parse_json(F.trim(r)), F.try_parse_json(F.regexp_replace(F.trim(r), r",\s*([}\]])", "$1"))).isNull()), "JSON-LD that does not parse"),
        F.when(F.col("_title_again"), "duplicate title"),
        F.when(F.col("_description_again"), "duplicate meta description"),
    ]
    own = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return rows.select("site", "url", F.concat(own, a11y_findings(F.col("html"), F.col("title"), F.col("meta_description"))).alias("findings"))


def _sources(targets: DataFrame, by: list[str]) -> DataFrame:
    """`from`: the pages that link to a target, in order, up to SOURCES_CHARS. No more of them are gathered than can be shown."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("url_from"))
    first = targets.select(*by, "url_from").distinct().withColumn("_n", turn).where(F.col("_n") <= SOURCES_CHARS // SHORTEST_URL + 1)
    return first.groupBy(*by).agg(F.substring(F.array_join(F.array_sort(F.collect_list("url_from")), ", "), 1, SOURCES_CHARS).alias("from"))


def page_answers(status: DataFrame, targets: DataFrame) -> DataFrame:
    """status(site, url, status, final_url, hops): answers that are wrong, with the pages that link there."""
    linked = _sources(targets, ["site", "target"]).withColumnRenamed("target", "url")
    rows = status.join(linked, ["site", "url"], "left").fillna("", ["from"])
    sources = lambda none: F.when(F.col("from") == "", none).otherwise(F.col("from"))
    url, ok = F.col("url"), F.col("status") < 400
    return (
        _issue(rows.where("status is null"), "unreachable", url, F.lit("no answer"))
        .unionByName(_issue(rows.where(~ok), "broken page", url, F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.lit(" (linked from "), sources("the crawl"), F.lit(")"))))
        .unionByName(_issue(rows.where(ok & (F.size("hops") > 1)), "redirect chain", url, F.concat(F.array_join("hops", " -> "), F.lit(" -> "), F.col("final_url"))))
        .unionByName(_issue(rows.where(ok & (F.size("hops") == 1)), "internal link redirects", url, F.concat(F.lit("-> "), F.col("final_url"), F.lit("; link to the final URL from "), sources("the sitemap"))))
    )


def target_answers(targets: DataFrame, crawled: DataFrame, status: DataFrame, external: bool = True, most_external: int = EXTERNAL) -> DataFrame:
    """Targets that were not crawled: broken, redirecting or heavy ones. Of external ones the first `most_external` of a site, in order, that are public."""
    t = _sources(targets, ["site", "netloc", "target"])
    t = t.join(crawled.select("site", F.col("url").alias("target")).distinct(), ["site", "target"], "left_anti").where(U.scheme(F.col("target")).isin("http", "https"))
    t = t.withColumn("internal", U.netloc(F.col("target")) == F.col("netloc"))
    outside = t.where(~F.col("internal") & F.coalesce(U.public_http(F.col("target")), F.lit(True))).withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("target"))).where(F.col("n") <= (most_external if external else 0)).drop("n")
    answers = status.select(F.col("url").alias("target"), "status", "final_url", "hops", "content_type", "content_length")
    bad = F.col("status").isNull() | (F.col("status") >= 400)
    said = F.concat(F.coalesce(F.concat(F.lit("HTTP "), F.col("status").cast("string")), F.lit("no answer")), F.lit(", linked from "), F.col("from"))
    out, inside = outside.join(answers, "target", "left"), t.where("internal").join(answers, "target", "left")
    target = F.col("target")
    heavy = (F.size("hops") == 0) & F.coalesce("content_type", F.lit("")).startswith("image/") & (F.coalesce("content_length", F.lit(0)) > MAX_IMAGE)
    return (
        _issue(out.where(bad), "broken external link", target, said)
        .unionByName(_issue(inside.where(bad), "broken internal link", target, said))
        .unionByName(_issue(inside.where(~bad & (F.size("hops") > 0)), "internal link redirects", target, F.concat(F.lit("-> "), F.col("final_url"), F.lit("; link to the final URL from "), F.col("from"))))
        .unionByName(_issue(inside.where(~bad & heavy), "heavy image", target, F.concat(F.floor(F.col("content_length") / 1024).cast("string"), F.lit(" KB; resize or compress it (under 1.5 MB)"))))
    )


def sitemap_drift(listed: DataFrame, status: DataFrame, answered: DataFrame) -> DataFrame:
    """listed(site, url), status(site, url, status, final_url), answered(site, sitemap_url, status): pages in the sitemap that fail, and the first of those that are not in it."""
    good = answered.where("status = 200").select("site")
    rows = listed.join(good, "site", "left_semi").join(status.select("site", "url", "status").withColumn("met", F.lit(True)), ["site", "url"])
    wrong = rows.where("status is null or status >= 400")
    detail = F.when(F.col("status").isNull(), "listed in the sitemap but does not answer").otherwise(F.concat(F.lit("listed in the sitemap but answers HTTP "), F.col("status").cast("string")))
    fine = status.where("status = 200").select("site", U.audit_norm(F.coalesce("final_url", "url")).alias("url")).distinct().join(good, "site", "left_semi").join(listed, ["site", "url"], "left_anti")
    fine = fine.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where(F.col("n") <= DRIFT)
    none = answered.where("status is null or status != 200")
    why = F.concat(F.lit("no sitemap ("), F.coalesce(F.concat(F.lit("HTTP "), F.col("status").cast("string")), F.lit("no answer")), F.lit(")"))
    return _issue(wrong, "sitemap", F.col("url"), detail).unionByName(_issue(fine, "sitemap", F.col("url"), F.lit("crawled but not in the sitemap"))).unionByName(_issue(none, "sitemap", F.col("sitemap_url"), why))


def old_urls(inventory: DataFrame, status: DataFrame, base: Column) -> DataFrame:
    """Old URLs on the new host whose verdict is not ok."""
    rows = inventory.select("site", "url", U.map_to(F.col("url"), base).alias("target")).join(status.select(F.col("url").alias("target"), "status", F.size("hops").alias("hops"), "noindex"), "target", "left")
    rows = rows.withColumn("verdict", R.verdict(F.col("status"), F.coalesce("hops", F.lit(0)), F.coalesce("noindex", F.lit(False))))
    return _issue(rows.where("verdict != 'ok'"), "old url", F.col("url"), F.concat(F.col("verdict"), F.lit(" ("), F.coalesce(F.col("status").cast("string"), F.lit("None")), F.lit(")")))


def audit(pages: DataFrame, status: DataFrame, listed: DataFrame, answered: DataFrame, external: bool = True) -> DataFrame:
    """All issues of crawled pages: pages(site, url, netloc, html, body_len, parsed fields), status of every URL asked."""
    targets = pages.select("site", "netloc", F.col("url").alias("url_from"), F.explode(F.array_distinct(F.concat(F.transform("links", lambda l: l["href"]), F.filter(F.transform("images", lambda i: i["src"]), lambda s: s != "")))).alias("target"))
    targets = targets.withColumn("target", U.audit_norm(F.col("target")))
    crawled = status.join(pages.select("site", "url"), ["site", "url"], "left_semi")
    found = page_findings(pages).select("site", F.col("url").alias("subject"), F.explode("findings").alias("detail"))
    return (
        page_answers(crawled, targets)
        .unionByName(found.select("site", F.lit("page").alias("kind"), "subject", "detail"))
        .unionByName(target_answers(targets, crawled, status, external))
        .unionByName(sitemap_drift(listed, crawled, answered))
    )


def counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("site", "kind").agg(F.count("*").alias("n"))


def reachable(edges: DataFrame, starts: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(site, url, steps): URLs that links lead to from the starts, with the least number of steps, up to most_steps if that is given. Each round joins only what the last one reached."""
    seen = written(starts.select("site", "url").distinct().withColumn("steps", F.lit(0)), "reached")
    last = seen
    step = 0
    while most_steps is None or step < most_steps:
        step += 1
        to = last.join(edges.select("site", F.col("from_url").alias("url"), "to_url"), ["site", "url"]).select("site", F.col("to_url").alias("url")).distinct()
        last = written(to.join(seen, ["site", "url"], "left_anti").withColumn("steps", F.lit(step)), "reached")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen
