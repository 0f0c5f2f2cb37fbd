"""Named queries over the driver's tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import markup as K
from ..functions import media as M
from ..functions import rules as R
from ..functions import text as X
from ..functions import url as U
from ..operators import audit, business, changes, content, dedupe, facts, furniture, inventory, launch, links, measure, media, templates
from ..parse.stage import a11y_findings
from . import site as S
from .written import spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    """A small table of the query's own."""
    return spark.createDataFrame(rows, ddl)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parsed_pages(table(spark, sf_dir, "pages"))


# URLs


@query
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("normal"))


@query
def url_same_site(spark, sf_dir):
    """Pages whose host is the first page's host but for www."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", U.site(F.col("url")).alias("site"), U.same_site(F.col("url"), F.lit("www.theran.example.net")).alias("same_site"))


@query
def url_crawlable(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.crawlable(F.col("url")).alias("crawlable"), U.is_document(F.col("url")).alias("document"))


@query
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.section(u).alias("section"), long(F.size(U.segments(u))).alias("depth"))


@query
def page_name(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.slugify(u).alias("slug"), U.page_name(u).alias("name"))


@query
def section_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(U.site(F.col("url")).alias("site"), U.section(F.col("url")).alias("section"))
    return p.groupBy("site", "section").agg(F.count("*").alias("n"))


@query
def map_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.map_to(F.col("url"), F.lit("https://new.example.com:8443")).alias("new_url"))


@query
def audit_norm(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.audit_norm(F.col("url")).alias("normal"))


@query
def tracking_param_share(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(U.site(F.col("url")).alias("site"), F.exists(U.parameters(U.query(F.col("url"))), lambda x: F.lower(x["name"]).rlike("^(" + "|".join(U.TRACKING_PARAMS) + ")")).alias("tracked"))
    return p.groupBy("site").agg(F.count("*").alias("pages"), F.count_if("tracked").alias("tracked"))


# text


@query
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_digest(F.col("text")).alias("digest"))


@query
def norm_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", long("pos").alias("pos"), X.norm_line(F.col("line")).alias("line"))


@query
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


@query
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", long(F.size(X.shingles(F.col("text")))).alias("shingles"))


@query
def phones(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.phones(F.col("text"))).alias("pos", "phone"))
    return d.select("doc_id", long("pos").alias("pos"), "phone", X.phone_key(F.col("phone")).alias("key"))


@query
def emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.emails(F.col("text"))).alias("email"))


@query
def contact_patterns(spark, sf_dir):
    """Counts of addresses, hours and dates that a text states."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", long(F.size(X.addresses(t))).alias("addresses"), long(F.size(X.hours(t))).alias("hours"), long(F.size(F.regexp_extract_all(t, F.lit(X.DATE), F.lit(0)))).alias("dates"))


@query
def action_score(spark, sf_dir):
    """Scores of links made of pages' URLs and a word of their titles."""
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.calendly.com/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("href"), F.when(F.col("page_id") % 2 == 0, "Book now").otherwise("More").alias("label"))
    return p.select("page_id", long(X.action_score(F.col("href"), F.col("label"))).alias("score"))


@query
def table_cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.cell(F.regexp_replace("text", "\n", " ")).alias("cell"))


@query
def json_strings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.frontmatter([("source", F.col("source"), "string"), ("lang", F.col("lang"), "string"), ("chars", F.col("n_chars"), "json"), ("none", F.lit(None).cast("string"), "string")]).alias("head"))


# duplicates and repetition


@query
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("site"), F.col("doc_id").alias("ord"), "text")
    return dedupe.exact(d).select(F.col("ord").alias("doc_id"), F.col("first_ord").alias("first_doc_id"), "kept")


@query
def minhash_signature(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(F.array_join(X.minhash(F.col("text")).cast("array<string>"), ",")).alias("signature"))


@query
def dedupe_greedy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("site"), F.col("doc_id").alias("ord"), "text")
    return dedupe.greedy(d).select(F.col("ord").alias("doc_id"), "kept", "reason")


@query
def near_duplicate_pairs(spark, sf_dir):
    """Pairs of documents that share a band and agree in half of their signature."""
    d = table(spark, sf_dir, "documents").select(F.lit("all").alias("site"), F.col("doc_id").alias("ord"), "text")
    first = dedupe.exact(d).where("kept").select("site", "ord")
    signed = written(dedupe.signatures(spread(d.join(first, ["site", "ord"], "left_semi"))).select("site", "ord", "signature"), "signatures")
    return dedupe.candidate_pairs(signed, 0.5).select("site", "a", "b", "agreement")


@query
def repeated_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line"))
    return content.repeated_lines(d, 0.05).select("site", "line", "n", "pages")


@query
def boilerplate_removed(spark, sf_dir):
    """Words of each document without the lines that repeat in its source."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("line"))
    again = content.repeated_lines(d, 0.05).select("site", F.col("line").alias("norm"))
    left = d.withColumn("norm", X.norm_line(F.col("line"))).join(again, ["site", "norm"], "left_anti")
    return left.groupBy(F.col("page").alias("doc_id")).agg(F.count("*").alias("lines"), F.sum(X.word_count(F.col("line"))).alias("words"))


# parsed pages


@query
def page_head(spark, sf_dir):
    return parsed(spark, sf_dir).select(F.col("ord").alias("page_id"), "title", "lang", "noindex", "meta_description")


@query
def page_h1(spark, sf_dir):
    return parsed(spark, sf_dir).select(F.col("ord").alias("page_id"), "h1", long("h1_count").alias("h1_count"))


@query
def nav_links(spark, sf_dir):
    x = links.links(parsed(spark, sf_dir)).where("landmark = 'nav'")
    return x.select(F.col("ord").alias("page_id"), long("pos").alias("pos"), "text", "href")


@query
def link_count(spark, sf_dir):
    return parsed(spark, sf_dir).select(F.col("ord").alias("page_id"), long(F.size("links")).alias("links"), long(F.size("internal_links")).alias("internal"))


@query
def page_blocks(spark, sf_dir):
    x = links.blocks(parsed(spark, sf_dir))
    return x.select(F.col("ord").alias("page_id"), long("pos").alias("pos"), "tag", "text", "chrome", "href")


@query
def page_markdown(spark, sf_dir):
    return S.with_markdown(parsed(spark, sf_dir)).select(F.col("ord").alias("page_id"), "markdown")


@query
def page_fingerprint(spark, sf_dir):
    return S.with_markdown(parsed(spark, sf_dir)).select(F.col("ord").alias("page_id"), "fingerprint")


@query
def landmark_lines(spark, sf_dir):
    x = parsed(spark, sf_dir).select(F.col("ord").alias("page_id"), F.explode("landmark_lines").alias("landmark", "lines"))
    return x.select("page_id", "landmark", F.posexplode("lines").alias("pos", "line")).withColumn("pos", long("pos"))


@query
def bot_check(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.is_bot_check(F.col("html")).alias("bot_check"))


@query
def page_a11y(spark, sf_dir):
    p = S.parsed_pages(table(spark, sf_dir, "pages")).select(F.col("ord").alias("page_id"), "title", "meta_description")
    rows = table(spark, sf_dir, "pages").select("page_id", "html").join(p, "page_id")
    return rows.select("page_id", F.posexplode(a11y_findings(F.col("html"), F.col("title"), F.col("meta_description"))).alias("pos", "finding")).withColumn("pos", long("pos"))


@query
def audit_titles(spark, sf_dir):
    """Titles that are missing, long, or used by several pages of a site."""
    p = parsed(spark, sf_dir).select("site", F.col("ord").alias("page_id"), "title")
    n = F.count("*").over(Window.partitionBy("site", "title"))
    return p.select("page_id", (F.col("title") == "").alias("missing"), (F.char_length("title") > 60).alias("long"), ((F.col("title") != "") & (n > 1)).alias("duplicate"))


@query
def audit_page_findings(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), "html", F.length(F.encode("html", "UTF-8")).cast("bigint").alias("body_len"))
    found = audit.page_findings(parsed(spark, sf_dir).join(rows, "ord"))
    return found.select("site", "url", F.posexplode("findings").alias("pos", "finding")).withColumn("pos", long("pos"))


@query
def audit_issue_counts(spark, sf_dir):
    """Counts of issues per site, where pages with an odd id answer after one hop, every 20th with 404, and targets that no page has are not asked."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html", U.site(F.col("url")).alias("site"), U.netloc(F.col("url")).alias("netloc"), F.length(F.encode("html", "UTF-8")).cast("bigint").alias("body_len"))
    full = parsed(spark, sf_dir).drop("url", "site").join(p.withColumnRenamed("page_id", "ord"), "ord").withColumn("url", U.audit_norm(F.col("url"))).dropDuplicates(["url"])
    status = full.select("site", "url", F.when(F.col("ord") % 20 == 0, 404).otherwise(200).alias("status"), F.col("url").alias("final_url"), F.when(F.col("ord") % 2 == 1, F.array("url")).otherwise(F.array().cast("array<string>")).alias("hops"), F.lit("text/html").alias("content_type"), F.lit(0).cast("bigint").alias("content_length"))
    answered = full.select("site", F.concat(F.lit("http://"), F.col("netloc"), F.lit("/sitemap.xml")).alias("sitemap_url"), F.lit(200).alias("status")).dropDuplicates(["site"])
    listed = full.where("ord % 3 = 0").select("site", "url")
    return audit.counts(audit.audit(full, status, listed, answered))


# links and templates


@query
def link_edges(spark, sf_dir):
    e = links.edges(parsed(spark, sf_dir))
    return e.select("from_url", "to_url", "sitewide").distinct()


@query
def inbound_degree(spark, sf_dir):
    p = parsed(spark, sf_dir)
    e = links.edges(p)
    known = p.select(U.normalize(F.col("url")).alias("url")).union(e.select("to_url"))
    return links.inbound(e, known).select("url", "sitewide_links", "body_links")


@query
def outbound_internal(spark, sf_dir):
    return links.outbound(links.edges(parsed(spark, sf_dir))).select("url", F.array_join("outbound_internal", " ").alias("targets"), long(F.size("outbound_internal")).alias("n"))


def known_urls(spark, sf_dir) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(U.site(u).alias("site"), U.normalize(u).alias("url"), F.col("page_id").alias("ord"))


@query
def url_template(spark, sf_dir):
    return templates.assign(known_urls(spark, sf_dir).select("site", "url").distinct())


@query
def collection_parents(spark, sf_dir):
    u = known_urls(spark, sf_dir).select("site", F.transform(U.segments(F.col("url")), R.norm_segment).alias("segs"), U.segments(F.col("url")).alias("raw")).where("size(segs) > 0")
    parent = F.array_join(F.slice("segs", F.lit(1), F.size("segs") - 1), "/")
    n = u.groupBy("site", parent.alias("parent")).agg(F.count_distinct(F.lower(F.element_at("raw", -1))).alias("children"))
    return n.where(F.col("children") >= R.MIN_COLLECTION)


@query
def template_report(spark, sf_dir):
    u = known_urls(spark, sf_dir).groupBy("site", "url").agg(F.min("ord").alias("ord"))
    a = templates.assign(u.select("site", "url"))
    r = u.join(a, ["site", "url"]).select("*", F.when(F.col("ord") % 2 == 0, F.col("url")).alias("file"), F.when(F.col("ord") % 2 == 1, "unread").alias("reason"), (F.col("ord") % 50).alias("word_count"), F.when(F.col("ord") % 4 == 0, "a").otherwise("b").alias("fingerprint"))
    t = templates.report(r)
    return t.select("site", "template", "collection", "count", "read", "not_read", "shapes", "avg_words", F.array_join("examples", " ").alias("examples"))


@query
def frontier_order(spark, sf_dir):
    """Pages found twice: once at a tier of their id, once at another."""
    u = known_urls(spark, sf_dir)
    found = u.select("site", "url", (F.col("ord") % 6).cast("int").alias("tier"), F.col("ord").alias("seq")).union(u.select("site", "url", (F.col("ord") % 4).cast("int"), F.col("ord") + 100_000))
    return templates.frontier(found).select("site", "url", long("tier").alias("tier"), "seq", long("rank").alias("rank"))


@query
def sampler_admit(spark, sf_dir):
    u = known_urls(spark, sf_dir).groupBy("site", "url").agg(F.min("ord").alias("ord"))
    a = u.join(templates.assign(u.select("site", "url")), ["site", "url"]).withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("ord")))
    return templates.admit(a.withColumn("in_nav", F.col("ord") % 7 == 0), 2, 3).select("site", "url", "admitted")


@query
def inventory_rows(spark, sf_dir):
    t = S.build(table(spark, sf_dir, "pages")).inventory
    return t.select("site", "url", "template", "title", "h1", "word_count", "body_links", "sitewide_links", "reason", "file", "fingerprint")


@query
def reason_counts(spark, sf_dir):
    return inventory.reason_counts(S.build(table(spark, sf_dir, "pages")).inventory)


@query
def run_summary(spark, sf_dir):
    return S.run_summary(S.build(table(spark, sf_dir, "pages")).inventory)


@query
def skip_reasons(spark, sf_dir):
    """The first rule that holds, over flags made of page ids."""
    i = F.col("page_id")
    empty = F.lit(None).cast("string")
    reason = inventory.skip_reason(i % 11 != 0, i % 7 != 0, F.when(i % 13 == 0, None).when(i % 5 == 0, 500).otherwise(200), i % 17 == 0, F.col("html"), i % 19 == 0, F.when(i % 23 == 0, "").otherwise("x"), F.when(i % 29 == 0, F.lit("near_duplicate")).otherwise(empty), i % 3 == 0)
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))


# facts


@query
def page_facts(spark, sf_dir):
    """Contact facts of documents, each taken as the text of a source's own page."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.concat(F.lit("http://h/contact/"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("ord"), "text")
    blocks = d.select("site", "url", F.lit(0).alias("pos"), F.lit("p").alias("tag"), "text", F.lit(False).alias("chrome"))
    m = facts.merge(facts.from_blocks(blocks, d.select("site", "url", "ord", F.lit("/contact").alias("template"))))
    return m.select("site", "kind", "key", "value", long(F.size("sources")).alias("sources"))


@query
def facts_several(spark, sf_dir):
    m = page_facts(spark, sf_dir)
    return m.where(F.col("kind").isin("phone", "email", "address")).groupBy("site", "kind").agg(F.count("*").alias("n")).where("n > 1")


# small tables of the query's own

IMAGES = [
    (1, "https://x.com/wp/photo-1024x683.jpg", "", 1024, 683, None, None, None), (2, "https://x.com/wp/photo.jpg?w=800&v=2", "A house", None, None, None, None, None),
    (3, "https://cdn.shopify.com/s/files/lamp_800x.jpg", "", 800, None, None, None, None), (4, "https://x.com/img/site-logo.png", "", 200, 80, "header", None, None),
    (5, "https://x.com/partners/acme.png", "Acme", 300, 100, None, None, 4), (6, "https://x.com/icons/arrow.svg", "", None, None, None, None, None),
    (7, "https://images.unsplash.com/a.jpg?fit=crop&w=100", "", 900, 700, None, None, None), (8, "https://x.com/a/b/badge_small.png", "", 90, 90, "footer", 80, None),
    (9, "https://x.com/hero-scaled.webp", "", 1900, 900, None, None, None), (10, "https://x.com/themes/bg.png", "", None, None, "header", None, None), (11, "https://x.com/u/pic.gif", "", 50, 50, None, None, None),
]


def image_rows(spark) -> DataFrame:
    return values(spark, "id bigint, src string, alt string, width int, height int, landmark string, shown int, row int", IMAGES)


@query
def image_kind(spark, sf_dir):
    kind = M.guess_kind(*[F.col(c) for c in ("src", "alt", "width", "height", "landmark", "shown", "row")])
    return image_rows(spark).select("id", kind.alias("kind"))


@query
def color_normalize(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("rgb("), (F.col("p_partkey") % 256).cast("string"), F.lit(", 10,  200)"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("rgba(1,2,"), F.col("p_size").cast("string"), F.lit(",0.5)"))).when(F.col("p_partkey") % 4 == 2, "#AbC").otherwise("#00FF7F").alias("c"))
    return p.select("p_partkey", R.normalize_color(F.col("c")).alias("color"))


@query
def launch_verdict(spark, sf_dir):
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", R.verdict(F.when(i % 5 == 0, 404).when(i % 7 == 0, 500).when(i % 11 == 0, 410).otherwise(200), (i % 3).cast("int"), i % 4 == 0).alias("verdict"))


@query
def launch_rows(spark, sf_dir):
    """Old pages against answers of a new host, which every third page does not have."""
    u = known_urls(spark, sf_dir).groupBy("url").agg(F.min("ord").alias("ord"))
    inv = u.select("url", F.lit("t").alias("title"), F.lit(None).cast("string").alias("reason"), F.lit(200).alias("status"), F.col("url").alias("file"))
    new = u.where("ord % 3 != 0").groupBy(U.map_to(F.col("url"), F.lit("https://new.example.com")).alias("url")).agg(F.min("ord").alias("ord"))
    new = new.select(
        "url", F.lit(200).alias("status"), F.when(F.col("ord") % 2 == 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("hops"), F.lit("f").alias("final_url"), F.when(F.col("ord") % 5 == 0, "").otherwise("T").alias("title"),
        (F.col("ord") % 2).cast("int").alias("h1_count"), F.lit("d").alias("meta_description"), (F.col("ord") % 4 == 0).alias("noindex"), F.lit(None).cast("string").alias("error"),
    )
    rows = launch.check(inv, new, F.lit("https://new.example.com"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.size("findings") > 0).alias("with_findings"))


@query
def sitemap_drift(spark, sf_dir):
    """Paths kept but not in a new sitemap that lists every second page, and paths new in it."""
    u = known_urls(spark, sf_dir).select("url", "ord")
    rows = u.where("ord % 3 != 0").select(F.col("url").alias("old_url"), F.lit("ok").alias("verdict"), F.array().cast("array<string>").alias("chain"))
    return launch.sitemap_differences(rows, u.where("ord % 2 = 0").select("url"))


@query
def sitemap_label(spark, sf_dir):
    s = values(spark, "id bigint, sitemap string", [(i, u) for i, u in enumerate(["https://x/post-sitemap2.xml", "https://x/sitemap_products_1.xml.gz", "https://x/wp-sitemap-posts-recipe-1.xml", "https://x/page-sitemap.xml", "https://x/sitemap.xml", "https://x/wp-sitemap-x-1.xml", "https://x/news_sitemap.xml"])])
    return s.select("id", R.sitemap_words(F.col("sitemap")).alias("words"), R.sitemap_label(F.col("sitemap")).alias("label"))


@query
def retry_waits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, "soon").alias("header"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("attempt"), F.when(F.col("o_orderkey") % 2 == 0, 429).otherwise(503).alias("status"))
    return o.select("o_orderkey", F.coalesce(R.throttled(F.col("status"), F.col("header")), F.lit(False)).alias("throttled"), R.backoff(F.col("attempt"), F.col("header"), F.lit(0.0)).alias("wait"))


@query
def strip_plans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 4).cast("int").alias("height"))
    plan = R.strip_plan(F.col("height"), 2044)
    return o.select("o_orderkey", long(F.size(plan["strips"])).alias("strips"), long(F.element_at(plan["strips"], -1)["h"]).alias("last"), plan["cut"].alias("cut"), long(R.strip_height(F.lit(1440))).alias("tallest"))


# changes between runs, registries, streams


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), "text")
    now = d.where("doc_id % 10 != 3").select("url", X.body_hash(F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text"))).alias("hash"))
    return now, d.where("doc_id % 10 != 5").select("url", X.body_hash(F.col("text")).alias("hash"))


@query
def change_status(spark, sf_dir):
    return changes.status(*snapshots(spark, sf_dir))


@query
def change_counts(spark, sf_dir):
    return changes.counts(changes.status(*snapshots(spark, sf_dir)))


@query
def registry_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return changes.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query
def top_k_per_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return e.withColumn("rank", long(rank)).where("rank <= 3")


@query
def stream_registry(spark, sf_dir):
    from ..streaming.incremental import registry_once

    return registry_once(spark, f"{sf_dir}/events.parquet")


@query
def stream_dedupe(spark, sf_dir):
    from ..streaming.incremental import dedupe_once

    return dedupe_once(spark, f"{sf_dir}/documents.parquet")


# pictures, business, furniture, layout, places, feeds: tables of the query's own


@query
def media_rollup(spark, sf_dir):
    """Occurrences of pictures by identity: one picture in two sizes on two pages, one used as a preview only."""
    rows = [("s", "u1", 0, 0, "https://x.com/a-300x200.jpg", "One", False, False, 300), ("s", "u2", 1, 0, "https://x.com/a.jpg", "", True, False, None), ("s", "u2", 1, 1, "https://x.com/b.png?w=9", "Two", True, False, 80), ("s", "u2", 1, 2, "https://x.com/o.jpg", None, True, True, None)]
    ddl = "site string, url string, ord bigint, pos int, src string, alt string, chrome boolean, og boolean, width int"
    none = {c: F.lit(None).cast(t) for c, t in {"srcset": "array<struct<url:string,w:int>>", "height": "int", "shown": "int", "row": "int", "video": "boolean", "autoplay": "boolean", "heading": "string"}.items()}
    seen = values(spark, ddl, rows).withColumns(none | {"step": F.lit(0), "background": F.lit(False), "beside": F.lit("")})
    m = media.classify(media.rollup(seen))
    return m.select("key", "original", F.array_join("alts", "|").alias("alts"), long(F.size("seen")).alias("seen"), long(F.size("pages")).alias("pages"), "chrome", "og", long("width").alias("width"), "kind")


@query
def business_card(spark, sf_dir):
    items = [("s.com", "u0", 0, 0, '{"@type":"Dentist","name":"Acme","telephone":"1","address":{"streetAddress":"1 A St","addressRegion":"NY","addressCountry":"US"},"sameAs":["https://x.com/a"]}'), ("s.com", "u1", 1, 0, '{"@type":"Organization","name":"Other","email":"e@s.com","sameAs":"http://x.com/a/"}'), ("t.com", "u2", 2, 0, '{"@type":"Article","name":"No"}')]
    merged = business.merge(values(spark, "site string, url string, ord bigint, pos int, item string", items))
    homes = values(spark, "site string, title string, meta_description string", [("s.com", "Home", "about"), ("t.com", "Home | Tea Room", "")])
    told = values(spark, "site string, kind string, value string, rank int", [("s.com", "phone", "555", 1), ("t.com", "hours", "Mon 9am-5pm", 1), ("t.com", "address", "2 B Rd, Reno, NV 89501", 1)])
    c = business.card(homes, merged, told)
    return c.select("site", "name", "telephone", "email", F.col("address.street").alias("street"), F.col("address.region").alias("region"), "time_zone", F.array_join("opening_hours", ";").alias("hours"), F.array_join("same_as", " ").alias("same_as"), "description", F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("sources"))


@query
def site_furniture(spark, sf_dir):
    f = furniture.site_furniture(furniture.page_furniture(parsed(spark, sf_dir)))
    return f.select("site", long("pages").alias("pages"), "has_landmarks", long(F.size("nav")).alias("nav"), long(F.size("social")).alias("social"), "copyright", long(F.size("pages_with_a_different_nav")).alias("differ"))


@query
def copyright_lines(spark, sf_dir):
    """The copyright line of each page's footer."""
    f = furniture.page_furniture(parsed(spark, sf_dir))
    return f.select(F.col("ord").alias("page_id"), F.col("copyright").startswith("©").alias("stated"), long(F.size("landmarks")).alias("landmarks"))


@query
def layout_problems(spark, sf_dir):
    from ..sources.contracts import LAYOUT_MEASURE

    rows = [("u", 390, None, (30, "div"), [], [(12.0, "p", "tiny")], [], 0), ("u", 900, None, (10, "div"), [], [(12.0, "p", "tiny")], [(4, "left", "div", "t")], 1), ("v", 390, "no answer", None, [], [], [], 0)]
    return measure.problems(values(spark, LAYOUT_MEASURE + ", ord int", rows)).select("url", "rule", "line")


QUERIES["inventory"] = inventory_rows

from . import built_queries  # noqa: E402, F401  registers its queries
