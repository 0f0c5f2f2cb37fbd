"""The whole derivation of sites from pages: parse once, then links, templates, what is read and what is left out, duplicates, markdown, inventory, facts, reviews, pictures, furniture, cards.

`site` (host without www) is part of every key, so one run serves any number of sites. Tables that several others read are
written once; the rest is declared and runs when it is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import markup as K
from ..functions import text as X
from ..functions import url as U
from ..operators import business, content, dedupe, facts, furniture, inventory, links, media, templates
from ..parse.stage import parse, reviews, stated_reviews
from ..sources.sitemaps import can_fetch
from .written import spread, written

AGENT = "weftline"


@dataclass(frozen=True)
class Profile:
    """Limits of a run: pages that are kept, pictures that are fetched, and how many pages of a template and of a section are read."""

    name: str = "pages"
    max_pages: int = 1000
    images: str = "content"
    per_template: int | None = None
    per_section: int | None = None


PROFILES = {p.name: p for p in (Profile("survey", 100, "none", 2, 6), Profile("brand", 100, "brand", 2, 6), Profile("pages", 1000, "content"), Profile("reference", 8, "none", 1, 3))}


def parsed_pages(pages: DataFrame, order: str = "page_id", cut: bool = True, **more: Column) -> DataFrame:
    """pages(page_id, url, html) parsed, with site and ord, and `more` columns made before the parse. The result is written: a parse must not be repeated by each of its readers."""
    rows = pages.select(U.site(F.col("url")).alias("site"), F.col(order).cast("bigint").alias("ord"), "url", "html", *[c.alias(name) for name, c in more.items()])
    out = parse(spread(rows)).withColumn("tracking", K.tracking_ids(F.col("html"))).drop("html")
    return written(out, "parsed") if cut else out


def with_markdown(parsed: DataFrame) -> DataFrame:
    return parsed.withColumns({"markdown": content.markdown(F.col("blocks")), "fingerprint": content.fingerprint(F.col("blocks"))})


@dataclass
class Site:
    """Tables of a run; those below the inventory are declared when they are asked for."""

    parsed: DataFrame
    edges: DataFrame
    duplicates: DataFrame
    repeated: DataFrame
    pages: DataFrame
    inventory: DataFrame
    kept: DataFrame  # parsed pages that are read and no duplicates
    assigned: DataFrame  # templates of known URLs
    limits: DataFrame  # site, limit_reached

    @cached_property
    def _items(self) -> DataFrame:
        return self.kept.select("site", "url", "ord", K.jsonld_items_all(F.col("jsonld_raw")).alias("items"))

    @cached_property
    def _markup(self) -> DataFrame:
        return self._items.select("site", "url", "ord", F.posexplode("items").alias("pos", "item"))

    @cached_property
    def _stated(self) -> DataFrame:
        return self._items.select("site", "url", "ord", stated_reviews(F.col("items"), F.col("url")).alias("s"))

    @cached_property
    def _told(self) -> DataFrame:
        """Reviews of the pages' own cards, then of their markup."""
        each = lambda df, c: df.select("site", "ord", F.posexplode(c).alias("pos", "r")).select("site", "ord", "pos", "r.*")
        return each(self.kept, "told").unionByName(each(self._stated, "s.reviews").withColumn("pos", F.col("pos") + 100_000))

    @cached_property
    def reviews(self) -> DataFrame:
        return facts.first_reviews(self._told)

    @cached_property
    def ratings(self) -> DataFrame:
        return facts.first_ratings(self._stated.select("site", "ord", F.posexplode("s.ratings").alias("pos", "r")).select("site", "ord", "pos", "r.*"))

    @cached_property
    def facts(self) -> DataFrame:
        named = self.assigned.select("site", F.col("url").alias("norm"), "template")
        placed = self.kept.select("site", "url", "ord", U.normalize(F.col("url")).alias("norm")).join(named, ["site", "norm"], "left").drop("norm")
        found = facts.from_blocks(links.blocks(self.kept), placed, self._told)
        return facts.merge(found.unionByName(facts.from_links(links.links(self.kept), placed)).unionByName(_stated_facts(self._markup)))

    @cached_property
    def furniture(self) -> DataFrame:
        return furniture.site_furniture(furniture.page_furniture(self.kept))

    @cached_property
    def media(self) -> DataFrame:
        return media.classify(media.rollup(_pictures(self.kept)), self.furniture.select("site", F.col("logo.src").alias("logo_src")))

    @cached_property
    def cards(self) -> DataFrame:
        start = Window.partitionBy("site").orderBy("ord")
        homes = self.kept.select("site", "title", "meta_description", F.row_number().over(start).alias("turn")).where("turn = 1").drop("turn")
        return business.card(homes, business.merge(self._markup), self.facts)


def _asked(pages: DataFrame, robots: DataFrame | None) -> DataFrame:
    """pages with status, final_url and robots filled in where they are not given."""
    given = {"status": F.lit(200), "final_url": F.col("url"), "robots": F.lit(None).cast("string")}
    if robots is not None:
        pages = pages.drop("robots").join(robots.select(F.col("site").alias("_site"), "robots"), U.site(F.col("url")) == F.col("_site"), "left").drop("_site")
    return pages.withColumns({name: value for name, value in given.items() if name not in pages.columns})


def _admitted(parsed: DataFrame, assigned: DataFrame, profile: Profile) -> DataFrame:
    """(site, ord, admitted): a site's first page always, pages that lead elsewhere and those robots.txt closes do not count, others as the sampler has room."""
    if profile.per_template is None and profile.per_section is None:
        return parsed.select("site", "ord", F.lit(True).alias("admitted"))
    rows = parsed.select("site", "ord", U.normalize(F.col("url")).alias("url"), "moved", "robots_ok").withColumn("turn", F.row_number().over(Window.partitionBy("site").orderBy("ord")))
    rows = rows.join(assigned.select("site", "url", "template", "in_nav"), ["site", "url"], "left").fillna(False, ["in_nav"])
    sampled = (F.col("turn") > 1) & ~F.col("moved") & F.col("robots_ok") & F.col("template").isNotNull()
    chosen = templates.admit(rows.where(sampled).withColumnRenamed("turn", "rank"), profile.per_template, profile.per_section)
    return chosen.select("site", "ord", "admitted").unionByName(rows.where(~sampled).select("site", "ord", F.lit(True).alias("admitted")))


def _pictures(kept: DataFrame) -> DataFrame:
    """Occurrences of pictures: those of blocks with the words around them, those of the markup, the preview."""
    null = lambda kind: F.lit(None).cast(kind)
    no, sizes = F.lit(False), "array<struct<url:string,w:int>>"
    columns = lambda step, **own: [F.lit(step).alias("step"), *[c.alias(n) for n, c in ({"background": no, "og": no, "width": null("int"), "height": null("int"), "shown": null("int"), "row": null("int"), "video": no, "autoplay": no, "heading": null("string"), "beside": F.lit("")} | own).items()]]
    shown = content.with_context(links.blocks(kept)).select("site", "url", "ord", "pos", "src", "alt", "srcset", "chrome", *columns(0, background=F.coalesce("background", no), shown=F.col("shown"), row=F.col("row"), heading=F.col("heading"), beside=F.col("beside")))
    marked = links.images(kept).select("site", "url", "ord", "pos", "src", "alt", F.col("srcset_w").alias("srcset"), F.col("landmark").isNotNull().alias("chrome"), *columns(1, width=F.col("width"), height=F.col("height"), row=F.col("row"), video=F.coalesce("video", no), autoplay=F.coalesce("autoplay", no)))
    preview = kept.select("site", "url", "ord", F.lit(0).alias("pos"), F.try_element_at("meta", F.lit("og:image")).alias("src"), F.lit("").alias("alt"), null(sizes).alias("srcset"), F.lit(True).alias("chrome"), *columns(2, og=F.lit(True)))
    return shown.unionByName(marked).unionByName(preview)


def _stated_facts(items: DataFrame) -> DataFrame:
    """Fields of the business markup as facts; an address is a line of its parts."""
    f = business.fields(items)
    place = business.address(F.col("value"))
    line = F.array_join(F.filter(F.array(*[place[p] for p in ("street", "locality", "region", "postal_code", "country")]), lambda x: x != ""), ", ")
    value = F.when(F.col("field") == "address", F.coalesce(F.nullif(line, F.lit("")), F.col("value"))).otherwise(F.col("value"))
    return facts.from_business(f.select("site", "url", "field", F.col("at.sub").alias("ord"), value.alias("value")))


def build(pages: DataFrame, profile: Profile = PROFILES["pages"], prior: DataFrame | None = None, robots: DataFrame | None = None, listed: DataFrame | None = None) -> Site:
    """All tables of the sites in pages(page_id, url, html[, status][, final_url]), in the order of page_id. prior(url, hash) are pages of an earlier run, robots(site, robots) the sites' rules for agents, listed(site, url, sitemap) what their sitemaps list."""
    asked, here = _asked(pages, robots), U.normalize(F.col("url"))
    parsed = parsed_pages(
        asked, status=F.col("status"), moved=F.coalesce(U.normalize(F.col("final_url")) != here, F.lit(False)), bot_check=X.is_bot_check(F.col("html")), full=F.trim(F.coalesce("html", F.lit(""))) != "",
        robots_ok=F.lit(True) if robots is None else can_fetch(F.col("robots"), F.lit(AGENT), F.col("url")), told=reviews(F.col("html"), F.col("url")),
    )
    edges = written(links.edges(parsed), "edges")
    urls = parsed.select("site", here.alias("url")).union(edges.select("site", "to_url")).distinct()
    if listed is not None:
        urls = urls.union(listed.select("site", U.normalize(F.col("url")))).where("url is not null").distinct()
    nav = templates.nav_urls(parsed).withColumn("in_nav", F.lit(True))
    known = urls.join(nav, ["site", "url"], "left").fillna(False, ["in_nav"])
    maps = parsed.limit(0).select("site", "url", F.lit("").alias("sitemap")) if listed is None else listed.select("site", U.normalize(F.col("url")).alias("url"), "sitemap")
    known = known.join(maps.groupBy("site", "url").agg(F.min("sitemap").alias("sitemap")), ["site", "url"], "left")
    assigned = written(templates.assign(known).withColumn("in_sitemap", F.col("sitemap").isNotNull()), "templates")
    body = written(with_markdown(parsed).select("site", "ord", "status", "moved", "bot_check", "full", "robots_ok", "markdown", "fingerprint", X.word_count(F.col("markdown")).alias("word_count")).join(_admitted(parsed, assigned, profile), ["site", "ord"]), "body")
    reason = lambda duplicate, repeated: inventory.skip_reason(F.col("robots_ok"), F.col("admitted"), F.col("status"), F.col("moved"), F.when(F.col("full"), "x"), F.col("bot_check"), F.col("markdown"), duplicate, repeated)
    read = body.where(reason(F.lit(None).cast("string"), F.lit(False)).isNull())
    duplicates = written(dedupe.greedy(read.select("site", "ord", F.col("markdown").alias("text"))), "duplicates")
    # the limit counts pages that are kept; what comes behind the last of them is not read
    turn = duplicates.where("kept").select("site", "ord", F.row_number().over(Window.partitionBy("site").orderBy("ord")).alias("turn"))
    last = turn.where(F.col("turn") == profile.max_pages).select("site", F.col("ord").alias("last"))
    some = turn.where(F.col("turn") <= profile.max_pages).select("site", "ord")
    kept = parsed.join(some, ["site", "ord"], "left_semi")
    blocks = links.blocks(kept)
    repeated = written(content.repeated_lines(content.block_lines(blocks)), "repeated")
    final = content.page_markdown(content.mark_repeated(blocks, repeated))
    final_body = F.coalesce("final", F.lit(""))
    late = F.coalesce(F.col("ord") > F.col("last"), F.lit(False))
    fate = body.join(duplicates.withColumnsRenamed({"reason": "duplicate", "kept": "first"}), ["site", "ord"], "left").join(last, "site", "left")
    rows = parsed.select("site", "ord", "url", "title", "meta_description", "h1", "h1_count", "canonical", "lang", "noindex", "forms", "iframes", "scripts", "jsonld_raw", "links").join(fate, ["site", "ord"]).join(final.withColumnRenamed("markdown", "final"), ["site", "url"], "left")
    why = F.when(late, "unread").otherwise(reason(F.col("duplicate"), F.coalesce("first", F.lit(False)) & (F.trim(final_body) == "")))
    rows = rows.withColumn("reason", why).withColumn("file", F.when(F.col("reason").isNull(), X.squash(U.page_name(here))))
    rows = rows.withColumns({"hash": X.body_hash(final_body), "thin": F.char_length(F.trim(final_body)) < X.THIN_CHARS})
    documents = F.size(F.array_distinct(F.transform(F.filter("links", lambda l: U.is_document(l["href"])), lambda l: l["href"])))
    own = rows.select(
        "site", "ord", here.alias("url"), "status", "title", "meta_description", "h1", "h1_count", "canonical", "lang", "word_count", "noindex", "reason", "file", "hash", "fingerprint", "thin",
        F.size("forms").alias("forms"), F.transform(K.embeds(F.col("iframes"), F.col("scripts")), lambda e: e["kind"]).alias("embed_kinds"), K.jsonld_types(K.jsonld_items_all(F.col("jsonld_raw"))).alias("jsonld_types"), documents.alias("documents"),
    )
    first = Window.partitionBy("url").orderBy("ord")
    own = own.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    table = assigned.join(own.drop("site"), "url", "left").join(links.inbound(edges, urls), "url", "left").join(links.outbound(edges), "url", "left")
    table = table.fillna(0, ["word_count", "sitewide_links", "body_links", "forms", "documents"]).fillna("", ["title", "h1", "lang"]).withColumn("reason", F.when(F.col("ord").isNull(), "unread").otherwise(F.col("reason")))
    if prior is not None:
        old = prior.select("url", F.col("hash").alias("old_hash"))
        table = table.join(old, "url", "left").withColumn("change", F.when(F.col("file").isNull(), None).when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("hash"), "same").otherwise("changed")).drop("old_hash")

    limits = turn.groupBy("site").agg((F.max("turn") >= profile.max_pages).alias("limit_reached"))
    return Site(parsed, edges, duplicates, repeated, final, table, kept, assigned, limits)


def run_summary(records: DataFrame) -> DataFrame:
    """One row of counts per site, from the inventory alone."""
    count = lambda when: F.count_if(when)
    file, reason = F.col("file").isNotNull(), F.col("reason")
    changed = [count(F.col("change") == c).alias(c) for c in ("new", "changed", "same")] if "change" in records.columns else []
    return records.groupBy("site").agg(
        F.count("*").alias("discovered"), count(file).alias("pages"), count(reason == "exact_duplicate").alias("exact_duplicates"), count(reason == "near_duplicate").alias("near_duplicates"),
        count(reason.isin("unread", "sampled_out")).alias("unread"), count(reason.isNotNull() & ~reason.isin("unread")).alias("skipped"), count(F.col("thin") & file).alias("thin"), count(F.col("noindex")).alias("noindex"),
        F.sum("word_count").alias("words"), F.count_distinct("template").alias("templates"), *changed,
    )


def full_summary(site: Site) -> DataFrame:
    """The inventory's counts with those of every other table: one row per site."""
    n = lambda df, name, key="site": df.groupBy(key).agg(F.count("*").alias(name))
    records = site.inventory
    out = run_summary(records)
    kinds = site.facts.groupBy("site").agg(*[F.count_if(F.col("kind") == k).alias(f"facts_{k}") for k in facts.KINDS])
    collections = templates.report(records).where("collection").groupBy("site").agg(F.count("*").alias("collections"))
    papers = records.groupBy("site").agg(F.sum("documents").alias("documents"), F.count_if(F.col("forms") > 0).alias("pages_with_forms"))
    frames = site.furniture.select("site", F.col("has_landmarks").alias("furniture_landmarks"), F.coalesce(F.size("nav"), F.lit(0)).alias("nav_items"))
    marked = site.cards.select("site", F.array_contains(F.map_values("sources"), "markup").alias("business_markup"))
    parts = [kinds, collections, papers, frames, marked, n(site.repeated, "common_lines"), n(site.reviews, "reviews"), n(site.ratings, "ratings"), n(site.media, "media"), site.limits, templates.uses_wordpress(site.kept)]
    for part in parts:
        out = out.join(part, "site", "left")
    return out.fillna(0).fillna(False)
