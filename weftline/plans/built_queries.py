"""Named queries over inputs that are built from the columns of the driver's tables: catalogue pages, sitemaps, feeds, listings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import business as B
from ..functions import http as H
from ..functions import markup as K
from ..functions import media as M
from ..functions import rules as R
from ..functions import text as X
from ..functions import url as U
from ..operators import audit, changes, content, facts, furniture, imports, inventory, launch, links, media, places, templates
from ..parse.stage import parse, reviews, stated_reviews
from ..sinks import files
from ..sources import feeds, sitemaps, state
from .queries import known_urls, long, query, table
from .written import spread, written

_none = lambda kind: F.lit(None).cast(kind)


def text(*parts: Column | str | int) -> Column:
    """Strings, and columns as strings, side by side; a string that begins with $ names a column."""
    return F.concat(*[(F.col(p[1:]) if p.startswith("$") else F.lit(p)).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def catalogue_html(spark, sf_dir) -> DataFrame:
    """A shop's page for each part: (site, ord, url, html)."""
    p = table(spark, sf_dir, "part").withColumnsRenamed({"p_partkey": "k", "p_name": "name"}).withColumn("t", F.lower("p_type"))
    html = text(
        '<html lang="en"><head><title>', "$name", " ", "$k", '</title><meta name="description" content="Item ', "$k", '"><meta property="og:image" content="/og/', "$k", '.jpg">',
        F.when(F.col("k") % 5 == 0, '<meta name="robots" content="noindex">').otherwise(""), '<link rel="canonical" href="/p/', "$k", '"><script type="application/ld+json">{"@type":"Product","name":"', "$name",
        '"}</script></head><body><header><a href="/"><img src="/logo.png" alt="Acme logo" width="120"></a><nav><a href="/p/', F.col("k") + 1, '">Next</a><ul><li><a href="/c/', "$t", '">', "$p_brand",
        '</a></li></ul></nav></header><main><h1>', "$name", "</h1><p>Size ", "$p_size", ' of <a href="/t/', "$t", '">', "$p_type", '</a></p><img src="/img/', "$k", '-300x200.jpg" alt="', "$p_type", '" width="', F.col("k") % 3 * 200 + 500,
        '" height="200" srcset="/img/', "$k", "-600x400.jpg 600w, /img/", "$k", '-900x600.jpg 900w"><form action="/buy" method="post"><input name="qty" required><input type="hidden" name="h"><textarea name="note"></textarea>',
        '<button type="submit" name="go">Buy</button></form><div itemscope itemtype="Product"><span itemprop="name">', "$name", '</span><meta itemprop="sku" content="', "$k", '"></div><p><a href="/docs/', "$k",
        '.pdf">Manual</a></p></main><footer><h4>Visit</h4><a href="/map">Map</a><a href="https://facebook.com/acme">fb</a><a href="/privacy">Privacy</a><p>© Acme ', F.col("k") % 3 + 2020, "</p></footer></body></html>",
    )
    site = text("shop", F.col("k") % 7, ".example")
    return p.select(site.alias("site"), F.col("k").alias("ord"), text("http://", site, "/p/", "$k").alias("url"), html.alias("html"))


def catalogue(spark, sf_dir) -> DataFrame:
    return written(parse(spread(catalogue_html(spark, sf_dir))), "catalogue")


@query
def catalogue_head(spark, sf_dir):
    return catalogue(spark, sf_dir).select("ord", "title", "meta_description", "canonical", "noindex", K.open_graph(F.col("meta"))["og:image"].alias("og_image"), F.array_join(K.jsonld_types(K.jsonld_items_all(F.col("jsonld_raw"))), ",").alias("types"))


@query
def catalogue_images(spark, sf_dir):
    i = links.images(catalogue(spark, sf_dir))
    return i.select("ord", long("pos").alias("pos"), "src", "alt", "alt_missing", long("width").alias("width"), long("height").alias("height"), "landmark", "in_link", M.widest(F.col("srcset_w")).alias("widest"))


@query
def catalogue_links(spark, sf_dir):
    x = links.links(catalogue(spark, sf_dir))
    return x.select("ord", long("pos").alias("pos"), "text", "href", "landmark", "in_main", long("depth").alias("depth"), "group")


@query
def catalogue_fields(spark, sf_dir):
    f = catalogue(spark, sf_dir).select("ord", F.explode("forms").alias("f")).select("ord", "f.action", "f.method", F.posexplode("f.fields").alias("pos", "field"))
    return f.select("ord", "action", "method", long("pos").alias("pos"), "field.name", "field.type", "field.required")


@query
def catalogue_items(spark, sf_dir):
    i = catalogue(spark, sf_dir).select("ord", F.explode("microdata").alias("m"))
    return i.select("ord", "m.type", F.try_element_at("m.props", F.lit("name")).alias("name"), F.try_element_at("m.props", F.lit("sku")).alias("sku"))


@query
def catalogue_words(spark, sf_dir):
    return catalogue(spark, sf_dir).select("ord", long("body_word_count").alias("words"), "has_landmarks")


@query
def catalogue_blocks(spark, sf_dir):
    """Blocks with links inside text, pictures and headings; and the words beside each picture."""
    b = links.blocks(catalogue(spark, sf_dir))
    beside = content.with_context(b).select("ord", "heading", "beside")
    own = b.where("not chrome").groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag", "text"))), lambda x: F.concat(x["tag"], F.lit(":"), x["text"])), "|").alias("blocks"))
    return own.join(beside, "ord")


@query
def catalogue_documents(spark, sf_dir):
    return links.documents(catalogue(spark, sf_dir))


@query
def catalogue_degrees(spark, sf_dir):
    e = links.edges(catalogue(spark, sf_dir))
    return links.inbound(e, e.select(F.col("to_url").alias("url"))).select("url", "sitewide_links", "body_links")


@query
def catalogue_furniture(spark, sf_dir):
    f = furniture.page_furniture(catalogue(spark, sf_dir))
    labels = lambda c: F.array_join(F.transform(c, lambda x: x["label"]), ",")
    return f.select("ord", labels("nav").alias("nav"), "logo.src", labels("social").alias("social"), labels("legal").alias("legal"), "copyright", F.col("primary_cta").isNull().alias("no_cta"), F.array_join(F.transform("footer_groups", lambda g: F.concat(g["heading"], F.lit("="), labels(g["links"]))), ";").alias("groups"))


@query
def catalogue_sites(spark, sf_dir):
    """One row per shop: its menu is that of its first page, every other page's differs."""
    f = furniture.site_furniture(furniture.page_furniture(catalogue(spark, sf_dir)))
    return f.select("site", long("pages").alias("pages"), "from", "copyright", long(F.size("social")).alias("social"), long(F.size("pages_with_a_different_nav")).alias("differ"))


def pictures(spark, sf_dir) -> DataFrame:
    i = links.images(catalogue(spark, sf_dir)).withColumn("chrome", F.col("landmark").isNotNull())
    return media.classify(media.rollup(i.select("site", "url", "ord", F.lit(0).alias("step"), "pos", "src", "alt", F.col("srcset_w").alias("srcset"), "chrome", F.lit(False).alias("background"), F.lit(False).alias("og"), "width", "height", _none("int").alias("shown"), "row", "video", "autoplay", _none("string").alias("heading"), F.lit("").alias("beside"))))


@query
def catalogue_pictures(spark, sf_dir):
    m = pictures(spark, sf_dir)
    return m.select("site", "original", F.array_join("alts", "|").alias("alts"), long(F.size("pages")).alias("pages"), "chrome", long("width").alias("width"), "kind")


@query
def catalogue_pictures_chosen(spark, sf_dir):
    return media.select(pictures(spark, sf_dir), "content").groupBy("site").agg(F.count("*").alias("n"))


@query
def catalogue_link_facts(spark, sf_dir):
    p = catalogue(spark, sf_dir)
    m = facts.merge(facts.from_links(links.links(p), p.select("site", "url", "ord", F.lit("/p/*").alias("template"))))
    return m.select("site", "kind", "value", long(F.size("sources")).alias("sources"), long("rank").alias("rank"))


@query
def catalogue_menu(spark, sf_dir):
    """What the home page's menu links to, where each shop's first page is its home page."""
    p = catalogue(spark, sf_dir).where("ord < 7").withColumn("url", text("http://", "$site", "/"))
    return templates.nav_urls(p)


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "k", "c_name": "name"})


def review_cards(spark, sf_dir) -> DataFrame:
    """(site, ord, url, r): reviews in cards of customers' pages, two of three with a date and stars."""
    c = customers(spark, sf_dir)
    stars = F.repeat(F.lit('<span class="star"></span>'), (F.col("k") % 5).cast("int"))
    html = text("<main><div class=\"review-card\"><p>They delivered order number ", "$k", ' on time.</p>', stars, "<cite>– ", "$name", "</cite> ", F.when(F.col("k") % 3 > 0, "Mar 3, 2024 on Yelp").otherwise(""), "</div></main>")
    rows = c.select(text("s", F.col("k") % 4).alias("site"), F.col("k").alias("ord"), text("http://c/", "$k").alias("url"), html.alias("html"))
    return spread(rows).select("site", "ord", "url", F.explode(reviews(F.col("html"), F.col("url"))).alias("r"))


@query
def review_cards_read(spark, sf_dir):
    return review_cards(spark, sf_dir).select("ord", "r.quote", "r.name", "r.date", "r.platform", "r.stars")


@query
def review_lines(spark, sf_dir):
    r = review_cards(spark, sf_dir).select("site", "ord", F.lit(0).alias("pos"), "r.quote", "r.name", "r.date", "r.platform", "r.stars", "r.url")
    return files.reviews_lines(facts.first_reviews(r.unionByName(r.withColumn("pos", F.lit(1))))).select("ord", "line")


@query
def stated_review_rows(spark, sf_dir):
    """Reviews and ratings of JSON-LD, each rating of a site once."""
    c = customers(spark, sf_dir)
    item = text('{"@type":"Store","review":[{"@type":"Review","reviewBody":"Order ', "$k", ' was fine","author":{"name":"', "$name", '"},"reviewRating":{"ratingValue":', F.col("k") % 5 + 1, '}}],"aggregateRating":{"ratingValue":4,"reviewCount":', F.col("k") % 9, "}}")
    both = c.select(F.col("k").alias("ord"), text("s", F.col("k") % 4).alias("site"), stated_reviews(F.array(item), text("http://c/", "$k")).alias("s"))
    said = both.select("site", "ord", F.explode("s.reviews").alias("r")).select("site", F.lit("review").alias("kind"), "r.quote", "r.name", "r.stars")
    rated = facts.first_ratings(both.select("site", "ord", F.posexplode("s.ratings").alias("pos", "r")).select("site", "ord", "pos", "r.value", "r.count"))
    return said.unionByName(rated.select("site", F.lit("rating").alias("kind"), F.col("value").alias("quote"), F.col("count").alias("name"), _none("string").alias("stars")))


@query
def facts_beside_reviews(spark, sf_dir):
    """Phones in blocks of contact pages, without blocks that hold a review's quote."""
    c = customers(spark, sf_dir).select(text("s", F.col("k") % 4).alias("site"), text("http://s/contact/", "$k").alias("url"), F.col("k").alias("ord"), text("Call 555-", F.lpad((F.col("k") % 900 + 100).cast("string"), 3, "0"), "-", F.lpad((F.col("k") % 10000).cast("string"), 4, "0"), " now").alias("said"))
    blocks = c.select("site", "url", F.lit(0).alias("pos"), F.lit("p").alias("tag"), F.col("said").alias("text"), F.lit(False).alias("chrome"))
    quotes = c.where("ord % 2 = 0").select("url", F.col("said").alias("quote"))
    m = facts.merge(facts.from_blocks(blocks, c.select("site", "url", "ord", F.lit("/contact").alias("template")), quotes))
    return m.where("kind = 'phone'").select("site", "key", long(F.size("sources")).alias("sources"))


# sitemaps, feeds, imports


def listed_pages(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", U.site(F.col("url")).alias("site"), U.normalize(F.col("url")).alias("url"))
    return p.where("url is not null and not lower(url) rlike '\\\\.xml'").withColumn("day", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd"))


def sitemap_files(spark, sf_dir) -> DataFrame:
    """An index and two sitemaps for each site: (site, sitemap_url, xml)."""
    p = listed_pages(spark, sf_dir).select("site", "page_id", (F.col("page_id") % 2).alias("half"), text("<url><loc> ", F.replace("url", F.lit("&"), F.lit("&amp;")), "</loc><lastmod>", "$day", "</lastmod></url>").alias("x"))
    maps = p.groupBy("site", "half").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "x"))), lambda e: e["x"]), "").alias("xml"))
    maps = maps.select("site", text("http://", "$site", "/sitemap-", "$half", ".xml").alias("sitemap_url"), text("<urlset>", "$xml", "</urlset>").alias("xml"))
    index = p.select("site").distinct().select("site", text("http://", "$site", "/sitemap.xml").alias("sitemap_url"), text("<sitemapindex><sitemap><loc>http://", "$site", "/sitemap-0.xml</loc></sitemap><sitemap><loc>http://", "$site", "/sitemap-1.xml</loc></sitemap></sitemapindex>").alias("xml"))
    return maps.unionByName(index)


@query
def sitemap_entries(spark, sf_dir):
    f = sitemap_files(spark, sf_dir).select("sitemap_url", F.explode(sitemaps.entries(F.col("xml"))).alias("e"))
    return f.groupBy("sitemap_url").agg(F.count("*").alias("n"), F.min("e.loc").alias("first"), F.max("e.lastmod").alias("last"))


@query
def sitemap_pages(spark, sf_dir):
    """Pages that sites' sitemaps list, the index followed."""
    f = sitemap_files(spark, sf_dir)
    starts = f.where("endswith(sitemap_url, '/sitemap.xml')").select("site", "sitemap_url")
    return sitemaps.expand(f.select("sitemap_url", "xml"), starts).select("site", "url", "lastmod", "sitemap")


@query
def sitemap_origins(spark, sf_dir):
    """Counts of a sitemap's pages at another origin, each once, and of its entries in audit form."""
    f = sitemap_files(spark, sf_dir).where("sitemap_url like '%-0.xml'")
    moved = f.select("site", long(F.size(sitemaps.on_origin(F.col("xml"), F.lit("http://localhost:3000")))).alias("moved"))
    own = sitemaps.audit_entries(f.select("site", F.col("site").alias("netloc"), F.col("sitemap_url").alias("start_url"), "xml")).groupBy("site").agg(F.count_distinct("url").alias("own"))
    return moved.join(own, "site", "left").fillna(0)


@query
def robots_allowed(spark, sf_dir):
    """Pages under a path that robots.txt closes for one agent, and another one for all."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 > 0, F.lit("User-agent: weft\nDisallow: /fr/\n\nUser-agent: *\nDisallow: /\n\nSitemap: http://x/s.xml\n")).alias("robots"))
    return spread(p).select("page_id", sitemaps.can_fetch(F.col("robots"), F.lit("weft"), F.col("url")).alias("weft"), sitemaps.can_fetch(F.col("robots"), F.lit("other"), F.col("url")).alias("other"), F.array_join(sitemaps.robots_sitemaps(F.coalesce("robots", F.lit(""))), " ").alias("maps"))


@query
def feed_items(spark, sf_dir):
    """An RSS document for each order, with its date in the form of mail."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0")
    xml = text("<rss><channel><item><title>Order ", "$o_orderkey", "</title><link>/o/", "$o_orderkey", "</link><pubDate>", F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), " GMT</pubDate><category>", "$o_orderpriority", "</category><description>&lt;p&gt;", "$o_orderstatus", "&lt;/p&gt;</description></item></channel></rss>")
    f = feeds.items(spread(o.select(F.lit("http://x.example/feed").alias("feed_url"), F.col("o_orderkey").alias("ord"), xml.alias("xml"))))
    return f.select("url", "title", "date", "html", F.array_join("categories", ",").alias("categories"), "source")


@query
def feed_places(spark, sf_dir):
    """Feeds of each site: one that its home page names on the site, one elsewhere, and the usual places."""
    h = listed_pages(spark, sf_dir).select("site").distinct().select("site", text("http://", "$site", "/").alias("url"), F.lit('<link rel="alternate" type="application/rss+xml" href="/own.xml"><link type="application/atom+xml" href="http://else.example/feed">').alias("html"))
    return feeds.discovered(h).select("site", "feed_url")


@query
def wordpress_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    posts = o.select(
        F.col("o_orderkey").alias("ord"), text("http://wp.example/", "$o_orderkey", "/").alias("link"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.col("o_custkey").alias("author"),
        F.array(F.col("o_custkey") % 25, F.lit(99).cast("bigint")).alias("categories"), F.struct(text("<b>A &amp; B</b> ", "$o_orderkey").alias("rendered")).alias("title"), F.struct(text("<p>", "$o_orderstatus", "</p>").alias("rendered")).alias("content"),
    )
    users = customers(spark, sf_dir).select(F.col("k").alias("id"), "name")
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    w = imports.from_wordpress(posts, users, named)
    return w.select("ord", "url", "title", "date", "author", F.array_join("categories", ",").alias("categories"), "html")


@query
def shopify_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    variant = lambda price: F.struct(price.cast("string").alias("price"))
    products = p.select(
        F.col("p_partkey").alias("ord"), text("item-", "$p_partkey").alias("handle"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.lit("").alias("product_type"), text("$p_type", ", new, ").alias("tags"), F.lit("2024-02-03T00:00:00Z").alias("published_at"),
        text("<p>", "$p_name", "</p>").alias("body_html"), F.array(variant(F.col("p_size").cast("double")), variant((F.col("p_size") + F.col("p_partkey") % 2).cast("double")), F.struct(F.lit("").alias("price"))).alias("variants"), F.array(F.struct(text("/i/", "$p_partkey", ".jpg").alias("src"), F.lit("").alias("alt"))).alias("images"),
    )
    i = imports.from_shopify(products, "http://shop.example/")
    return i.select("ord", "url", "title", "date", "html", "front.vendor", F.array_join("front.tags", ",").alias("tags"), "front.price", F.col("front.product_type").isNull().alias("no_type"))


def import_items(spark, sf_dir) -> DataFrame:
    """Items of three sources for each order: two of them share a URL."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0")
    item = lambda source, path: o.select(F.col("o_orderkey").alias("ord"), text("http://i.example/", path, "/", "$o_orderkey").alias("url"), text(source, " ", "$o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.lit(source).alias("source"))
    return imports.merged(item("rss", "a").unionByName(item("wp-rest", "a")).unionByName(item("shopify", "b")))


@query
def import_precedence(spark, sf_dir):
    return import_items(spark, sf_dir).select("url", "title", "source")


@query
def import_choice(spark, sf_dir):
    """Items since a day, the inventory's date where the item has none."""
    items = import_items(spark, sf_dir)
    known = items.select("url", F.lit("/a/*").alias("template"), F.when(F.col("ord") % 2 == 0, "1997-06-01").alias("lastmod"), "ord")
    return imports.choose(known, items, since="1997-01-01").select("url", "date")


@query
def item_pages(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", imports.item_html(text("$p_name", " <&> 'x'"), text("<p>", "$p_type", "</p>")).alias("html"))


# places, listings, identifiers


def place_rows(spark, sf_dir) -> DataFrame:
    c = customers(spark, sf_dir)
    hour = F.col("k") % 3 + 8
    period = lambda day: text('{"open":{"day":', day, ',"hour":', hour, ',"minute":30},"close":{"day":', day, ',"hour":17,"minute":5}}')
    details = text(
        '{"id":"', "$k", '","displayName":{"text":"', "$name", '"},"formattedAddress":"', "$k", ' Main St","addressComponents":[{"longText":"', "$k", '","shortText":"', "$k", '","types":["street_number"]},{"longText":"Main Street","shortText":"Main St","types":["route"]},',
        '{"longText":"Nevada","shortText":"NV","types":["administrative_area_level_1","political"]},{"longText":"Reno","types":["locality"]}],"internationalPhoneNumber":"+1 555 ', F.lpad((F.col("k") % 10000).cast("string"), 4, "0"),
        '","regularOpeningHours":{"periods":[', period("1"), ",", period("2"), ",", period("4"), ']},"primaryType":"', F.when(F.col("k") % 2 == 0, "thai_restaurant").otherwise("florist"), '","types":["store"],"rating":4.5,"userRatingCount":', "$k",
        ',"businessStatus":"OPERATIONAL","reviews":[{"text":{"text":" Good ', "$k", ' "},"authorAttribution":{"displayName":"Ann"},"publishTime":"2024-05-06T00:00:00Z","rating":5},{"text":{"text":" "}}]}',
    )
    return places.summarize(c.select(details.alias("details")))


@query
def place_facts(spark, sf_dir):
    p = place_rows(spark, sf_dir)
    return p.select("place_id", "name", "telephone", "address.street", "address.locality", "address.region", F.array_join("opening_hours", "; ").alias("hours"), "schema_type", "status", "rating", long("review_count").alias("review_count"), F.array_join(F.transform("reviews", lambda r: F.concat(r["quote"], F.lit("/"), r["name"], F.lit("/"), r["date"])), ";").alias("reviews"))


@query
def place_lines(spark, sf_dir):
    return files.place_lines(place_rows(spark, sf_dir)).select("place_id", long("ord").alias("ord"), "line")


@query
def hours_runs(spark, sf_dir):
    """Listing hours of suppliers: equal ones on three days, others on a fourth, a line that says nothing."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4 + 7).alias("from"), (F.col("s_suppkey") % 3 + 4).alias("till"))
    plain = lambda day: text(day, ": ", "$from", ":30am - ", "$till", "pm")
    return s.select("id", F.array_join(B.schema_hours(F.array(plain("Mon"), plain("Tuesday"), plain("Wed."), F.lit("Thu closed"), text("Sat ", "$from", " a.m. to 12 pm"))), "; ").alias("hours"))


@query
def address_parts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, text("$s_suppkey", " Oak St, Springfield, IL ", F.lpad("s_suppkey", 5, "0"))).when(F.col("s_suppkey") % 3 == 1, text("$s_suppkey", " Main Rd, Suite 4, Reno, NV 89501-1234, USA")).otherwise(text("Hauptstr. ", "$s_suppkey", ", Berlin")).alias("line"))
    return s.select("id", B.us_line(F.col("line")).alias("a")).select("id", "a.*")


@query
def time_zone(spark, sf_dir):
    c = customers(spark, sf_dir).select("k", F.when(F.col("k") % 4 == 0, "CA").when(F.col("k") % 4 == 1, "FL").when(F.col("k") % 4 == 2, "NY").alias("region"), F.when(F.col("k") % 3 == 0, "US").when(F.col("k") % 3 == 1, " france ").otherwise("").alias("country"))
    return c.select("k", B.time_zone(F.col("region"), F.col("country")).alias("zone"))


@query
def profiles_dedupe(spark, sf_dir):
    c = customers(spark, sf_dir).select("k", F.array(text("http://www.facebook.com/", "$name", "/"), text("https://facebook.com/", F.lower("name")), F.lit("https://x.com/a")).alias("urls"))
    return c.select("k", F.array_join(B.profiles(F.col("urls")), " ").alias("profiles"))


@query
def name_from_title(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text("Home | ", "$p_name", " - ", "$p_type", " – Shop").alias("title"), F.when(F.col("p_partkey") % 2 == 0, text("www.", F.lower("p_type"), "store.example")).otherwise("x.com").alias("host"))
    return p.select("p_partkey", B.name_from_title(F.col("title"), F.col("host")).alias("name"))


@query
def tracking_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text("gtag('config','G-", F.lpad("p_partkey", 8, "A"), "'); GTM-", F.lpad("p_partkey", 6, "B"), " again GTM-", F.lpad("p_partkey", 6, "B"), " <meta name=\"google-site-verification\" content=\"v", "$p_partkey", "\">").alias("html"))
    return p.select("p_partkey", F.posexplode(K.tracking_ids(F.col("html"))).alias("pos", "t")).select("p_partkey", long("pos").alias("pos"), "t.kind", "t.value")


@query
def embeds(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(text("https://www.youtube.com/embed/", "$p_partkey"), F.lit("https://x.example/frame")).alias("iframes"), F.array(F.lit("https://js.stripe.com/v3"), text("https://www.youtube.com/embed/", "$p_partkey")).alias("scripts"))
    return p.select("p_partkey", F.posexplode(K.embeds(F.col("iframes"), F.col("scripts"))).alias("pos", "e")).select("p_partkey", long("pos").alias("pos"), "e.*")


@query
def jsonld_types(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, text('{"@type":"', "$p_type", '","name":"A",}')).when(F.col("p_partkey") % 3 == 1, text('[{"@type":["Store","', "$p_type", '"]},{"@graph":[{"@type":"Review"},{"@type":"Store"}]}]')).otherwise("{not json}").alias("raw"))
    return p.select("p_partkey", F.array_join(K.jsonld_types(K.jsonld_items(F.col("raw"))), ",").alias("types"))


@query
def image_variant(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, text("https://x.com/wp/photo", "$p_partkey", "-1024x683.jpg")).otherwise(text("https://x.com/wp/photo", "$p_partkey", ".jpg")).alias("src"))
    return p.select("p_partkey", M.variant(F.col("src"))["original"].alias("original"))


@query
def picture_files(spark, sf_dir):
    """Names of files for pictures, by type of the answer and by the URL's ending."""
    p = table(spark, sf_dir, "part").select("p_partkey", text("https://x.com/a/", F.upper("p_type"), "%20", "$p_partkey", ".PNG").alias("src"), F.when(F.col("p_partkey") % 2 == 0, "image/jpeg; q=1").alias("kind"))
    ext = M.extension(F.col("kind"), F.col("src"))
    return p.select("p_partkey", ext.alias("ext"), M.file_name(F.col("src"), F.col("src"), ext).alias("file"))


@query
def rewritten_pictures(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text("a ![", "$p_name", "](/i/", "$p_partkey", '.png "t") b ![c](/other.png) [l](/i/', "$p_partkey", ".png)").alias("md"), F.create_map(text("/i/", "$p_partkey", ".png"), text("../images/", "$p_partkey", ".png")).alias("files"))
    return p.select("p_partkey", X.rewrite_images(F.col("md"), F.col("files")).alias("md"))


@query
def edge_groups(spark, sf_dir):
    band = lambda x, name: F.struct(x.cast("int").alias("x"), F.lit(name).alias("band"))
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", R.edge_groups(F.array(band(k % 5, "a"), band(k % 5 + k % 4, "b"), band(F.lit(40), "c"))).alias("g"))
    return p.select("p_partkey", F.array_join(F.transform("g", lambda g: F.concat(g["x"].cast("string"), F.lit(":"), F.array_join(g["bands"], "+"))), " ").alias("groups"))


# hosts, answers, own pages


@query
def public_hosts(spark, sf_dir):
    k = F.col("c_custkey")
    first = F.when(k % 5 == 0, 10).when(k % 5 == 1, 172).when(k % 5 == 2, 192).when(k % 5 == 3, 8).otherwise(169)
    c = table(spark, sf_dir, "customer").select("c_custkey", text("http://", first, ".", k % 256, ".", k % 7, ".9/p").alias("url"))
    return c.select("c_custkey", U.public_http(F.col("url")).alias("public"))


@query
def page_problems(spark, sf_dir):
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.when(k % 7 == 0, None).when(k % 5 == 0, 404).otherwise(200).alias("status"), F.when(k % 2 == 0, text("/a/", "$page_id")).when(k % 3 == 0, "ftp://x").otherwise(F.col("url")).alias("page"))
    return p.select("page_id", H.why_not(F.col("url"), F.col("status")).alias("why"), H.page_url(F.col("page")).alias("shown"), H.name_for(F.col("url")).alias("name"))


@query
def files_that_fit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "image/PNG; x").when(F.col("o_orderkey") % 3 == 1, "text/html").alias("kind"), F.col("o_totalprice").cast("bigint").alias("length"))
    return o.select("o_orderkey", H.fits(F.col("kind"), F.when(F.col("o_orderkey") % 7 > 0, F.col("length")), ("image/",), 100_000).alias("fits"))


@query
def own_pages(spark, sf_dir):
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", F.when(k % 4 == 0, "http://a.example/").when(k % 4 == 1, "http://a.example/our/Contact-us").when(k % 4 == 2, "http://a.example/team/x").otherwise("http://a.example/blog").alias("url"), F.when(k % 3 == 0, "/team/*").otherwise("/x").alias("template"))
    return p.select("page_id", X.own_page(F.col("url"), F.col("template")).alias("own"))


# state, registries, reports


@query
def registry_upsert(spark, sf_dir):
    """Customers as a registry, newer entries for two thirds of them and some new ones."""
    c = customers(spark, sf_dir)
    key = lambda n: text("k", F.col("k") + n)
    old = c.select(key(0).alias("key"), F.lit("2024-01-01").alias("updated"), F.create_map(F.lit("name"), F.col("name"), F.lit("old"), F.lit("yes")).alias("attrs"))
    new = c.where("k % 3 > 0").select(key(100).alias("key"), F.lit("2024-02-02").alias("updated"), F.create_map(F.lit("name"), text("new ", "$name")).alias("attrs"))
    u = changes.upsert(old, new, {"profile": "pages"})
    return u.select("key", "updated", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attrs"))


@query
def state_without(spark, sf_dir):
    """Pages kept by an earlier run, less those that are read again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "doc_id")
    return state.without(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0")).select("url")


@query
def known_before(spark, sf_dir):
    """Rows an earlier run does not know, and what it knows filled into those it does."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")).alias("lang"))
    old = table(spark, sf_dir, "documents").where("doc_id % 5 > 0").select("doc_id", F.lit("old").alias("lang"))
    fresh = changes.not_yet_known(d, old, ["doc_id"]).select("doc_id", F.lit(True).alias("fresh"))
    return changes.filled(d, old, "doc_id", ["lang"]).join(fresh, "doc_id", "left").fillna(False, ["fresh"])


@query
def page_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 > 0, text("p-", "$doc_id")).alias("file"), text("http://h/", "$doc_id").alias("url"), F.col("source").alias("title"), F.lit("").alias("meta_description"), F.lit("/*").alias("template"), F.col("n_chars").alias("word_count"), (F.col("doc_id") % 2 == 0).alias("noindex"), F.lit("Body\n").alias("markdown"))
    return files.page_files(d)


@query
def common_lines(spark, sf_dir):
    """Lines of a source's documents that repeat, as first seen."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    again = content.repeated_lines(d, 0.05)
    blocks = d.select("site", F.col("page").alias("ord"), "pos", F.col("line").alias("text"), F.lit("p").alias("tag"))
    return files.common_lines(blocks, again).select("site", F.col("at.ord").alias("doc_id"), long("at.pos").alias("pos"), "text")


def records(spark, sf_dir) -> DataFrame:
    """Inventory records made of pages' URLs."""
    u = known_urls(spark, sf_dir).groupBy("site", "url").agg(F.min("ord").alias("ord"))
    k = F.col("ord")
    read = k % 3 > 0
    return u.select(
        "site", "url", "ord", F.lit("/x/*").alias("template"), F.when(read, F.lit(200)).alias("status"), text("T|", "$ord").alias("title"), F.lit("").alias("h1"), (k % 90).alias("word_count"), (k % 4).alias("body_links"), F.lit(1).cast("bigint").alias("sitewide_links"), (k % 2 == 0).alias("in_sitemap"),
        (k % 5 == 0).alias("noindex"), (k % 3).alias("forms"), F.array(F.lit("video"), F.lit("map"), F.lit("video")).alias("embed_kinds"), F.when(read, text("pages/", "$ord", ".md")).alias("file"), F.when(~read, F.lit("unread")).alias("reason"), F.lit("f").alias("fingerprint"), F.lit(False).alias("thin"),
    )


@query
def inventory_lines(spark, sf_dir):
    return inventory.markdown_rows(records(spark, sf_dir)).select("site", long("ord").alias("ord"), "line")


@query
def record_reasons(spark, sf_dir):
    return inventory.reason_counts(records(spark, sf_dir))


@query
def template_lines(spark, sf_dir):
    return files.template_lines(templates.report(records(spark, sf_dir)))


@query
def launch_eligible(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("reason", F.when(F.col("ord") % 7 == 0, "robots").when(F.col("ord") % 3 == 0, "http_404")).withColumn("status", F.when(F.col("ord") % 6 == 0, 200).otherwise(404))
    return launch.eligible(r).select("url")


def launch_table(spark, sf_dir) -> DataFrame:
    r = records(spark, sf_dir).withColumn("new_url", U.map_to(F.col("url"), F.lit("https://n.example")))
    k = F.col("ord")
    answers = r.where("ord % 4 > 0").groupBy("new_url").agg(F.min("ord").alias("ord"))
    answers = answers.select(F.col("new_url").alias("url"), F.when(k % 5 == 0, 404).otherwise(200).alias("status"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("hops"), F.col("new_url").alias("final_url"), F.lit("A|B").alias("title"), (k % 2).cast("int").alias("h1_count"), F.lit("").alias("meta_description"), (k % 7 == 0).alias("noindex"), _none("string").alias("error"))
    return launch.check(r, answers, F.lit("https://n.example"))


@query
def launch_lines(spark, sf_dir):
    return files.launch_lines(launch_table(spark, sf_dir)).select("line")


@query
def launch_counts(spark, sf_dir):
    return launch.counts(launch_table(spark, sf_dir))


def page_issues(spark, sf_dir) -> DataFrame:
    """Targets of pages: each page links to one broken page of its site and one broken page elsewhere."""
    r = records(spark, sf_dir).select("site", F.col("url").alias("url_from"), F.col("site").alias("netloc"), "ord")
    t = r.select("site", "netloc", "url_from", text("http://", "$site", "/gone/", F.col("ord") % 3).alias("target")).unionByName(r.select("site", "netloc", "url_from", text("https://out.example/", F.col("ord") % 9).alias("target")))
    status = t.select(F.col("target").alias("url")).distinct().select("url", F.lit(404).alias("status"), F.col("url").alias("final_url"), F.array().cast("array<string>").alias("hops"), F.lit("text/html").alias("content_type"), _none("bigint").alias("content_length"))
    return audit.target_answers(t, r.select("site", F.col("url_from").alias("url")), status, most_external=4)


@query
def broken_targets(spark, sf_dir):
    return page_issues(spark, sf_dir).select("site", "kind", "subject")


@query
def issue_counts(spark, sf_dir):
    return audit.counts(page_issues(spark, sf_dir))


@query
def old_urls(spark, sf_dir):
    r = records(spark, sf_dir)
    status = r.where("ord % 2 = 0").select(U.map_to(F.col("url"), F.lit("https://n.example")).alias("url")).distinct().select("url", F.lit(200).alias("status"), F.array().cast("array<string>").alias("hops"), F.lit(False).alias("noindex"))
    return files.issue_lines(audit.old_urls(r, status, F.lit("https://n.example"))).select("site", "subject", "line")
