import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.text import minhash_of
from weftline.operators import audit, business, changes, content, dedupe, facts, furniture, imports, launch, links, measure, media, places, styles, templates
from weftline.parse.stage import parse

PAGES = [
    (0, "http://oak.com/", '<html lang=en><head><title>Oak</title></head><header><a href="/"><img src="/logo.png" alt="Oak"></a><nav><a href="/contact">Contact</a><a href="/work">Work</a></nav></header><main><h1>Oak</h1><p>Hello <a href="/work?utm_source=x">work</a></p></main><footer><h4>More</h4><a href="/map">Map</a><a href="https://facebook.com/oak">fb</a><a href="/privacy">Privacy</a><p>© Oak</p></footer>'),
    (1, "http://www.oak.com/contact", '<header><a href="/">Home</a></header><main><h1>Contact</h1><p>Call (555) 123-4567, write to a@oak.com</p><a href="tel:555-123-4567">call</a><a href="https://calendly.com/oak">Book</a></main><footer><p>12 Oak Street, Springfield, IL 62701</p></footer>'),
    (2, "http://oak.com/work", '<header><a href="/">Home</a></header><main><h1>Work</h1><p>Text (555) 999-0000</p></main>'),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([("oak.com", *p) for p in PAGES], "site string, ord bigint, url string, html string")
    return parse(rows).cache()


def test_edges_and_degrees(parsed):
    e = links.edges(parsed)
    known = parsed.select(F.regexp_replace("url", "www.", "").alias("url"))
    got = {r.url: (r.sitewide_links, r.body_links) for r in links.inbound(e, known).collect()}
    assert got == {"http://oak.com/": (1, 0), "http://oak.com/work": (1, 1)} or got["http://oak.com/work"] == (1, 1)
    out = {r.url: r.outbound_internal for r in links.outbound(e).collect()}
    assert out["http://oak.com/"] == ["http://oak.com/contact", "http://oak.com/work", "http://oak.com/map", "http://oak.com/privacy"]


def test_templates(spark):
    urls = [f"http://x.com/blog/p{i}" for i in range(6)] + ["http://x.com/", "http://x.com/about", "http://x.com/2024/05/post", "http://x.com/page/3", "http://x.com/blog/page/2", "http://x.com/tag/t/page/2"]
    rows = [("x.com", u, None, False) for u in urls] + [("x.com", "http://x.com/a", "http://x.com/recipe-sitemap.xml", False), ("x.com", "http://x.com/blog/nav", None, True), ("y.com", "http://y.com/blog/p1", None, False)]
    got = {(r.site, r.url): r.template for r in templates.assign(spark.createDataFrame(rows, "site string, url string, sitemap string, in_nav boolean")).collect()}
    want = {"blog/p1": "/blog/*", "": "/", "about": "/about", "2024/05/post": "/{n}/{n}/*", "page/3": "/page/{n}", "tag/t/page/2": "/tag/t/page/{n}", "a": "recipe", "blog/nav": "/blog/nav"}
    for path, t in want.items():
        assert got["x.com", f"http://x.com/{path}"] == t, path
    assert got["y.com", "http://y.com/blog/p1"] == "/blog/p1"


def test_frontier_and_sampler(spark):
    found = [("x", "a", 5, 0), ("x", "b", 1, 1), ("x", "a", 0, 2), ("x", "c", 1, 3), ("x", "b", 4, 4)]
    order = [r.url for r in templates.frontier(spark.createDataFrame(found, "site string, url string, tier int, seq int")).orderBy("rank").collect()]
    assert order == ["a", "b", "c"]
    rows = [("x", f"http://x/s/{i}", i, "/s/*", False) for i in range(4)] + [("x", f"http://x/t/{i}", 10 + i, f"/t/{i}", i == 4) for i in range(5)] + [("x", f"http://x/blog/{i}", 20 + i, f"/blog/{i}", False) for i in range(3)]
    out = templates.admit(spark.createDataFrame(rows, "site string, url string, rank int, template string, in_nav boolean"), 2, 3).orderBy("rank").collect()
    assert [r.admitted for r in out] == [True, True, False, False, True, True, True, False, True, True, True, False]


def brute_greedy(texts):
    import hashlib
    import re

    kept, digests, out = [], set(), []
    for t in texts:
        d, s = hashlib.sha256(re.sub(r"\s+", " ", t).strip().encode()).hexdigest(), minhash_of(t)
        near = any(sum(x == y for x, y in zip(s, k)) >= 58 and any(s[i : i + 4] == k[i : i + 4] for i in range(0, 64, 4)) for k in kept)
        reason = "exact_duplicate" if d in digests else "near_duplicate" if near else None
        if reason is None:
            kept.append(s)
            digests.add(d)
        out.append(reason)
    return out


@pytest.mark.parametrize("parts, small", [(1, 64), (5, 64), (3, 1), (3, 4)])
def test_greedy_duplicates(spark, monkeypatch, parts, small):
    monkeypatch.setattr(dedupe, "SMALL_BAND", small)
    rng, texts = random.Random(4), []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(99)}" for _ in range(400)]
        for i in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(400)] = f"x{g}{i}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "site string, ord bigint, text string").repartition(parts)
    got = [r.reason for r in dedupe.greedy(df).orderBy("ord").collect()]
    assert got == brute_greedy(texts) and {"exact_duplicate", "near_duplicate", None} == set(got)
    pairs = dedupe.candidate_pairs(dedupe.signatures(df))
    assert pairs.count() > 0


def test_greedy_goes_on_from_an_earlier_run(spark):
    from weftline.functions import text as X

    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(60)) for _ in range(10)]
    texts += [texts[0], texts[3] + " more"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "site string, ord bigint, text string")
    old = df.where("ord < 10").select("site", "ord", X.content_digest(F.col("text")).alias("digest"), X.minhash(F.col("text")).alias("signature"))
    got = [r.reason for r in dedupe.greedy(df.where("ord >= 10"), kept_before=old).orderBy("ord").collect()]
    assert got == brute_greedy(texts)[10:]


def test_repeated_lines(spark):
    rows = [("s", p, line) for p in range(6) for line in ("Menu ", f"own {p}", "half" if p < 2 else f"x{p}", "menu")] + [("t", p, "same") for p in range(2)]
    got = [(r.site, r.line, r.n) for r in content.repeated_lines(spark.createDataFrame(rows, "site string, page int, line string")).collect()]
    assert got == [("s", "menu", 6)]


def test_facts(spark, parsed):
    pages = parsed.select("site", "url", "ord", F.regexp_replace("url", "http://(www.)?oak.com", "").alias("template"))
    both = facts.from_blocks(links.blocks(parsed), pages).unionByName(facts.from_links(links.links(parsed), pages))
    got = {(r.kind, r.value): len(r.sources) for r in facts.merge(both).collect()}
    assert got[("phone", "(555) 123-4567")] == 2 and ("phone", "(555) 999-0000") not in got
    assert got[("email", "a@oak.com")] == 1 and got[("address", "12 Oak Street, Springfield, IL 62701")] == 1 and ("social", "https://facebook.com/oak") in got
    assert ("action", "https://calendly.com/oak") in got and facts.several(facts.merge(both)).count() == 0
    quotes = spark.createDataFrame([("http://www.oak.com/contact", "Call (555) 123-4567")], "url string, quote string")
    assert ("email", "a@oak.com") not in {(r.kind, r.value) for r in facts.from_blocks(links.blocks(parsed), pages, quotes).collect()}


def test_furniture(parsed):
    pages = furniture.page_furniture(parsed).cache()
    r = pages.where("ord = 0").first()
    assert [n.label for n in r.nav] == ["Work"] or [n.label for n in r.nav] == ["Contact", "Work"]
    assert r.logo.src == "http://oak.com/logo.png" and [s.href for s in r.social] == ["https://facebook.com/oak"] and [x.label for x in r.legal] == ["Privacy"] and r.copyright == "© Oak"
    assert [(g.heading, [x.label for x in g.links]) for g in r.footer_groups] == [("More", ["Map"])]
    s = furniture.site_furniture(pages).first()
    assert s["from"] == "http://oak.com/" and len(s.pages_with_a_different_nav) >= 1 and s.pages == 3


def test_nav_tree(spark):
    x = spark.createDataFrame([([("a", "h", 0), ("b", "h", 1), ("c", "h", 2), ("d", "h", 1), ("e", "h", 0)],)], "l array<struct<text:string,href:string,depth:int>>")
    assert [n.parent_order for n in x.select(furniture.nav_tree(F.col("l")).alias("t")).first().t] == [None, 0, 1, 0, None]


def test_business(spark):
    items = [("s", "u0", 0, 0, '{"@type":"Dentist","name":"A","sameAs":["x","y"],"telephone":"1","address":{"streetAddress":"S","addressRegion":"NY","addressCountry":"US"}}'), ("s", "u1", 1, 0, '{"@type":["Organization"],"name":"B","email":"e","sameAs":"z"}'), ("s", "u1", 1, 1, '{"@type":"Article","name":"C"}')]
    m = business.merge(spark.createDataFrame(items, "site string, url string, ord bigint, pos int, item string"))
    r = m.first()
    assert r.fields["name"] == "A" and r.fields["email"] == "e" and r.fields["sameAs"] == '["x","y","z"]' and r.sources["sameAs"] == ["u0", "u1"] and r.types == ["Dentist", "Organization"]
    homes = spark.createDataFrame([("s", "Home | S Co", "d"), ("t.com", "Welcome", "")], "site string, title string, meta_description string")
    told = spark.createDataFrame([("s", "phone", "555", 1), ("s", "hours", "Mon 9am-5pm", 1)], "site string, kind string, value string, rank int")
    c = {r.site: r for r in business.card(homes, m, told).collect()}
    assert (c["s"].name, c["s"].telephone, c["s"].sources["telephone"], c["s"].address.street, c["s"].time_zone, c["s"].opening_hours, c["s"].description) == ("A", "555", "facts", "S", "America/New_York", ["Mo 09:00-17:00"], "d")
    assert (c["t.com"].name, c["t.com"].sources) == ("t.com", {"name": "host"})


def seen_rows(spark, rows):
    ddl = "site string, url string, ord bigint, step int, pos int, src string, alt string, srcset array<struct<url:string,w:int>>, chrome boolean, background boolean, og boolean, width int, height int, shown int, row int, video boolean, autoplay boolean, heading string, beside string"
    return spark.createDataFrame([("oak.com", f"u{i % 40}", i, 0, 0, src, alt, None, chrome, False, og, w, h, None, None, None, None, None, "") for i, (src, alt, chrome, og, w, h) in enumerate(rows)], ddl)


def test_media(spark):
    rows = [("http://oak.com/oak-logo.png", "", True, False, 100, 40), ("http://x/partner-logo.png", "", False, False, 90, 40)]
    rows += [(f"http://oak.com/photo{i}.jpg", "a", False, False, 100 + i, 100) for i in range(80)] + [("http://oak.com/photo1-300x200.jpg", "b", True, False, None, None)]
    items = media.classify(media.rollup(seen_rows(spark, rows))).cache()
    one = items.where("key = 'oak.com/photo1.jpg'").first()
    assert len(one.seen) == 2 and one.alts == ["a", "b"] and not one.chrome and one.width == 101
    assert items.count() == 82 and {r.kind: r.n for r in items.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"logo": 1, "mark": 1, "photo": 80}
    assert media.select(items, "brand").count() == 62 and media.select(items, "content").count() == 82 and media.select(items, "none").count() == 0
    gallery = [("http://oak.com/p.jpg", "a", False, False, 300, 300)]
    assert media.select(media.classify(media.rollup(seen_rows(spark, gallery))), "brand").count() == 1
    f = spark.createDataFrame([("s", 1, "a", b"x"), ("s", 2, "b", b"x"), ("s", 3, "c", b"y")], "site string, ord int, url string, data binary")
    assert [r.kept for r in media.same_bytes(f).orderBy("ord").collect()] == [True, False, True]


def test_context(spark):
    blocks = [("s", "u", i, t, x) for i, (t, x) in enumerate([("h2", "[A](l) title"), ("img", ""), ("img", ""), ("p", "words"), ("img", "")])]
    got = content.with_context(spark.createDataFrame(blocks, "site string, url string, pos int, tag string, text string")).orderBy("pos").collect()
    assert [(r.heading, r.beside) for r in got] == [("A title", "words"), ("A title", "words"), ("A title", "")]


def test_styles(spark):
    from weftline.sources.contracts import STYLE_READING

    role = ("Inter, x", "1", "2", "3", "4", "rgb(0,0,0)", None)
    rows = [("s", 0, "p", ["'Oak Sans', serif", "Inter"], [("rgb(1,2,3)", 2), ("#fff", 5)], {"h1": role}, [("Go", "#000", None, "r", "Inter", "w", "p")], []), ("s", 1, "q", ["Inter"], [("#010203", 4)], {}, [("Go", "#000000", None, "r", "Inter", "w", "p")], [])]
    df = spark.createDataFrame(rows, "site string, ord int, " + STYLE_READING)
    assert [(r.font, r.n) for r in styles.fonts(df).orderBy("rank").collect()] == [("Inter", 2), ("Oak Sans", 1)]
    assert [(r.color, r.n) for r in styles.colors(df).orderBy("rank").collect()] == [("#010203", 6), ("#ffffff", 5)]
    assert styles.roles(df).first().font == "Inter" and styles.buttons(df).count() == 1 and styles.logos(df).count() == 0


def test_audit(spark, parsed):
    html = spark.createDataFrame([(i, h) for i, _, h in PAGES], "ord bigint, html string")
    pages = parsed.drop("html").join(html, "ord").withColumns({"netloc": F.lit("oak.com"), "body_len": F.length("html").cast("bigint")})
    status = [("oak.com", "http://oak.com/", 200, "http://oak.com/", []), ("oak.com", "http://www.oak.com/contact", 404, None, []), ("oak.com", "http://oak.com/work", 200, "http://oak.com/w2", ["http://oak.com/work"]), ("oak.com", "http://oak.com/map", 500, None, []), ("oak.com", "http://oak.com/logo.png", 200, None, []), ("oak.com", "https://facebook.com/oak", None, None, [])]
    ddl = "site string, url string, status int, final_url string, hops array<string>, content_type string, content_length bigint"
    s = spark.createDataFrame([(*r, "image/png", 2_000_000) for r in status], ddl)
    listed = spark.createDataFrame([("oak.com", "http://oak.com/"), ("oak.com", "http://www.oak.com/contact")], "site string, url string")
    answered = spark.createDataFrame([("oak.com", "http://oak.com/sitemap.xml", 200)], "site string, sitemap_url string, status int")
    got = {(r.kind, r.subject): r.detail for r in audit.audit(pages, s, listed, answered).collect() if r.kind != "page"}
    assert got[("broken page", "http://www.oak.com/contact")].startswith("HTTP 404") and ("internal link redirects", "http://oak.com/work") in got
    assert ("heavy image", "http://oak.com/logo.png") in got and ("broken internal link", "http://oak.com/map") in got and ("broken external link", "https://facebook.com/oak") in got
    assert got[("sitemap", "http://www.oak.com/contact")] == "listed in the sitemap but answers HTTP 404" and got[("sitemap", "http://oak.com/w2")] == "crawled but not in the sitemap"
    found = {r.url: r.findings for r in audit.page_findings(pages).collect()}
    assert found["http://oak.com/"][:1] == ["no meta description"] and "no title" in found["http://oak.com/work"]
    steps = {r.url: r.steps for r in audit.reachable(links.edges(parsed), spark.createDataFrame([("oak.com", "http://oak.com/")], "site string, url string")).collect()}
    assert steps["http://oak.com/"] == 0 and steps["http://oak.com/map"] == 1


def test_launch(spark):
    inv = spark.createDataFrame([(f"http://o.com/{i}", "t", None, 200, "f") for i in range(5)] + [("http://o.com/x", "t", "unread", None, None)], "url string, title string, reason string, status int, file string")
    ddl = "url string, status int, hops array<string>, final_url string, title string, h1_count int, meta_description string, noindex boolean, error string"
    new = [("https://n.com/0", 200, [], "u", "T", 1, "d", False, None), ("https://n.com/1", 200, ["a", "b"], "u", "T", 1, "d", False, None), ("https://n.com/2", 404, [], "u", "", 0, "", False, None), ("https://n.com/3", 200, ["a"], "u", "", 2, "", False, None)]
    rows = launch.check(inv, spark.createDataFrame(new, ddl), F.lit("https://n.com"))
    got = {r.old_url[-1]: (r.verdict, r.findings) for r in rows.collect()}
    assert got == {"0": ("ok", []), "1": ("chain", []), "2": ("missing", []), "3": ("ok", ["no title", "2 h1", "no description"]), "4": ("error", [])}
    diff = launch.sitemap_differences(rows, spark.createDataFrame([("https://n.com/new/",), ("https://n.com/2",)], "url string"))
    assert {(r.path, r.side) for r in diff.collect()} == {("/0", "missing_from_sitemap"), ("/new", "new_in_sitemap")}
    assert launch.sitemap_differences(rows, spark.createDataFrame([], "url string")).count() == 0
    assert launch.counts(rows).first().asDict() == {"ok": 2, "missing": 1, "chain": 1, "noindex": 0, "error": 1}


def test_imports(spark):
    ddl = imports.ITEM + ", ord bigint"
    none = (None, None, None, None)
    item = lambda u, s, d, o: (u, "T", d, "", [], "<p>x</p>", s, none, o)
    items = imports.merged(spark.createDataFrame([item("http://x/a", "rss", "2024-01-02", 1), item("http://x/a/", "wp-rest", "2024-01-01", 2), item("http://x/b", "shopify", None, 3)], ddl))
    assert {r.url: r.source for r in items.collect()} == {"http://x/a": "wp-rest", "http://x/b": "shopify"}
    inv = spark.createDataFrame([("http://x/a", "/*", None, 1), ("http://x/b", "/*", "2024-05-01T00:00", 2), ("http://x/c", "/*", None, 3)], "url string, template string, lastmod string, ord bigint")
    assert [r.url for r in imports.choose(inv, items, "/*").collect()] == ["http://x/b", "http://x/a", "http://x/c"]
    assert [r.url for r in imports.choose(inv, items, "/*", since="2024-01-02").collect()] == ["http://x/b"]
    assert [r.url for r in imports.choose(inv, items, None, limit=1).collect()] == ["http://x/a"]
    posts = spark.createDataFrame([(0, "http://x/p/", "2024-02-03T10:00:00", 7, [1, 9], ("A &amp; <b>B</b>",), ("<p>c</p>",))], "ord bigint, link string, date string, author bigint, categories array<bigint>, title struct<rendered:string>, content struct<rendered:string>")
    names = lambda rows: spark.createDataFrame(rows, "id bigint, name string")
    r = imports.from_wordpress(posts, names([(7, "Ann")]), names([(1, "News")])).first()
    assert (r.url, r.title, r.date, r.author, r.categories) == ("http://x/p", "A & B", "2024-02-03", "Ann", ["News", "9"])
    product = spark.createDataFrame([(0, "lamp", "Lamp", "V", "", "a, b", "2024-01-01T0", "<p>", [("9.5",), ("20",)], [("s.jpg", None)])], "ord bigint, handle string, title string, vendor string, product_type string, tags string, published_at string, body_html string, variants array<struct<price:string>>, images array<struct<src:string,alt:string>>")
    p = imports.from_shopify(product, "https://s.com").first()
    assert (p.url, p.front.price, p.front.tags, p.html) == ("https://s.com/products/lamp", "9.5-20.0", ["a", "b"], '<p><img src="s.jpg" alt="Lamp">')


def test_measure(spark):
    from weftline.sources.contracts import LAYOUT_MEASURE

    rows = [("u", 390, None, (30, "div.x"), [], [(12.0, "p", "tiny"), (11.5, "p", "more")], [], 0), ("u", 900, None, (10, "div.x"), [(10, ["a", "b", "c", "d"]), (20, ["e"])], [], [(4, "left", "div", "t")], 1), ("u", 1280, "no answer", None, [], [], [], 2)]
    got = [r.line for r in measure.problems(spark.createDataFrame(rows, LAYOUT_MEASURE + ", ord int")).orderBy("at").collect()]
    assert got[0] == "390px, 900px: scrolls sideways by 30px, first past the edge: div.x"
    assert got[1] == '390px: text at 11.5px in <p> "tiny" (+1 more); 14px is the smallest a reader needs'
    assert got[2] == "900px: left edges differ: 10px a, b, c +1 more; 20px e; put every band's content on one left edge" and got[4] == "1280px: not measured: no answer"


def test_places(spark):
    import json

    t = lambda d, h: {"day": d, "hour": h, "minute": 0}
    d = {"id": "p", "displayName": {"text": "Oak"}, "addressComponents": [{"longText": "12", "types": ["street_number"]}, {"longText": "Oak St", "types": ["route"]}, {"longText": "Illinois", "shortText": "IL", "types": ["administrative_area_level_1"]}], "regularOpeningHours": {"periods": [{"open": t(i, 8), "close": t(i, 17)} for i in range(1, 6)]}, "primaryType": "thai_restaurant", "reviews": [{"text": {"text": " Good "}, "rating": 5, "publishTime": "2024-01-02T"}]}
    r = places.summarize(spark.createDataFrame([(json.dumps(d),)], "details string")).first()
    assert (r.name, r.address.street, r.address.region, r.opening_hours, r.schema_type, r.reviews[0].quote, r.reviews[0].date) == ("Oak", "12 Oak St", "IL", ["Mo-Fr 08:00-17:00"], "Restaurant", "Good", "2024-01-02")
    always = places.summarize(spark.createDataFrame([(json.dumps({"regularOpeningHours": {"periods": [{"open": t(0, 0)}]}}),)], "details string")).first()
    assert always.opening_hours == ["Mo-Su 00:00-23:59"]


def test_changes(spark):
    mk = lambda rows: spark.createDataFrame(rows, "url string, hash string")
    got = {r.url: r.change for r in changes.status(mk([("a", "1"), ("b", "2"), ("c", "3")]), mk([("a", "1"), ("b", "0"), ("d", "4")])).collect()}
    assert got == {"a": "same", "b": "changed", "c": "new", "d": "earlier"}
    reg = lambda rows: spark.createDataFrame(rows, "key string, updated string, attrs map<string,string>")
    out = {r.key: (r.updated, r.attrs) for r in changes.upsert(reg([("k", "1", {"docs": "true"}), ("o", "0", {})]), reg([("k", "2", {"n": "5"}), ("z", "3", {})]), {"docs": "false", "wp": "false"}).collect()}
    assert out == {"k": ("2", {"docs": "true", "wp": "false", "n": "5"}), "o": ("0", {}), "z": ("3", {"docs": "false", "wp": "false"})}


def test_reachable_over_a_long_chain(spark):
    edges = spark.createDataFrame([("a", f"u{i}", f"u{i + 1}") for i in range(23)], "site string, from_url string, to_url string")
    starts = spark.createDataFrame([("a", "u0")], "site string, url string")
    assert {r.url: r.steps for r in audit.reachable(edges, starts).collect()} == {f"u{i}": i for i in range(24)}


def _greedy(rows, threshold=0.9):
    """Kept pages of (ord, text) in reading order, by signatures."""
    from weftline.functions.text import minhash_of

    kept, out = [], {}
    for i, t in sorted(rows):
        sig = minhash_of(t)
        out[i] = not any(sum(x == y for x, y in zip(sig, k)) >= 64 * threshold for k in kept)
        if out[i]:
            kept.append(sig)
    return out


@pytest.mark.parametrize("one_key", [False, True])
def test_greedy_in_rounds(spark, monkeypatch, one_key):
    """Chains of near copies and unlike pages, also where all pages meet under one key in many cells: the rule of the reader in order, in few rounds."""
    import random

    from weftline.operators import dedupe

    rng, rows = random.Random(5), []
    base = [f"w{rng.randrange(700)}" for _ in range(200)]
    for i in range(160):
        w = list(base) if i % 2 else [f"u{rng.randrange(9999)}" for _ in range(60)]
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    if one_key:
        monkeypatch.setattr(dedupe, "keys", lambda signature, threshold: F.array(F.lit(7).cast("bigint")))
        monkeypatch.setattr(dedupe, "SMALL_BAND", 4)
        monkeypatch.setattr(dedupe, "CELL", 16)
    rounds, plain = [], dedupe._settle
    monkeypatch.setattr(dedupe, "_settle", lambda *a: rounds.append(1) or plain(*a))
    got = {r.ord: r.kept for r in dedupe.greedy(spark.createDataFrame([("s", i, t) for i, t in rows], "site string, ord bigint, text string")).collect()}
    assert got == _greedy(rows) and 10 < sum(got.values()) < 150
    assert len(rounds) <= 5


def test_keys_lose_no_match():
    """Any two signatures that match have a key in common."""
    from weftline.operators import dedupe

    need = dedupe.slots_needed(0.9)
    groups = 64 - need + 1
    cuts = [64 * i // groups for i in range(groups + 1)]
    assert need == 58 and groups == 7 and cuts[0] == 0 and cuts[-1] == 64 and all(a < b for a, b in zip(cuts, cuts[1:]))
