import pytest
from pyspark.sql import functions as F

from weftline.functions import business as B
from weftline.functions import markup as K
from weftline.functions import media as M
from weftline.functions import rules as R
from weftline.functions import text as X
from weftline.functions import url as U


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def pairs(spark, f, cases, kind="string"):
    got = apply(spark, f, [c[0] for c in cases], kind)
    for (value, want), x in zip(cases, got):
        assert x == want, (value, x, want)


def test_normalize(spark):
    cases = [
        ("HTTPS://User@WWW.Example.COM:8080/A/b//?utm_source=x&b=2&a=&ref=1#frag", "https://www.example.com/A/b?b=2&a="),
        ("http://example.com", "http://example.com/"),
        ("http://example.com/?refund=1&GCLID=2&q=a+b%7E*", "http://example.com/?q=a+b~%2A"),
        ("mailto:a@b.c", None),
        ("javascript:void(0)", None),
        ("http://my_host.com/a b", "http://my_host.com/a b"),
        ("http://h/%zz?a=%zz", "http://h/%zz?a=%25zz"),
    ]
    pairs(spark, U.normalize, cases)
    again = apply(spark, lambda c: U.normalize(U.normalize(c)), [c[0] for c in cases])
    assert again == [c[1] for c in cases]


def test_url_rules(spark):
    pairs(spark, lambda c: U.same_site(c, F.lit("www.Example.com")), [("http://example.com/x", True), ("http://WWW.example.com", True), ("http://blog.example.com", False)])
    pairs(spark, U.crawlable, [("http://x/a.PDF", False), ("http://x/a.html", True), ("http://x/a.pdf?x", False), ("http://x/pdf", True)])
    pairs(spark, U.is_document, [("http://x/a.Docx", True), ("http://x/a.zip", False)])
    pairs(spark, U.page_name, [("http://x/", "index"), ("http://x/a/b", "a--b"), ("http://x/blog-post", "blog-post")])
    assert all(len(x.rsplit("-", 1)[1]) == 8 for x in apply(spark, U.page_name, ["http://x/A", "http://x/a?b", "http://x/" + "y" * 90]))
    pairs(spark, U.public_http, [("http://localhost/", False), ("http://10.0.0.1/", False), ("http://8.8.8.8/", True), ("http://172.20.1.1", False), ("ftp://8.8.8.8", False), ("http://a.local", False), ("http://example.com", None)])
    pairs(spark, U.local_http, [("http://127.0.0.1:3000/", True), ("https://localhost", False)])
    pairs(spark, lambda c: U.map_to(c, F.lit("https://n.com:1")), [("http://o.com/a?b#c", "https://n.com:1/a?b"), ("http://o.com", "https://n.com:1/")])


def test_text(spark):
    pairs(spark, X.word_count, [("\u00e9t\u00e9 b\u00e7 e\u0301a", 4), ("", 0), ("a_b 1-2", 3)])
    pairs(spark, X.norm_line, [("  A  B\t", "a b")])
    pairs(spark, lambda c: F.size(X.shingles(c)), [("one two", 1), (" ".join(map(str, range(10))), 3), ("a " * 20, 1)])
    pairs(spark, X.phones, [("Call (555) 123-4567 or 555.123.4567 or +1 555 123 4567", ["(555) 123-4567"]), ("12-34", [])])
    pairs(spark, X.emails, [("a.b+c@d-e.co.uk, x@y.png.", ["a.b+c@d-e.co.uk"])])
    pairs(spark, X.addresses, [("at 12 Oak Street, Springfield, IL 62701 now", ["12 Oak Street, Springfield, IL 62701"])])
    pairs(spark, X.hours, [("Mon-Fri: 9am - 5pm, Sat closed", ["Mon-Fri: 9am - 5pm", "Sat closed"])])
    pairs(spark, lambda c: X.action_score(c, F.lit("Book a table")), [("https://www.opentable.com/x", 2), ("https://x.com/book", 0), ("https://a.com/b", 1), ("tel:1", 0), ("https://a.com/#", 0), (None, 0)])
    pairs(spark, lambda c: X.own_page(c, F.lit("/about-us")), [("http://x/", True), ("http://x/About-us", True), ("http://x/blog/a", False)])
    pairs(spark, X.is_bot_check, [("<title>Just a moment...</title>", True), ("<title>Just a moment of joy</title>", False)])
    pairs(spark, lambda c: X.rewrite_images(c, F.create_map(F.lit("u1"), F.lit("../i/1.jpg"))), [("a ![x](u1) u1 ![y](u2)", "a ![x](../i/1.jpg) u1 ![y](u2)")])


def test_minhash_is_the_modular_minimum():
    import hashlib
    import zlib

    text = " ".join(f"w{i % 37}" for i in range(100))
    w = text.split()
    x = [zlib.crc32(" ".join(w[i : i + 8]).encode()) for i in range(93)]
    p = (1 << 61) - 1
    seed = lambda s: int(hashlib.sha1(s.encode()).hexdigest()[:12], 16)
    assert X.minhash_of(text) == [min(((seed(f"a{i}") | 1) * v + seed(f"b{i}")) % p for v in x) for i in range(64)]


def test_business(spark):
    pairs(spark, B.schema_hours, [(["Mon: 8:00am - 6:00pm", "tue 8am-6pm", "Wed: closed", "Thu-Fri 9am-5pm", "Sun 12pm - 12am"], ["Mo-Tu 08:00-18:00", "Su 12:00-00:00"])], "array<string>")
    pairs(spark, B.profiles, [(["http://X.com/a/", "https://www.x.com/A", "https://y.com"], ["https://www.x.com/A", "https://y.com"])], "array<string>")
    pairs(spark, lambda c: B.time_zone(c, F.lit("US")), [("NY", "America/New_York"), ("TX", ""), (None, "")])


def test_media(spark):
    cases = [
        ("https://x.com/a/b-300x200.JPG", ("x.com/a/b.jpg", "https://x.com/a/b.JPG")),
        ("https://x.com/_next/image?url=%2Fa.png&w=640", ("x.com/a.png", "https://x.com/a.png")),
        ("https://res.cloudinary.com/d/image/upload/w_300,c_fill/v12/p/q.jpg", ("res.cloudinary.com/d/image/upload/p/q.jpg", "https://res.cloudinary.com/d/image/upload/p/q.jpg")),
        ("https://x.com/sites/default/files/styles/big/public/p.jpg.webp?itok=1", ("x.com/sites/default/files/p.jpg", "https://x.com/sites/default/files/p.jpg")),
        ("https://static.wixstatic.com/media/a.jpg/v1/fill/w_1/a.jpg", ("static.wixstatic.com/media/a.jpg", "https://static.wixstatic.com/media/a.jpg")),
    ]
    pairs(spark, lambda c: M.variant(c), [(u, w) for u, w in cases])
    pairs(spark, lambda c: M.extension(c, F.lit("http://x/a.PNG")), [("image/jpeg; q=1", "jpg"), (None, "png"), ("text/x", "png")])
    assert apply(spark, lambda c: M.file_name(F.lit("k"), c, F.lit("jpg")), ["http://x/My%20Photo.jpg"])[0].startswith("my-photo-")
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (2).to_bytes(4, "big")
    gif = b"GIF89a" + (40).to_bytes(2, "little") + (30).to_bytes(2, "little")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\0" * 8
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")
    assert [M.size_of(x) for x in (png, gif, jpeg, webp, b"junk", None)] == [(3, 2), (40, 30), (640, 480), (800, 600), None, None]


@pytest.mark.parametrize("width, height", [(100, 100), (1440, 9000)])
def test_rules(spark, width, height):
    pairs(spark, R.normalize_color, [("rgb(47, 91, 234)", "#2f5bea"), ("rgba(1,2,3,0.5)", "#010203@0.5"), ("rgba(1,2,3,1)", "#010203"), ("#AbC", "#aabbcc"), ("red", None), (None, None)])
    pairs(spark, R.sitemap_label, [("http://x/post-sitemap2.xml", "post"), ("http://x/page-sitemap.xml", None), ("http://x/wp-sitemap-posts-product-1.xml", "product")])
    pairs(spark, R.retry_seconds, [("5", 5.0), ("-1", 0.0), ("soon", None), (None, None)])
    bands = [[(10, "a"), (11, "b"), (13, "c"), (14, "d")], [(5, "a"), (6, "b")]]
    got = apply(spark, R.edge_groups, bands, "array<struct<x:int,band:string>>")
    assert [[(g.x, g.bands) for g in r] for r in got] == [[(10, ["a", "b"]), (13, ["c", "d"])], []]
    r = spark.range(1).select(R.strip_plan(F.lit(height), 2044).alias("p"), R.overview_scale(F.lit(width), F.lit(height)).alias("s")).first()
    assert sum(x.h for x in r.p.strips) == height and not r.p.cut and 0 < r.s <= 1


def test_markup(spark):
    raw = ['{"@type": "Dentist", "name": "A",}', '[{"@type":["Store"]},{"@graph":[{"@type":"Review"},3]}]', "{bad", "  "]
    items = apply(spark, K.jsonld_items, raw)
    assert [len(i or []) for i in items] == [1, 2, 0, 0]
    pairs(spark, K.embed_kind, [("https://calendly.com/x", "booking"), ("https://www.youtube.com/e", "video"), ("https://x.com", None)])
    pairs(spark, K.is_social, [("https://www.facebook.com/a", True), ("https://m.yelp.com/b", True), ("https://notfacebook.com", False)])
    pairs(spark, lambda c: K.is_skip_link(c, F.lit("http://x/a")), [("Skip to content", True), ("Menu", True), ("Services", False)])
