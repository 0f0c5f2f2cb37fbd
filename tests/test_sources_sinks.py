import pyspark.sql.functions as F

from weftline.sinks import files
from weftline.sources import feeds, sitemaps

RSS = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><title>T</title><link>/a</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate>
<dc:creator>Ann</dc:creator><category>x</category><description>d</description><content:encoded>full</content:encoded></item><item><title>no link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="/s"/><link href="/b"/><updated>2024-03-04T00:00:00Z</updated><author><name>Bo</name></author><category term="y"/><summary>s</summary></entry></feed>"""


def test_feeds(spark):
    rows = spark.createDataFrame([("http://x/feed", 0, RSS), ("http://x/atom", 1, ATOM), ("http://x/bad", 2, "<oops")], "feed_url string, ord bigint, xml string")
    got = [(r.url, r.title, r.date, r.author, r.categories, r.html) for r in feeds.items(rows).orderBy("ord").collect()]
    assert got == [("http://x/a", "T", "2024-01-02", "Ann", ["x"], "full"), ("http://x/b", "A", "2024-03-04", "Bo", ["y"], "s")]
    assert feeds.iso_date("soon") == "soon" and feeds.iso_date("") is None
    page = '<link rel="alternate" type="application/rss+xml" href="/f"><link rel="https://api.w.org/" href="http://x/wp-json/">'
    r = spark.createDataFrame([(page,)], "h string").select(feeds.feed_links(F.col("h")).alias("f"), feeds.wordpress_api(F.col("h")).alias("w")).first()
    assert r.f == ["/f"] and r.w == "http://x/wp-json/"


def test_sitemaps(spark):
    index = "<sitemapindex><sitemap><loc>http://x.com/post-sitemap.xml</loc></sitemap><sitemap><loc>http://other.com/sitemap2.xml</loc></sitemap></sitemapindex>"
    posts = "<urlset><url><loc> http://x.com/a </loc><lastmod>2024-01-01</lastmod></url><url><loc>http://www.x.com/b</loc></url><url><loc>http://y.com/c</loc></url>"
    df = spark.createDataFrame([("http://x.com/sitemap.xml", index), ("http://x.com/post-sitemap.xml", posts)], "sitemap_url string, xml string")
    got = {(r.url, r.lastmod, r.sitemap) for r in sitemaps.expand(df, spark.createDataFrame([("x.com", "http://x.com/sitemap.xml")], "site string, sitemap_url string")).collect()}
    assert got == {("http://x.com/a", "2024-01-01", "http://x.com/post-sitemap.xml"), ("http://www.x.com/b", None, "http://x.com/post-sitemap.xml")}
    bare = df.limit(1).select(sitemaps.entries(F.lit("junk <loc>http://x/1</loc>")).alias("e"), sitemaps.robots_sitemaps(F.lit("User-agent: *\n Sitemap: http://x/s.xml\n")).alias("s"), sitemaps.on_origin(F.lit("<loc>http://a/b</loc><loc>http://a/b</loc><loc>http://a</loc>"), F.lit("http://l")).alias("o")).first()
    assert [e.loc for e in bare.e] == ["http://x/1"] and bare.s == ["http://x/s.xml"] and bare.o == ["http://l/b", "http://l/"]
    r = spark.createDataFrame([("User-agent: *\nDisallow: /private", "bot", "http://x/private/a"), (None, "bot", "http://x/private/a")], "r string, a string, u string")
    assert [x.ok for x in r.select(sitemaps.can_fetch(F.col("r"), F.col("a"), F.col("u")).alias("ok")).collect()] == [False, True]
    rel = spark.createDataFrame([("x.com", "x.com", "http://x.com/", "<url><loc>/a/</loc></url><url><loc>http://z.com/</loc></url>")], "site string, netloc string, start_url string, xml string")
    assert [e.url for e in sitemaps.audit_entries(rel).collect()] == ["http://x.com/a"]


def test_page_files(spark, tmp_path):
    df = spark.createDataFrame([("a--b", "http://x/a/b", 'Say "hi" é', "", "/a/*", 3, False, "# T\n")], "file string, url string, title string, meta_description string, template string, word_count int, noindex boolean, markdown string")
    r = files.page_files(df).first()
    assert r.file == "a--b.md" and r.content == '---\nurl: "http://x/a/b"\ntitle: "Say \\"hi\\" é"\ntemplate: "/a/*"\nwords: 3\nnoindex: false\n---\n\n# T\n'
    files.write_json(df, str(tmp_path / "j"))
    files.write_parquet(df, str(tmp_path / "p"), ["template"])
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 1
