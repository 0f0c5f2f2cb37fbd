import gzip

from pyspark.sql import functions as F

from weftline import sql
from weftline.functions import http as H
from weftline.operators import templates
from weftline.parse.stage import parse
from weftline.sinks.files import place_lines
from weftline.sources import feeds, state


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([("http://e.com/", '<h1>T</h1><p>a <a href="/x">x</a></p>')], "url string, html string").createOrReplaceTempView("t_pages")
    rows = spark.sql("SELECT b.tag, b.text FROM t_pages, LATERAL html_blocks(html, url) b ORDER BY pos").collect()
    assert [tuple(r) for r in rows] == [("h1", "T"), ("p", "a [x](http://e.com/x)")]
    assert spark.sql("SELECT l.href FROM t_pages, LATERAL html_links(html, url) l").first().href == "http://e.com/x"
    assert spark.sql("SELECT count(*) n FROM t_pages, LATERAL a11y_findings(html) f").first().n == 2
    assert spark.sql("SELECT size(minhash('a b')) n").first().n == 64


def test_answers(spark):
    assert H.seconds_until("Tue, 02 Jan 2024 10:00:10 GMT", 1704189600.0) == 10.0 and H.seconds_until("Tue, 02 Jan 2024 10:00:10 GMT", 2e9) == 0.0 and H.seconds_until("x", 0) is None
    r = spark.createDataFrame([(gzip.compress("é".encode()), "gzip"), (b"\xff", None)], "b binary, e string").select(H.decode_body(F.col("b"), F.col("e"), F.lit(10)).alias("t"), H.fits(F.lit("image/png"), F.lit(5), ("image/",), 4).alias("f")).collect()
    assert [(x.t, x.f) for x in r] == [("é", False), ("�", False)]
    one = spark.range(1).select(H.why_not(F.lit("u"), F.lit(404)).alias("a"), H.page_url(F.lit("/x")).alias("b"), H.name_for(F.lit("http://h/A/b-c/")).alias("c"), H.name_for(F.lit("http://h/")).alias("d"), H.retry_after(F.lit("7"), F.lit(0.0)).alias("e")).first()
    assert tuple(one) == ("u answered 404", "http://localhost:3000/x", "a-b-c", "home", 7.0)


def test_state(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "url string, n int")
    state.save(df, str(tmp_path / "s"))
    assert state.load(spark, str(tmp_path / "s")).count() == 2 and state.load(spark, str(tmp_path / "s"), 1).count() == 0
    assert [r.url for r in state.without(df, df.where("n = 1")).collect()] == ["b"]


def test_site_rules(spark):
    page = '<meta name="generator" content="WordPress 6"><nav><a href="/a?utm_source=x">a</a></nav><main><nav><a href="/b">b</a></nav></main>'
    p = parse(spark.createDataFrame([("e.com", 0, "http://e.com/", page)], "site string, ord bigint, url string, html string"))
    assert [r.url for r in templates.nav_urls(p).collect()] == ["http://e.com/a"] and templates.uses_wordpress(p).first().wordpress
    got = feeds.discovered(spark.createDataFrame([("e.com", "http://e.com/", '<link type="application/rss+xml" href="/feed">')], "site string, url string, html string"))
    assert got.count() == len(feeds.FEED_PATHS) and got.orderBy("ord").first().feed_url == "http://e.com/feed"
    place = spark.createDataFrame([("p", "1 St", "", "", "", "", 4.5, 3, ["Mo 1"], "")], "place_id string, formatted_address string, telephone string, website string, primary_type string, status string, rating double, review_count bigint, opening_hours array<string>, time_zone string")
    assert [r.line for r in place_lines(place).collect()] == ["- **Address:** 1 St", "- **Rating:** 4.5 from 3 reviews", "- **Hours (schema.org):** Mo 1"]
