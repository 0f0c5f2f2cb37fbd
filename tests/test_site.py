"""The whole build: what is read, what is left out and why, and what the tables beside the inventory say."""

import pytest

from weftline.plans import site as S

HEAD = '<html lang=en><head><title>{t}</title></head><body><header><a href="/"><img src="/logo.png" alt="Oak logo"></a><nav><a href="/contact">Contact</a><a href="/blog">Blog</a></nav></header><main>'
TAIL = '</main><footer><a href="https://facebook.com/oak">fb</a><p>Call (555) 123-4567</p><p>© Oak</p></footer></body></html>'


def page(title, body):
    return HEAD.format(t=title) + f"<h1>{title}</h1>{body}" + TAIL


def prose(word, n=60):
    return "<p>" + " ".join(f"{word}{i}" for i in range(n)) + "</p>"


PAGES = [
    (0, "http://oak.com/", page("Oak", prose("home") + '<script type="application/ld+json">{"@type":"Store","name":"Oak & Co","telephone":"555 999 0000","aggregateRating":{"ratingValue":4,"reviewCount":3}}</script>'), 200, None),
    (1, "http://oak.com/contact", page("Contact", prose("contact") + '<p>Write to a@oak.com</p><div class="review-card"><p>They built our whole kitchen in a week.</p><cite>Ann B.</cite></div><a href="/menu.pdf">Menu</a>'), 200, None),
    *[(2 + i, f"http://oak.com/blog/p{i}", page(f"Post {i}", prose(f"post{i}x")), 200, None) for i in range(6)],
    (8, "http://oak.com/old", page("Old", prose("old")), 200, "http://oak.com/contact"),
    (9, "http://oak.com/gone", "no", 404, None),
    (10, "http://oak.com/wait", "<html><title>Just a moment...</title><p>x</p></html>", 200, None),
    (11, "http://oak.com/closed/x", page("Closed", prose("closed")), 200, None),
    (12, "http://oak.com/copy", page("Contact", prose("contact") + '<p>Write to a@oak.com</p><div class="review-card"><p>They built our whole kitchen in a week.</p><cite>Ann B.</cite></div><a href="/menu.pdf">Menu</a>'), 200, None),
    (13, "http://oak.com/blank", "<html><body><nav><a href=/x>x</a></nav></body></html>", 200, None),
    (14, "http://oak.com/nothing", "", 200, None),
    (15, "http://elm.com/", page("Elm", prose("elm")), 200, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, s, f or u) for i, u, h, s, f in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, status int, final_url string")


@pytest.fixture(scope="module")
def robots(spark):
    return spark.createDataFrame([("oak.com", "User-agent: *\nDisallow: /closed/\n")], "site string, robots string")


def reasons(site):
    return {r.url: r.reason for r in site.inventory.collect()}


def test_reasons(pages, robots):
    got = reasons(S.build(pages, robots=robots))
    want = {"old": "redirect", "gone": "http_404", "wait": "bot_check", "closed/x": "robots", "copy": "exact_duplicate", "blank": "empty", "nothing": "fetch_failed", "x": "unread", "blog": "unread", "contact": None, "blog/p5": None, "": None}
    assert {k: got[f"http://oak.com/{k}"] for k in want} == want and got["http://elm.com/"] is None


def test_profiles(pages):
    """Two of a collection are read in a survey, one in a reference; the limit counts kept pages."""
    survey = reasons(S.build(pages, S.PROFILES["survey"]))
    assert [survey[f"http://oak.com/blog/p{i}"] for i in range(6)] == [None, None, *["sampled_out"] * 4]
    few = S.build(pages, S.Profile("few", max_pages=3))
    got = reasons(few)
    assert [got[f"http://oak.com/{k}"] for k in ("", "contact", "blog/p0", "blog/p1", "old")] == [None, None, None, "unread", "unread"] and got["http://elm.com/"] is None
    assert {r.site: r.limit_reached for r in few.limits.collect()} == {"oak.com": True, "elm.com": False}


def test_tables_beside_the_inventory(pages, robots):
    site = S.build(pages, robots=robots)
    facts = {(r.site, r.kind): r.value for r in site.facts.collect()}
    assert facts["oak.com", "email"] == "a@oak.com" and facts["elm.com", "phone"] == "(555) 123-4567" and facts["oak.com", "social"] == "https://facebook.com/oak"
    assert [(r.quote, r.name) for r in site.reviews.collect()] == [("They built our whole kitchen in a week.", "Ann B.")]
    assert [(r.value, r["count"]) for r in site.ratings.collect()] == [("4", "3")]
    assert {r.kind for r in site.media.where("site = 'oak.com'").collect()} == {"logo"}
    card = {r.site: r for r in site.cards.collect()}
    assert card["oak.com"].name == "Oak & Co" and card["oak.com"].telephone == "(555) 123-4567" and card["elm.com"].name == "Elm"
    s = {r.site: r.asDict() for r in S.full_summary(site).collect()}["oak.com"]
    want = {"pages": 8, "exact_duplicates": 1, "reviews": 1, "ratings": 1, "business_markup": True, "furniture_landmarks": True, "nav_items": 1, "documents": 2, "facts_email": 1, "facts_social": 1, "limit_reached": False, "wordpress": False, "media": 1, "collections": 2}
    assert {k: s[k] for k in want} == want


def test_changes_against_an_earlier_run(spark, pages):
    first = S.build(pages).inventory.where("file is not null").select("url", "hash")
    prior = first.where("url like '%/blog/%'").unionByName(first.where("url = 'http://oak.com/'").selectExpr("url", "'other' AS hash"))
    s = {r.site: r for r in S.run_summary(S.build(pages, prior=prior).inventory).collect()}
    assert (s["oak.com"].same, s["oak.com"].changed, s["elm.com"].new) == (6, 1, 1)


def test_sitemaps_of_a_site(spark, pages):
    """Listed URLs are known, marked, and named by their sitemap."""
    listed = spark.createDataFrame([("oak.com", "http://oak.com/blog/p1", "http://oak.com/recipe-sitemap.xml"), ("oak.com", "http://oak.com/far", "http://oak.com/page-sitemap.xml")], "site string, url string, sitemap string")
    got = {r.url: (r.in_sitemap, r.template, r.reason) for r in S.build(pages, listed=listed).inventory.collect()}
    assert got["http://oak.com/blog/p1"] == (True, "recipe", None) and got["http://oak.com/far"] == (True, "/far", "unread") and got["http://oak.com/blog/p2"] == (False, "/blog/*", None)
