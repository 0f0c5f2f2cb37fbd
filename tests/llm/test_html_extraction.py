import pytest

from weftline.llm import html_extraction as H


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>plain", "plain"),
        ("<article><h1>T</h1><p><b>A<br><p>B &amp;lt; c&copy;</p></article><footer>f</footer>", "T A B &lt; c©"),
        ("<nav>n</nav><main><article><header><h1>H</h1></header><p class=x>in<b>li</b>ne<ul><li>one<li>two</ul></article></main>", "H inline one two"),
        ('<div class="ad">ad</div><div id="cookie-notice">c</div><p>Text.</p><form><p>f</form>', "Text."),
        ('<article><p>A<div class="comments"><p>c</div><aside>s</aside><p>B</article>', "A B"),
        ('<article>x<script>var t="</p>";</script>y<!-- no --><style>p{}</style></article>', "xy"),
        ("<article>a\n\t b&nbsp;c", "a b c"),
        ('<main>m<p hidden>h</p><p aria-hidden="true">g</p></main>out', "m"),
        ("<body><p>a < b and <</body>", "a < b and <"),
    ],
)
def test_pages(spark, page, text):
    r = H.extract(spark.createDataFrame([(1, "http://h/p", page)], "page_id bigint, url string, html string")).first()
    assert (r.text, r.n_chars) == (text, len(text))


def test_shared_is_a_longest_common_subsequence():
    import random

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = sorted(H.shared(a, b))
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_differencing(spark):
    """Pages without an article: lines that the nearest page on the host also has are furniture; a copy keeps all."""
    page = lambda own: f"<div>Menu</div><div>Top stories</div><p>{own}</p><p>More of {own}, which goes on</p><div>Imprint</div>"
    rows = [(1, "http://h/a", page("First text is here")), (2, "http://h/b", page("Second text is there")), (3, "http://i/a", page("Alone")), (4, "http://j/a", page("Twin")), (5, "http://j/b", page("Twin")), (6, None, None)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == "First text is here More of First text is here, which goes on" and got[2] == "Second text is there More of Second text is there, which goes on"
    assert got[3] == "Menu Top stories Alone More of Alone, which goes on Imprint" and got[4] == got[5] == "Menu Top stories Twin More of Twin, which goes on Imprint" and got[6] == ""


def test_borders_make_no_difference(spark):
    rows = [(i, f"http://h{i // 9}/{i % 9}", f"<div>Menu {i // 9}</div><p>Text number {i} of a page that is long enough</p><p>tail {i % 4}</p>") for i in range(60)]
    df, got = spark.createDataFrame(rows, "page_id bigint, url string, html string"), []
    for n in ("1", "3", "25"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted((r.page_id, r.text) for r in H.extract(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2] and len(got[0]) == 60 and not any("Menu" in t for i, t in got[0] if i < 54)


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_long_alignment_in_bounded_memory(monkeypatch):
    """Halved alignments are as long as whole ones."""
    import random

    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(30))] for _ in range(2))
        monkeypatch.setattr(H, "CELLS", 1 << 26)
        whole = H.aligned(a, b)
        monkeypatch.setattr(H, "CELLS", 8)
        halved = H.aligned(a, b)
        assert len(halved) == len(whole) and all(a[i] == b[j] for i, j in halved)
        assert halved == sorted(halved) and len({i for i, _ in halved}) == len({j for _, j in halved}) == len(halved)


def pages_of(spark, *htmls, url="http://h/{}"):
    rows = [(i, url.format(i), h, "clash") for i, h in enumerate(htmls)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, lines string")
    return [r.text for r in sorted(H.extract(df).collect(), key=lambda r: r.page_id)]


def test_site_wide_lines_inside_articles(spark):
    """Lines of links that the neighbour's article has too go; sentences that articles share, and links of one article only, stay."""
    page = lambda own: f'<article><p><a href="/t">Top story of the week</a></p><p>{own}</p><p>A quoted sentence.</p><p><a href="/x">See {own[:3]}</a></p></article>'
    assert pages_of(spark, page("One is the first text"), page("Two were another one")) == ["One is the first text A quoted sentence. See One", "Two were another one A quoted sentence. See Two"]


def test_short_page_beside_a_long_menu(spark):
    """The share of a page that is shared does not matter."""
    menu = "".join(f"<div>Site menu entry number {i} shared by every page</div>" for i in range(40))
    assert pages_of(spark, f"{menu}<p>Rain tomorrow.</p>", f"{menu}<p>Prices fell again.</p>") == ["Rain tomorrow.", "Prices fell again."]


def test_near_copies_keep_their_lines(spark):
    """A neighbour that differs in a few words is a copy: the one on the other side is taken."""
    body = [f"Sentence {i} of an article on subject {i * i}." for i in range(20)]
    page = lambda lines: "<div>Menu</div>" + "".join(f"<p>{x}</p>" for x in lines) + "<div>Imprint</div>"
    changed = [*body[:9], body[9].replace("article", "essay"), *body[10:]]
    other = [f"Line {i} on a matter that is unlike." for i in range(9)]
    got = pages_of(spark, page(body), page(changed), page(other))
    assert got == ["Menu " + " ".join(body) + " Imprint", " ".join(changed), " ".join(other)]


def test_class_words_inside_articles(spark):
    page = '<article><p class="share-price">Share price rose.</p><p class="reply">He replied.</p><div class="share-buttons">Share</div><div class="related">More</div><ul class="comment-list"><li>first!</ul></article>'
    assert pages_of(spark, page) == ["Share price rose. He replied."]


def test_odd_rows(spark):
    """String ids, repeated rows, one URL for all pages, and a very long page."""
    long = "".join(f"<p>line {i % 977} {i}</p>" for i in range(30000))
    rows = [("a", "http://h/", long), ("b", "http://h/", "<p>x"), ("b", "http://h/", "<p>x"), (None, None, None), (None, "http://h/", "<p>line 0 0</p><p>y")]
    got = sorted(((r.page_id or "", r.n_chars) for r in H.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()))
    assert [n for _, n in got if n < 100] == [0, 1, 1, 1] and len(got) == 5
