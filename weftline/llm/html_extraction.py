"""Main text of web pages: what a page shares with the page of the nearest URL is furniture.

A page is read into text lines, one per block, each with its place: in the article (or main) element, or outside, or in an
element that is furniture by its name, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments), which goes in any case. Pages are sorted by host and path, and each is paired with the neighbour on its
host whose path agrees with its own for longer (on a tie the one before). The two pages' lines are aligned by longest common
subsequence, and lines that both have are deleted: any line of a page without an article, and lines inside an article that
are links and nothing else. Other lines of an article stay, since articles quote each other.

From copies nothing can be told: where the lines that only one of the pair has are none, or are variants of the other's
(`VARIANT` of their word pairs agree) and weigh less than what is shared, the neighbour on the other side is tried, and if
that is a copy too, no line goes.

Hosts are not gathered: pages are dealt by ranges of (host, path), cut at keys of a bounded sample, so a large host spreads
over many tasks. The pages at a range's ends are finished in a second, small step with the page across the border, so where
ranges end makes no difference. Each page is parsed once. An alignment holds at most `CELLS` bits at once.

Defined results: null html and pages without text give an empty text; a null URL sorts first, with an empty host; equal
pages are copies and keep their lines; very long pages are read whole; ids may be of any type that sorts, and null; an empty
table gives an empty table. Columns other than the three named are not read.
"""

from __future__ import annotations

import bisect
import functools
import html
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import parallelism, stash, tidy
from .url_filter import host_of, path_of

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style template svg noscript iframe object canvas math audio video textarea title".split())
#: Elements that often stay open, or only mark words; they are followed only where they are furniture.
OPEN = INLINE | frozenset("p li td tr th dt dd option".split())
FURNITURE = frozenset("nav aside footer form menu dialog button select head fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: Parts of a class or id that mark furniture wherever they stand; names that do only as a whole, or with a container's part beside them; and parts that do outside an article only.
WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr popup newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus paywall".split())
WHOLE_WORDS = frozenset("promo promotion notice notification modal overlay subscription signup replies respond share sharing social related widget toolbar skip".split())
CONTAINERS = frozenset("area bar block box btn button buttons container content group icons inner items link links list outer panel section tools widget wrap wrapper".split())
OUTER_WORDS = WHOLE_WORDS | frozenset("header masthead topbar banner hero alert alerts announcement toast reply".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Elements that leave no gap in the words around them.
UNSEEN = frozenset("script style template".split())


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)


ARTICLE, OUTSIDE, GONE, MAIN = 0, 1, 2, 3
#: Added to the place of a line that is links and nothing else.
LINK = 4
#: Share of the word pairs of what only one page of a pair has that makes it a variant of what only the other has.
VARIANT = 0.5


def _marks(names: str, inside: bool) -> bool:
    """Whether a class or id marks furniture."""
    for name in names.split():
        parts = set(filter(None, _SPLIT.split(name)))
        if parts & WORDS or parts and parts & WHOLE_WORDS and parts <= WHOLE_WORDS | CONTAINERS or not inside and parts & OUTER_WORDS:
            return True
    return False


def _is_furniture(tag: str, attrs: str, inside: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if not attrs.strip():
        return False
    a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)}
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "") in ROLES:
        return True
    if tag in ("html", "body", "article", "main") and "comment" not in a.get("class", ""):
        return False
    return _marks(f"{a.get('class', '')} {a.get('id', '')}", inside)


def page_lines(page: str) -> tuple[list[str], list[int], bool]:
    """Text lines in page order, their places, and whether the page has an article."""
    lines: list[str] = []
    places: list[int] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, and the depths of furniture, article and main before it
    gone = article = main = 0
    link, beside = False, False  # inside a link; text of the line stands beside links
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal beside
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                lines.append(text)
                places.append((GONE if gone else ARTICLE if article else MAIN if main else OUTSIDE) + LINK * (not beside))
        beside = False

    def seen(piece: str) -> None:
        nonlocal beside
        pieces.append(piece)
        beside = beside or not link and not piece.isspace()

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            seen(page[at:])
            break
        if m.start() > at:
            seen(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                seen(html.escape(m[0][9:].removesuffix("]]>"), False))
            continue
        tag = tag.lower()
        if tag not in INLINE and tag not in UNSEEN:
            flush()
            link = link and not m[1]
        elif tag == "a":
            link = not m[1] and "href" in m[3].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    _, gone, article, main = stack[i]
                    del stack[i:]
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = _end_of(tag).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or tag in OPEN and not m[3].strip():
            continue
        hides = _is_furniture(tag, m[3], bool(article or main))
        is_article = tag == "article"
        is_main = tag == "main" or re.search(r"role\s*=\s*[\"']?main\b", m[3], re.I) is not None
        if hides or is_article or is_main or tag not in OPEN:
            stack.append((tag, gone, article, main))
            gone += hides
            article += is_article and not gone
            main += is_main and not gone
    flush()
    kinds = {p % LINK for p in places}
    if ARTICLE in kinds:
        return lines, [p if p % LINK in (ARTICLE, GONE) else OUTSIDE for p in places], True
    if MAIN in kinds:
        return lines, [p - MAIN + ARTICLE if p % LINK == MAIN else p for p in places], True
    return lines, places, False


#: Bits of an alignment that are held at once.
CELLS = 1 << 26


def _swept(a: list[int], b: list[int], keep: bool = False) -> list[int]:
    """Bit vectors after each line of a (or the last one only): bit j is unset where b[: j + 1] has a longer common subsequence than b[:j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and b[:j], for each j."""
    raw = np.frombuffer(_swept(a, b)[0].to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(np.unpackbits(raw, count=len(b), bitorder="little") == 0)])


def _aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence; halved (Hirschberg) where it would take more than CELLS bits."""
    if not a or not b:
        return []
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _aligned(a[half:], b[cut:])]
    rows, out, i, j = _swept(a, b, True), [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append((i, j - 1))
                j -= 1
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence of lines."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    common = {x: k for k, x in enumerate(set(a[first : len(a) - last]) & set(b[first : len(b) - last]))}
    left, right = ([i for i in range(first, len(x) - last) if x[i] in common] for x in (a, b))
    inner = [(left[i], right[j]) for i, j in _aligned([common[a[i]] for i in left], [common[b[j]] for j in right])]
    return [(i, i) for i in range(first)] + inner + [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of a in a longest common subsequence with b."""
    return {i for i, _ in aligned(a, b)}


def copies(own: list[str], others: list[str], both: list[str]) -> bool:
    """Whether two pages are copies, from the lines that only one of them has, and those that both have."""
    if not own or not others:
        return True
    weight = lambda lines: sum(map(len, lines))
    if weight(both) <= min(weight(own), weight(others)):
        return False
    pairs = [{p for x in map(str.split, lines) for p in zip(x, x[1:] or x)} for lines in (own, others)]
    return len(pairs[0] & pairs[1]) >= VARIANT * min(map(len, pairs))


def _read(bounds: list[tuple]):
    """Pages with the number of the range their key falls into, a checksum to order pages of one key, and their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                packed, range_, tie = [], [], []
                for page, host, path, id in zip(*(part.column(c).to_pylist() for c in ("html", "host", "path", "page_id"))):
                    packed.append(zlib.compress(json.dumps([path, *page_lines(page or "")], ensure_ascii=False).encode(), 1))
                    range_.append(bisect.bisect_right(bounds, _key(host, path, id)))
                    tie.append(zlib.crc32((page or "").encode()))
                made = [pa.array(range_, pa.int32()), pa.array(tie, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("page_id", "url", "host", "path")], *made], names=["page_id", "url", "host", "path", "range", "tie", "lines"])

    return tidy(run)


def _key(host: str, path: str, id: object) -> tuple:
    return host.encode(), path.encode(), id is not None, id


def _load(packed: bytes) -> tuple[str, list[str], list[int], bool]:
    return json.loads(zlib.decompress(packed))


def _text(page: bytes, near: list[bytes]) -> str:
    """Main text of a page beside the lines of the pages before and behind it on its host."""
    path, lines, places, whole = _load(page)
    left = [i for i, p in enumerate(places) if p % LINK == (ARTICLE if whole else OUTSIDE)]
    open_ = {lines[i] for i in left if not whole or places[i] >= LINK}
    gone: set[int] = set()
    others = [_load(x) for x in near] if open_ else []
    for _, others_lines, others_places, _ in sorted(others, key=lambda o: -len(os.path.commonprefix([path, o[0]]))):
        mine = [i for i, p in enumerate(places) if p % LINK != GONE]
        theirs = [x for x, p in zip(others_lines, others_places) if p % LINK != GONE]
        if not open_ & set(theirs):
            break
        pairs = aligned([lines[i] for i in mine], theirs)
        met, answered = {mine[i] for i, _ in pairs}, {j for _, j in pairs}
        if not copies([lines[i] for i in mine if i not in met], [x for j, x in enumerate(theirs) if j not in answered], [lines[i] for i in met]):
            gone = {i for i in met if not whole or places[i] >= LINK}
            break
    return " ".join(lines[i] for i in left if i not in gone)


_FIRST, _LAST = 1, 2


def _differ(fields: list[pa.Field]):
    """Texts of the pages of a range in its order. A range's first and last page wait for the page across the border: their text is null, and they bring their lines and those of their neighbours in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []

        def rows() -> Iterator[dict | None]:
            for batch in batches:
                yield from batch.to_pylist()
            yield None

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=pa.schema(fields))
            out.clear()
            return done

        before = now = None
        for behind in rows():
            if now is not None:
                near = [x["lines"] if x is not None and x["host"] == now["host"] else None for x in (before, behind)]
                ends = _FIRST * (before is None) + _LAST * (behind is None)
                if ends:
                    out.append((now["page_id"], now["url"], None, None, part, ends, now["host"], now["lines"], *near))
                else:
                    t = _text(now["lines"], [x for x in near if x])
                    out.append((now["page_id"], now["url"], t, len(t), part, 0, None, None, None, None))
                if len(out) >= 512:
                    yield batch()
            before, now = now, behind
        if out:
            yield batch()

    return tidy(run)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = zip(*(batch.column(c).to_pylist() for c in ("lines", "before", "previous", "behind", "next")))
        texts = [_text(lines, [x for x in (before or previous, behind or next) if x]) for lines, before, previous, behind, next in near]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


#: Keys sampled for each range, about, from which the ranges' bounds are taken.
SAMPLED = 60


def _bounds(keys: DataFrame, ranges: int) -> list[tuple]:
    """Keys (host, path, page_id) that cut the rows into about equal ranges, from a bounded sample by hash."""
    most = SAMPLED * ranges
    n, h = keys.count(), F.xxhash64("host", "path", "page_id").bitwiseAND((1 << 62) - 1)
    sample = keys if n <= most else keys.withColumn("h", h).where(F.col("h") < int(2.0 * most / n * (1 << 62))).orderBy("h").limit(most)
    got = sorted({_key(r["host"], r["path"], r["page_id"]) for r in sample.select("host", "path", "page_id").collect()})
    return [got[i * len(got) // ranges] for i in range(1, ranges)] if got else []


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    spark, u = pages.sparkSession, F.col(f"`{url}`").cast("string")
    own = pages.select(F.col(f"`{id}`").alias("page_id"), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"), F.col(f"`{page}`").cast("string").alias("html"))
    ranges, key = parallelism(spark), own.schema["page_id"]
    done = [key, *T.StructType.fromDDL("url string, text string, n_chars long")]
    passed = T.StructType([*done, *T.StructType.fromDDL("part int, ends int, host string, lines binary, before binary, behind binary")])
    read = own.mapInArrow(_read(_bounds(own, ranges)), T.StructType([key, *T.StructType.fromDDL("url string, host string, path string, range int, tie long, lines binary")]))
    dealt = read.repartitionById(ranges, "range").sortWithinPartitions("host", "path", "page_id", "tie")
    seen = stash(dealt.mapInArrow(_differ(list(to_arrow_schema(passed))), passed), "extracted")
    # ranges that hold pages, in order: one number for each partition
    parts = sorted(r["part"] for r in seen.where(F.col("ends").bitwiseAND(_FIRST) > 0).select("part").collect())
    order = spark.createDataFrame([(p, i) for i, p in enumerate(parts)], "part int, at int")
    edges = seen.where("ends > 0").join(F.broadcast(order), "part")
    last = edges.where(F.col("ends").bitwiseAND(_LAST) > 0).select((F.col("at") + 1).alias("at"), "host", F.col("lines").alias("previous"))
    first = edges.where(F.col("ends").bitwiseAND(_FIRST) > 0).select((F.col("at") - 1).alias("at"), "host", F.col("lines").alias("next"))
    # only a range's first page has one before it across the border, only its last one a page behind
    met = edges.withColumn("b", F.when(F.col("ends").bitwiseAND(_FIRST) > 0, F.col("at"))).join(last.withColumnRenamed("at", "b"), ["b", "host"], "left")
    met = met.withColumn("n", F.when(F.col("ends").bitwiseAND(_LAST) > 0, F.col("at"))).join(first.withColumnRenamed("at", "n"), ["n", "host"], "left")
    rest = met.select("page_id", "url", "lines", "before", "previous", "behind", "next").mapInArrow(_borders, T.StructType(done))
    return seen.where("ends = 0").select("page_id", "url", "text", "n_chars").unionByName(rest)
