"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from ..functions import media as M
from ..functions import rules as R
from ..functions import text as X
from ..functions import url as U

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_WORD = r"[\p{L}\p{N}_]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def part(u: str, i: int) -> str:
    return f"regexp_extract({u}, '{_PARTS}', {i})"


def host(u: str) -> str:
    return f"lower(regexp_extract({part(u, 2)}, '^(?:.*@)?([^:]*)', 1))"


def site(u: str) -> str:
    return f"regexp_replace({host(u)}, '^www\\.', '')"


def netloc(u: str) -> str:
    return part(u, 2)


def segments(u: str) -> str:
    return f"list_filter(string_split({part(u, 3)}, '/'), lambda s: s <> '')"


def squash(t: str) -> str:
    return f"trim(regexp_replace({t}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


_TRACKS = "^(" + "|".join(U.TRACKING_PARAMS) + ")"
_PATH = "CASE WHEN p = '' THEN '/' WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END"
_KEPT = f"array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '{_TRACKS}')), '&')"


def normal(source: str, extra: str) -> str:
    """Rows of source(url, extra) with normal."""
    return f"""SELECT {extra}, s || '://' || h || {_PATH} || CASE WHEN k <> '' THEN '?' || k ELSE '' END AS normal FROM
      (SELECT *, {_KEPT} AS k FROM (SELECT {extra}, {part('url', 1)} AS s, {host('url')} AS h, {part('url', 3)} AS p, {part('url', 4)} AS q FROM {source}))"""


_NORM_SEGMENT = f"CASE WHEN regexp_matches(x, '{R.NUMERIC_SEGMENT}') THEN '{{n}}' ELSE lower(x) END"
_KNOWN = f"WITH n AS ({normal('pages', 'page_id, url')}), k AS (SELECT {site('url')} AS site, normal AS url, page_id AS ord FROM n)"
_SEGS = f"""{_KNOWN}, u AS (SELECT DISTINCT site, url FROM k),
 s AS (SELECT *, list_transform(raw, lambda x: {_NORM_SEGMENT}) AS segs FROM (SELECT site, url, {segments('url')} AS raw FROM u)),
 par AS (SELECT *, array_to_string(segs[1:len(segs) - 1], '/') AS parent FROM s),
 c AS (SELECT site, parent, count(DISTINCT lower(raw[-1])) AS children FROM par WHERE len(raw) > 0 GROUP BY site, parent),
 t AS (SELECT site, url, CASE WHEN len(segs) = 0 THEN '/' WHEN coalesce(children, 0) >= {R.MIN_COLLECTION} OR list_contains(segs, '{{n}}')
   THEN '/' || CASE WHEN parent <> '' THEN parent || '/' ELSE '' END || '*' ELSE '/' || array_to_string(segs, '/') END AS template FROM par LEFT JOIN c USING (site, parent))"""

#: A page's markup without scripts and styles; its menu's links; the links of one page once.
_BARE = "regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
_NAV = f"""SELECT page_id, url, pos - 1 AS pos, regexp_extract(l, 'href="([^"]*)"', 1) AS href, regexp_extract(l, '>([^<]*)</a>', 1) AS text FROM (
  SELECT page_id, url, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT page_id, url, regexp_extract_all({_BARE}, '<a [^>]*>[^<]*</a>') AS ls FROM pages))"""
_ABS = f"CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE {part('url', 1)} || '://' || {part('url', 2)} || href END"
_EDGES = f"""WITH nav AS (SELECT page_id, pos, url AS from_raw, {_ABS} AS url FROM ({_NAV})),
 f AS ({normal('(SELECT page_id, from_raw AS url, url AS target, pos FROM nav)', 'page_id, pos, target, url')}),
 g AS ({normal('(SELECT page_id, pos, target AS url, normal AS from_url FROM f)', 'page_id, pos, from_url, url')}),
 e AS (SELECT page_id, pos, from_url, normal AS to_url FROM g WHERE normal <> from_url AND NOT regexp_matches(lower({part('normal', 3)}), '\\.({"|".join(U.SKIP_EXTENSIONS)})$'))"""
_LINES = "SELECT source AS site, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents"
_NORMLINE = f"lower({squash('line')})"
_REPEATED = f"""rep AS (SELECT site, norm AS line, count(*) AS n, any_value(pages) AS pages FROM (SELECT DISTINCT site, page, {_NORMLINE} AS norm FROM lines WHERE line <> '')
  JOIN (SELECT site, count(DISTINCT page) AS pages FROM lines GROUP BY site HAVING count(DISTINCT page) >= 3) USING (site)
  GROUP BY site, norm HAVING count(*) >= greatest(3, ceil(any_value(pages) * 0.05::DOUBLE)))"""
_PHONE_ROWS = f"""ph AS (SELECT doc_id, source, pos, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, source, unnest(xs) AS raw0, generate_subscripts(xs, 1) AS pos, trim(raw0) AS raw FROM
  (SELECT doc_id, source, regexp_extract_all(text, {_q(X.PHONE)}) AS xs FROM documents))),
 pk AS (SELECT *, CASE WHEN starts_with(raw, '+') AND NOT starts_with(raw, '+1') THEN d ELSE right(d, 10) END AS key FROM ph WHERE length(d) BETWEEN 10 AND 13),
 pf AS (SELECT doc_id, source, key, min(pos) AS pos, arg_min(raw, pos) AS phone FROM pk GROUP BY doc_id, source, key)"""
_CHANGES = """WITH n AS (SELECT doc_id::VARCHAR AS url, CASE WHEN doc_id % 7 = 0 THEN upper(text) ELSE text END AS a FROM documents WHERE doc_id % 10 <> 3),
 o AS (SELECT doc_id::VARCHAR AS url, text AS b FROM documents WHERE doc_id % 10 <> 5),
 c AS (SELECT url, CASE WHEN a IS NULL THEN 'earlier' WHEN b IS NULL THEN 'new' WHEN a = b THEN 'same' ELSE 'changed' END AS change FROM n FULL JOIN o USING (url))"""
_LATEST = "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


def case(rules: list[tuple[str, str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in rules) + f" ELSE {other} END"


def rows(columns: str, listed: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else _q(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in listed)}) AS t({columns})"


def _images() -> str:
    from .queries import IMAGES

    return rows("id, src, alt, width, height, landmark, shown, row_", IMAGES)


def _look(pattern: str) -> str:
    """A pattern without look-around, which RE2 has not."""
    return pattern.replace("(?<![a-z])", "(^|[^a-z])").replace("(?![a-z])", "($|[^a-z])")


def _image_kind() -> str:
    n, a, p, s = "name", "a", "path", "s"
    big, chrome, jpeg = "(coalesce(width, 0) > 0 AND coalesce(height, 0) > 0)", "coalesce(landmark, '') IN ('header', 'footer')", "regexp_matches(path, '\\.jpe?g$')"
    m = lambda x, r: f"regexp_matches({x}, {_q(_look(r))})"
    rules = [
        (f"contains({n}, 'logo') OR contains({a}, 'logo')", "'logo'"),
        (f"{big} AND width <= 64 AND height <= 64", "'icon'"),
        (f"{m(n, M.MARK_WORDS)} OR {m(a, M.MARK_WORDS)} OR {m(p, M.MARK_DIRECTORY)}", "'mark'"),
        (f"coalesce(row_, 0) >= 3 AND NOT {m(n + chr(32) + '|| chr(32) || a', M.SOCIAL_PICTURE)} AND NOT {m(n + chr(32) + '|| chr(32) || a', M.AVATAR)}", "'mark'"),
        (f"{big} AND height <= 200 AND 2 * height <= width AND width <= 1000 AND NOT {jpeg}", "'mark'"),
        (f"coalesce(shown, 0) BETWEEN 1 AND 260 AND {a} = '' AND NOT {jpeg} AND (coalesce(width, 0) > shown OR ends_with({p}, '.svg'))", "'mark'"),
        (f"{chrome} AND {big} AND greatest(width, height) <= 400 AND {a} = '' AND NOT {jpeg}", "'mark'"),
        (f"ends_with({p}, '.svg') OR {m(n, M.ICON_WORDS)}", "'icon'"),
        (f"regexp_matches(h, '{'|'.join(M.STOCK_HOSTS)}') OR {m(s, M.STOCK_NAME)}", "'stock'"),
        (f"{m(s, M.THEME)} OR ({chrome} AND {a} = '')", "'theme'"),
        (f"regexp_matches({s}, '\\.(jpg|jpeg|webp|avif|heic)$') OR contains({s}, 'upload') OR contains({s}, 'photo') OR contains({s}, 'gallery') OR {a} <> ''", "'photo'"),
    ]
    return f"SELECT id, {case(rules, chr(39) + 'theme' + chr(39))} AS kind FROM (SELECT *, lower(src) AS s, lower(coalesce(alt, '')) AS a, {part('lower(src)', 3)} AS path, {host('lower(src)')} AS h, string_split({part('lower(src)', 3)}, '/')[-1] AS name FROM {_images()})"


ORACLE_SQL: dict[str, str] = {
    "url_normalize": normal("pages", "page_id"),
    "url_same_site": f"SELECT page_id, {site('url')} AS site, {site('url')} = 'theran.example.net' AS same_site FROM pages",
    "url_crawlable": f"SELECT page_id, NOT regexp_matches(lower({part('url', 3)}), '\\.({'|'.join(U.SKIP_EXTENSIONS)})$') AS crawlable, regexp_matches(lower({part('url', 3)}), '\\.({'|'.join(U.DOCUMENT_EXTENSIONS)})$') AS document FROM pages",
    "url_parts": f"SELECT page_id, {part('url', 1)} AS scheme, {host('url')} AS host, {part('url', 3)} AS path, {part('url', 4)} AS query, lower(coalesce({segments('url')}[1], '')) AS section, len({segments('url')}) AS depth FROM pages",
    "page_name": f"""SELECT page_id, slug, CASE WHEN q = '' AND length(p) <= 80 AND (p = '' OR regexp_matches(p, '^[a-z0-9]+(?:-[a-z0-9]+)*(?:/[a-z0-9]+(?:-[a-z0-9]+)*)*$'))
      THEN CASE WHEN p = '' THEN 'index' ELSE replace(p, '/', '--') END ELSE slug[1:70] || '-' || sha1(url)[1:8] END AS name FROM (
      SELECT *, coalesce(nullif(trim(regexp_replace(lower(CASE WHEN p = '' THEN 'index' ELSE p END), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'index')[1:80] AS slug FROM
      (SELECT page_id, url, trim({part('url', 3)}, '/') AS p, {part('url', 4)} AS q FROM pages))""",
    "section_counts": f"SELECT {site('url')} AS site, lower(coalesce({segments('url')}[1], '')) AS section, count(*) AS n FROM pages GROUP BY ALL",
    "map_url": f"SELECT page_id, 'https://new.example.com:8443' || coalesce(nullif({part('url', 3)}, ''), '/') || CASE WHEN {part('url', 4)} <> '' THEN '?' || {part('url', 4)} ELSE '' END AS new_url FROM pages",
    "audit_norm": f"SELECT page_id, {part('url', 1)} || '://' || {part('url', 2)} || coalesce(nullif(regexp_replace({part('url', 3)}, '/+$', ''), ''), '/') || CASE WHEN {part('url', 4)} <> '' THEN '?' || {part('url', 4)} ELSE '' END AS normal FROM pages",
    "tracking_param_share": f"SELECT {site('url')} AS site, count(*) AS pages, count(*) FILTER (len(list_filter(string_split({part('url', 4)}, '&'), lambda x: regexp_matches(lower(split_part(x, '=', 1)), '{_TRACKS}'))) > 0) AS tracked FROM pages GROUP BY 1",
    "content_digest": f"SELECT doc_id, sha256({squash('text')}) AS digest FROM documents",
    "norm_lines": f"SELECT doc_id, pos - 1 AS pos, {_NORMLINE} AS line FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))",
    "word_count": f"SELECT doc_id, len(regexp_extract_all(text, '{_WORD}')) AS words FROM documents",
    "shingle_counts": f"""SELECT doc_id, CASE WHEN len(w) < 8 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) END AS shingles
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents)""",
    "phones": f"WITH {_PHONE_ROWS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, phone, key FROM pf",
    "emails": f"SELECT doc_id, email FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {_q(X.EMAIL)})) AS email FROM documents) WHERE NOT regexp_matches(email, '{X.EMAIL_IMAGE}')",
    "contact_patterns": f"SELECT doc_id, len(list_distinct(regexp_extract_all(text, {_q(X.ADDRESS)}))) AS addresses, len(list_distinct(regexp_extract_all(text, {_q(X.HOURS)}))) AS hours, len(regexp_extract_all(text, {_q(X.DATE)})) AS dates FROM documents",
    "action_score": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS score FROM pages",
    "table_cells": "SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE t[1:59] || '…' END AS cell FROM (SELECT doc_id, trim(replace(replace(text, chr(10), ' '), '|', '/')) AS t FROM documents)",
    "json_strings": "SELECT doc_id, '---' || chr(10) || 'source: ' || to_json(source)::VARCHAR || chr(10) || 'lang: ' || to_json(lang)::VARCHAR || chr(10) || 'chars: ' || n_chars::VARCHAR || chr(10) || '---' || chr(10) AS head FROM documents",
    "exact_duplicates": f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {squash('text')}) AS first_doc_id, doc_id = min(doc_id) OVER (PARTITION BY {squash('text')}) AS kept FROM documents",
    "repeated_lines": f"WITH lines AS ({_LINES}), {_REPEATED} SELECT * FROM rep",
    "boilerplate_removed": f"""WITH lines AS ({_LINES}), {_REPEATED} SELECT page AS doc_id, count(*) AS lines, sum(len(regexp_extract_all(x.line, '{_WORD}')))::BIGINT AS words
      FROM (SELECT *, {_NORMLINE} AS norm FROM lines) AS x ANTI JOIN (SELECT site, line AS norm FROM rep) AS r ON x.site = r.site AND x.norm = r.norm GROUP BY page""",
    "page_head": f"""SELECT page_id, {squash("replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&quot;', chr(34))")} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, false AS noindex, '' AS meta_description FROM pages""",
    "page_h1": f"""SELECT page_id, {squash("replace(replace(regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1), '&amp;', '&'), '&quot;', chr(34))")} AS h1, len(regexp_extract_all({_BARE}, '<h1>')) AS h1_count FROM pages""",
    "nav_links": f"SELECT page_id, pos, {squash('text')} AS text, {_ABS} AS href FROM ({_NAV})",
    "link_count": f"SELECT page_id, len(regexp_extract_all({_BARE}, '<a ')) AS links, len(regexp_extract_all({_BARE}, '<a ')) AS internal FROM pages",
    "bot_check": f"SELECT page_id, regexp_matches(regexp_extract(html, '(?i)<title[^>]*>([^<]*)', 1), {_q(X.BOT_CHECK)}) AS bot_check FROM pages",
    "audit_titles": f"""WITH p AS (SELECT page_id, {site('url')} AS site, {squash("replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&quot;', chr(34))")} AS title FROM pages)
      SELECT page_id, title = '' AS missing, length(title) > 60 AS long, title <> '' AND count(*) OVER (PARTITION BY site, title) > 1 AS duplicate FROM p""",
    "link_edges": f"{_EDGES} SELECT DISTINCT from_url, to_url, true AS sitewide FROM e",
    "inbound_degree": f"{_EDGES} SELECT to_url AS url, count(DISTINCT from_url) AS sitewide_links, 0::BIGINT AS body_links FROM e GROUP BY 1",
    "outbound_internal": f"{_EDGES}, o AS (SELECT from_url, to_url, min(page_id * 1000000 + pos) AS first_at FROM e GROUP BY 1, 2) SELECT from_url AS url, string_agg(to_url, ' ' ORDER BY first_at) AS targets, count(*) AS n FROM o GROUP BY 1",
    "url_template": f"{_SEGS} SELECT site, url, template FROM t",
    "collection_parents": f"{_SEGS} SELECT site, parent, children FROM c WHERE children >= {R.MIN_COLLECTION}",
    "template_report": f"""{_SEGS}, r AS (SELECT site, url, min(ord) AS ord FROM k GROUP BY 1, 2)
      SELECT site, template, NOT starts_with(template, '/') OR contains(template, '*') OR contains(template, '{{n}}') AS collection, count(*) AS count, count(*) FILTER (ord % 2 = 0) AS read,
      count(*) FILTER (ord % 2 = 1) AS not_read, count(DISTINCT CASE WHEN ord % 2 = 0 THEN CASE WHEN ord % 4 = 0 THEN 'a' ELSE 'b' END END) AS shapes,
      round_even(sum(CASE WHEN ord % 2 = 0 THEN ord % 50 END) / nullif(count(*) FILTER (ord % 2 = 0), 0), 0)::BIGINT AS avg_words,
      array_to_string(list(url ORDER BY ord)[1:3], ' ') AS examples FROM r JOIN t USING (site, url) GROUP BY site, template""",
    "frontier_order": f"""{_KNOWN}, f AS (SELECT site, url, ord % 6 AS tier, ord AS seq FROM k UNION ALL SELECT site, url, ord % 4, ord + 100000 FROM k),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY tier, seq) AS i FROM f) WHERE i = 1)
      SELECT site, url, tier::BIGINT AS tier, seq, row_number() OVER (PARTITION BY site ORDER BY tier, seq, url) AS rank FROM b""",
    "skip_reasons": "SELECT page_id, " + case([("page_id % 11 = 0", "'robots'"), ("page_id % 7 = 0", "'sampled_out'"), ("page_id % 13 = 0", "'fetch_failed'"), ("page_id % 17 = 0", "'redirect'"), ("page_id % 5 = 0", "'http_500'"), ("html = ''", "'fetch_failed'"), ("page_id % 19 = 0", "'bot_check'"), ("page_id % 23 = 0", "'empty'"), ("page_id % 29 = 0", "'near_duplicate'"), ("page_id % 3 = 0", "'boilerplate_only'")]) + " AS reason FROM pages",
    "facts_several": f"""WITH {_PHONE_ROWS}, f AS (SELECT source AS site, 'phone' AS kind, right(d, 10) AS key FROM pk JOIN (SELECT doc_id, pos FROM pf) USING (doc_id, pos)
      UNION SELECT source, 'email', lower(e) FROM (SELECT source, unnest(regexp_extract_all(text, {_q(X.EMAIL)})) AS e FROM documents)
      UNION SELECT source, 'address', trim(regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) FROM (SELECT source, unnest(regexp_extract_all(text, {_q(X.ADDRESS)})) AS a FROM documents))
      SELECT site, kind, count(DISTINCT key) AS n FROM f GROUP BY 1, 2 HAVING count(DISTINCT key) > 1""",
    "image_kind": "",
    "color_normalize": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#' || lpad(lower(to_hex(p_partkey % 256)), 2, '0') || '0ac8' WHEN 1 THEN '#0102' || lpad(lower(to_hex(p_size)), 2, '0') || '@0.5' WHEN 2 THEN '#aabbcc' ELSE '#00ff7f' END AS color FROM part",
    "launch_verdict": """SELECT page_id, CASE WHEN s = 200 AND page_id % 4 = 0 THEN 'noindex' WHEN s = 200 AND page_id % 3 <= 1 THEN 'ok' WHEN s = 200 THEN 'chain' WHEN s IN (404, 410) THEN 'missing' ELSE 'error' END AS verdict
      FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 404 WHEN page_id % 7 = 0 THEN 500 WHEN page_id % 11 = 0 THEN 410 ELSE 200 END AS s FROM pages)""",
    "sitemap_drift": f"""{_KNOWN}, x AS (SELECT ord, coalesce(nullif(regexp_replace({part('url', 3)}, '/+$', ''), ''), '/') AS path FROM k)
      (SELECT path, 'missing_from_sitemap' AS side FROM x WHERE ord % 3 <> 0 EXCEPT SELECT path, 'missing_from_sitemap' FROM x WHERE ord % 2 = 0)
      UNION ALL (SELECT path, 'new_in_sitemap' FROM x WHERE ord % 2 = 0 EXCEPT SELECT path, 'new_in_sitemap' FROM x WHERE ord % 3 <> 0)""",
    "sitemap_label": "SELECT * FROM " + rows("id, words, label", [(0, "post", "post"), (1, "products", "products"), (2, "recipe", "recipe"), (3, "page", None), (4, "", None), (5, "", None), (6, "news", "news")]),
    "retry_waits": """SELECT o_orderkey, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS throttled, least(120.0::DOUBLE, greatest(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END::DOUBLE, 5 * pow(2, o_orderkey % 4))) AS wait FROM orders""",
    "strip_plans": """SELECT o_orderkey, n AS strips, least(2044, h - (n - 1) * 2044) AS last, h > n * 2044 AS cut, 2044::BIGINT AS tallest FROM
      (SELECT o_orderkey, h, least(40, ceil(h / 2044.0)::BIGINT) AS n FROM (SELECT o_orderkey, greatest(1, trunc(o_totalprice / 4)::BIGINT) AS h FROM orders))""",
    "change_status": f"{_CHANGES} SELECT * FROM c",
    "change_counts": f"{_CHANGES} SELECT change, count(*) AS n FROM c GROUP BY 1",
    "registry_latest": _LATEST,
    "stream_registry": _LATEST,
    "top_k_per_group": "SELECT * FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3",
}
ORACLE_SQL["image_kind"] = _image_kind()
ORACLE_SQL["media_rollup"] = """SELECT * FROM (VALUES ('x.com/a.jpg', 'https://x.com/a.jpg', 'One', 2, 2, false, false, 300, 'photo'), ('x.com/b.png', 'https://x.com/b.png', 'Two', 1, 1, true, false, 80, 'photo'),
  ('x.com/o.jpg', 'https://x.com/o.jpg', '', 1, 0, true, true, NULL, 'theme')) AS t(key, original, alts, seen, pages, chrome, og, width, kind)"""
ORACLE_SQL["business_card"] = "SELECT * FROM " + rows("site, name, telephone, email, street, region, time_zone, hours, same_as, description, sources", [
    ("s.com", "Acme", "555", "e@s.com", "1 A St", "NY", "America/New_York", "", "https://x.com/a", "about", "address=markup description=inventory email=markup name=markup telephone=facts"),
    ("t.com", "Tea Room", None, None, "2 B Rd", "NV", "", "Mo 09:00-17:00", "", None, "address=facts name=title opening_hours=facts")])
ORACLE_SQL["copyright_lines"] = "SELECT page_id, contains(html, '<footer>&copy;') AS stated, 2::BIGINT AS landmarks FROM pages"
ORACLE_SQL["layout_problems"] = "SELECT * FROM " + rows("url, rule, line", [
    ("u", "sideways", "390px, 900px: scrolls sideways by 30px, first past the edge: div"), ("u", "small-text", '390px, 900px: text at 12px in <p> "tiny"; 14px is the smallest a reader needs'),
    ("u", "tight-panel", '900px: "t" is 4px from the left edge of <div>, a panel with its own ground; give it at least 16px of padding'), ("v", "not-measured", "390px: not measured: no answer")])

from .built_oracles import BUILT  # noqa: E402  it reads the parts above

ORACLE_SQL |= BUILT
