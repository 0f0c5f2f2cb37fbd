"""DuckDB SQL for the queries over built inputs, and for those over parsed pages: what must come out, from the same columns."""

from __future__ import annotations

from ..functions import markup as K
from ..functions import rules as R
from ..functions import text as X
from ..sources import feeds
from .oracles import _ABS, _KNOWN, _LINES, _NAV, _NORMLINE, _PHONE_ROWS, _REPEATED, _SEGS, normal, part, segments, site, squash

# catalogue pages

_P = """p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS typ, lower(p_type) AS t, p_size AS size,
  'shop' || (p_partkey % 7) || '.example' AS site, 'http://shop' || (p_partkey % 7) || '.example' AS base FROM part)"""
_N = "count(*) OVER (PARTITION BY site)"
CATALOGUE = {
    "catalogue_head": f"WITH {_P} SELECT k AS ord, name || ' ' || k AS title, 'Item ' || k AS meta_description, base || '/p/' || k AS canonical, k % 5 = 0 AS noindex, '/og/' || k || '.jpg' AS og_image, 'Product' AS types FROM p",
    "catalogue_images": f"""WITH {_P} SELECT k AS ord, 0::BIGINT AS pos, base || '/logo.png' AS src, 'Acme logo' AS alt, false AS alt_missing, 120::BIGINT AS width, NULL::BIGINT AS height, 'header' AS landmark, true AS in_link, NULL AS widest FROM p
      UNION ALL SELECT k, 1, base || '/img/' || k || '-300x200.jpg', typ, false, 500 + 200 * (k % 3), 200, NULL, false, base || '/img/' || k || '-900x600.jpg' FROM p""",
    "catalogue_links": f"""WITH {_P} SELECT k AS ord, unnest(range(8)) AS pos, unnest(['', 'Next', brand, typ, 'Manual', 'Map', 'fb', 'Privacy']) AS text,
      unnest([base || '/', base || '/p/' || (k + 1), base || '/c/' || t, base || '/t/' || t, base || '/docs/' || k || '.pdf', base || '/map', 'https://facebook.com/acme', base || '/privacy']) AS href,
      unnest(['header', 'nav', 'nav', NULL, NULL, 'footer', 'footer', 'footer']) AS landmark, unnest([false, false, false, true, true, false, false, false]) AS in_main,
      unnest([0, 0, 1, 0, 0, 0, 0, 0]::BIGINT[]) AS depth, unnest([NULL, NULL, NULL, NULL, NULL, 'Visit', 'Visit', 'Visit']) AS "group" FROM p""",
    "catalogue_fields": f"WITH {_P} SELECT k AS ord, base || '/buy' AS action, 'post' AS method, unnest(range(3)) AS pos, unnest(['qty', 'note', 'go']) AS name, unnest(['text', 'textarea', 'submit']) AS type, unnest([true, false, false]) AS required FROM p",
    "catalogue_items": f"WITH {_P} SELECT k AS ord, 'Product' AS type, name, k::VARCHAR AS sku FROM p",
    "catalogue_words": f"WITH {_P} SELECT k AS ord, (3 * len(regexp_extract_all(name, '\\w+')) + len(regexp_extract_all(typ, '\\w+')) + 6)::BIGINT AS words, true AS has_landmarks FROM p",
    "catalogue_blocks": f"""WITH {_P} SELECT k AS ord, 'h1:' || name || '|p:Size ' || size || ' of [' || typ || '](' || base || '/t/' || t || ')|img:|p:' || name || '|p:[Manual](' || base || '/docs/' || k || '.pdf)' AS blocks,
      name AS heading, name AS beside FROM p""",
    "catalogue_documents": f"WITH {_P} SELECT site, base || '/docs/' || k || '.pdf' AS document, base || '/p/' || k AS linked_from FROM p",
    "catalogue_degrees": f"""WITH {_P}, e AS (SELECT k, unnest([base || '/', base || '/p/' || (k + 1), base || '/c/' || t, base || '/map', base || '/privacy', base || '/t/' || t]) AS url, unnest([1, 1, 1, 1, 1, 0]) AS s FROM p)
      SELECT url, count(DISTINCT k) FILTER (s = 1) AS sitewide_links, count(DISTINCT k) FILTER (s = 0) AS body_links FROM e GROUP BY url""",
    "catalogue_furniture": f"WITH {_P} SELECT k AS ord, 'Next,' || brand AS nav, base || '/logo.png' AS src, 'fb' AS social, 'Privacy' AS legal, '© Acme ' || (k % 3 + 2020) AS copyright, true AS no_cta, 'Visit=Map' AS groups FROM p",
    "catalogue_sites": f"WITH {_P} SELECT site, count(*) AS pages, 'http://' || site || '/p/' || min(k) AS \"from\", '© Acme ' || (min(k) % 3 + 2020) AS copyright, 1::BIGINT AS social, count(*) - 1 AS differ FROM p GROUP BY site",
    "catalogue_pictures": f"""WITH {_P} SELECT site, base || '/img/' || k || '.jpg' AS original, typ AS alts, 1::BIGINT AS pages, false AS chrome, (500 + 200 * (k % 3))::BIGINT AS width, 'photo' AS kind FROM p
      UNION ALL SELECT site, any_value(base) || '/logo.png', 'Acme logo', count(*), true, 120, 'mark' FROM p GROUP BY site""",
    "catalogue_pictures_chosen": f"WITH {_P} SELECT site, count(*) AS n FROM p GROUP BY site",
    "catalogue_link_facts": f"WITH {_P} SELECT site, 'social' AS kind, 'https://facebook.com/acme' AS value, count(*) AS sources, 1::BIGINT AS rank FROM p GROUP BY site",
    "catalogue_menu": f"WITH {_P} SELECT site, unnest([base || '/', base || '/p/' || (k + 1), base || '/c/' || t]) AS url FROM p WHERE k < 7",
}

# reviews, facts

_C = "c AS (SELECT c_custkey AS k, c_name AS name FROM customer)"
_CARD = f"""{_C}, r AS (SELECT k, 'They delivered order number ' || k || ' on time.' AS quote, name, CASE WHEN k % 3 > 0 THEN 'Mar 3, 2024' END AS date, CASE WHEN k % 3 > 0 THEN 'Yelp' END AS platform, CASE WHEN k % 5 > 0 THEN (k % 5)::VARCHAR END AS stars FROM c)"""
REVIEWS = {
    "review_cards_read": f"WITH {_CARD} SELECT k AS ord, quote, name, date, platform, stars FROM r",
    "review_lines": f"""WITH {_CARD}, s AS (SELECT *, concat_ws(', ', date, platform, stars || ' stars') AS said FROM r)
      SELECT k AS ord, '> ' || quote || chr(10) || '> — ' || name || CASE WHEN said <> '' THEN ' (' || said || ')' ELSE '' END || '  ' || chr(10) || '> http://c/' || k || chr(10) AS line FROM s""",
    "stated_review_rows": f"""WITH {_C} SELECT 's' || (k % 4) AS site, 'review' AS kind, 'Order ' || k || ' was fine' AS quote, name, (k % 5 + 1)::VARCHAR AS stars FROM c
      UNION ALL SELECT DISTINCT 's' || (k % 4), 'rating', '4', CASE WHEN k % 9 > 0 THEN (k % 9)::VARCHAR END, NULL FROM c""",
    "facts_beside_reviews": f"WITH {_C} SELECT 's' || (k % 4) AS site, '555' || lpad((k % 900 + 100)::VARCHAR, 3, '0') || lpad((k % 10000)::VARCHAR, 4, '0') AS key, count(*) AS sources FROM c WHERE k % 2 = 1 GROUP BY 1, 2",
}

# sitemaps, feeds, imports

_LISTED = f"n AS ({normal('pages', 'page_id, url')}), l AS (SELECT page_id, {site('url')} AS site, normal AS url, strftime(DATE '2024-01-01' + (page_id % 300)::INT, '%Y-%m-%d') AS day FROM n WHERE normal IS NOT NULL)"
_ORDERS = "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, * FROM orders"
_places = ", ".join(f"'{p}'" for p in feeds.FEED_PATHS)
SOURCES = {
    "sitemap_entries": f"""WITH {_LISTED} SELECT 'http://' || site || '/sitemap-' || (page_id % 2) || '.xml' AS sitemap_url, count(*) AS n, min(replace(url, '&', '&amp;')) AS first, max(day) AS last FROM l GROUP BY 1
      UNION ALL SELECT 'http://' || site || '/sitemap.xml', 2, 'http://' || site || '/sitemap-0.xml', NULL FROM l GROUP BY site""",
    "sitemap_pages": f"WITH {_LISTED} SELECT site, replace(url, '&', '&amp;') AS url, day AS lastmod, 'http://' || site || '/sitemap-' || (page_id % 2) || '.xml' AS sitemap FROM l",
    "sitemap_origins": f"""WITH {_LISTED} SELECT site, count(DISTINCT coalesce(nullif({part('url', 3)}, ''), '/')) AS moved,
      count(DISTINCT coalesce(nullif(regexp_replace({part('url', 3)}, '/+$', ''), ''), '/') || '?' || {part('url', 4)} || {part('url', 1)}) FILTER ({part('url', 2)} = site) AS own FROM l WHERE page_id % 2 = 0 GROUP BY site""",
    "robots_allowed": f"SELECT page_id, page_id % 3 = 0 OR NOT starts_with({part('url', 3)}, '/fr/') AS weft, page_id % 3 = 0 AS other, CASE WHEN page_id % 3 > 0 THEN 'http://x/s.xml' ELSE '' END AS maps FROM pages",
    "feed_items": f"SELECT 'http://x.example/o/' || k AS url, 'Order ' || k AS title, day AS date, '<p>' || o_orderstatus || '</p>' AS html, o_orderpriority AS categories, 'rss' AS source FROM ({_ORDERS}) WHERE k % 10 = 0",
    "feed_places": f"WITH {_LISTED} SELECT DISTINCT site, 'http://' || site || f AS feed_url FROM l, unnest(['/own.xml', {_places}]) AS x(f)",
    "wordpress_items": f"""SELECT k AS ord, 'http://wp.example/' || k AS url, 'A & B ' || k AS title, day AS date, coalesce(c_name, '') AS author, coalesce(n_name, (o_custkey % 25)::VARCHAR) || ',99' AS categories, '<p>' || o_orderstatus || '</p>' AS html
      FROM ({_ORDERS}) LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_custkey % 25 WHERE k % 5 = 0""",
    "shopify_items": """SELECT p_partkey AS ord, 'http://shop.example/products/item-' || p_partkey AS url, p_name AS title, '2024-02-03' AS date, '<p>' || p_name || '</p><img src="/i/' || p_partkey || '.jpg" alt="' || p_name || '">' AS html, p_brand AS vendor,
      p_type || ',new' AS tags, p_size || '.0' || CASE WHEN p_partkey % 2 = 1 THEN '-' || (p_size + 1) || '.0' ELSE '' END AS price, true AS no_type FROM part""",
    "import_precedence": "SELECT 'http://i.example/a/' || o_orderkey AS url, 'wp-rest ' || o_orderkey AS title, 'wp-rest' AS source FROM orders WHERE o_orderkey % 20 = 0 UNION ALL SELECT 'http://i.example/b/' || o_orderkey, 'shopify ' || o_orderkey, 'shopify' FROM orders WHERE o_orderkey % 20 = 0",
    "import_choice": f"SELECT * FROM (SELECT 'http://i.example/a/' || k AS url, CASE WHEN k % 3 > 0 THEN day ELSE '1997-06-01' END AS date FROM ({_ORDERS}) WHERE k % 20 = 0) WHERE date >= '1997-01-01'",
    "item_pages": "SELECT p_partkey, '<html><head><title>' || t || '</title></head><body><main><h1>' || t || '</h1><p>' || p_type || '</p></main></body></html>' AS html FROM (SELECT *, p_name || ' &lt;&amp;&gt; &#x27;x&#x27;' AS t FROM part)",
}

# places, listings, identifiers

_HOURS = "'Mo-Tu ' || h || ':30-17:05; Th ' || h || ':30-17:05'"
_PLACE = f"{_C}, q AS (SELECT *, lpad((k % 3 + 8)::VARCHAR, 2, '0') AS h, CASE WHEN k % 2 = 0 THEN 'thai_restaurant' ELSE 'florist' END AS kind, '+1 555 ' || lpad((k % 10000)::VARCHAR, 4, '0') AS phone FROM c)"
LISTINGS = {
    "place_facts": f"""WITH {_PLACE} SELECT k::VARCHAR AS place_id, name, phone AS telephone, k || ' Main Street' AS street, 'Reno' AS locality, 'NV' AS region, {_HOURS} AS hours, CASE WHEN k % 2 = 0 THEN 'Restaurant' ELSE 'Florist' END AS schema_type,
      'OPERATIONAL' AS status, 4.5::DOUBLE AS rating, k AS review_count, 'Good ' || k || '/Ann/2024-05-06' AS reviews FROM q""",
    "place_lines": f"""WITH {_PLACE} SELECT k::VARCHAR AS place_id, unnest(range(6)) AS ord, unnest(['- **Address:** ' || k || ' Main St', '- **Phone:** ' || phone, '- **Type:** ' || kind, '- **Status:** OPERATIONAL', '- **Rating:** 4.5 from ' || k || ' reviews',
      '- **Hours (schema.org):** ' || replace({_HOURS}, ';', ',')]) AS line FROM q""",
    "hours_runs": "SELECT s_suppkey AS id, 'Mo-We ' || lpad((s_suppkey % 4 + 7)::VARCHAR, 2, '0') || ':30-' || (s_suppkey % 3 + 16) || ':00; Sa ' || lpad((s_suppkey % 4 + 7)::VARCHAR, 2, '0') || ':00-12:00' AS hours FROM supplier",
    "address_parts": """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || ' Oak St' WHEN 1 THEN s_suppkey || ' Main Rd, Suite 4' ELSE 'Hauptstr. ' || s_suppkey || ', Berlin' END AS street, CASE s_suppkey % 3 WHEN 0 THEN 'Springfield' WHEN 1 THEN 'Reno' ELSE '' END AS locality,
      CASE s_suppkey % 3 WHEN 0 THEN 'IL' WHEN 1 THEN 'NV' ELSE '' END AS region, CASE s_suppkey % 3 WHEN 0 THEN lpad(s_suppkey::VARCHAR, 5, '0') WHEN 1 THEN '89501-1234' ELSE '' END AS postal_code, CASE WHEN s_suppkey % 3 < 2 THEN 'US' ELSE '' END AS country FROM supplier""",
    "time_zone": "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 1 THEN '' WHEN c_custkey % 4 = 0 THEN 'America/Los_Angeles' WHEN c_custkey % 4 = 2 THEN 'America/New_York' ELSE '' END AS zone FROM customer",
    "profiles_dedupe": "SELECT c_custkey AS k, 'https://facebook.com/' || lower(c_name) || ' https://x.com/a' AS profiles FROM customer",
    "name_from_title": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 2 AND contains(lower(p_type) || 'store', w))) = 0 THEN p_type ELSE p_name END AS name FROM part",
    "tracking_ids": "SELECT p_partkey, unnest(range(3)) AS pos, unnest(['ga4', 'gtm', 'google_site_verification']) AS kind, unnest(['G-' || lpad(p_partkey::VARCHAR, 8, 'A'), 'GTM-' || lpad(p_partkey::VARCHAR, 6, 'B'), 'v' || p_partkey]) AS value FROM part",
    "embeds": "SELECT p_partkey, unnest(range(2)) AS pos, unnest(['video', 'payments']) AS kind, unnest(['www.youtube.com', 'js.stripe.com']) AS host, unnest(['https://www.youtube.com/embed/' || p_partkey, 'https://js.stripe.com/v3']) AS src FROM part",
    "jsonld_types": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'Store,' || p_type || ',Review' ELSE '' END AS types FROM part",
    "image_variant": "SELECT p_partkey, 'https://x.com/wp/photo' || p_partkey || '.jpg' AS original FROM part",
    "picture_files": """SELECT p_partkey, ext, lower(p_type) || '-' || p_partkey || '-' || sha1('https://x.com/a/' || upper(p_type) || '%20' || p_partkey || '.PNG')[1:8] || '.' || ext AS file
      FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'jpg' ELSE 'png' END AS ext FROM part)""",
    "rewritten_pictures": "SELECT p_partkey, 'a ![' || p_name || '](../images/' || p_partkey || '.png \"t\") b ![c](/other.png) [l](/i/' || p_partkey || '.png)' AS md FROM part",
    "edge_groups": "SELECT p_partkey, (p_partkey % 5) || CASE WHEN p_partkey % 4 < 3 THEN ':a+b' ELSE ':a ' || (p_partkey % 5 + 3) || ':b' END || ' 40:c' AS groups FROM part",
    "public_hosts": """SELECT c_custkey, CASE k % 5 WHEN 0 THEN false WHEN 1 THEN NOT k % 256 BETWEEN 16 AND 31 WHEN 2 THEN NOT (k % 256 = 168 OR k % 256 = 0 AND k % 7 IN (0, 2)) WHEN 3 THEN true ELSE k % 256 <> 254 END AS public FROM (SELECT *, c_custkey AS k FROM customer)""",
    "page_problems": f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'nothing answered at ' || url WHEN page_id % 5 = 0 THEN url || ' answered 404' END AS why, CASE WHEN page_id % 2 = 0 THEN 'http://localhost:3000/a/' || page_id WHEN page_id % 3 > 0 THEN url END AS shown,
      coalesce(nullif(trim(regexp_replace(lower({part('url', 3)}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'home') AS name FROM pages""",
    "files_that_fit": "SELECT o_orderkey, o_orderkey % 3 = 0 AND (o_orderkey % 7 = 0 OR trunc(o_totalprice) <= 100000) AS fits FROM orders",
    "own_pages": "SELECT page_id, page_id % 4 = 0 OR page_id % 4 < 3 AND page_id % 3 > 0 AS own FROM pages",
}

# state, registries, reports

_REC = f"{_KNOWN.removeprefix('WITH ')}, rec AS (SELECT site, url, min(ord) AS k FROM k GROUP BY site, url)"
_moved = lambda u: f"'https://n.example' || coalesce(nullif({part(u, 3)}, ''), '/') || CASE WHEN {part(u, 4)} <> '' THEN '?' || {part(u, 4)} ELSE '' END"
_LAUNCH = f"""{_REC}, m AS (SELECT *, {_moved('url')} AS new_url FROM rec), a AS (SELECT new_url, min(k) AS a FROM m WHERE k % 4 > 0 GROUP BY new_url),
 v AS (SELECT url, new_url, a, CASE WHEN a % 5 = 0 THEN 404 WHEN a IS NOT NULL THEN 200 END AS status FROM m LEFT JOIN a USING (new_url) WHERE k % 3 > 0),
 w AS (SELECT *, CASE WHEN status = 200 AND a % 7 = 0 THEN 'noindex' WHEN status = 200 AND a % 3 > 0 THEN 'ok' WHEN status = 200 THEN 'chain' WHEN status = 404 THEN 'missing' ELSE 'error' END AS verdict FROM v)"""
_ISSUES = f"""{_REC}, i AS (SELECT DISTINCT site, 'broken internal link' AS kind, 'http://' || site || '/gone/' || (k % 3) AS subject FROM rec
 UNION ALL SELECT site, 'broken external link', subject FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY subject) AS n FROM (SELECT DISTINCT site, 'https://out.example/' || (k % 9) AS subject FROM rec)) WHERE n <= 4)"""
REPORTS = {
    "registry_upsert": f"""WITH {_C}, o AS (SELECT k, name FROM c), n AS (SELECT k + 100 AS k, name FROM c WHERE k % 3 > 0)
      SELECT 'k' || k AS key, CASE WHEN n.name IS NULL THEN '2024-01-01' ELSE '2024-02-02' END AS updated, 'name=' || coalesce('new ' || n.name, o.name) || CASE WHEN o.name IS NULL THEN '' ELSE ';old=yes' END || CASE WHEN n.name IS NULL THEN '' ELSE ';profile=pages' END AS attrs FROM o FULL JOIN n USING (k)""",
    "state_without": "SELECT doc_id::VARCHAR AS url FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 > 0",
    "known_before": "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 > 0 THEN lang END, CASE WHEN doc_id % 5 > 0 THEN 'old' END) AS lang, doc_id % 5 = 0 AS fresh FROM documents",
    "page_files": "SELECT 'p-' || doc_id || '.md' AS file, concat_ws(chr(10), '---', 'url: \"http://h/' || doc_id || '\"', 'title: ' || to_json(source)::VARCHAR, 'template: \"/*\"', 'words: ' || n_chars, 'noindex: ' || (doc_id % 2 = 0)::VARCHAR, '---', '', 'Body', '') AS content FROM documents WHERE doc_id % 3 > 0",
    "common_lines": f"""WITH lines AS ({_LINES}), {_REPEATED}, each AS (SELECT source AS site, doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents))
      SELECT site, doc_id, pos, text FROM (SELECT site, doc_id, pos, e.line AS text, row_number() OVER (PARTITION BY site, rep.line ORDER BY doc_id, pos) AS n FROM (SELECT *, {_NORMLINE} AS norm FROM each WHERE line <> '') AS e JOIN rep USING (site) WHERE e.norm = rep.line) WHERE n = 1""",
    "inventory_lines": f"""WITH {_REC} SELECT site, row_number() OVER (PARTITION BY site ORDER BY k % 3 = 0, url) AS ord, '| ' || concat_ws(' | ', url, CASE WHEN k % 3 > 0 THEN '200' ELSE '' END, 'T/' || k, '', k % 90, k % 4, 1, CASE WHEN k % 2 = 0 THEN 'yes' ELSE '' END, CASE WHEN k % 5 = 0 THEN 'yes' ELSE '' END,
      CASE WHEN k % 3 > 0 THEN (k % 3)::VARCHAR ELSE '' END, 'map, video', CASE WHEN k % 3 > 0 THEN 'pages/' || k || '.md' ELSE 'unread' END) || ' |' AS line FROM rec""",
    "record_reasons": f"WITH {_REC} SELECT site, 'unread' AS reason, count(*) AS n FROM rec WHERE k % 3 = 0 GROUP BY site",
    "template_lines": f"""WITH {_REC}, g AS (SELECT site, count(*) AS n, count(*) FILTER (k % 3 > 0) AS r, round_even(sum(k % 90) FILTER (k % 3 > 0) / nullif(count(*) FILTER (k % 3 > 0), 0), 0)::BIGINT AS w, arg_min(url, k) AS u FROM rec GROUP BY site)
      SELECT site, '/x/*' AS template, '| ' || concat_ws(' | ', '/x/*', n, r, n - r, CASE WHEN r > 0 THEN '1' ELSE '' END, coalesce(w::VARCHAR, ''), u) || ' |' AS line FROM g""",
    "launch_eligible": f"WITH {_REC} SELECT url FROM rec WHERE k % 7 > 0 AND (k % 3 > 0 OR k % 6 = 0)",
    "launch_lines": f"""WITH {_LAUNCH} SELECT '| ' || concat_ws(' | ', url, verdict, coalesce(status::VARCHAR, ''), CASE WHEN a IS NULL THEN '' ELSE new_url END, CASE WHEN a IS NULL THEN '' ELSE 'A/B' END,
      CASE WHEN verdict = 'ok' THEN CASE WHEN a % 2 = 0 THEN '0 h1, ' ELSE '' END || 'no description' ELSE '' END) || ' |' AS line FROM w""",
    "launch_counts": f"WITH {_LAUNCH} SELECT {', '.join(f'count(*) FILTER (verdict = {chr(39)}{v}{chr(39)}) AS {v}' for v in ('ok', 'missing', 'chain', 'noindex', 'error'))} FROM w",
    "broken_targets": f"WITH {_ISSUES} SELECT site, kind, subject FROM i",
    "issue_counts": f"WITH {_ISSUES} SELECT site, kind, count(*) AS n FROM i GROUP BY site, kind",
    "launch_rows": f"""WITH {_REC}, m AS (SELECT *, {_moved('url').replace('n.example', 'new.example.com')} AS new_url FROM rec), a AS (SELECT new_url, min(k) AS a FROM m WHERE k % 3 > 0 GROUP BY new_url)
      SELECT verdict, count(*) AS n, count(*) FILTER (verdict = 'ok' AND (a % 5 = 0 OR a % 2 = 0)) AS with_findings FROM (SELECT a, CASE WHEN a IS NULL THEN 'error' WHEN a % 4 = 0 THEN 'noindex' ELSE 'ok' END AS verdict FROM m LEFT JOIN a USING (new_url)) GROUP BY verdict""",
    "old_urls": f"WITH {_REC}, m AS (SELECT *, {_moved('url')} AS new_url FROM rec) SELECT site, url AS subject, '- ' || url || ': error (None)' AS line FROM m WHERE new_url NOT IN (SELECT new_url FROM m WHERE k % 2 = 0)",
}

# parsed pages

_plain = lambda t: f"replace(replace(replace(replace(regexp_replace({t}, '&amp;|&amp', chr(1), 'g'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), chr(1), '&')"
_clean = lambda t: squash(_plain(t))
_lines = lambda t: f"array_to_string(list_filter(list_transform(string_split({_plain(t)}, chr(10)), lambda x: {squash('x')}), lambda x: x <> ''), chr(10))"
_PAGE = f"""g AS (SELECT page_id, url, {_lines("regexp_extract(html, '(?s)<div class=.ad.>([^<]*)</div>', 1)")} AS ad, {_lines("regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1)")} AS h1, {_lines("regexp_extract(html, '(?s)<footer>([^<]*)</footer>', 1)")} AS foot,
  regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p><b>[^<]*<br>|<p>[^<]*</p>') AS ps FROM pages),
 q AS (SELECT page_id, foot, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM g),
 lo AS (SELECT page_id, max(i) AS last FROM q WHERE starts_with(p, '<p><b>') GROUP BY page_id),
 b AS (SELECT page_id, pos AS o, 'li' AS tag, '[' || replace({squash('text')}, ']', ')') || '](' || {_ABS} || ')' AS text, true AS chrome FROM ({_NAV}) WHERE {squash('text')} <> ''
  UNION ALL SELECT page_id, 100000, 'p', ad, false FROM g UNION ALL SELECT page_id, 200000, 'h1', h1, false FROM g
  UNION ALL SELECT page_id, 300000 + i, 'p', array_to_string(list_filter([{_lines("regexp_replace(p, '<[^>]*>', '', 'g')")}, CASE WHEN i = last THEN foot ELSE '' END], lambda x: x <> ''), chr(10)), false FROM q LEFT JOIN lo USING (page_id)
  UNION ALL SELECT page_id, 900000, 'p', foot, true FROM g ANTI JOIN lo USING (page_id)),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, tag, text ORDER BY o) AS n FROM b WHERE text <> '') WHERE n = 1 OR length(text) < 60 AND regexp_matches(text, '[0-9]')),
 blocks AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, tag, text, chrome FROM u)"""
_COLLECTION = "(NOT starts_with(template, '/') OR contains(template, '*') OR contains(template, '{n}'))"
_GENERIC = "'click here', 'here', 'read more', 'learn more', 'more', 'link', 'this', 'continue'"
_A11Y = f"""t AS (SELECT page_id, {site('url')} AS site, url, {_clean("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages),
 gen AS (SELECT page_id, 'generic link text: ' || string_agg(DISTINCT '"' || w || '"', ', ' ORDER BY '"' || w || '"') AS f FROM (SELECT page_id, rtrim(lower({squash('text')}), '.!') AS w FROM ({_NAV})) WHERE w IN ({_GENERIC}) GROUP BY page_id),
 mute AS (SELECT page_id, count(*) || ' link(s) with no text' AS f FROM ({_NAV}) WHERE {squash('text')} = '' GROUP BY page_id),
 a11y AS (SELECT page_id, 10 AS o, 'no viewport meta tag' AS finding FROM pages UNION ALL SELECT page_id, 11, f FROM mute UNION ALL SELECT page_id, 12, f FROM gen
  UNION ALL SELECT page_id, 13, 'title is ' || length(title) || ' characters (keep it under 60)' FROM t WHERE length(title) > 60)"""
_MENU = f"""menu AS (SELECT page_id, {site('url')} AS site, list(h ORDER BY pos) AS hrefs FROM (SELECT page_id, url, pos, {_ABS} AS h, {squash('text')} AS w FROM ({_NAV}))
  WHERE w <> '' AND NOT regexp_matches(w, {chr(39)}{K.CTA}{chr(39)}) AND NOT starts_with(lower(w), 'skip ') AND NOT regexp_matches(lower(w), '^[^\\p{{L}}\\p{{N}}]*(menu|close|open|toggle)?[^\\p{{L}}\\p{{N}}]*$') GROUP BY ALL),
 pg AS (SELECT page_id, {site('url')} AS site, coalesce(hrefs, []) AS hrefs, {_clean("regexp_extract(html, '(?s)<footer>([^<]*)</footer>', 1)")} AS foot FROM pages LEFT JOIN menu USING (page_id)),
 best AS (SELECT site, count(*) AS pages, arg_max(hrefs, {{'n': len(hrefs), 'o': -page_id}}) AS hrefs, arg_max(foot, {{'n': len(hrefs), 'o': -page_id}}) AS copyright FROM pg GROUP BY site)"""
_FACT = lambda kind, pattern: f"SELECT source AS site, doc_id, '{kind}' AS kind, unnest(xs) AS value, generate_subscripts(xs, 1) AS pos FROM (SELECT source, doc_id, regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}') AS xs FROM documents)"
_PLAIN_VALUE = squash("value")
PARSED = {
    "page_blocks": f"WITH {_PAGE} SELECT page_id, pos, tag, text, chrome, NULL AS href FROM blocks",
    "page_markdown": f"""WITH {_PAGE} SELECT page_id, coalesce(md || chr(10), '') AS markdown FROM pages LEFT JOIN (SELECT page_id,
      string_agg(CASE WHEN tag = 'h1' THEN '# ' || replace(text, chr(10), ' ') ELSE replace(text, chr(10), '  ' || chr(10)) END, chr(10) || chr(10) ORDER BY pos) AS md FROM blocks WHERE NOT chrome GROUP BY page_id) USING (page_id)""",
    "page_fingerprint": f"""WITH {_PAGE}, s AS (SELECT page_id, pos, tag, lag(tag) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM (SELECT page_id, pos, replace(tag, 'h1', 'h') AS tag FROM blocks WHERE NOT chrome))
      SELECT page_id, coalesce(f, '') AS fingerprint FROM pages LEFT JOIN (SELECT page_id, sha1(array_to_string(list(tag ORDER BY pos)[1:8], ' '))[1:10] AS f FROM s WHERE before IS NULL OR before <> tag GROUP BY page_id) USING (page_id)""",
    "landmark_lines": f"""SELECT page_id, 'nav' AS landmark, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, {squash('text')} AS line FROM ({_NAV}) WHERE {squash('text')} <> ''
      UNION ALL SELECT page_id, 'footer', 0, {_clean("regexp_extract(html, '(?s)<footer>([^<]*)</footer>', 1)")} FROM pages""",
    "page_a11y": f"WITH {_A11Y} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, finding FROM a11y",
    "audit_page_findings": f"""WITH {_A11Y}, own AS (SELECT page_id, 0 AS o, 'no title' AS finding FROM t WHERE title = '' UNION ALL SELECT page_id, 1, 'no meta description' FROM t
      UNION ALL SELECT page_id, 2, 'duplicate title' FROM (SELECT page_id, title, count(*) OVER (PARTITION BY site, title) AS n FROM t) WHERE n > 1 AND title <> '' UNION ALL SELECT * FROM a11y)
      SELECT site, url, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, finding FROM own JOIN t USING (page_id)""",
    "site_furniture": f"""WITH {_MENU} SELECT site, pages, true AS has_landmarks, len(hrefs)::BIGINT AS nav, 0::BIGINT AS social, copyright, (SELECT count(*) FROM pg WHERE pg.site = best.site AND pg.hrefs <> best.hrefs) AS differ FROM best""",
    "page_facts": f"""WITH {_PHONE_ROWS}, f AS (SELECT source AS site, doc_id, 'phone' AS kind, phone AS value, pos, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS pkey FROM pf
      UNION ALL SELECT *, NULL FROM ({_FACT('email', X.EMAIL)}) WHERE NOT regexp_matches(value, '{X.EMAIL_IMAGE}') UNION ALL SELECT *, NULL FROM ({_FACT('address', X.ADDRESS)}) UNION ALL SELECT *, NULL FROM ({_FACT('hours', X.HOURS)})),
      v AS (SELECT site, doc_id, kind, pos, {_PLAIN_VALUE} AS value, coalesce(pkey, CASE WHEN kind = 'address' THEN trim(regexp_replace(lower({_PLAIN_VALUE}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) ELSE lower({_PLAIN_VALUE}) END) AS key FROM f)
      SELECT site, kind, key, arg_min(value, {{'d': doc_id, 'p': pos}}) AS value, count(DISTINCT doc_id) AS sources FROM v WHERE value <> '' GROUP BY site, kind, key""",
}

#: The sampler goes through a site's pages one by one; what was admitted so far is carried along.
PARSED["sampler_admit"] = f"""{_SEGS.replace('WITH ', 'WITH RECURSIVE ', 1)}, o AS (SELECT site, url, min(ord) AS ord FROM k GROUP BY site, url),
 a AS MATERIALIZED (SELECT t.site, t.url, template, lower(coalesce({segments('t.url')}[1], '')) AS sec, ord % 7 = 0 AS nav, row_number() OVER (PARTITION BY t.site ORDER BY ord) AS rank FROM t JOIN o USING (site, url)),
 r AS (SELECT DISTINCT site, 0::BIGINT AS rank, '' AS url, []::VARCHAR[] AS ts, []::VARCHAR[] AS ss, false AS admitted FROM a UNION ALL
  SELECT site, rank, url, CASE WHEN ok THEN list_append(ts, template) ELSE ts END, CASE WHEN ok THEN list_append(ss, sec) ELSE ss END, ok FROM (
   SELECT a.site, a.rank, a.url, ts, ss, template, sec, NOT ({_COLLECTION} AND len(list_filter(ts, lambda x: x = template)) >= 2)
    AND NOT (NOT nav AND sec <> '' AND len(list_filter(ss, lambda x: x = sec)) >= CASE WHEN regexp_matches(sec, '{R.POST_SECTIONS}') THEN 2 ELSE 3 END) AS ok FROM r JOIN a ON a.site = r.site AND a.rank = r.rank + 1))
 SELECT site, url, admitted FROM r WHERE rank > 0"""

BUILT = CATALOGUE | REVIEWS | SOURCES | LISTINGS | REPORTS | PARSED
