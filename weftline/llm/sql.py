"""DuckDB SQL for the rows of those queries that SQL can express."""

from .decontamination import LEAST, MASKS, MISMATCH, SHARE, SHORTEST
from .near_dup import SIMILARITY, WORDS
from .quality_rules import LineRules
from .url_filter import BLOCK_GLOBS, SITE_RULES

_R = LineRules()
_SENTENCE = _R.sentence.replace("'", "''")
_PHRASES = _R.phrases.replace("'", "''")
_count = lambda x, chars: f"(length({x}) - length(translate({x}, '{chars}', '')))"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, i, word FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM
  (SELECT r, regexp_extract_all(t, '[^ \\t-\\r]+') AS ws FROM d))),
g AS (SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram,
  lead(word, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE last IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM again, range(5) AS x(k) GROUP BY r),
nw AS (SELECT r, count(*) AS n_words FROM w GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
line AS (SELECT r, line, count(*) AS times, len(regexp_extract_all(line, '[^ \\t-\\r]+')) AS n FROM lines
  WHERE regexp_matches(line, '[^ \\t-\\r]') GROUP BY r, line),
judged AS (SELECT r, n, times, NOT regexp_matches(line, '{_SENTENCE}')
  OR {_count("line", _R.marks)} + (length(line) - length(replace(line, '{_R.shout}', ''))) / {len(_R.shout)} > n * {_R.symbol_share}::DOUBLE
  OR {_count("line", _R.separators)} >= greatest({_R.separator_count}, n / 4)
  OR (n <= {_R.phrase_words} AND regexp_matches(line, '{_PHRASES}')) AS bad FROM line),
doc AS (SELECT r, sum(times - 1)::BIGINT AS n_dup_lines, coalesce(sum(n) FILTER (NOT bad), 0)::BIGINT AS n_words_kept, count(*) FILTER (bad) AS n_lines_failed FROM judged GROUP BY r),
base AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
  {_count("t", "#*$%&|<>")} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  coalesce(n_words_kept, 0) AS n_words_kept, coalesce(n_lines_failed, 0) AS n_lines_failed
  FROM d LEFT JOIN nw USING (r) LEFT JOIN rep USING (r) LEFT JOIN doc USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_kept >= {_R.least_kept}::DOUBLE * n_words AS kept FROM base
"""

_fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
_ranked = sorted(SITE_RULES, key=lambda r: -len(r.name))
_pattern = lambda g: g.replace("_", "\\_").replace("[?]", "\0").replace("*", "%").replace("?", "_").replace("\0", "?")
_like = " OR ".join(f"whole LIKE '{_pattern(g)}' ESCAPE '\\'" for g in BLOCK_GLOBS)
#: For URLs without escapes and dot segments in the path, as the driver's tables have them.
OP10 = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) AS query FROM pages),
f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') || path || query AS whole FROM p)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in _ranked)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _ranked)} WHEN {_like} THEN 'block' ELSE 'allow' END AS verdict FROM f
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM again, range(35) AS t(k)),
word AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

#: Lengths of items that no mask fits into.
_SHORT = range(SHORTEST, min(len(mask.rstrip("0")) for mask in MASKS))
_masked = lambda mask: f"concat_ws(' ', {', '.join(f'ws[p + {j}]' for j, b in enumerate(mask) if b == '1')})"

OP5 = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
tp AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM t), ip AS (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM i),
ts AS ({" UNION ALL ".join(f"SELECT doc_id, p, {k} AS m, {_masked(mask)} AS g FROM tp WHERE p + {len(mask.rstrip('0')) - 1} <= len(ws)" for k, mask in enumerate(MASKS))}
  {"".join(f" UNION ALL SELECT doc_id, p, {100 + n} AS m, {_masked('1' * n)} AS g FROM tp WHERE p + {n - 1} <= len(ws) AND EXISTS (SELECT 1 FROM i WHERE len(ws) = {n})" for n in _SHORT)}),
its AS ({" UNION ALL ".join(f"SELECT item_id, p, {k} AS m, {_masked(mask)} AS g FROM ip WHERE p + {len(mask.rstrip('0')) - 1} <= len(ws)" for k, mask in enumerate(MASKS))}
  {"".join(f" UNION ALL SELECT item_id, p, {100 + n} AS m, {_masked('1' * n)} AS g FROM ip WHERE p = 1 AND len(ws) = {n}" for n in _SHORT)}),
c AS (SELECT DISTINCT ts.doc_id, its.item_id, ts.p - its.p AS shift FROM ts JOIN its USING (m, g)),
a AS (SELECT doc_id, item_id, shift, j AS p, i.ws[j] = t.ws[j + shift] AS same, len(i.ws) AS n FROM
  (SELECT *, unnest(range(greatest(1, 1 - shift), least(len(i.ws), len(t.ws) - shift) + 1)) AS j FROM c JOIN t USING (doc_id) JOIN i USING (item_id)) AS x JOIN t USING (doc_id) JOIN i USING (item_id)),
s AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -{MISMATCH} END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS total, sum(same::INT) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS hits FROM a),
z AS (SELECT doc_id, item_id, shift, p, total, hits, n FROM s UNION ALL SELECT doc_id, item_id, shift, min(p) - 1, 0, 0, any_value(n) FROM s GROUP BY 1, 2, 3),
l AS (SELECT *, min(total) OVER w AS low, first_value(p) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS zero FROM z WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT doc_id, item_id, shift, arg_max(p, struct_pack(a := total - low, b := -p)) AS stop, max(total - low) AS score FROM l WHERE low IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT e.doc_id, e.item_id, e.shift, stop, arg_min(l.p, struct_pack(a := l.total, b := l.p)) AS begin FROM e JOIN l ON l.doc_id = e.doc_id AND l.item_id = e.item_id AND l.shift = e.shift AND l.p < stop GROUP BY ALL),
f AS (SELECT b.doc_id, b.item_id, begin + b.shift AS start, stop - begin AS length, hi.hits - lo.hits AS same, hi.n FROM b
  JOIN l AS hi ON hi.doc_id = b.doc_id AND hi.item_id = b.item_id AND hi.shift = b.shift AND hi.p = stop JOIN l AS lo ON lo.doc_id = b.doc_id AND lo.item_id = b.item_id AND lo.shift = b.shift AND lo.p = begin)
SELECT doc_id, item_id, -m.back AS start, m.length AS length, m.same AS same FROM (SELECT doc_id, item_id, max(struct_pack(same := same::BIGINT, back := (-start)::BIGINT, length := length::BIGINT)) AS m FROM f
  WHERE same >= least({LEAST}, n) AND same >= {SHARE}::DOUBLE * length GROUP BY 1, 2)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE c >= {SIMILARITY}::DOUBLE * (x.n + y.n - c)
  UNION SELECT x.doc_id, y.doc_id FROM d AS x JOIN d AS y ON x.text = y.text AND x.doc_id <> y.doc_id),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS class_id, doc_id = least(doc_id, coalesce(min(b), doc_id)) AS kept FROM d LEFT JOIN r ON r.a = doc_id GROUP BY doc_id
"""

#: For pages with one article element and no furniture inside it, as the driver's tables have them.
_ARTICLE = "regexp_extract(regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?s)<article>(.*?)(</article>|<footer|$)', 1)"
OP2 = f"""
WITH a AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace({_ARTICLE}, '<[^>]*>', ' ', 'g'), '&amp;|&amp', chr(1), 'g'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '[\\s\\x{{a0}}]+', ' ', 'g')) AS t FROM pages)
SELECT page_id, url, replace(t, chr(1), '&') AS text, length(t) AS n_chars FROM a
"""

ORACLE_SQL = {"op2_html_extraction": OP2, "op1_substring_dedup": OP1, "op5_decontamination": OP5, "op9_near_dup": OP9, "op3_quality_rules": OP3, "op10_url_filter": OP10}
