"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FOLD = "replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"
_WORDS = "array_to_string(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'), ' ')"
_SITE = r"regexp_replace(regexp_extract(lower(trim(final_url)), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)', 1), '^www\.', '')"

_P2 = f"""
WITH pages AS (SELECT DISTINCT page_id, {_SITE} AS site, raw_text FROM web_pages WHERE page_id IS NOT NULL AND raw_text <> ''),
raw AS (SELECT site, page_id, unnest(string_split(raw_text, chr(10))) AS line, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) AS line_no FROM pages WHERE site <> ''),
lines AS (SELECT site, page_id, line_no, trim(regexp_replace({_FOLD.format(x="line")}, '{_SPACE}+', ' ', 'g')) AS line FROM raw),
counted AS (SELECT site, line, count(DISTINCT page_id) AS n FROM lines WHERE length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) >= 3 GROUP BY 1, 2),
sizes AS (SELECT site, count(DISTINCT page_id) AS pages FROM pages GROUP BY 1)
SELECT DISTINCT page_id, CAST(line_no AS INT) AS line_no FROM lines JOIN counted USING (site, line) JOIN sizes USING (site) WHERE n >= 6 AND 4 * n >= pages
"""

_P2_CLEANED = f"""
WITH gone AS (SELECT page_id, list(line_no) AS gone FROM ({_P2}) GROUP BY 1)
SELECT DISTINCT w.page_id, CASE WHEN gone IS NULL THEN raw_text ELSE array_to_string(list_filter(string_split(raw_text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS kept_text
FROM web_pages w LEFT JOIN gone USING (page_id) WHERE w.page_id IS NOT NULL
"""

_P3 = f"""
WITH r AS (SELECT DISTINCT record_id, main_class, {_FOLD.format(x="coalesce(sub_class, '')")} AS sub, {_FOLD.format(x="text")} AS t FROM canonical_memories
           WHERE record_id IS NOT NULL AND trim(main_class) <> '' AND regexp_matches(text, '[^\\s\\x{{a0}}\\x{{2009}}]')),
k AS (SELECT record_id, main_class, {_WORDS.format(x="sub")} AS sub,
      array_to_string(list_sort(list_filter(list_transform(string_split_regex(t, '[;|]'), lambda p: {_WORDS.format(x="p")}), lambda p: p <> '')), ';') AS t FROM r),
g AS (SELECT *, min(record_id) OVER (PARTITION BY main_class, sub, t) AS kept_id FROM k)
"""

_P7 = """
SELECT DISTINCT 'web_pages' AS origin, page_id AS item_id FROM web_pages WHERE length(raw_text) > 6400 AND page_id IS NOT NULL
UNION ALL SELECT DISTINCT 'page_parents', parent_id FROM page_parents WHERE length(text) > 3200 AND parent_id IS NOT NULL
UNION ALL SELECT DISTINCT 'parent_children', child_id FROM parent_children WHERE length(text) > 800 AND child_id IS NOT NULL
"""


_RUNS = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
_P5 = f"""
WITH t AS (SELECT DISTINCT 'web_pages' AS origin, page_id AS id, raw_text AS text FROM web_pages WHERE page_id IS NOT NULL AND raw_text IS NOT NULL UNION ALL SELECT DISTINCT 'page_parents', parent_id, text FROM page_parents WHERE parent_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT origin, id, regexp_extract_all({_FOLD.format(x="text")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
s AS (SELECT DISTINCT origin, id, unnest({_RUNS}) AS s FROM w WHERE len(w) >= 3),
n AS (SELECT origin, id, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT a.origin, a.id AS id_a, b.id AS id_b, count(*) AS met FROM s a JOIN s b ON a.origin = b.origin AND a.s = b.s AND a.id < b.id GROUP BY 1, 2, 3)
SELECT p.origin, id_a, id_b FROM p JOIN n a ON a.origin = p.origin AND a.id = id_a JOIN n b ON b.origin = p.origin AND b.id = id_b WHERE met >= 0.7 * (a.n + b.n - met)
"""

_P10 = """
WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, i, 250)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 248)) AS i FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 250)),
m AS (SELECT doc_id, h FROM w WHERE h IN (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id
"""


_P5_GROUPS = f"""
WITH RECURSIVE t AS (SELECT DISTINCT 'web_pages' AS origin, page_id AS id, raw_text AS text FROM web_pages WHERE page_id IS NOT NULL AND raw_text IS NOT NULL UNION ALL SELECT DISTINCT 'page_parents', parent_id, text FROM page_parents WHERE parent_id IS NOT NULL AND text IS NOT NULL),
w0 AS (SELECT origin, id, text, regexp_extract_all({_FOLD.format(x="text")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
c AS (SELECT origin, text, min(id) AS rep, count(*) AS copies, any_value(w) AS w FROM w0 WHERE len(w) >= 3 GROUP BY 1, 2),
s AS (SELECT DISTINCT origin, rep, unnest({_RUNS}) AS s FROM c),
n AS (SELECT origin, rep, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT a.origin, a.rep AS x, b.rep AS y, count(*) AS met FROM s a JOIN s b ON a.origin = b.origin AND a.s = b.s AND a.rep < b.rep GROUP BY 1, 2, 3),
l AS (SELECT p.origin, x, y FROM p JOIN n a ON a.origin = p.origin AND a.rep = x JOIN n b ON b.origin = p.origin AND b.rep = y WHERE met >= 0.7 * (a.n + b.n - met)),
e AS (SELECT origin, x, y FROM l UNION ALL SELECT origin, y, x FROM l),
r AS (SELECT origin, rep AS a, rep AS b FROM c UNION SELECT r.origin, r.a, e.y FROM r JOIN e ON e.origin = r.origin AND e.x = r.b),
g AS (SELECT origin, a AS rep, min(b) AS group_id FROM r GROUP BY 1, 2),
k AS (SELECT origin, x AS rep, count(*) AS links FROM e GROUP BY 1, 2)
SELECT w0.origin, w0.id, group_id, copies, coalesce(links, 0) AS links FROM w0 JOIN c USING (origin, text) JOIN g USING (origin, rep) LEFT JOIN k USING (origin, rep) WHERE copies > 1 OR links > 0
"""

_P10_SHARES = f"""
WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
v AS (SELECT doc_id, i, md5(substr(text, i, 250)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 248)) AS i FROM d WHERE length(text) >= 250)),
often AS (SELECT h FROM v GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT DISTINCT doc_id, i FROM v WHERE h IN (SELECT h FROM often)),
cov AS (SELECT doc_id, sum(CASE WHEN nx IS NULL THEN 250 ELSE least(250, nx - i) END) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM m) GROUP BY 1),
p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM (SELECT DISTINCT doc_id, h FROM v WHERE h IN (SELECT h FROM often)) a JOIN (SELECT DISTINCT doc_id, h FROM v WHERE h IN (SELECT h FROM often)) b ON a.h = b.h AND a.doc_id <> b.doc_id),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, p.y FROM r JOIN p ON p.x = r.b)
SELECT d.doc_id, length(d.text) AS n_chars, CAST(coalesce(cov.n, 0) AS INT) AS shared_chars, CASE WHEN length(d.text) > 0 THEN round(coalesce(cov.n, 0) / length(d.text), 6) ELSE 0.0::DOUBLE END AS shared_share, g.c AS cluster_id
FROM d JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) g ON g.a = d.doc_id LEFT JOIN cov USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p2_cleaned": _P2_CLEANED,
        "p3_found": _P3 + "SELECT kept_id, record_id FROM g WHERE record_id <> kept_id",
        "p3_collapsed": _P3 + "SELECT kept_id, count(*) AS copies FROM g GROUP BY 1",
        "p7_found": _P7,
        # what must hold of every result, next to what the tables tell
        "p5_found": _P5,
        "p10_found": _P10,
        "p5_groups": _P5_GROUPS,
        "p10_shares": _P10_SHARES,
        "p7_audit": f"SELECT origin, item_id, true AS within, true AS covered, true AS overlapping FROM ({_P7})",
        "p8_audit": "SELECT count(*) AS docs, true AS whole, true AS within, true AS unsplit FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^\\s\\x{a0}\\x{2009}\\x{3000}]'))",
        "p9_audit": "SELECT source, target_share, true AS reached, true AS within FROM source_targets WHERE source IS NOT NULL AND target_share IS NOT NULL",
    }
