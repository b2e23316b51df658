"""DuckDB statements for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

import string

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (
    SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1
), l AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), r(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""

SUBSTRING_DEDUP = """
WITH d AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), g AS (
    SELECT doc_id, k, substring(h, CAST(2 * k + 1 AS INTEGER), 100) AS g FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) AS k FROM d WHERE len(h) >= 100)
), m AS (
    SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT g.doc_id, g.k + o AS b FROM g JOIN m USING (g), range(50) AS t(o) WHERE g.doc_id > m.first
), spans AS (
    SELECT doc_id, count(*) AS removed, count(*) FILTER (before IS DISTINCT FROM b - 1) AS spans FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM gone) GROUP BY 1
), bytes AS (
    SELECT doc_id, b, substring(h, CAST(2 * b + 1 AS INTEGER), 2) AS x FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 1)) AS b FROM d WHERE doc_id IN (SELECT doc_id FROM gone))
), kept AS (
    SELECT bytes.doc_id, string_agg(x, '' ORDER BY b) AS h FROM bytes ANTI JOIN gone USING (doc_id, b) GROUP BY 1
)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

LINE_DEDUP = rf"""
WITH l AS (
    SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), w AS (
    SELECT doc_id, line, x, row_number() OVER (ORDER BY doc_id, line) AS pos, regexp_extract_all(translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM l
), t AS (
    SELECT doc_id, line, x, pos, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS t FROM w
), k AS (
    SELECT *, md5(array_to_string(t, chr(10))) AS k FROM t
), s AS (
    SELECT k, any_value(t) AS t, min(pos) AS first, len(any_value(t)) AS n FROM k WHERE len(t) > 0 GROUP BY k
), u AS (
    SELECT k, n, unnest(t) AS token FROM s
), f AS (
    SELECT token, count(*) AS df FROM u GROUP BY token
), p AS (
    SELECT k, token FROM (SELECT k, n, token, row_number() OVER (PARTITION BY k ORDER BY df, token) AS r FROM u JOIN f USING (token)) WHERE r <= n - (3 * n + 3) // 4 + 1
), c AS (
    SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.token = b.token AND a.k <> b.k
), m AS (
    SELECT a AS k, min(y.first) AS first FROM (SELECT a, b, len(list_intersect(x.t, y.t)) AS shared, x.n + y.n AS n FROM c JOIN s x ON x.k = a JOIN s y ON y.k = b) q JOIN s y ON y.k = b WHERE 100 * shared >= 75 * (q.n - shared) GROUP BY a
), r AS (
    SELECT k.*, coalesce(pos > least(s.first, coalesce(m.first, s.first)), false) AS gone FROM k LEFT JOIN s USING (k) LEFT JOIN m USING (k)
), d AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(d.text) AS kept_chars, sha256(d.text) AS kept_sha256 FROM documents LEFT JOIN d USING (doc_id)
"""
