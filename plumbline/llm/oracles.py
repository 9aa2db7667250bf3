"""DuckDB SQL for the queries that SQL can express, by definition and without the operators' methods."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.doc_id = m.c AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT DISTINCT item, least(10, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS key FROM b WHERE len(w) > 0),
f AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d JOIN (SELECT DISTINCT k FROM q) ON len(w) >= k),
h AS (SELECT f.doc_id, f.i, f.k, q.item FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS key FROM f) f JOIN q ON f.k = q.k AND f.key = q.key),
t AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(t.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items, sha256(coalesce(o.items, '')) AS items_sha256, t.n IS NOT NULL AS contaminated
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""

VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE v IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM e UNION SELECT l.w, r.c FROM r JOIN l ON l.u = r.vec_id),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.vec_id = m.c AS kept FROM m LEFT JOIN n ON m.vec_id = n.u
"""
