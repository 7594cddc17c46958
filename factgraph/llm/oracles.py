"""SQL counterparts of the queries that SQL can express, for the small tables."""

#: Bytes as pairs of hex digits: strings of 50 bytes, their smallest document, and what they cover.
REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 p AS (SELECT doc_id, n, i, substr(x, (2 * i + 1)::INT, 2) AS b, CASE WHEN i + 50 <= n THEN substr(x, (2 * i + 1)::INT, 100) END AS w FROM (SELECT *, unnest(range(n)) AS i FROM h)),
 f AS (SELECT w, min(doc_id) AS first FROM p WHERE w IS NOT NULL GROUP BY w HAVING count(DISTINCT doc_id) > 1),
 g AS (SELECT p.doc_id, i, b, coalesce(max((first < p.doc_id)::INT) OVER (PARTITION BY p.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM p LEFT JOIN f USING (w)),
 s AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g),
 a AS (SELECT doc_id, sum(gone) AS n_removed, sum((gone = 1 AND before = 0)::INT) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM s GROUP BY doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN a USING (doc_id)
"""
#: Shingles as text, links by shared ones, and the smallest document that links reach.
GROUPS = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
 l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(root) FROM r WHERE r.id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""
