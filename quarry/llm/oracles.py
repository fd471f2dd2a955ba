"""DuckDB SQL of the training-data queries whose contracts SQL can express (for small tables: all pairs, closures)."""

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM w, unnest(range(1, len(w) - 33)) t(i) WHERE len(w) >= 35),
hit AS (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM hit, range(35) r(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(x.n_removed, 0) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT words.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS kept
                  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id) x ON x.doc_id = w.doc_id"""

MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
      FROM w, unnest(range(1, greatest(len(w) - 1, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN both_ways l ON l.x = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, w.y FROM r JOIN both_ways w ON w.x = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT t.vec_id, (SELECT count(*) FROM both_ways WHERE x = t.vec_id) AS n_links, c.component_id, t.vec_id = c.component_id AS kept
FROM embeddings t JOIN c ON c.a = t.vec_id"""

ORACLE = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op6_embedding_dedup": EMBEDDING_DEDUP,
    "op10_minhash": MINHASH,
}
