"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

#: Every pair of one label by cosine, then reachability by recursion.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, e.vec_id = c.root AS kept
FROM embeddings e JOIN (SELECT node, min(root) AS root FROM reach GROUP BY 1) c ON c.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) n ON n.a = e.vec_id
"""

#: Every window of 50 words and the smallest document it starts in.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT p.doc_id, p.i, d.w[p.i] AS word, CASE WHEN p.i + 49 <= p.n THEN md5_number(array_to_string(d.w[p.i : p.i + 49], ' ')) END AS k FROM p JOIN d ON d.doc_id = p.doc_id),
f AS (SELECT k, min(doc_id) AS first FROM s WHERE k IS NOT NULL GROUP BY k),
m AS (SELECT s.doc_id, s.i, s.word, coalesce(f.first < s.doc_id, false) AS later FROM s LEFT JOIN f ON f.k = s.k),
g AS (SELECT *, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
