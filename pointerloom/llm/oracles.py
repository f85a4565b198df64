"""DuckDB SQL of the training-data queries that SQL can express, in the plainest form."""

from __future__ import annotations

def _components(links: str, nodes: str) -> str:
    """CTEs up to ``comps(node, component)`` of ``links(a, b)``, given in both directions."""
    return f"""
reach(node, component) AS (
  SELECT node, node FROM {nodes}
  UNION
  SELECT l.b, r.component FROM reach r JOIN {links} l ON l.a = r.node WHERE r.component < l.b),
comps AS (SELECT node, min(component) AS component FROM reach GROUP BY node)"""


OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND list_dot_product(x, x) > 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q
    ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
   AND list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.95),
nodes AS (SELECT DISTINCT vec_id AS node FROM v),
{_components("links", "nodes")},
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component AS component_id, vec_id = component AS kept
FROM v JOIN comps ON node = vec_id LEFT JOIN degrees ON a = vec_id"""

OP8 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT doc_id, unnest(list_distinct(
    CASE WHEN len(words) = 0 THEN []
         WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    END)) AS shingle
  FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared
  FROM sets p JOIN sets q ON p.shingle = q.shingle AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * shared >= 80 * (s.n + t.n - shared)),
nodes AS (SELECT doc_id AS node FROM documents),
{_components("links", "nodes")}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id
FROM documents d JOIN comps ON node = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id"""

OP12 = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS smallest FROM t GROUP BY text),
judged AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good,
         bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
cells AS (
  SELECT part,
         (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)
             THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN smallest < t.doc_id THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
  FROM t JOIN firsts USING (text) LEFT JOIN judged ON judged.doc_id = t.doc_id
  GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
places AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f,
         substr(filter_order, 1, step - 1) AS earlier
  FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
fates AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails,
         contains(fails, f) AS failing, translate(fails, earlier, '') <> fails AS gone
  FROM cells, places),
steps AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
  FROM fates GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps"""

OP13 = r"""
WITH t AS (
  SELECT conv_id, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '')
                            || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos
  FROM t),
ids AS (
  SELECT conv_id, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(
      range(1, strlen(CAST(conv_id AS VARCHAR)) + 1),
      lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(
      list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
      lambda v, z: xor(v // 2, CASE WHEN v % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))
    ), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
built AS (
  SELECT i.conv_id, 0 AS own, pos, digest, words
  FROM ids i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 20 AND pos < h
  UNION ALL
  SELECT i.conv_id, 1, pos, digest, words FROM ids i JOIN o ON o.conv_id = i.conv_id AND pos >= h),
s AS (
  SELECT conv_id, digest, words,
         row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth
  FROM built),
p AS (
  SELECT conv_id, depth, words,
         string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
lengths AS (SELECT conv_id, max(depth) AS turns FROM p GROUP BY conv_id),
nodes AS (
  SELECT path, depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(CASE WHEN turns = depth THEN CAST(p.conv_id AS VARCHAR) END, ','
                                    ORDER BY p.conv_id), '')) AS ends_sha256
  FROM p JOIN lengths USING (conv_id) GROUP BY path, depth),
births AS (
  SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY 1),
lines AS (
  SELECT left(path, 32 * k) AS path, (n_convs - 1) * words AS saved,
         path NOT IN (SELECT path FROM births) AS leaf
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes)),
sums AS (SELECT path, sum(saved) AS saved_tokens, count_if(leaf) AS n_leaves FROM lines GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs,
       coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN births USING (path)
LEFT JOIN nodes up ON n.depth > 0 AND up.path = left(n.path, 32 * (n.depth - 1))"""

ORACLES: dict[str, str] = {
    "op3_vector_forest": OP3,
    "op8_ngram_join": OP8,
    "op12_filter_audit": OP12,
    "op13_prefix_trie": OP13,
}
