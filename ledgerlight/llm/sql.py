"""DuckDB SQL for those queries that SQL can express."""

EXACT_DEDUP = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

_MIXED = """
d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS key
  FROM {docs}),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS reach FROM s),
v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (
              ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY reach, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
f AS (SELECT arg_min(level, reach) AS level FROM v WHERE level < reach),
g AS (
  SELECT source, source_size,
         CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target
  FROM v LEFT JOIN f ON true),
p AS (
  SELECT d.*, source_size, target, round(target)::BIGINT AS budget,
         (sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
m AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p),
mixed AS (
  SELECT doc_id, source, size, source_size, target,
         (epochs * size + least(size, greatest(0, budget - epochs * source_size - start)))::BIGINT AS taken
  FROM m)
"""

MIX_SOURCES = f"""
WITH {_MIXED.format(docs="documents")}
SELECT doc_id, size, source_size, target, taken FROM mixed
"""

NEIGHBOURS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
m AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM v),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (q.norm * c.norm) AS score
  FROM m q JOIN m c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: CRC-32 of the decimal digits of an identifier, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                          lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN t ON t.conv_id = c.base AND place <= h
  UNION ALL SELECT conv_id, 1, place, role, text FROM c JOIN t USING (conv_id) WHERE place > h),
s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, length(text) AS chars,
         md5(length(role) || ':' || role || text) AS said
  FROM r),
p AS (
  SELECT conv_id, depth, chars, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY key),
u AS (SELECT n.*, p.key AS up FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
k AS (SELECT up AS key, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY 1),
a AS (
  SELECT p.key, sum(CASE WHEN k.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n.chars) AS saved_tokens
  FROM n LEFT JOIN k USING (key) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1),
e AS (
  SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
  FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1) USING (conv_id, depth) GROUP BY 1)
SELECT u.conv_id, u.depth, above.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM u LEFT JOIN n above ON above.key = u.up LEFT JOIN k ON k.key = u.key JOIN a ON a.key = u.key LEFT JOIN e ON e.key = u.key
"""
