"""SQL equivalents of the queries that SQL can express."""

OP4 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
        first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
g AS (SELECT *, first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id) AS first_id FROM h)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::BIGINT >> s) & 31) + 1, 1)),
           'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight,
        2.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER before, 0)) /
                (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, (max(level) OVER ()) * weight) AS target,
             ('0x' || substr(md5('mix' || coalesce(source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS shift FROM l),
n AS (SELECT source, count(*) AS rows FROM d GROUP BY source),
b AS (SELECT d.*, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % (1 + n.rows // 16384) AS stratum
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
r AS (SELECT b.*, row_number() OVER (PARTITION BY source ORDER BY stratum, size, doc_id) AS rank FROM b),
c AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.shift, r.rank,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate * rank + shift) - floor(rate * (rank - 1) + shift)) * size)::BIGINT AS taken FROM c
"""

OP12 = r"""
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
          lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
              lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 6 AS h FROM t),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns
      FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS total, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
k AS (SELECT conv_id, total, depth, sha256(turns[1:depth]::JSON::VARCHAR) AS node,
             CASE WHEN depth > 0 THEN sha256(turns[1:depth - 1]::JSON::VARCHAR) END AS parent,
             CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS points FROM p),
n AS (SELECT node, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256
      FROM k GROUP BY node, depth),
c AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.parent = n.node),
a AS (SELECT k.node AS top, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.points) AS saved_tokens
      FROM m JOIN k ON k.conv_id = m.conv_id AND k.depth <= m.depth GROUP BY k.node)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, a.n_leaves::BIGINT AS n_leaves,
       a.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN a ON a.top = m.node LEFT JOIN m u ON u.node = m.parent
"""

ORACLES: dict[str, str] = {"op4_exact_groups": OP4, "op5_warc": OP5, "op10_mixing": OP10, "op12_prefix_trie": OP12}
