"""DuckDB SQL for the registered queries that SQL can express."""

OP3 = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP4 = """
WITH parts AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(action, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, url, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
"""

OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), k AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keep FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep = page_id THEN NULL ELSE keep END AS refers_to
FROM k
"""

OP10 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS here FROM w
), t AS (
  SELECT *, least(cap, weight * max(here) OVER ()) AS target FROM l
), q AS (
  SELECT d.doc_id, d.size, d.h, d.source, t.source_size, t.target, t.rank, t.budget,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, turn, (cum + turn * source_size)::DOUBLE / target AS finish
  FROM q CROSS JOIN (VALUES (0), (1)) v(turn) WHERE target > 0
), o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, h, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS upto FROM c
), k AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM o WHERE upto <= budget GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id
"""

ORACLES = {"op3_block_naming": OP3, "op4_url_filter": OP4, "op6_warc": OP6, "op10_fair_mixing": OP10}
