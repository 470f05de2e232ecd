"""DuckDB SQL of those operators that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT rid, n, i, item FROM dw JOIN bw USING (n, k)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM v GROUP BY k),
g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM v JOIN f USING (k) WHERE first < doc_id),
l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(
    list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w[x]), ' ') END) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 2], ' ') AS sh
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (
  SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.rid < y.rid
  GROUP BY x.rid, y.rid),
e AS (
  SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b
  WHERE 100 * k >= 90 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(rid, other) AS (
  SELECT rid, rid FROM d UNION SELECT r.rid, u.b FROM r JOIN u ON u.a = r.other),
c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.other GROUP BY r.rid),
l AS (SELECT a AS rid, count(*) AS n_links FROM u GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid) LEFT JOIN l USING (rid)
"""
