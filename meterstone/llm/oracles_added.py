"""DuckDB SQL of the manifest and of hard negatives."""

from __future__ import annotations

from meterstone.llm.oracles import LOWER, UPPER

HARD_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same QUALIFY place <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s USING (rid)
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE r <= 3
"""


def _tree(name: str, levels: int) -> str:
    """CTEs of a tree over ``{name}0(g, pos, h)``: runs of every level, nodes of the next."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}r{k} AS (SELECT g, pos // 8 AS run, list(h ORDER BY pos) AS hs, min(n) AS n "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY g, pos // 8), "
            f"{name}{k + 1} AS (SELECT g, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h "
            f"FROM {name}r{k})"
        )
    return ",\n".join(out)


def _folds(name: str, start: str, columns: str, levels: int) -> str:
    """CTEs that carry the rows of ``start(g, pos, sibs, cur, ...)`` up the tree ``name``."""
    out, last = [], start
    for k in range(levels):
        slot = f"CAST(x.pos // {8**k} % 8 AS INTEGER)"
        left, right = f"array_to_string(r.hs[1:{slot}], '')", f"array_to_string(r.hs[{slot} + 2:], '')"
        out.append(
            f"{name}f{k} AS (SELECT x.g, x.pos, {columns}, "
            f"CASE WHEN r.n > 1 THEN x.sibs || {left} || {right} ELSE x.sibs END AS sibs, "
            f"CASE WHEN r.n > 1 THEN sha256({left} || x.cur || {right}) ELSE x.cur END AS cur "
            f"FROM {last} x JOIN {name}r{k} r ON r.g = x.g AND r.run = x.pos // {8 ** (k + 1)})"
        )
        last = f"{name}f{k}"
    return ",\n".join(out)


def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: Levels the SQL looks at: 8^8 rows of a language, 8^4 languages.
_LEVELS, _TOP_LEVELS = 8, 4

# crc32 bit by bit: each byte of the decimal id, then eight shifts.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), CAST(range(8) AS BIGINT[])),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

MERKLE_MANIFEST = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295) % 3 = 0
      THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos FROM d),
t0 AS (SELECT g, pos, leaf AS h FROM o),
{_tree("t", _LEVELS)},
u0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY encode(t.g)) - 1 AS pos, h, t.g AS of FROM t{_LEVELS} t),
{_tree("u", _TOP_LEVELS)},
a AS (SELECT g, pos, doc_id, leaf, '' AS sibs, coalesce(other, leaf) AS cur FROM o),
{_folds("t", "a", "x.doc_id, x.leaf", _LEVELS)},
b AS (
  SELECT u0.g, u0.pos, x.doc_id, x.leaf, u0.h AS subroot, x.sibs, x.cur
  FROM tf{_LEVELS - 1} x JOIN u0 ON u0.of = x.g),
{_folds("u", "b", "x.doc_id, x.leaf, x.subroot", _TOP_LEVELS)}
SELECT doc_id, leaf, subroot, h AS root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = h AS verified
FROM uf{_TOP_LEVELS - 1}, u{_TOP_LEVELS}
"""
