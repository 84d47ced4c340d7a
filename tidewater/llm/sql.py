"""DuckDB SQL for the Merkle manifest and the conversation trie.  DuckDB has no crc32, so it is spelled out bit by bit."""

from __future__ import annotations


def crc32(text: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""


def leaf(text: str) -> str:
    fields = (f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, source, {leaf("text")} AS leaf,
         CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(LOWER)} ELSE {leaf("text")} END AS shown FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), nodes AS (
  SELECT source, 0 AS level, place AS pos, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 15) // 16) FROM nodes WHERE n > 1 GROUP BY source, level, pos // 16
), subs AS MATERIALIZED (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, level AS height FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place AS pos, node, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 15) // 16) FROM tops WHERE n > 1 GROUP BY level, pos // 16
), runs AS MATERIALIZED (
  SELECT source, level, pos // 16 AS run, list(node ORDER BY pos) AS run_nodes FROM nodes WHERE n > 1 GROUP BY source, level, pos // 16
  UNION ALL
  SELECT subs.source, subs.height + t.level, -1, t.run_nodes
  FROM subs JOIN (SELECT level, pos // 16 AS run, list(node ORDER BY pos) AS run_nodes FROM tops WHERE n > 1 GROUP BY level, pos // 16) t ON subs.place // (16 ** (t.level + 1))::BIGINT = t.run
), walk AS (
  SELECT d.doc_id, d.source, d.place, d.leaf, s.height, s.place AS outer_place, s.node AS subroot, d.shown AS node, '' AS siblings, 0 AS level FROM placed d JOIN subs s ON d.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT doc_id, source, place, leaf, height, outer_place, subroot,
         sha256(array_to_string(run_nodes[:i], '') || node || array_to_string(run_nodes[i + 2:], '')), siblings || array_to_string(run_nodes[:i], '') || array_to_string(run_nodes[i + 2:], ''), level + 1
  FROM (SELECT w.*, r.run_nodes, CASE WHEN w.level < w.height THEN w.place // (16 ** w.level)::BIGINT ELSE w.outer_place // (16 ** (w.level - w.height))::BIGINT END % 16 AS i
        FROM walk w JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.level = w.level AND r.run = CASE WHEN w.level < w.height THEN w.place // (16 ** (w.level + 1))::BIGINT ELSE -1 END)
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, w.node AS folded_root, w.node = root AS verified
FROM walk w, (SELECT node AS root, level AS rounds FROM tops WHERE n = 1) r WHERE w.level = w.height + rounds
"""

TRIE = f"""
WITH RECURSIVE turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS item
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, {crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT h.conv_id, t.place, t.item FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 5 AND t.place < h.h
  UNION ALL
  SELECT h.conv_id, t.place, t.item FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.place >= h.h
), sequences AS (
  SELECT h.conv_id, coalesce(list(r.item ORDER BY r.place) FILTER (WHERE r.conv_id IS NOT NULL), []) AS items FROM heads h LEFT JOIN rebuilt r ON r.conv_id = h.conv_id GROUP BY h.conv_id
), prefixes AS (
  SELECT conv_id, 0 AS depth, NULL::VARCHAR AS above, sha256('') AS node, 0 AS size, items, len(items) = 0 AS ends FROM sequences
  UNION ALL
  SELECT conv_id, depth + 1, node, sha256(node || strlen(items[depth + 1].role)::VARCHAR || ':' || items[depth + 1].role || items[depth + 1].text), strlen(items[depth + 1].text), items, len(items) = depth + 1
  FROM prefixes WHERE depth < len(items)
), nodes AS MATERIALIZED (
  SELECT node, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node
), children AS MATERIALIZED (
  SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
), climb AS (
  SELECT n.node AS top, n.above, n.saved, (c.n IS NULL)::INT AS leaf FROM nodes n LEFT JOIN children c ON c.node = n.node
  UNION ALL
  SELECT n.node, n.above, climb.saved, climb.leaf FROM climb JOIN nodes n ON n.node = climb.above
), sums AS (
  SELECT top AS node, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM climb GROUP BY top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes p ON p.node = n.above
"""
