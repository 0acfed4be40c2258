"""DuckDB SQL of the queries that SQL can express, over the same tables and whole texts.

Each is the plain definition of the result: all sets are compared exactly, and components are closures. ``%s`` in a part is
filled in where it is used.
"""

from __future__ import annotations

#: Smallest node reachable: ``edge`` (a, b) in both directions -> ``component`` (node, component).
_CLOSURE = """
reach(node, other) AS (SELECT a, a FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.other = e.a),
component AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

#: ``sets`` (id, n, members: list of distinct values) -> ``edge`` of pairs with 100 * both >= 80 * either. The rarest members of
#: each set, so many that two similar sets share one of them, give the candidates; these are compared whole.
_SIMILAR = """
member AS MATERIALIZED (SELECT id, n, unnest(members) AS m FROM sets),
often AS (SELECT m, count(*) AS df FROM member GROUP BY m),
ranked AS (SELECT id, n, m, row_number() OVER (PARTITION BY id ORDER BY df, m) AS r FROM member JOIN often USING (m)),
prefix AS MATERIALIZED (SELECT id, n, m FROM ranked WHERE r <= n - CAST(ceil(n * 0.8) AS BIGINT) + 1),
candidate AS MATERIALIZED (SELECT DISTINCT x.id AS a, y.id AS b FROM prefix x JOIN prefix y ON x.m = y.m AND x.id < y.id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
pair AS MATERIALIZED (
  SELECT c.a, c.b, len(list_intersect(x.members, y.members)) AS common, x.n + y.n AS total
  FROM candidate c JOIN sets x ON x.id = c.a JOIN sets y ON y.id = c.b),
link AS MATERIALIZED (SELECT a, b FROM pair WHERE 100 * common >= 80 * (total - common)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link)"""

_WORDS = r"regexp_extract_all(%s, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE piece AS MATERIALIZED (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
spot AS MATERIALIZED (
  SELECT doc_id, p, trim(parts[p], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM piece, unnest(generate_series(1, len(parts))) AS t(p)),
named AS MATERIALIZED (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM spot WHERE line <> '')),
sets AS MATERIALIZED (
  SELECT id, len(members) AS n, members FROM (
    SELECT id, list_distinct([substring(line, CAST(i AS BIGINT), 8) FOR i IN generate_series(1, greatest(length(line) - 7, 1))]) AS members FROM named)),
{_SIMILAR},
{_CLOSURE},
grouped AS (SELECT doc_id, p, coalesce(component, id) AS g FROM spot JOIN named USING (line) LEFT JOIN component ON node = id),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM grouped) WHERE r > 1),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(q.parts), 0) AS n_lines, coalesce(len(ps), 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL WHEN ps IS NULL THEN d.text
    ELSE coalesce(array_to_string([q.parts[i] FOR i IN generate_series(1, len(q.parts)) IF NOT list_contains(ps, i)], chr(10)), '') END AS text
FROM documents d LEFT JOIN piece q ON q.doc_id = d.doc_id LEFT JOIN lists l ON l.doc_id = d.doc_id
"""

OP4 = f"""
WITH split AS MATERIALIZED (SELECT doc_id, {_WORDS % "coalesce(text, '')"} AS words FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, p, md5(array_to_string(words[p : p + 49], ' ')) AS k FROM split, unnest(generate_series(1, len(words) - 49)) AS t(p)),
earliest AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING count(DISTINCT doc_id) > 1),
covered AS (
  SELECT doc_id, list(DISTINCT p + o) AS gone FROM windows JOIN earliest USING (k), range(50) AS r(o) WHERE first < doc_id GROUP BY doc_id),
kept AS (
  SELECT s.doc_id, len(words) AS n, CASE WHEN gone IS NULL THEN words ELSE [words[i] FOR i IN generate_series(1, len(words)) IF NOT list_contains(gone, i)] END AS left_
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id)
SELECT doc_id, n AS n_words, n - len(left_) AS n_removed, sha256(coalesce(array_to_string(left_, ' '), '')) AS kept_sha256 FROM kept
"""

OP5 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id AS id, {_WORDS % "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"} AS w FROM documents),
every AS MATERIALIZED (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)]) END AS members FROM split),
sets AS MATERIALIZED (SELECT id, len(members) AS n, members FROM every WHERE len(members) > 0),
{_SIMILAR},
{_CLOSURE}
SELECT id AS doc_id, len(members) AS n_shingles, coalesce(component, id) AS component_id, id = coalesce(component, id) AS kept
FROM every LEFT JOIN component ON node = id
"""

OP6 = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS MATERIALIZED (
  SELECT vec_id, e, len(e) AS dim, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND x.dim = y.dim WHERE list_dot_product(x.e, y.e) >= 0.9 * x.norm * y.norm),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
{_CLOSURE},
counted AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM v LEFT JOIN counted ON a = vec_id LEFT JOIN component ON node = vec_id
"""

_BARE = r"list_filter([regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g') FOR x IN regexp_extract_all(coalesce(text, ''), '[^\s\x{85}\x{A0}]+')], lambda y: y <> '')"
_RUNS = "list_distinct([array_to_string(w[i : i + {0} - 1], ' ') FOR i IN generate_series(1, len(w) - {0} + 1)])"

OP10 = f"""
WITH item AS MATERIALIZED (
  SELECT item_id, width, unnest({_RUNS.format("width")}) AS s FROM (SELECT item_id, w, least(len(w), 5) AS width FROM (SELECT item_id, {_BARE} AS w FROM benchmark)) WHERE width > 0),
sized AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id),
width AS (SELECT DISTINCT width AS k FROM item),
split AS MATERIALIZED (SELECT doc_id, {_BARE} AS w FROM documents),
doc AS (SELECT doc_id, k, unnest({_RUNS.format("k")}) AS s FROM split, width WHERE len(w) >= k),
found AS (SELECT doc_id, item_id, count(*) AS n_found FROM doc JOIN item ON item.width = doc.k AND item.s = doc.s GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment FROM found JOIN sized USING (item_id) WHERE n_found >= 0.8 * n_item - 1e-9
"""

ORACLE_SQL = {"op1_line_dedup": OP1, "op4_substring_dedup": OP4, "op5_near_dedup": OP5, "op6_embedding_dedup": OP6, "op10_decontaminate": OP10}
