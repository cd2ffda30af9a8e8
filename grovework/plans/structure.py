"""Queries of problems 1 and 4, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovework.operators import hierarchy as H
from grovework.operators import references as R
from grovework.runtime import cut, table


def _refs(spark, d):
    return table(spark, d, "code_edges"), table(spark, d, "code_nodes"), table(spark, d, "externals")


def p1_found(spark, d):
    return R.orphan_references(*_refs(spark, d))


def p1_report(spark, d):
    return R.orphan_report(*_refs(spark, d))


def p4_found(spark, d):
    return H.loops(table(spark, d, "code_nodes")).select("project", "id", "cycle_id")


def p4_hierarchy(spark, d):
    h = H.hierarchy(table(spark, d, "code_nodes"))
    return h.withColumn("path", F.array_join("path", " > ")).drop("parent_id")


def p4_descendants(spark, d):
    return H.descendants(cut(H.hierarchy(table(spark, d, "code_nodes")), "hierarchy"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p4_found, p4_hierarchy, p4_descendants)}

_RESOLVED = """
WITH refs AS (
  SELECT project, source, edge_type, target, min(indexed_at) AS edge_at FROM code_edges GROUP BY ALL
), ends AS (
  SELECT *, 'source' AS side, source AS ref FROM refs WHERE source IS NOT NULL
  UNION ALL
  SELECT *, 'target' AS side, target AS ref FROM refs WHERE target IS NOT NULL
), parents AS (
  SELECT project, id, min(indexed_at) AS valid_from,
         first(deleted_at ORDER BY indexed_at DESC NULLS LAST, deleted_at DESC NULLS LAST) AS removed_at
  FROM code_nodes WHERE id IS NOT NULL GROUP BY project, id
), ext AS (SELECT DISTINCT project, id FROM externals),
resolved AS (
  SELECT e.*, CASE WHEN e.side = 'target' AND x.id IS NOT NULL THEN NULL
                   WHEN p.id IS NULL THEN 'missing'
                   WHEN p.removed_at IS NOT NULL THEN 'deleted'
                   WHEN p.valid_from > e.edge_at THEN 'later' END AS reason
  FROM ends e LEFT JOIN parents p ON e.project = p.project AND e.ref = p.id
              LEFT JOIN ext x ON e.project = x.project AND e.ref = x.id
)
"""
_TREE = """
WITH RECURSIVE cur AS (
  SELECT project, id, first(parent_id ORDER BY indexed_at DESC NULLS LAST, parent_id DESC NULLS LAST) AS parent_id
  FROM code_nodes WHERE project IS NOT NULL AND id IS NOT NULL GROUP BY project, id
), links AS (
  SELECT c.project, c.id, p.id AS parent_id FROM cur c LEFT JOIN cur p ON c.project = p.project AND c.parent_id = p.id
), up AS (
  SELECT project, id, parent_id AS anc FROM links WHERE parent_id IS NOT NULL
  UNION
  SELECT u.project, u.id, l.parent_id FROM up u JOIN links l ON u.project = l.project AND u.anc = l.id WHERE l.parent_id IS NOT NULL
), rings AS (
  SELECT project, id FROM up WHERE anc = id GROUP BY ALL
), seen AS (SELECT DISTINCT project, id, anc FROM up)
"""
_WALK = _TREE.rstrip() + """,
cyc AS (SELECT s.project, s.id, min(s.anc) AS cycle_id FROM seen s JOIN rings r ON s.project = r.project AND s.anc = r.id GROUP BY s.project, s.id),
nodes AS (SELECT l.*, c.cycle_id, r.id IS NOT NULL AS on_cycle, l.parent_id IS NULL OR (c.cycle_id IS NOT NULL AND c.cycle_id = l.id) AS top
  FROM links l LEFT JOIN cyc c USING (project, id) LEFT JOIN rings r USING (project, id)),
walk AS (
  SELECT project, id, id AS pos, 0 AS steps FROM nodes
  UNION ALL
  SELECT w.project, w.id, n.parent_id, w.steps + 1 FROM walk w JOIN nodes n ON n.project = w.project AND n.id = w.pos WHERE NOT n.top
)
"""
SQL = {
    "p4_hierarchy": _WALK
    + """
SELECT n.project, n.id, CASE WHEN n.cycle_id IS NULL THEN p.root END AS root, p.path, p.depth, coalesce(d.k, 0) AS n_descendants, n.cycle_id, n.on_cycle, coalesce(n.cycle_id = n.id, false) AS back_edge
FROM nodes n JOIN (SELECT project, id, string_agg(pos, ' > ' ORDER BY steps DESC) AS path, max(steps) AS depth, arg_max(pos, steps) AS root FROM walk GROUP BY ALL) p USING (project, id)
LEFT JOIN (SELECT project, pos AS id, count(*) AS k FROM walk WHERE steps > 0 GROUP BY ALL) d USING (project, id)""",
    "p4_descendants": _WALK + "SELECT project, pos AS ancestor, id AS descendant, steps AS distance FROM walk WHERE steps > 0",
    "p1_found": _RESOLVED + "SELECT project, source, edge_type, target, side, reason FROM resolved WHERE reason IS NOT NULL",
    "p1_report": _RESOLVED
    + """
SELECT edge_type, CASE WHEN side = 'target' AND starts_with(ref, 'ext:') THEN 'externals' ELSE 'code_nodes' END AS ref_table,
       strftime(edge_at, '%Y-%m') AS month, count(*) AS n_refs,
       count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'deleted') AS n_deleted,
       count(*) FILTER (reason = 'later') AS n_later, round(count(reason) / count(*), 6) AS dangling_share
FROM resolved GROUP BY 1, 2, 3""",
    "p4_found": _TREE
    + """
SELECT s.project, s.id, min(s.anc) AS cycle_id FROM seen s JOIN rings r ON s.project = r.project AND s.anc = r.id
GROUP BY s.project, s.id""",
}
