"""Graph queries: filters, pages, joins, traversals, aggregates, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grovework.functions import text as X
from grovework.operators import chunking as K
from grovework.operators import model as M
from grovework.operators import paging as P
from grovework.operators import search as S
from grovework.operators import stats as A
from grovework.operators import traverse as T
from grovework.plans.sqlbase import CHUNKS, EDGES, EXT, INNER, LIVE, REL, cte
from grovework.plans.structure import _WALK
from grovework.runtime import table

#: The project the single-project tools are shown on.
PROJECT = "harborline_6be41f07"
INCLUDE, EXCLUDE = ["**/*.py", "**/*.go"], ["**/report/**", "core_*"]

LIGHT = ["name", "node_type", "file_path", "line_start", "line_end", "parent_id", "summary"]
CHUNK_LIGHT = ["node_id", "file_path", "start_line", "end_line", "chunk_kind"]

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def g(spark, d, *cols):
    return M.load_graph(spark, d, list(cols) or LIGHT, CHUNK_LIGHT)


# ---- 2.3 projections, filters, predicates ----


@query(cte(LIVE, body=f"SELECT project, id, name, file_path FROM live WHERE project = '{PROJECT}'"))
def flt01_project_scope(spark, d):
    return g(spark, d, "name", "file_path").project(PROJECT).nodes


@query(cte(LIVE, body="SELECT project, id, node_type FROM live WHERE lower(node_type) IN ('function', 'struct')"))
def flt02_type_filter(spark, d):
    return T.by_type(g(spark, d, "node_type").nodes, ["function", "struct"])


@query(
    cte(
        LIVE,
        body="""SELECT project, id, file_path FROM live
WHERE (file_path LIKE '%.py' AND (contains(file_path, '/') OR true) OR file_path LIKE '%.go')
  AND NOT (file_path LIKE '%/report/%' OR file_path LIKE 'report/%' OR file_path LIKE 'core\\_%' ESCAPE '\\')""",
    )
)
def flt04_path_globs(spark, d):
    n = g(spark, d, "file_path").nodes
    return n.where(X.path_allowed(F.col("file_path"), INCLUDE, EXCLUDE))


@query(cte(LIVE, body="SELECT project, id, name FROM live WHERE contains(lower(name), 'ledger')"))
def flt05_name_substring(spark, d):
    return g(spark, d, "name").nodes.where(F.contains(F.lower("name"), F.lit("ledger")))


@query(cte(EDGES, body="SELECT project, source, edge_type, target FROM edges WHERE edge_type IN ('INHERITS', 'IMPLEMENTS')"))
def flt06_relation_filter(spark, d):
    return g(spark, d).edges.where(F.col("edge_type").isin("INHERITS", "IMPLEMENTS")).select(*M.EDGE_KEY)


@query(cte(EDGES, REL, body="SELECT project, direction, edge_type, count(*) AS n FROM rel GROUP BY ALL"))
def flt07_direction(spark, d):
    return T.relations(g(spark, d)).groupBy("project", "direction", "edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(cte(LIVE, body="SELECT project, id, node_type FROM live WHERE node_type IN ('module', 'document')"))
def flt09_file_nodes(spark, d):
    return g(spark, d, "node_type").nodes.where(F.col("node_type").isin(*A.FILE_TYPES))


@query(cte(LIVE, body="SELECT project, id, summary FROM live WHERE summary IS NOT NULL AND summary <> ''"))
def flt10_summarized(spark, d):
    return g(spark, d, "summary").nodes.where(A.present("summary"))


@query(cte(LIVE, body="SELECT l.project, l.id FROM live l WHERE EXISTS (SELECT 1 FROM file_changes c WHERE c.project = l.project AND c.path = l.file_path AND c.kind = 'deleted')"))
def flt11_in_list_of_files(spark, d):
    gone = table(spark, d, "file_changes").where("kind = 'deleted'").select("project", F.col("path").alias("file_path"))
    return g(spark, d, "file_path").nodes.join(gone, ["project", "file_path"], "left_semi").select("project", "id")


@query(
    cte(
        LIVE,
        body=r"""SELECT project, id, CASE WHEN length(summary) > 60 THEN concat(regexp_replace(substring(summary, 1, 60), '\s+$', ''), '…') ELSE summary END AS preview,
       CASE WHEN summary = '' THEN NULL WHEN length(summary) > 40 THEN concat(regexp_replace(substring(summary, 1, 39), '\s+$', ''), '…') ELSE summary END AS short
FROM live""",
    )
)
def prj02_summary_preview(spark, d):
    n = g(spark, d, "summary").nodes
    return n.select("project", "id", X.preview(F.col("summary"), 60).alias("preview"), X.trimmed(F.col("summary"), 40).alias("short"))


@query("SELECT project, regexp_replace(project, '_[^_]*$', '') AS shown FROM projects")
def prj06_display_name(spark, d):
    return table(spark, d, "projects").select("project", X.display_name(F.col("project")).alias("shown"))


@query(cte(LIVE, body="SELECT project, id, name, node_type, file_path, line_start, line_end, has_vec AS has_summary_embedding FROM live"))
def prj07_entity_payload(spark, d):
    n = g(spark, d, "name", "node_type", "file_path", "line_start", "line_end", "summary_embedding").nodes
    return n.withColumn("has_summary_embedding", F.col("summary_embedding").isNotNull()).drop("summary_embedding")


# ---- 2.4 joins and traversals ----


@query(cte(LIVE, CHUNKS, body="SELECT c.project, c.id, c.node_id, l.name, l.node_type FROM ch c JOIN live l ON c.project = l.project AND c.node_id = l.id"))
def jn01_chunk_owner(spark, d):
    x = g(spark, d, "name", "node_type")
    owner = x.nodes.select("project", F.col("id").alias("node_id"), "name", "node_type")
    return x.chunks.select("project", "id", "node_id").join(owner, ["project", "node_id"])


@query(
    cte(
        LIVE, EDGES, REL,
        body="""SELECT r.project, r.id, r.direction, r.edge_type, r.other, o.name FROM rel r JOIN live l ON r.project = l.project AND r.id = l.id
JOIN live o ON r.project = o.project AND r.other = o.id WHERE r.edge_type IN ('INHERITS', 'IMPLEMENTS', 'IMPORTS')""",
    )
)
def jn03_related_both_ways(spark, d):
    return T.related(g(spark, d), ["INHERITS", "IMPLEMENTS", "IMPORTS"]).select("project", "id", "direction", "edge_type", "other", "name")


@query(
    cte(
        LIVE,
        body="SELECT l.project, l.id, l.parent_id, p.name AS parent_name, p.node_type AS parent_type FROM live l LEFT JOIN live p ON l.project = p.project AND l.parent_id = p.id",
    )
)
def jn04_parent_left_join(spark, d):
    return T.parents(g(spark, d))


@query(
    cte(
        LIVE, EDGES,
        body="""SELECT l.project, l.id, l.node_type, count(c.id) AS child_count FROM live l LEFT JOIN edges e ON e.project = l.project AND e.source = l.id AND e.edge_type = 'CONTAINS'
LEFT JOIN live c ON c.project = e.project AND c.id = e.target GROUP BY ALL""",
    )
)
def jn05_child_counts(spark, d):
    return T.child_counts(g(spark, d))


@query(
    cte(
        LIVE, EDGES,
        body="""SELECT c.project, p.id AS source, c.id AS target FROM live c JOIN live p ON c.project = p.project AND c.parent_id = p.id
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project = c.project AND e.source = p.id AND e.target = c.id AND e.edge_type = 'CONTAINS')""",
    )
)
def jn06_missing_contains(spark, d):
    return T.missing_contains(g(spark, d))


@query(cte(EDGES, EXT, body="SELECT project, id, name, kind FROM ext x WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project = x.project AND e.target = x.id)"))
def jn07_orphan_externals(spark, d):
    return T.orphan_externals(g(spark, d))


@query("SELECT p.project, EXISTS (SELECT 1 FROM code_nodes n WHERE n.project = p.project) AS indexed FROM projects p")
def jn08_is_indexed(spark, d):
    known = table(spark, d, "code_nodes").select("project").distinct().withColumn("indexed", F.lit(True))
    return table(spark, d, "projects").select("project").join(known, "project", "left").select("project", F.coalesce("indexed", F.lit(False)).alias("indexed"))


@query(
    cte(
        LIVE, EDGES,
        """
module AS (SELECT project, file_path, min(id) AS module FROM live WHERE node_type IN ('module', 'document') GROUP BY ALL),
own AS (SELECT l.project, l.id, l.file_path, m.module FROM live l JOIN module m ON l.project = m.project AND l.file_path = m.file_path)""",
        body="""SELECT e.project, a.module AS from_module, b.module AS to_module, count(*) AS weight FROM edges e JOIN own a ON e.project = a.project AND e.source = a.id
JOIN own b ON e.project = b.project AND e.target = b.id WHERE e.edge_type <> 'CONTAINS' AND a.file_path <> b.file_path GROUP BY ALL""",
    )
)
def jn09_module_edges(spark, d):
    return T.module_edges(g(spark, d, "node_type", "file_path"))


@query(
    cte(
        LIVE, EDGES,
        """con AS (SELECT project, source, target FROM edges WHERE edge_type = 'CONTAINS'),
l1 AS (SELECT r.project, r.id AS root, c.target AS at, 1 AS depth FROM live r JOIN con c ON c.project = r.project AND c.source = r.id WHERE r.node_type = 'directory' AND r.parent_id IS NULL),
l2 AS (SELECT l.project, l.root, c.target AS at, 2 AS depth FROM l1 l JOIN con c ON c.project = l.project AND c.source = l.at),
l3 AS (SELECT l.project, l.root, c.target AS at, 3 AS depth FROM l2 l JOIN con c ON c.project = l.project AND c.source = l.at)""",
        body="""SELECT x.project, x.root, x.at AS id, min(x.depth) AS depth FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) x
JOIN live n ON n.project = x.project AND n.id = x.at WHERE x.root <> x.at GROUP BY ALL""",
    )
)
def jn11_structure_depth3(spark, d):
    x = g(spark, d, "node_type", "parent_id")
    return T.structure(x, x.nodes.where("node_type = 'directory' AND parent_id IS NULL"), 3)


@query(
    cte(
        """up AS (SELECT project, id, id AS at, 0 AS k, name, parent_id FROM live UNION ALL
SELECT u.project, u.id, p.id, u.k + 1, p.name, p.parent_id FROM up u JOIN live p ON p.project = u.project AND p.id = u.parent_id WHERE u.k < 26)""",
        body="SELECT project, id, string_agg(coalesce(name, ''), ' / ' ORDER BY k DESC) AS crumbs FROM up GROUP BY project, id HAVING max(k) < 26",
    ).replace("WITH ", "WITH RECURSIVE " + LIVE + ",", 1)
)
def jn12_breadcrumbs(spark, d):
    b = T.all_breadcrumbs(g(spark, d, "name", "parent_id")).where("depth <= 25 and cycle_id is null")
    return b.select("project", "id", F.array_join("path", " / ").alias("crumbs"))


_CUR = _WALK[_WALK.index("cur AS (") : _WALK.index("), links")]


@query(
    _WALK.replace("WITH RECURSIVE ", "WITH RECURSIVE " + LIVE + ", ", 1).replace(_CUR, "cur AS (SELECT project, id, parent_id FROM live", 1)
    + """, crumbs AS (SELECT w.project, w.id, string_agg(coalesce(l.name, ''), ' / ' ORDER BY w.steps DESC) AS crumbs, max(w.steps)::INT AS depth
  FROM walk w JOIN live l ON l.project = w.project AND l.id = w.pos GROUP BY ALL)
SELECT n.project, n.id, c.crumbs, c.depth, n.cycle_id FROM nodes n JOIN crumbs c USING (project, id)"""
)
def jn12_all_breadcrumbs(spark, d):
    b = T.all_breadcrumbs(g(spark, d, "name", "parent_id"))
    return b.select("project", "id", F.array_join("path", " / ").alias("crumbs"), "depth", "cycle_id")


_HOP = "SELECT DISTINCT r.project, r.other AS id FROM rel r JOIN {a} a ON r.project = a.project AND r.id = a.id WHERE EXISTS (SELECT 1 FROM live l WHERE l.project = r.project AND l.id = r.other)"


@query(
    cte(
        LIVE, EDGES, REL,
        f"""h0 AS (SELECT project, id FROM live WHERE node_type = 'struct'),
a1 AS ({_HOP.format(a='h0')}), h1 AS (SELECT * FROM a1 EXCEPT SELECT * FROM h0),
a2 AS ({_HOP.format(a='h1')}), h2 AS (SELECT * FROM a2 EXCEPT SELECT * FROM h0 EXCEPT SELECT * FROM h1)""",
        body="SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2",
    )
)
def jn13_neighbourhood(spark, d):
    x = g(spark, d, "node_type")
    return T.neighbourhood(x, x.nodes.where("node_type = 'struct'"), 2)


@query(
    cte(
        LIVE, CHUNKS,
        "fn AS (SELECT project, id, file_path, line_start, line_end FROM live WHERE node_type IN ('function', 'method', 'class', 'struct'))",
        body="""SELECT p.project, p.file_path, p.line, (SELECT f.id FROM fn f WHERE f.project = p.project AND f.file_path = p.file_path AND p.line BETWEEN f.line_start AND f.line_end
  ORDER BY f.line_start DESC, f.id LIMIT 1) AS span
FROM (SELECT DISTINCT project, file_path, start_line + 3 AS line FROM ch WHERE start_line IS NOT NULL) p
WHERE EXISTS (SELECT 1 FROM fn f WHERE f.project = p.project AND f.file_path = p.file_path AND p.line BETWEEN f.line_start AND f.line_end)""",
    )
)
def jn15_innermost_span(spark, d):
    x = g(spark, d, "node_type", "file_path", "line_start", "line_end")
    spans = x.nodes.where(F.col("node_type").isin("function", "method", "class", "struct"))
    points = x.chunks.where(F.col("start_line").isNotNull()).select("project", "file_path", (F.col("start_line") + 3).alias("line")).distinct()
    return T.innermost(spans, points)


@query(cte(LIVE, EDGES, INNER, body="SELECT project, source, edge_type, target, resolution FROM inn"))
def jn17_resolved_edges(spark, d):
    x = g(spark, d, "name")
    live = x.nodes.select("project", "id")
    e = x.edges.join(live.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").join(live.withColumnRenamed("id", "target"), ["project", "target"], "left_semi")
    return e.select(*M.EDGE_KEY, "resolution")


@query(cte(LIVE, EDGES, INNER, body="SELECT project, id, count(*) AS degree FROM (SELECT project, source AS id FROM inn UNION ALL SELECT project, target FROM inn) GROUP BY ALL"))
def jn18_degree(spark, d):
    return T.degrees(g(spark, d, "name"))


# ---- 2.6 aggregations ----


@query(
    cte(
        LIVE, EDGES, INNER, CHUNKS,
        body="""SELECT n.project, n.nodes, coalesce(c.chunks, 0) AS chunks, n.embedded_summaries, coalesce(e.k, 0) + coalesce(h.k, 0) AS edges
FROM (SELECT project, count(*) AS nodes, count(*) FILTER (has_vec) AS embedded_summaries FROM live GROUP BY 1) n
LEFT JOIN (SELECT project, count(*) AS chunks FROM ch GROUP BY 1) c USING (project)
LEFT JOIN (SELECT project, count(*) AS k FROM inn GROUP BY 1) e USING (project)
LEFT JOIN (SELECT c.project, count(*) AS k FROM ch c WHERE EXISTS (SELECT 1 FROM live l WHERE l.project = c.project AND l.id = c.node_id) GROUP BY 1) h USING (project)""",
    )
)
def agg01_project_stats(spark, d):
    return A.project_stats(g(spark, d, "summary_embedding"))


@query(cte(LIVE, body="SELECT project, count(*) AS entities, count(*) FILTER (node_type IN ('module', 'document')) AS files, count(*) FILTER (summary IS NOT NULL AND summary <> '') AS summaries FROM live GROUP BY 1"))
def agg02_project_list(spark, d):
    return A.project_list(g(spark, d, "node_type", "summary").nodes)


@query(cte(LIVE, body="SELECT project, node_type, count(*) AS n FROM live GROUP BY ALL"))
def agg03_type_histogram(spark, d):
    return A.type_histogram(g(spark, d, "node_type").nodes)


@query(cte(LIVE, EDGES, INNER, body="SELECT project, edge_type, count(*) AS n FROM inn GROUP BY ALL"))
def agg04_relation_histogram(spark, d):
    return A.relation_histogram(g(spark, d, "name"))


@query(
    cte(
        LIVE,
        body="""SELECT project, count(*) AS entities, count(*) FILTER (node_type IN ('module', 'document')) AS files, count(*) FILTER (summary IS NOT NULL AND summary <> '') AS summarized,
count(*) FILTER (node_type <> 'directory') AS summarizable, count(*) FILTER (has_vec) AS embeddings FROM live GROUP BY 1""",
    )
)
def agg05_totals(spark, d):
    return A.totals(g(spark, d, "node_type", "summary", "summary_embedding").nodes)


@query(cte(CHUNKS, body="SELECT project, count(*) AS chunks FROM ch GROUP BY 1"))
def agg06_chunk_count(spark, d):
    return g(spark, d).chunks.groupBy("project").agg(F.count(F.lit(1)).alias("chunks"))


_TOP = """SELECT project, id, name, file_path, n, place FROM (
  SELECT c.project, c.id, l.name, l.file_path, c.n, row_number() OVER (PARTITION BY c.project ORDER BY c.n DESC, c.id) AS place
  FROM (SELECT project, target AS id, count(*) AS n FROM edges WHERE edge_type = '{t}' GROUP BY ALL) c JOIN live l ON l.project = c.project AND l.id = c.id) WHERE place <= 8"""


@query(cte(LIVE, EDGES, body=_TOP.format(t="CALLS")))
def agg07_most_called(spark, d):
    return A.top_targets(g(spark, d, "name", "file_path"), "CALLS")


@query(cte(LIVE, EDGES, body=_TOP.format(t="IMPORTS")))
def agg08_most_imported(spark, d):
    return A.top_targets(g(spark, d, "name", "file_path"), "IMPORTS")


@query(
    cte(
        LIVE,
        body="""SELECT f.project, f.file_path, f.n, f.place, m.module FROM (
  SELECT project, file_path, count(*) AS n, row_number() OVER (PARTITION BY project ORDER BY count(*) DESC, file_path) AS place
  FROM live WHERE node_type NOT IN ('directory', 'module') AND file_path IS NOT NULL GROUP BY project, file_path) f
LEFT JOIN (SELECT project, file_path, min(id) AS module FROM live WHERE node_type = 'module' GROUP BY ALL) m USING (project, file_path) WHERE f.place <= 8""",
    )
)
def agg09_largest_files(spark, d):
    return A.largest_files(g(spark, d, "node_type", "file_path"))


_LANG = "CASE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGE_BY_SUFFIX.items()) + " ELSE 'other' END"


@query(cte(LIVE, body=f"SELECT project, {_LANG} AS language, count(*) AS files FROM live WHERE node_type = 'module' GROUP BY ALL"))
def agg10_language_histogram(spark, d):
    return A.language_histogram(g(spark, d, "node_type", "file_path").nodes)


@query(cte(EDGES, body="SELECT project, source AS id, count(*) AS n FROM edges WHERE edge_type = 'CONTAINS' GROUP BY ALL"))
def agg12_container_sizes(spark, d):
    return A.container_sizes(g(spark, d))


@query(cte(EDGES, EXT, body="SELECT e.project, x.root, count(*) AS uses, count(DISTINCT e.source) AS users FROM edges e JOIN ext x ON e.project = x.project AND e.target = x.id GROUP BY ALL"))
def agg16_dependency_usage(spark, d):
    return A.dependency_usage(g(spark, d))


@query(
    cte(
        LIVE, EDGES,
        body="""SELECT project, id, name FROM live l WHERE node_type IN ('function', 'method') AND coalesce(len(external_calls), 0) = 0 AND coalesce(len(unresolved_calls), 0) = 0
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.edge_type = 'CALLS' AND e.project = l.project AND e.source = l.id)""",
    )
)
def agg21_call_leaves(spark, d):
    return A.call_leaves(g(spark, d, "name", "node_type", "external_calls", "unresolved_calls"))


@query(cte(EXT, body="SELECT kind, count(*) AS n, count(DISTINCT root) AS roots FROM ext GROUP BY 1"))
def agg22_external_kinds(spark, d):
    return A.external_kinds(g(spark, d).externals)


@query(cte(EDGES, body="SELECT project, nullif(resolution, '') AS resolution, count(*) AS n FROM edges WHERE edge_type = 'CALLS' GROUP BY ALL"))
def agg24_calls_by_resolution(spark, d):
    return A.calls_by_resolution(g(spark, d))


@query(cte(CHUNKS, body="SELECT project, node_id, count(*) AS n_chunks, sum(length(content))::BIGINT AS chars FROM ch WHERE node_id IS NOT NULL GROUP BY ALL"))
def agg19_chunks_per_node(spark, d):
    return A.chunk_counts(M.merged_chunks(table(spark, d, "chunks"), ["node_id", "content"]))


@query(
    cte(
        LIVE,
        body="""SELECT project, parent_id AS id, count(*) AS children, sha256(string_agg(concat_ws(' ', node_type, concat(coalesce(name, ''), ':'), coalesce(summary, '')), chr(10)
  ORDER BY coalesce(file_path, ''), coalesce(line_start, 0), id)) AS input_hash FROM live WHERE parent_id IS NOT NULL GROUP BY ALL""",
    )
)
def agg23_container_hash(spark, d):
    return A.child_lines(g(spark, d))


# ---- 2.8 sort, limit, pages; 2.11 graph tools ----


@query(cte(LIVE, body=f"SELECT id, name, node_type, file_path, line_start FROM live WHERE project = '{PROJECT}' ORDER BY file_path NULLS FIRST, line_start NULLS FIRST, name NULLS FIRST, id LIMIT 50 OFFSET 20"))
def gr01_list_entities(spark, d):
    n = g(spark, d, "name", "node_type", "file_path", "line_start").project(PROJECT).nodes
    return P.page(n.select("id", "name", "node_type", "file_path", "line_start"), ["file_path", "line_start", "name", "id"], 50, 20)


@query(
    cte(
        LIVE, EDGES, REL, EXT,
        """named AS (SELECT project, id, name FROM live UNION ALL SELECT project, id, name FROM ext),
sec AS (SELECT r.project, r.id, CASE WHEN direction = 'outgoing' AND edge_type = 'CONTAINS' THEN 'children' WHEN direction = 'outgoing' THEN 'outgoing' ELSE 'incoming' END AS section, r.edge_type, r.other, n.name
        FROM rel r JOIN named n ON n.project = r.project AND n.id = r.other)""",
        body="""SELECT project, id, section, place, edge_type, other, name FROM (
  SELECT *, row_number() OVER (PARTITION BY project, id, section ORDER BY edge_type, other) AS place FROM sec WHERE section <> 'incoming' OR NOT starts_with(other, 'ext:')) WHERE place <= 5""",
    )
)
def gr03_context_sections(spark, d):
    return T.context_sections(g(spark, d, "name"), 5)


@query(
    cte(
        LIVE,
        body="""SELECT project, id, node_type, name FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY CASE node_type WHEN 'directory' THEN 0 WHEN 'module' THEN 1 ELSE 2 END,
  file_path NULLS FIRST, line_start NULLS FIRST, name NULLS FIRST, id) AS p FROM live) WHERE p <= 40""",
    )
)
def lim10_tree_order(spark, d):
    n = g(spark, d, "name", "node_type", "file_path", "line_start").nodes
    rank = F.when(F.col("node_type") == "directory", 0).when(F.col("node_type") == "module", 1).otherwise(2)
    return P.page_per_group(n, ["project"], [rank, "file_path", "line_start", "name", "id"], 40).select("project", "id", "node_type", "name")


@query(
    cte(
        LIVE, EDGES, INNER,
        """deg AS (SELECT project, id, count(*) AS degree FROM (SELECT project, source AS id FROM inn UNION ALL SELECT project, target FROM inn) GROUP BY ALL)""",
        body="""SELECT * FROM (SELECT l.project, l.id, l.node_type, coalesce(d.degree, 0) AS degree, row_number() OVER (PARTITION BY l.project
  ORDER BY CASE l.node_type WHEN 'directory' THEN 0 WHEN 'module' THEN 1 ELSE 2 END, coalesce(d.degree, 0) DESC, l.id) AS place
FROM live l LEFT JOIN deg d ON d.project = l.project AND d.id = l.id) WHERE place <= 60""",
    )
)
def lim09_graph_cap(spark, d):
    return T.graph_cap(g(spark, d, "node_type"), 60)


@query(cte(LIVE, body="SELECT project, id, name, node_type FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_path NULLS FIRST, line_start NULLS FIRST, name NULLS FIRST, id) AS p FROM live WHERE contains(lower(name), 'cache')) WHERE p <= 20"))
def sr05_search_entities(spark, d):
    n = g(spark, d, "name", "node_type", "file_path", "line_start").nodes.where(F.contains(F.lower("name"), F.lit("cache")))
    return P.page_per_group(n, ["project"], ["file_path", "line_start", "name", "id"], 20).select("project", "id", "name", "node_type")


# ---- 2.12 chunking, hashing, cost ----


@query(
    """SELECT doc_id, w AS "window", substring(text, w * 400 + 1, 500) AS content FROM (
  SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 100) / 400.0), 1)::BIGINT))::INT AS w FROM documents WHERE length(text) > 0)
WHERE regexp_matches(substring(text, w * 400 + 1, 500), '\\S')"""
)
def chk06_char_windows(spark, d):
    return K.char_windows(table(spark, d, "documents"), ["doc_id"], "text", 500, 100)


@query(
    cte(
        CHUNKS,
        body="""SELECT project, id, concat('chunk:', substring(sha256(concat_ws(chr(0), coalesce(node_id, ''), coalesce(file_path, ''), coalesce(start_line::VARCHAR, ''), coalesce(end_line::VARCHAR, ''),
  coalesce(chunk_kind, ''), coalesce(content, ''))), 1, 16)) AS derived_id FROM ch""",
    )
)
def chk09_chunk_ids(spark, d):
    return K.with_ids(M.merged_chunks(table(spark, d, "chunks"))).select("project", "id", "derived_id")


_BODY = """
src AS (SELECT project, file_path, r.content FROM (SELECT project, file_path, max(struct_pack(indexed_at, content)) AS r FROM source_files WHERE content IS NOT NULL GROUP BY ALL)),
body AS (SELECT l.project, l.id, l.line_start, l.line_end, string_split(replace(regexp_replace(s.content, '\\r\\n?', chr(10), 'g'), chr(13), chr(10)), chr(10))[l.line_start:l.line_end] AS lines
  FROM live l JOIN src s ON s.project = l.project AND s.file_path = l.file_path
  WHERE l.node_type IN ('function', 'method') AND l.line_start IS NOT NULL AND l.line_end >= l.line_start)"""


def newest_files(spark, d):
    """The newest text of each file."""
    f = table(spark, d, "source_files").where(F.col("content").isNotNull() & F.col("project").isNotNull() & F.col("file_path").isNotNull())
    return f.groupBy("project", "file_path").agg(F.max(F.struct("indexed_at", "content")).getField("content").alias("content"))


@query(
    cte(
        LIVE, _BODY,
        """win AS (SELECT *, unnest(range(0, greatest(ceil((len(lines) - 5) / 15.0), 1)::BIGINT))::INT AS w FROM body WHERE len(lines) > 0)""",
        body="""SELECT project, id, w AS "window", sha256(array_to_string(lines[w * 15 + 1 : w * 15 + 20], chr(10))) AS hash, line_start + w * 15 AS start_line,
  (line_start + least(w * 15 + 20, len(lines)) - 1)::INT AS end_line FROM win WHERE regexp_matches(array_to_string(lines[w * 15 + 1 : w * 15 + 20], chr(10)), '\\S')""",
    )
)
def chk02_body_windows(spark, d):
    n = g(spark, d, "node_type", "file_path", "line_start", "line_end").nodes
    files = newest_files(spark, d)
    w = K.body_windows(K.node_bodies(n, files), 20, 5)
    return w.select("project", "id", "window", F.sha2("content", 256).alias("hash"), "start_line", "end_line")


@query(
    cte(
        LIVE, _BODY,
        body="""SELECT b.project, b.id, sha256(concat_ws(chr(0), array_to_string(b.lines, chr(10)), coalesce(l.signature, ''), coalesce(l.docstring, ''))) AS input_hash
FROM body b JOIN live l ON l.project = b.project AND l.id = b.id""",
    )
)
def sum01_leaf_hash(spark, d):
    n = g(spark, d, "node_type", "file_path", "line_start", "line_end", "signature", "docstring").nodes
    files = newest_files(spark, d)
    b = K.node_bodies(n, files).join(n.select("project", "id", "signature", "docstring"), ["project", "id"])
    return b.select("project", "id", X.source_hash(F.array_join("lines", "\n"), F.col("signature"), F.col("docstring")).alias("input_hash"))


@query(
    """SELECT project, count(*) AS files, sum(b)::BIGINT AS bytes, sum(floor(l / 10))::BIGINT AS nodes, sum(floor(b / 4))::BIGINT AS tokens,
round(((sum(floor(b / 4)) + 250 * sum(floor(l / 10))) * 0.25 + 90 * sum(floor(l / 10)) * 1.5 + (sum(floor(b / 4)) + 90 * sum(floor(l / 10))) * 0.02) / 1e6, 4) AS cost
FROM (SELECT project, strlen(content) AS b, length(regexp_replace(content, '[^\n]', '', 'g')) + 1 AS l FROM (SELECT DISTINCT project, file_path, content FROM source_files WHERE content IS NOT NULL)) GROUP BY 1"""
)
def cst01_index_cost(spark, d):
    return K.cost(table(spark, d, "source_files").where(F.col("content").isNotNull()).select("project", "file_path", "content").distinct())


# ---- 2.10 search ----

_BM = """
tok AS (SELECT {keys}, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS t FROM {src} WHERE {text} IS NOT NULL),
b AS (SELECT *, len(t) AS dl, [{tfs}] AS tf FROM tok),
c AS (SELECT {scope}, count(*) AS n, avg(dl) AS av, {dfs} FROM b GROUP BY {scope})"""


def _bm(keys: str, text: str, src: str, scope: str, terms: list[str]) -> tuple[str, str]:
    terms = sorted(terms)
    tfs = ", ".join(f"len(list_filter(t, lambda x: x = '{x}'))" for x in terms)
    dfs = ", ".join(f"count(*) FILTER (tf[{i + 1}] > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(
        f"CASE WHEN tf[{i + 1}] > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf[{i + 1}] * 2.2 / (tf[{i + 1}] + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0 END" for i in range(len(terms))
    )
    ks = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    return _BM.format(keys=keys, text=text, src=src, scope=scope, tfs=tfs, dfs=dfs), f"SELECT {ks}, round({part}, 6) AS score FROM b JOIN c USING ({scope}) WHERE list_sum(tf) > 0"


_TXT1 = _bm("project, id", "summary", "live", "project", ["cache", "parse", "ledger"])
_TXT2 = _bm("project, id", "sym", "(SELECT *, concat_ws(' ', name, signature) AS sym FROM live)", "project", ["batch", "limit"])
_TXT3 = _bm("project, id, node_id", "content", "ch", "project", ["restore", "ledger", "error"])
_DOC = _bm("lang, doc_id", "text", "documents", "lang", ["ledger", "invoice", "crash"])


@query(cte(LIVE, _TXT1[0], body=_TXT1[1]))
def txt01_summary_bm25(spark, d):
    return S.bm25(g(spark, d, "summary").nodes, "cache parse ledger", ["project", "id"], "summary")


@query(cte(LIVE, _TXT2[0], body=_TXT2[1]))
def txt02_symbol_bm25(spark, d):
    n = g(spark, d, "name", "signature").nodes.withColumn("sym", F.concat_ws(" ", "name", "signature"))
    return S.bm25(n, "batch limit", ["project", "id"], "sym")


@query(cte(CHUNKS, _TXT3[0], body=_TXT3[1]))
def txt03_code_bm25(spark, d):
    query = "error: restore(ledger)"
    chunks = S.counted(table(spark, d, "chunks").select("project", "id", "indexed_at", "node_id", "content"), query, "content")
    return S.score_counted(M.merged_chunks(chunks, ["node_id", "_dl", "_f"]), query, ["project", "id", "node_id"])


@query("WITH " + _DOC[0] + _DOC[1])
def txt04_document_bm25(spark, d):
    return S.bm25(table(spark, d, "documents"), "invoice ledger crash", ["lang", "doc_id"], "text", "lang")


@query(
    cte(
        LIVE, CHUNKS, *[x[0].replace("tok AS", f"tok{i} AS").replace("FROM tok)", f"FROM tok{i})").replace("b AS (", f"b{i} AS (").replace("c AS (", f"c{i} AS (").replace("FROM b GROUP", f"FROM b{i} GROUP") for i, x in enumerate((_TXT1, _TXT2, _TXT3))],
        body="""SELECT project, id, max(score) AS score, CASE WHEN count(DISTINCT src) > 1 THEN 'text' ELSE any_value(src) END AS source_type FROM (
"""
        + " UNION ALL ".join(
            "SELECT project, {k} AS id, score, '{s}' AS src FROM ({q}) WHERE {k} IS NOT NULL".format(
                k="node_id" if i == 2 else "id", s=("summary", "name", "code")[i], q=x[1].replace("b.", f"b{i}.").replace("FROM b JOIN c", f"FROM b{i} JOIN c{i}")
            )
            for i, x in enumerate((_TXT1, _TXT2, _TXT3))
        )
        + ") GROUP BY project, id",
    )
)
def sr04_fused_text(spark, d):
    code = txt03_code_bm25(spark, d).where(F.col("node_id").isNotNull()).select("project", F.col("node_id").alias("id"), "score")
    return S.fuse({"summary": txt01_summary_bm25(spark, d), "name": txt02_symbol_bm25(spark, d), "code": code}, ["project", "id"], ["code", "summary", "name"])


#: A fixed query vector of 64 values.
QUERY_VECTOR = [round(((i * 37) % 64 - 31.5) / 32, 4) for i in range(64)]
_COS = "round(list_dot_product({v}::DOUBLE[], {q}) / sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])) / " + repr(sum(x * x for x in QUERY_VECTOR) ** 0.5) + ", 6)"


def _cos(v: str) -> str:
    return _COS.format(v=v, q=f"{QUERY_VECTOR}::DOUBLE[]")


_VCHUNK = "v AS (SELECT project, id, max(struct_pack(indexed_at, node_id, start_line, end_line, embedding)) AS r FROM chunks GROUP BY ALL)"


@query("WITH " + _VCHUNK + f", s AS (SELECT project, id, {_cos('r.embedding')} AS score FROM v WHERE len(r.embedding) = 64 AND list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]) > 0) SELECT * FROM s ORDER BY score DESC, project, id LIMIT 100")
def vec01_chunk_vectors(spark, d):
    c = M.merged_chunks(table(spark, d, "chunks"), ["embedding"])
    return S.vector_search(c, "embedding", QUERY_VECTOR, 100, "project", "id").select("project", "id", "score")


@query(
    f"""WITH v AS (SELECT project, id, max(struct_pack(indexed_at, deleted_at, summary_embedding)) AS r FROM code_nodes GROUP BY ALL),
s AS (SELECT project, id, {_cos('r.summary_embedding')} AS score FROM v WHERE r.deleted_at IS NULL AND len(r.summary_embedding) = 64 AND list_dot_product(r.summary_embedding::DOUBLE[], r.summary_embedding::DOUBLE[]) > 0)
SELECT * FROM s ORDER BY score DESC, project, id LIMIT 100"""
)
def vec02_summary_vectors(spark, d):
    return S.vector_search(g(spark, d, "summary_embedding").nodes, "summary_embedding", QUERY_VECTOR, 100, "project", "id").select("project", "id", "score")


@query(f"SELECT vec_id, label, score FROM (SELECT vec_id, label, {_cos('embedding')} AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 50")
def vec03_embedding_topk(spark, d):
    return S.vector_search(table(spark, d, "embeddings"), "embedding", QUERY_VECTOR, 50, "vec_id").select("vec_id", "label", "score")


_SR1 = f"""SELECT project, r.node_id AS id, max(score) AS score, count(*) AS n_matches FROM (
SELECT project, r, {_cos('r.embedding')} AS score FROM v WHERE r.node_id IS NOT NULL AND len(r.embedding) = 64 AND list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]) > 0) WHERE score >= 0.1 GROUP BY ALL"""


@query("WITH " + _VCHUNK + " " + _SR1)
def sr01_code_hits(spark, d):
    c = M.merged_chunks(table(spark, d, "chunks"), ["node_id", "start_line", "end_line", "embedding"]).where(F.col("node_id").isNotNull())
    hits = S.vector_search(c.withColumnRenamed("id", "chunk_id"), "embedding", QUERY_VECTOR, None).where(F.col("score") >= 0.1)
    return S.group_hits(hits.withColumnRenamed("node_id", "id"), ["project", "id"]).select("project", "id", "score", F.size("matches").cast("long").alias("n_matches"))


@query(
    "WITH "
    + _VCHUNK
    + f""", w AS (SELECT project, id, max(struct_pack(indexed_at, deleted_at, summary_embedding)) AS r FROM code_nodes GROUP BY ALL),
code AS ({_SR1}), summ AS (SELECT project, id, {_cos('r.summary_embedding')} AS score FROM w WHERE r.deleted_at IS NULL AND len(r.summary_embedding) = 64 AND list_dot_product(r.summary_embedding::DOUBLE[], r.summary_embedding::DOUBLE[]) > 0)
SELECT project, id, max(score) AS score, CASE WHEN max(c) = 1 THEN 'hybrid' ELSE 'summary' END AS source_type FROM (
SELECT project, id, score, 1 AS c FROM code UNION ALL SELECT project, id, score, 0 FROM summ) WHERE score >= 0.1 GROUP BY ALL"""
)
def sr03_hybrid(spark, d):
    n = S.vector_search(g(spark, d, "summary_embedding").nodes, "summary_embedding", QUERY_VECTOR, None).select("project", "id", "score")
    return S.hybrid(sr01_code_hits(spark, d).select("project", "id", "score"), n, ["project", "id"], 0.1)
