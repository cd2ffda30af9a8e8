"""Queries of dashboard reads, chunking, summaries and import resolution, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovework.functions import text as X
from grovework.operators import chunking as K
from grovework.operators import imports as I
from grovework.operators import model as M
from grovework.operators import reconcile as RC
from grovework.operators import resolve as R
from grovework.operators import search as S
from grovework.operators import traverse as T
from grovework.plans.graph import CHUNK_LIGHT, LIGHT, QUERY_VECTOR, _cos, _VCHUNK, newest_files
from grovework.plans.sqlbase import CHUNKS, EDGES, EXT, INNER, LIVE, REL, cte
from grovework.runtime import table
from grovework.sources import parsers

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


def values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


_DEG = "deg AS (SELECT project, id, count(*) AS degree FROM (SELECT project, source AS id FROM inn UNION ALL SELECT project, target FROM inn) GROUP BY ALL)"


@query(
    cte(
        LIVE, EDGES, INNER, _DEG,
        """kept AS (SELECT project, id FROM (SELECT l.project, l.id, row_number() OVER (PARTITION BY l.project
  ORDER BY CASE l.node_type WHEN 'directory' THEN 0 WHEN 'module' THEN 1 ELSE 2 END, coalesce(d.degree, 0) DESC, l.id) AS place
FROM live l LEFT JOIN deg d ON d.project = l.project AND d.id = l.id) WHERE place <= 60)""",
        body="""SELECT * FROM (SELECT e.project, e.source, e.edge_type, e.target, row_number() OVER (PARTITION BY e.project ORDER BY e.source, e.edge_type, e.target) AS place
FROM edges e JOIN kept a ON a.project = e.project AND a.id = e.source JOIN kept b ON b.project = e.project AND b.id = e.target) WHERE place <= 100""",
    )
)
def lim09_graph_edges(spark, d):
    return T.graph_cap_edges(g(spark, d, "node_type"), 60, 100)


_RELATED = "reld AS (SELECT r.*, l.file_path, l.line_start FROM rel r JOIN live l ON l.project = r.project AND l.id = r.other WHERE EXISTS (SELECT 1 FROM live h WHERE h.project = r.project AND h.id = r.id))"


@query(
    cte(
        LIVE, EDGES, REL, _RELATED,
        body="""SELECT project, id, direction, edge_type, other, place FROM (SELECT *, row_number() OVER (PARTITION BY project, id, direction
  ORDER BY edge_type, file_path NULLS FIRST, line_start NULLS FIRST, other) AS place FROM reld WHERE edge_type <> 'CONTAINS') WHERE place <= 200""",
    )
)
def lim11_relations(spark, d):
    return T.relations_list(g(spark, d))


@query(
    cte(
        LIVE, EDGES, REL, _RELATED, CHUNKS,
        """k AS (SELECT project, id, count(*) FILTER (direction = 'outgoing' AND edge_type = 'CONTAINS') AS children, count(*) FILTER (direction = 'outgoing' AND edge_type <> 'CONTAINS') AS outgoing,
  count(*) FILTER (direction = 'incoming' AND edge_type <> 'CONTAINS') AS incoming FROM reld GROUP BY ALL), n AS (SELECT project, node_id AS id, count(*) AS chunks FROM ch WHERE node_id IS NOT NULL GROUP BY ALL)""",
        body="""SELECT l.project, l.id, l.name, coalesce(children, 0) AS children, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming, coalesce(chunks, 0) AS chunks
FROM live l LEFT JOIN k ON k.project = l.project AND k.id = l.id LEFT JOIN n ON n.project = l.project AND n.id = l.id""",
    )
)
def gr08_entity_detail(spark, d):
    return T.entity_detail(g(spark, d))


_SUMV = "w AS (SELECT project, id, max(struct_pack(indexed_at, deleted_at, summary_embedding)) AS r FROM code_nodes GROUP BY ALL)"
_SUMS = f"summ AS (SELECT project, id, {_cos('r.summary_embedding')} AS score FROM w WHERE r.deleted_at IS NULL AND len(r.summary_embedding) = 64 AND list_dot_product(r.summary_embedding::DOUBLE[], r.summary_embedding::DOUBLE[]) > 0)"
_CHS = f"chs AS (SELECT project, r.node_id AS id, max({_cos('r.embedding')}) AS score FROM v WHERE r.node_id IS NOT NULL AND len(r.embedding) = 64 AND list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]) > 0 GROUP BY ALL)"


def _hits(spark, d):
    n = S.vector_search(g(spark, d, "summary_embedding").nodes, "summary_embedding", QUERY_VECTOR, None).select("project", "id", "score")
    c = M.merged_chunks(table(spark, d, "chunks"), ["node_id", "embedding"]).where(F.col("node_id").isNotNull())
    c = S.vector_search(c.drop("id"), "embedding", QUERY_VECTOR, None).groupBy("project", F.col("node_id").alias("id")).agg(F.max("score").alias("score"))
    return n, c


@query(
    f"""WITH {_VCHUNK}, {_SUMV}, {_SUMS}, {_CHS},
ten AS (SELECT *, 0 AS src FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS p FROM summ) WHERE p <= 10
  UNION ALL SELECT *, 1 FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS p FROM chs) WHERE p <= 10),
one AS (SELECT project, id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY src) AS q FROM ten) WHERE q = 1)
SELECT * FROM (SELECT project, id, score, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS place FROM one) WHERE place <= 15"""
)
def sr07_semantic_panel(spark, d):
    return S.semantic_panel(*_hits(spark, d))


@query(
    cte(
        LIVE, _VCHUNK, _SUMV, _SUMS,
        """nm AS (SELECT project, id, round(CASE WHEN lower(name) = 'cache' THEN 1.0 ELSE 5.0 / length(name) END, 6) AS score FROM live WHERE contains(lower(name), 'cache')),
sy AS (SELECT project, id, round(1.0 / length(signature), 6) AS score FROM live WHERE contains(lower(signature), 'cache')),
su AS (SELECT project, id, round(1.0 / length(summary), 6) AS score FROM live WHERE contains(lower(summary), 'cache')),
al AS (SELECT *, 0 AS src, 15 AS most, 'name' AS section FROM nm UNION ALL SELECT *, 1, 10, 'text' FROM sy UNION ALL SELECT *, 2, 10, 'text' FROM su UNION ALL SELECT *, 3, 15, 'semantic' FROM summ),
rk AS (SELECT *, row_number() OVER (PARTITION BY project, src ORDER BY score DESC, id) AS p FROM al),
fs AS (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY src, p) AS f FROM rk WHERE p <= most)""",
        body="SELECT project, id, round(score, 3) AS score, section, row_number() OVER (PARTITION BY project ORDER BY src, p) AS place FROM fs WHERE f = 1",
    )
)
def sr06_quick_search(spark, d):
    n = g(spark, d, "name", "signature", "summary").nodes
    has = lambda c: n.where(F.contains(F.lower(c), F.lit("cache")))
    names = has("name").select("project", "id", F.round(F.when(F.lower("name") == "cache", 1.0).otherwise(F.lit(5.0) / F.length("name")), 6).alias("score"))
    by = lambda c: has(c).select("project", "id", F.round(F.lit(1.0) / F.length(c), 6).alias("score"))
    return S.quick_search(names, by("signature"), by("summary"), _hits(spark, d)[0])


# ---- chunks ----

_KIDS = """kids AS (SELECT project, parent_id AS id, string_agg(concat_ws(' ', node_type, coalesce(signature, name)), chr(10) ORDER BY coalesce(line_start, 0), id) AS kids FROM live WHERE parent_id IS NOT NULL GROUP BY ALL)"""


@query(
    cte(
        LIVE, _KIDS,
        body="""SELECT l.project, l.id, 'module_context' AS chunk_kind, concat_ws(chr(10), 'module ' || l.file_path, CASE WHEN l.docstring <> '' THEN l.docstring END, k.kids) AS content,
1 AS start_line, least(greatest(coalesce(l.line_end, 1), 1), 80) AS end_line FROM live l LEFT JOIN kids k ON k.project = l.project AND k.id = l.id WHERE l.node_type = 'module'""",
    )
)
def chk03_module_context(spark, d):
    return K.module_context(g(spark, d, "name", "node_type", "file_path", "line_start", "line_end", "signature", "docstring", "parent_id").nodes)


@query(
    cte(
        LIVE, _KIDS,
        body="""SELECT l.project, l.id, 'class_context' AS chunk_kind, concat_ws(chr(10), coalesce(nullif(l.signature, ''), 'class ' || coalesce(l.name, '')), CASE WHEN l.docstring <> '' THEN l.docstring END, k.kids) AS content,
coalesce(l.line_start, 1) AS start_line, least(greatest(coalesce(l.line_end, l.line_start, 1), coalesce(l.line_start, 1)), coalesce(l.line_start, 1) + 80) AS end_line
FROM live l LEFT JOIN kids k ON k.project = l.project AND k.id = l.id WHERE l.node_type = 'class'""",
    )
)
def chk04_class_context(spark, d):
    return K.class_context(g(spark, d, "name", "node_type", "file_path", "line_start", "line_end", "signature", "docstring", "parent_id").nodes)


@query(
    cte(
        CHUNKS,
        """l AS (SELECT project, node_id, start_line, id, unnest(string_split(replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(13), chr(10)), chr(10))) AS text,
  unnest(range(0, len(string_split(replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(13), chr(10)), chr(10))))) AS i
  FROM ch WHERE chunk_kind = 'function_body' AND node_id IS NOT NULL AND content IS NOT NULL AND start_line IS NOT NULL),
one AS (SELECT project, node_id, start_line + i AS line, first(text ORDER BY start_line, id) AS text FROM l GROUP BY ALL),
gap AS (SELECT *, CASE WHEN line > lag(line) OVER (PARTITION BY project, node_id ORDER BY line) + 1 THEN chr(10) || text ELSE text END AS t FROM one)""",
        body="SELECT project, node_id, min(line) AS first_line, count(*)::INT AS n_lines, string_agg(t, chr(10) ORDER BY line) AS text FROM gap GROUP BY ALL",
    )
)
def gr10_stitched_source(spark, d):
    c = M.merged_chunks(table(spark, d, "chunks"), ["node_id", "content", "start_line", "chunk_kind"])
    c = c.where((F.col("chunk_kind") == "function_body") & F.col("node_id").isNotNull() & F.col("content").isNotNull() & F.col("start_line").isNotNull())
    return K.stitch(c, ["project", "node_id"])


@query(
    cte(
        LIVE, _KIDS,
        "src AS (SELECT project, file_path, r.content FROM (SELECT project, file_path, max(struct_pack(indexed_at, content)) AS r FROM source_files WHERE content IS NOT NULL AND file_path IS NOT NULL GROUP BY ALL))",
        """b AS (SELECT l.project, l.id, string_split(replace(regexp_replace(s.content, '\\r\\n?', chr(10), 'g'), chr(13), chr(10)), chr(10))[l.line_start:l.line_end] AS lines FROM live l JOIN src s ON s.project = l.project AND s.file_path = l.file_path
  WHERE l.node_type IN ('function', 'method') AND l.line_start IS NOT NULL AND l.line_end >= l.line_start),
w AS (SELECT *, unnest(range(0, greatest(ceil((len(lines) - 12) / 68.0), 1)::BIGINT))::INT AS w FROM b WHERE len(lines) > 0)""",
        body="""SELECT project, 'function_body' AS chunk_kind, count(*) AS n FROM w WHERE regexp_matches(array_to_string(lines[w * 68 + 1 : w * 68 + 80], chr(10)), '\\S') GROUP BY 1
UNION ALL SELECT project, 'module_context', count(*) FROM live WHERE node_type = 'module' GROUP BY 1 UNION ALL SELECT project, 'class_context', count(*) FROM live WHERE node_type = 'class' GROUP BY 1""",
    )
)
def chk01_repository_chunks(spark, d):
    """Chunks of code by kind; documents are cut at sentences, which SQL cannot express (tests compare them with their texts)."""
    n = g(spark, d, "name", "node_type", "file_path", "line_start", "line_end", "signature", "docstring", "parent_id").nodes
    c = K.repository_chunks(n, newest_files(spark, d))
    return c.where("chunk_kind <> 'document'").groupBy("project", "chunk_kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def chk05_document_windows(spark, d):
    return K.document_windows(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text").select("doc_id", "window", "start_line", "end_line", F.md5("content").alias("hash"))


# ---- maintenance ----


@query(cte(EDGES, LIVE, INNER, body="SELECT project, source, edge_type, target FROM inn WHERE edge_type = 'CALLS' AND resolution = 'same-module'"))
def set02_stale_edges(spark, d):
    x = g(spark, d, "name")
    return RC.stale_edges(x.edges, x.edges.where("not (edge_type = 'CALLS' and resolution = 'same-module')"), x.nodes).select(*M.EDGE_KEY)


@query(
    cte(
        CHUNKS,
        "f AS (SELECT DISTINCT project, file_path FROM source_files WHERE file_path LIKE '%.py')",
        body="SELECT c.project, c.id FROM ch c JOIN f ON f.project = c.project AND f.file_path = c.file_path WHERE c.chunk_kind <> 'function_body'",
    )
)
def set03_stale_chunks(spark, d):
    c = M.merged_chunks(table(spark, d, "chunks"), ["file_path", "chunk_kind"])
    files = table(spark, d, "source_files").where(F.col("file_path").endswith(".py")).select("project", "file_path").distinct()
    return RC.stale_chunks(c, c.where("chunk_kind = 'function_body'"), files).select("project", "id")


@query(
    f"""WITH {_VCHUNK}, {_SUMV}, {_SUMS}, {_CHS}
SELECT project, id, score FROM (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY src) AS q FROM (SELECT *, 0 AS src FROM summ UNION ALL SELECT *, 1 FROM chs)) WHERE q = 1"""
)
def set05_first_list_wins(spark, d):
    return S.first_list_wins(list(_hits(spark, d)), ["project", "id"]).select("project", "id", "score")


@query(cte(EDGES, body="""SELECT project, source, edge_type, target, CASE WHEN edge_type = 'CALLS' THEN 'semantic' ELSE resolution END AS resolution, CASE WHEN edge_type = 'CALLS' THEN 'x' ELSE callee_text END AS callee_text FROM edges"""))
def snk02_upserted_edges(spark, d):
    e = g(spark, d, "name").edges
    new = e.where("edge_type = 'CALLS'").withColumn("resolution", F.lit("semantic")).withColumn("callee_text", F.lit("x"))
    return RC.upsert_edges(e, new)


@query(cte(CHUNKS, "v AS (SELECT project, id, max(struct_pack(indexed_at, embedding)) AS r FROM chunks GROUP BY ALL)", body="SELECT c.project, c.id, CASE WHEN c.chunk_kind = 'document' THEN 'again' ELSE c.chunk_kind END AS chunk_kind, v.r.embedding IS NOT NULL AS has_vec FROM ch c JOIN v ON v.project = c.project AND v.id = c.id"))
def snk04_upserted_chunks(spark, d):
    c = M.merged_chunks(table(spark, d, "chunks"), ["chunk_kind", "embedding"])
    new = c.where("chunk_kind = 'document'").withColumn("chunk_kind", F.lit("again")).withColumn("embedding", F.lit(None).cast("array<float>"))
    return K.upsert_chunks(c, new).select("project", "id", "chunk_kind", F.col("embedding").isNotNull().alias("has_vec"))


@query(cte(LIVE, EDGES, body="SELECT project, id FROM live WHERE node_type = 'class'"))
def snk06_deleted_nodes(spark, d):
    x = g(spark, d, "node_type")
    nodes, _ = RC.detach_delete(x.nodes, x.edges, x.nodes.where("node_type <> 'class'"))
    return nodes.select("project", "id")


@query(cte(LIVE, body="SELECT project, id FROM live WHERE coalesce(summary, '') <> '' AND (NOT has_vec OR (node_type = 'class' AND summary_input_hash IS NULL) OR (node_type = 'class' AND summary_input_hash IS NOT NULL))"))
def emb04_stale_by_hash(spark, d):
    n = M.live_nodes(table(spark, d, "code_nodes"), ["node_type", "summary", "summary_input_hash", "summary_embedding"])
    made = F.when(F.col("node_type") == "class", F.lit("another")).when(F.col("node_type") == "method", None).otherwise(F.coalesce("summary_input_hash", F.lit(None)))
    return RC.stale_summary_vectors(n, n.withColumn("vector_hash", made))


@query("SELECT project, file_path FROM (SELECT project, file_path, bool_and(r.embedding IS NOT NULL) AS ok FROM (SELECT r, project, r.file_path AS file_path FROM (SELECT project, id, max(struct_pack(indexed_at, file_path, embedding)) AS r FROM chunks GROUP BY project, id)) WHERE file_path IS NOT NULL GROUP BY ALL) WHERE ok")
def emb05_covered_files(spark, d):
    return K.covered_files(M.merged_chunks(table(spark, d, "chunks"), ["file_path", "embedding"]))


_COST = """c AS (SELECT project, round(((sum(floor(b / 4)) + 250 * sum(floor(l / 10))) * 0.25 + 90 * sum(floor(l / 10)) * 1.5 + (sum(floor(b / 4)) + 90 * sum(floor(l / 10))) * 0.02) / 1e6, 4) AS cost
FROM (SELECT project, strlen(content) AS b, length(regexp_replace(content, '[^\n]', '', 'g')) + 1 AS l FROM (SELECT DISTINCT project, file_path, content FROM source_files WHERE content IS NOT NULL {more})) GROUP BY 1)"""


@query("WITH " + _COST.format(more="AND file_path LIKE '%.py'") + " SELECT * FROM c")
def src10_estimate_paths(spark, d):
    f = table(spark, d, "source_files").where(F.col("content").isNotNull()).select("project", "file_path", "content").distinct()
    return K.cost_of_paths(f, ["*.py"]).select("project", "cost")


@query("WITH " + _COST.format(more="") + " SELECT * FROM c WHERE cost > 0.002")
def cst02_over_budget(spark, d):
    f = table(spark, d, "source_files").where(F.col("content").isNotNull()).select("project", "file_path", "content").distinct()
    return K.over_budget(K.cost(f), 0.002)


@query(cte(LIVE, body="SELECT project, id, CASE WHEN node_type <> 'module' THEN calls_provenance WHEN file_path LIKE '%.go' THEN 'scip-go' ELSE 'heuristic' END AS calls_provenance FROM live"))
def res25_provenance(spark, d):
    n = g(spark, d, "node_type", "file_path", "calls_provenance").nodes
    return R.with_provenance(n, n.where(F.col("file_path").endswith(".go")), "scip-go").select("project", "id", "calls_provenance")


@query("SELECT project, root_path, split_part(project, '_', -1) = substring(md5(root_path), 1, 8) AS ok FROM projects")
def gr15_root_verify(spark, d):
    p = table(spark, d, "projects")
    return p.select("project", "root_path", X.root_matches(F.col("project"), F.col("root_path")).alias("ok"))


@query(
    """WITH f AS (SELECT DISTINCT project, file_path, split_part(file_path, '/', -1) AS name FROM source_files WHERE file_path IS NOT NULL),
w AS (SELECT DISTINCT project, path AS wanted, split_part(path, '/', -1) AS name FROM file_changes WHERE path IS NOT NULL)
SELECT project, wanted, p.p AS file_path FROM (SELECT w.project, w.wanted, min(struct_pack(k := CASE WHEN f.file_path = w.wanted THEN 0 WHEN ends_with(f.file_path, '/' || w.wanted) OR ends_with(w.wanted, '/' || f.file_path) THEN 1 ELSE 2 END, p := f.file_path)) AS p
FROM w JOIN f ON f.project = w.project AND f.name = w.name GROUP BY ALL)"""
)
def gr16_find_files(spark, d):
    return T.find_files(table(spark, d, "source_files"), table(spark, d, "file_changes").select("project", F.col("path").alias("wanted")))


@query(cte(LIVE, body="SELECT project, id, CASE WHEN node_type IN ('function', 'method') AND file_path LIKE '%.go' THEN 0 ELSE coalesce(len(unresolved_calls), -1) END AS n FROM live"))
def res24_cleared_lists(spark, d):
    n = g(spark, d, "node_type", "file_path", "unresolved_calls").nodes
    c = R.clear_unresolved(n, n.where(F.col("file_path").endswith(".go")))
    return c.select("project", "id", F.coalesce(F.size("unresolved_calls"), F.lit(-1)).alias("n"))


# ---- imports ----

_TREE = ["src/app/__init__.py", "src/app/core.py", "src/app/sub/mod.py", "web/a.ts", "web/lib/index.tsx", "web/lib/b.js", "go.mod", "cmd/main.go", "pkg/util/z.go", "rs/src/lib.rs", "rs/src/net/tcp.rs"]
_IMPORTS = [
    ("src/app/core.py", "app.sub.mod.Thing", "src/app/sub/mod.py"), ("src/app/core.py", ".sub.mod.f", "src/app/sub/mod.py"), ("src/app/sub/mod.py", "..core.g", "src/app/core.py"), ("src/app/core.py", "json", None), ("src/app/core.py", "app.gone", "src/app/__init__.py"),
    ("web/a.ts", "./lib", "web/lib/index.tsx"), ("web/a.ts", "./lib/b", "web/lib/b.js"), ("web/lib/b.js", "../a", "web/a.ts"), ("web/a.ts", "react", None), ("cmd/main.go", "ex.org/app/pkg/util", "pkg/util/z.go"), ("cmd/main.go", "fmt", None), ("rs/src/lib.rs", "crate::net::tcp::Listener", "rs/src/net/tcp.rs"), ("rs/src/lib.rs", "std::io", None),
]


@query(values(_IMPORTS, "file_path, spec, target"))
def res13_imports(spark, d):
    """One case of each kind of import over a small tree."""
    files = spark.createDataFrame([("p", f, "module ex.org/app\n" if f == "go.mod" else None) for f in _TREE], "project string, file_path string, content string")
    imports = spark.createDataFrame([("p", f, s) for f, s, _ in _IMPORTS], "project string, file_path string, spec string")
    return I.resolve_imports(imports, files, I.go_modules(files)).select("file_path", "spec", "target")


@query(
    """WITH f AS (SELECT DISTINCT project, file_path, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS s FROM source_files WHERE project IS NOT NULL AND file_path IS NOT NULL),
k AS (SELECT project, file_path, CASE WHEN s = 'py' THEN 'python' WHEN s IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx') THEN 'javascript' WHEN s = 'go' THEN 'go' WHEN s = 'rs' THEN 'rust' END AS language FROM f),
m AS (SELECT project, language, file_path, CASE language
  WHEN 'python' THEN regexp_replace(replace(regexp_replace(regexp_replace(file_path, '\\.pyi?$', ''), '(^|/)__init__$', ''), '/', '.'), '^src\\.', '')
  WHEN 'javascript' THEN file_path WHEN 'go' THEN regexp_replace(file_path, '/?[^/]*$', '')
  WHEN 'rust' THEN replace('crate::' || replace(regexp_replace(regexp_replace(regexp_replace(file_path, '\\.rs$', ''), '^(.*/)?src/', ''), '(^|/)(mod|lib|main)$', ''), '/', '::'), 'crate::', 'crate::') END AS key FROM k WHERE language IS NOT NULL)
SELECT project, language, CASE WHEN key = 'crate::' THEN 'crate' ELSE key END AS key, max(file_path) AS target FROM m GROUP BY 1, 2, 3"""
)
def res14_module_index(spark, d):
    return I.module_index(table(spark, d, "source_files"))

# ---- parsers ----

#: Small files of three languages and what a reader finds in them.
_SOURCES = {
    'web/app.ts': 'import def, { save as keep, type T } from \'./lib\';\nimport * as ns from "./ns";\nconst { a, b: c } = require(\'m\');\nexport { z } from \'./z\';\n/** Runs it. */\nexport class App<T> extends ns.Base<T> implements One, Two<T> {\n  private x = new Map<string, number>();\n  run(x: number, {p, q: r}: any): void {\n    this.stop(); keep(1); a.b().c(); ns.f<string>(x); new Foo(2);\n    const inner = () => { def(x) };\n  }\n  stop() {}\n}\ninterface Shape { area(): number }\nenum E { A }\nconst go = async (v) => { run(v); let w = 1; };\nfunction plain(): void { plain() }\ntop.level(1);\n',
    'srv/main.go': 'package main\nimport (\n  "fmt"\n  u "app/util"\n)\ntype (\n  A struct { *Base; pkg.Other; log, out *Logger; m map[string]int `json:"x"` }\n  I interface { Do(x int) error }\n)\n// Save keeps it.\nfunc (s *A) Save(x int, ys ...string) error { s.log.Print(x); v, err := helper(x); for i := range ys { u.Go(i, v) }; return err }\nfunc helper(x int) (int, error) { fmt.Println(x); return func(z int) int { return z }(x), nil }\n',
    'rs/lib.rs': 'use std::{io, fmt::Display};\npub struct S<T> { a: u8 }\npub trait Tr { fn m(&self) -> u8; }\nimpl<T> Tr for S<T> {\n    /// Doc.\n    #[inline]\n    pub fn m(&self) -> u8 { self.help(1); Self::make(2); println!("{}", x(1)); vec.iter().map(f).collect::<Vec<_>>() }\n}\nmod inner { pub enum E { A(u8) } fn deep() { crate::top::go(); } }\n',
}
_OUTLINE = [
    ('rs/lib.rs', 'IMPORTS', 'std::{io, fmt::Display}', None, None), ('rs/lib.rs', 'module', '', 1, 10), ('rs/lib.rs::E', 'enum', 'rs/lib.rs', 9, 9),
    ('rs/lib.rs::S', 'IMPLEMENTS', 'Tr', None, None), ('rs/lib.rs::S', 'struct', 'rs/lib.rs', 2, 2), ('rs/lib.rs::S.m', 'CALLS', 'Self.make', None, None),
    ('rs/lib.rs::S.m', 'CALLS', 'self.help', None, None), ('rs/lib.rs::S.m', 'CALLS', 'vec.iter', None, None), ('rs/lib.rs::S.m', 'CALLS', 'x', None, None),
    ('rs/lib.rs::S.m', 'method', 'rs/lib.rs::S', 7, 7), ('rs/lib.rs::Tr', 'trait', 'rs/lib.rs', 3, 3), ('rs/lib.rs::Tr.m', 'method', 'rs/lib.rs::Tr', 3, 3),
    ('rs/lib.rs::deep', 'CALLS', 'crate.top.go', None, None), ('rs/lib.rs::deep', 'function', 'rs/lib.rs', 9, 9), ('srv/main.go', 'IMPORTS', 'app/util', None, None),
    ('srv/main.go', 'IMPORTS', 'fmt', None, None), ('srv/main.go', 'module', '', 1, 13), ('srv/main.go::A', 'INHERITS', 'Base', None, None),
    ('srv/main.go::A', 'INHERITS', 'pkg.Other', None, None), ('srv/main.go::A', 'struct', 'srv/main.go', 7, 7), ('srv/main.go::A.Save', 'CALLS', 'helper', None, None),
    ('srv/main.go::A.Save', 'CALLS', 's.log.Print', None, None), ('srv/main.go::A.Save', 'CALLS', 'u.Go', None, None), ('srv/main.go::A.Save', 'method', 'srv/main.go', 11, 11),
    ('srv/main.go::I', 'interface', 'srv/main.go', 8, 8), ('srv/main.go::helper', 'CALLS', 'fmt.Println', None, None), ('srv/main.go::helper', 'function', 'srv/main.go', 12, 12),
    ('web/app.ts', 'CALLS', 'require', None, None), ('web/app.ts', 'CALLS', 'top.level', None, None), ('web/app.ts', 'IMPORTS', './lib', None, None),
    ('web/app.ts', 'IMPORTS', './ns', None, None), ('web/app.ts', 'IMPORTS', './z', None, None), ('web/app.ts', 'IMPORTS', 'm', None, None),
    ('web/app.ts', 'module', '', 1, 19), ('web/app.ts::App', 'IMPLEMENTS', 'One', None, None), ('web/app.ts::App', 'IMPLEMENTS', 'Two', None, None),
    ('web/app.ts::App', 'INHERITS', 'ns.Base', None, None), ('web/app.ts::App', 'class', 'web/app.ts', 6, 13), ('web/app.ts::App.run', 'CALLS', 'Foo', None, None),
    ('web/app.ts::App.run', 'CALLS', 'a.b', None, None), ('web/app.ts::App.run', 'CALLS', 'def', None, None), ('web/app.ts::App.run', 'CALLS', 'keep', None, None),
    ('web/app.ts::App.run', 'CALLS', 'ns.f', None, None), ('web/app.ts::App.run', 'CALLS', 'this.stop', None, None), ('web/app.ts::App.run', 'method', 'web/app.ts::App', 8, 11),
    ('web/app.ts::App.stop', 'method', 'web/app.ts::App', 12, 12), ('web/app.ts::E', 'enum', 'web/app.ts', 15, 15), ('web/app.ts::Shape', 'interface', 'web/app.ts', 14, 14),
    ('web/app.ts::go', 'CALLS', 'run', None, None), ('web/app.ts::go', 'function', 'web/app.ts', 16, 16), ('web/app.ts::plain', 'CALLS', 'plain', None, None),
    ('web/app.ts::plain', 'function', 'web/app.ts', 17, 17),
]


@query(values(_OUTLINE, "id, kind, other, line_start, line_end"))
def par02_outlines(spark, d):
    """Nodes and edges (CONTAINS aside) of the sample files."""
    rows = parsers.parse(spark.createDataFrame(list(_SOURCES.items()), "file_path string, content string").select(F.lit("p").alias("project"), "file_path", "content"))
    found = rows.where("record in ('node', 'edge') and coalesce(edge_type, '') <> 'CONTAINS'")
    kind, other = F.coalesce("node_type", "edge_type"), F.when(F.col("record") == "node", F.coalesce("parent_id", F.lit(""))).otherwise(F.col("target"))
    return found.select("id", kind.alias("kind"), other.alias("other"), "line_start", "line_end").distinct()


_BOUND = [
    ("web/app.ts::App.run", "this.stop", "bound", "web/app.ts::App.stop"), ("web/app.ts::App.run", "keep", "bound", "web/lib/index.ts::save"), ("web/app.ts::App.run", "ns.f", "bound", "web/ns.ts::f"), ("web/app.ts::App.run", "a.b", "external", "m:a"), ("web/app.ts::App.run", "Foo", "unresolved", None),
    ("web/app.ts::App.run", "def", "unresolved", None), ("web/app.ts::go", "run", "unresolved", None), ("web/app.ts::plain", "plain", "bound", "web/app.ts::plain"), ("web/app.ts", "top.level", "unresolved", None), ("web/app.ts", "require", "skipped", None),
    ("srv/main.go::A.Save", "s.log.Print", "bound", "srv/log.go::Logger.Print"), ("srv/main.go::A.Save", "helper", "bound", "srv/main.go::helper"), ("srv/main.go::A.Save", "u.Go", "bound", "util/go.go::Go"), ("srv/main.go::helper", "fmt.Println", "external", "fmt"),
    ("rs/lib.rs::S.m", "self.help", "unresolved", None), ("rs/lib.rs::S.m", "Self.make", "unresolved", None), ("rs/lib.rs::S.m", "x", "unresolved", None), ("rs/lib.rs::S.m", "vec.iter", "unresolved", None), ("rs/lib.rs::deep", "crate.top.go", "unresolved", None),
]
_OTHERS = {
    "web/lib/index.ts": "export function save(x) {}\n", "web/ns.ts": "export function f(x) {}\n", "go.mod": "module app\n", "util/go.go": "package util\nfunc Go(i, v int) {}\n",
    "srv/log.go": "package main\ntype Logger struct{}\nfunc (l Logger) Print(x int) {}\n",
}


@query(values(_BOUND, "source, callee, outcome, target"))
def res00_rungs(spark, d):
    """Calls of the sample files: parsed, then bound, external, skipped or unresolved."""
    files = spark.createDataFrame(list((_SOURCES | _OTHERS).items()), "file_path string, content string").select(F.lit("p").alias("project"), "file_path", "content")
    rows = parsers.parse(files)
    n, e = parsers.parsed_nodes(rows), parsers.parsed_edges(rows)
    calls = e.where("edge_type = 'CALLS'").select("project", "source", F.col("target").alias("callee"), "ordinal")
    go = I.go_owner(files, I.go_modules(files))
    bases = R.resolve_bases(n, e.where("edge_type = 'INHERITS'").select("project", "source", "edge_type", F.col("target").alias("base")))
    found = R.resolve_calls(n, calls, parsers.parsed_facts(rows), bases.where("bound"), go)
    return found.where(F.col("source").rlike("^(web/app|srv/main|rs/lib)")).select("source", "callee", "outcome", "target")
