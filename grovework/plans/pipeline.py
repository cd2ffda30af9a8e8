"""Indexing queries: parsing, resolution, reconciliation, change streams, guard and ad-hoc language."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grovework.functions import text as X
from grovework.operators import chunking as K
from grovework.operators import model as M
from grovework.operators import reconcile as RC
from grovework.operators import resolve as R
from grovework.plans import cypher, guard
from grovework.plans.graph import PROJECT
from grovework.plans.sqlbase import CHUNKS, EDGES, EXT, LIVE, cte
from grovework.runtime import cut, shared_dir, table
from grovework.sources import parsers, repository
from grovework.streaming import changes as C

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark, d):
    f = table(spark, d, "source_files").where(F.col("content").isNotNull())
    return f.groupBy("project", "file_path").agg(F.max(F.struct("indexed_at", "content", "checksum")).alias("f")).select("project", "file_path", "f.content", "f.checksum")


_SRC = "src AS (SELECT project, file_path, r.content, r.checksum FROM (SELECT project, file_path, max(struct_pack(indexed_at, content, checksum)) AS r FROM source_files WHERE content IS NOT NULL GROUP BY ALL))"


# ---- sources ----


@query(
    f"""WITH {_SRC} SELECT project, file_path, (regexp_matches(file_path, '(^|/)[^/]*_pb2\\.py$|(^|/)[^/]*_pb2_grpc\\.py$|(^|/)[^/]*\\.pb\\.go$|(^|/)[^/]*\\.min\\.js$|(^|/)[^/]*\\.generated\\.[^/]*$|(^|/)[^/]*\\.g\\.dart$|(^|/)[^/]*_generated\\.go$|(^|/)zz_generated[^/]*$')
OR contains(substring(content, 1, 2048), '@generated') OR (contains(substring(content, 1, 2048), 'Code generated') AND contains(substring(content, 1, 2048), 'DO NOT EDIT'))) AS generated,
strlen(content) > 8192 AS large, md5(content) AS checksum FROM src"""
)
def src04_generated_size_checksum(spark, d):
    f = _files(spark, d)
    c = F.col("content")
    return f.select("project", "file_path", repository.looks_generated(F.col("file_path"), c).alias("generated"), (F.octet_length(c) > 8192).alias("large"), F.md5(c).alias("checksum"))


@query(
    f"""WITH {_SRC} SELECT CASE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGE_BY_SUFFIX.items())} ELSE 'other' END AS language,
count(*) AS files, sum(strlen(content))::BIGINT AS bytes, floor(sum(length(regexp_replace(content, '[^\n]', '', 'g')) + 1) / 10)::BIGINT AS nodes, floor(sum(strlen(content)) / 4)::BIGINT AS tokens FROM src GROUP BY 1"""
)
def src09_preview(spark, d):
    f = _files(spark, d).select(F.lit("keep").alias("verdict"), X.language_of(F.col("file_path")).alias("language"), F.octet_length("content").cast("long").alias("length"), "content")
    return repository.preview(f)


@query()
def par01_parsed_counts(spark, d):
    rows = parsers.parse(_files(spark, d))
    kind = F.coalesce("node_type", "edge_type", F.lit("-"))
    return rows.groupBy("project", "record", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query()
def par05_parsed_functions(spark, d):
    return parsers.parsed_nodes(parsers.parse(_files(spark, d))).where(F.col("node_type").isin("function", "method")).select("project", "id", "name", "line_start", "line_end", "signature")


# ---- resolution ----


@query()
def res06_resolved_calls(spark, d):
    rows = cut(parsers.parse(_files(spark, d)), "parsed")
    n, e, f = parsers.parsed_nodes(rows), parsers.parsed_edges(rows), parsers.parsed_facts(rows)
    calls = e.where("edge_type = 'CALLS'").select("project", "source", F.col("target").alias("callee"), "ordinal")
    return R.resolve_calls(n, calls, f).groupBy("project", "outcome", "resolution").agg(F.count(F.lit(1)).alias("n"))


@query(
    cte(
        LIVE, EDGES,
        """c AS (SELECT e.project, e.source, e.callee_text AS callee FROM edges e WHERE e.edge_type = 'CALLS' AND e.callee_text <> '' AND NOT contains(e.callee_text, '.') GROUP BY ALL),
o AS (SELECT c.*, l.file_path FROM c JOIN live l ON l.project = c.project AND l.id = c.source),
t AS (SELECT o.project, o.source, o.callee, min(n.id) AS target, count(DISTINCT n.id) AS k FROM o JOIN live n ON n.project = o.project AND n.file_path = o.file_path AND n.name = o.callee AND n.node_type IN ('function', 'class', 'struct') GROUP BY ALL)""",
        body="SELECT project, source, callee, target FROM t WHERE k = 1",
    )
)
def res09_same_module(spark, d):
    g = M.load_graph(spark, d, ["name", "node_type", "file_path", "parent_id"], ["node_id"])
    calls = g.edges.where((F.col("edge_type") == "CALLS") & (F.col("callee_text") != "") & ~F.contains("callee_text", F.lit("."))).select("project", "source", F.col("callee_text").alias("callee"), F.lit(0).alias("ordinal"))
    calls = calls.join(g.nodes.select("project", F.col("id").alias("source")), ["project", "source"], "left_semi")
    return R.resolve_calls(g.nodes, calls).where(F.col("resolution") == "same-module").select("project", "source", "callee", "target")


@query(
    cte(
        LIVE, EDGES,
        "res AS (SELECT * FROM edges WHERE edge_type IN ('IMPORTS', 'INHERITS'))",
        body="""SELECT r.project, concat('ext:', CASE WHEN r.edge_type = 'IMPORTS' THEN 'module' ELSE 'type' END, ':', r.target) AS id, count(*) AS uses FROM res r
WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.project = r.project AND l.id = r.target) GROUP BY ALL""",
    )
)
def res18_externalise(spark, d):
    g = M.load_graph(spark, d, ["file_path"], ["node_id"])
    edges, _ = R.externalise(g.edges, g.nodes)
    return edges.where(F.col("target").startswith("ext:") & F.col("edge_type").isin("IMPORTS", "INHERITS")).join(g.nodes.select("project", F.col("id").alias("target")), ["project", "target"], "left_anti").groupBy("project", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("uses"))


@query(
    """WITH f AS (SELECT DISTINCT project, file_path FROM source_files), p AS (SELECT project, file_path, string_split(file_path, '/') AS p FROM f),
k AS (SELECT *, unnest(range(0, len(p)))::INT AS k FROM p)
SELECT DISTINCT project, CASE WHEN k = 0 THEN 'dir:.' ELSE concat('dir:', array_to_string(p[1:k], '/')) END AS edge_source,
CASE WHEN k = len(p) - 1 THEN file_path ELSE concat('dir:', array_to_string(p[1:k + 1], '/')) END AS edge_target FROM k"""
)
def res20_directories(spark, d):
    return R.directories(table(spark, d, "source_files").select("project", "file_path").distinct())


# ---- reconciliation ----


@query(
    f"""WITH {_SRC}, n AS (SELECT project, path AS file_path, max(struct_pack(ts, arrived_at, kind)) AS e FROM file_changes WHERE path IS NOT NULL GROUP BY ALL),
scan AS (SELECT s.project, s.file_path, CASE WHEN n.e.kind = 'modified' THEN concat(s.checksum, '*') ELSE s.checksum END AS c FROM src s LEFT JOIN n ON n.project = s.project AND n.file_path = s.file_path WHERE coalesce(n.e.kind, '') <> 'deleted'
  UNION ALL SELECT n.project, n.file_path, 'new' FROM n WHERE n.e.kind = 'added' AND NOT EXISTS (SELECT 1 FROM src s WHERE s.project = n.project AND s.file_path = n.file_path))
SELECT project, file_path, CASE WHEN s.file_path IS NULL THEN 'added' WHEN x.file_path IS NULL THEN 'deleted' WHEN s.checksum = x.c THEN 'same' ELSE 'modified' END AS change
FROM src s FULL JOIN scan x USING (project, file_path)"""
)
def set04_changed_files(spark, d):
    stored = _files(spark, d).select("project", "file_path", "checksum")
    last = C.latest_changes(table(spark, d, "file_changes")).select("project", F.col("path").alias("file_path"), "kind")
    seen = stored.join(last, ["project", "file_path"], "left").where(F.coalesce("kind", F.lit("")) != "deleted")
    seen = seen.select("project", "file_path", F.when(F.col("kind") == "modified", F.concat("checksum", F.lit("*"))).otherwise(F.col("checksum")).alias("checksum"))
    new = last.where("kind = 'added'").join(stored, ["project", "file_path"], "left_anti").select("project", "file_path", F.lit("new").alias("checksum"))
    return RC.file_diff(stored, seen.unionByName(new))


@query(
    cte(
        LIVE,
        "allk AS (SELECT DISTINCT project, id FROM code_nodes)",
        body="SELECT a.project, a.id FROM allk a WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.project = a.project AND l.id = a.id)",
    )
)
def set01_stale_nodes(spark, d):
    stored = table(spark, d, "code_nodes").select("project", "id", "file_path").dropDuplicates(["project", "id"])
    produced = M.live_nodes(table(spark, d, "code_nodes"), ["name"])
    return RC.stale_nodes(stored.withColumn("file_path", F.coalesce("file_path", F.lit(""))), produced, stored.select("project", F.coalesce("file_path", F.lit("")).alias("file_path")).distinct()).select("project", "id")


@query(cte(LIVE, EDGES, EXT, body="SELECT e.project, e.edge_type, count(*) AS written FROM edges e WHERE EXISTS (SELECT 1 FROM live l WHERE l.project = e.project AND l.id = e.source) AND (EXISTS (SELECT 1 FROM live l WHERE l.project = e.project AND l.id = e.target) OR EXISTS (SELECT 1 FROM ext x WHERE x.project = e.project AND x.id = e.target)) GROUP BY ALL"))
def snk02_written_edges(spark, d):
    g = M.load_graph(spark, d, ["name"], ["node_id"])
    return RC.write_checked(g.edges, g.nodes, g.externals).groupBy("project", "edge_type").agg(F.count(F.lit(1)).alias("written"))


@query(cte(LIVE, body="SELECT project, id, node_type FROM live WHERE node_type <> 'directory' AND coalesce(summary, '') = ''"))
def snk09_missing_summaries(spark, d):
    return RC.missing_summaries(M.live_nodes(table(spark, d, "code_nodes"), ["node_type", "summary"]))


@query(cte(LIVE, body="SELECT project, id FROM live WHERE coalesce(summary, '') <> '' AND NOT has_vec"))
def snk09_stale_embeddings(spark, d):
    return RC.stale_embeddings(M.live_nodes(table(spark, d, "code_nodes"), ["summary", "summary_embedding"]))


@query(
    """WITH v AS (SELECT project, id, max(indexed_at) AS m FROM code_nodes GROUP BY ALL),
old AS (SELECT n.project, n.id, max(struct_pack(indexed_at := n.indexed_at, summary := n.summary, h := n.summary_input_hash)) AS r FROM code_nodes n JOIN v ON v.project = n.project AND v.id = n.id AND n.indexed_at < v.m GROUP BY ALL),
new AS (SELECT n.project, n.id, max(struct_pack(indexed_at := n.indexed_at, summary := n.summary, h := n.summary_input_hash)) AS r FROM code_nodes n GROUP BY ALL)
SELECT project, id, CASE WHEN n.r.summary IS NULL OR n.r.summary = '' THEN coalesce(nullif(o.r.summary, ''), n.r.summary) ELSE n.r.summary END AS summary
FROM new n LEFT JOIN old o USING (project, id)"""
)
def snk01_stale_beats_empty(spark, d):
    rows = table(spark, d, "code_nodes").select("project", "id", "indexed_at", "summary", "summary_input_hash")
    last = rows.groupBy("project", "id").agg(F.max("indexed_at").alias("m"))
    older = rows.join(last, ["project", "id"]).where(F.col("indexed_at") < F.col("m"))
    pick = lambda df: df.groupBy("project", "id").agg(F.max(F.struct("indexed_at", "summary", "summary_input_hash")).alias("r")).select("project", "id", "r.summary", "r.summary_input_hash")
    return RC.upsert_nodes(pick(older), pick(rows)).select("project", "id", "summary")


@query(cte(CHUNKS, "v AS (SELECT project, id, max(struct_pack(indexed_at, embedding)) AS r FROM chunks GROUP BY ALL)", body="SELECT project, id, v.r.embedding IS NULL AS to_embed FROM v"))
def emb03_reuse_vectors(spark, d):
    stored = M.merged_chunks(table(spark, d, "chunks"), ["embedding"]).where(F.col("embedding").isNotNull())
    return RC.reuse_vectors(M.merged_chunks(table(spark, d, "chunks"), ["node_id"]), stored).select("project", "id", "to_embed")


_LEAVES = """
body AS (SELECT l.project, l.id, array_to_string(string_split(replace(regexp_replace(s.content, '\\r\\n?', chr(10), 'g'), chr(13), chr(10)), chr(10))[l.line_start:l.line_end], chr(10)) AS source
  FROM live l JOIN src s ON s.project = l.project AND s.file_path = l.file_path WHERE l.node_type IN ('function', 'method') AND l.line_start IS NOT NULL AND l.line_end >= l.line_start),
leaf AS (SELECT l.*, b.source, regexp_replace(coalesce(nullif(l.docstring, ''), nullif(b.source, ''), l.signature, ''), '^\\s+|\\s+$', '', 'g') AS text,
  sha256(concat_ws(chr(0), coalesce(b.source, ''), coalesce(l.signature, ''), coalesce(l.docstring, ''))) AS h
  FROM live l LEFT JOIN body b ON b.project = l.project AND b.id = l.id WHERE NOT EXISTS (SELECT 1 FROM live c WHERE c.project = l.project AND c.parent_id = l.id)),
made AS (SELECT *, coalesce(nullif(regexp_extract(text, '(?s)^(.+?[.!?])(\\s|$)', 1), ''), string_split(text, chr(10))[1]) AS made FROM leaf)"""


@query(
    cte(
        LIVE, _SRC, _LEAVES,
        body="""SELECT project, id, CASE WHEN summary_input_hash = h AND coalesce(summary, '') <> '' THEN summary WHEN made <> '' THEN made ELSE summary END AS summary,
CASE WHEN made = '' AND NOT coalesce(summary_input_hash = h AND summary <> '', false) THEN '' ELSE h END AS summary_input_hash,
CASE WHEN summary_input_hash = h AND coalesce(summary, '') <> '' THEN 'reused' WHEN made <> '' THEN 'generated' ELSE 'failed' END AS outcome FROM made""",
    )
)
def sum02_summaries(spark, d):
    """The leaves of a bottom-up drain of the whole graph (containers are compared with plain code in the tests)."""
    n = cut(M.live_nodes(table(spark, d, "code_nodes"), ["name", "node_type", "file_path", "line_start", "line_end", "signature", "docstring", "parent_id", "summary", "summary_input_hash"]), "nodes")
    bodies = K.node_bodies(n, _files(spark, d)).select("project", "id", F.array_join("lines", "\n").alias("source"))
    live = n.select("project", F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    nodes = n.join(bodies, ["project", "id"], "left").join(live, ["project", "parent_id"], "left").withColumn("parent_id", F.when(F.col("_there"), F.col("parent_id")))
    cols = ["project", "id", "parent_id", "name", "node_type", "file_path", "line_start", "source", "signature", "docstring"]
    done = RC.drain_summaries(nodes.select(cols), n.select("project", "id", "summary", "summary_input_hash"))
    return done.join(n.where(F.col("parent_id").isNotNull()).select("project", F.col("parent_id").alias("id")).distinct(), ["project", "id"], "left_anti")


# ---- change streams ----


@query(
    """WITH e AS (SELECT project, path, ts FROM file_changes WHERE path IS NOT NULL AND lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.py', '.go', '.ts') AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY project ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM e),
s AS (SELECT *, sum(n) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT project, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP AS last, count(*) AS n_events, array_to_string(list_sort(list(DISTINCT path)), ' ') AS paths FROM s GROUP BY project, k"""
)
def str03_debounced_bursts(spark, d):
    e = C.relevant(table(spark, d, "file_changes"), [".py", ".go", ".ts"], []).where(F.col("ts").isNotNull())
    b = C.debounce(e, "6 hours").withColumn("paths", F.array_join("paths", " "))
    return b.withColumn("start", F.to_timestamp_ntz(F.col("start").cast("string"))).withColumn("last", F.to_timestamp_ntz(F.col("last").cast("string")))


@query("SELECT project, path, r.kind FROM (SELECT project, path, max(struct_pack(ts, arrived_at, kind)) AS r FROM file_changes WHERE path IS NOT NULL GROUP BY ALL)")
def str04_latest_changes(spark, d):
    return C.latest_changes(table(spark, d, "file_changes")).select("project", "path", "kind")


@query(
    """WITH p AS (SELECT DISTINCT project, path AS file_path FROM file_changes), disk AS (SELECT DISTINCT project, file_path FROM source_files), known AS (SELECT DISTINCT project, file_path FROM code_nodes WHERE file_path IS NOT NULL)
SELECT p.project, p.file_path, CASE WHEN d.file_path IS NOT NULL THEN 'changed' WHEN k.file_path IS NOT NULL THEN 'deleted' ELSE 'ignored' END AS change FROM p
LEFT JOIN disk d ON d.project = p.project AND d.file_path = p.file_path LEFT JOIN known k ON k.project = p.project AND k.file_path = p.file_path"""
)
def set06_classify_events(spark, d):
    return C.classify(table(spark, d, "file_changes"), table(spark, d, "source_files"), table(spark, d, "code_nodes").where(F.col("file_path").isNotNull()))


@query("SELECT project, path, r.kind FROM (SELECT project, path, max(struct_pack(ts, arrived_at, kind)) AS r FROM file_changes WHERE path IS NOT NULL GROUP BY ALL)")
def str05_streamed_changes(spark, d):
    """The whole change table read as a stream in micro-batches, each written under its number; then their newest events."""
    source = cut(table(spark, d, "file_changes").select("project", "path", "kind", "ts", "arrived_at"), "changes")._grovework_path
    folder = f"{shared_dir(spark)}/grovework/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    C.append_latest(C.read_changes(spark, source, 4), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return C.appended(spark, f"{folder}/table").select("project", "path", "kind")


# ---- ad-hoc language ----

_SCOPE = "{project: $project}"


def _cy(spark, d, q):
    g = M.load_graph(spark, d, ["name", "node_type", "file_path", "line_start", "parent_id", "external_calls", "unresolved_calls", "summary"], ["node_id"])
    return cypher.run(g.project(PROJECT), q, {"project": PROJECT})


@query(cte(LIVE, EDGES, body=f"SELECT m.id, count(*) AS calls FROM edges e JOIN live n ON n.project = e.project AND n.id = e.source JOIN live m ON m.project = e.project AND m.id = e.target WHERE e.project = '{PROJECT}' AND e.edge_type = 'CALLS' AND n.node_type = 'function' GROUP BY 1"))
def cy01_callers(spark, d):
    return _cy(spark, d, f"MATCH (n:Function {_SCOPE})-[:CALLS]->(m:Code {_SCOPE}) RETURN m.id AS id, count(*) AS calls ORDER BY calls DESC, id")


@query(
    cte(
        LIVE, EDGES,
        f"con AS (SELECT source, target FROM edges WHERE project = '{PROJECT}' AND edge_type = 'CONTAINS'), n AS (SELECT * FROM live WHERE project = '{PROJECT}')",
        body="""SELECT p.id AS p, count(*) AS n FROM n p JOIN (SELECT source AS a, target AS b FROM con UNION ALL SELECT x.source, y.target FROM con x JOIN con y ON x.target = y.source) w ON w.a = p.id
JOIN n c ON c.id = w.b WHERE p.node_type = 'directory' GROUP BY 1""",
    )
)
def cy03_variable_length(spark, d):
    return _cy(spark, d, f"MATCH (p:Directory {_SCOPE})-[:CONTAINS*1..2]->(c:Code {_SCOPE}) RETURN p.id AS p, count(c) AS n")


@query(
    cte(
        LIVE, EDGES,
        f"n AS (SELECT * FROM live WHERE project = '{PROJECT}')",
        body=f"""SELECT n.id, count(c.id) AS kids FROM n LEFT JOIN edges e ON e.project = '{PROJECT}' AND e.source = n.id AND e.edge_type = 'CONTAINS' LEFT JOIN n c ON c.id = e.target GROUP BY 1 HAVING count(c.id) > 2""",
    )
)
def cy04_optional_with(spark, d):
    return _cy(spark, d, f"MATCH (n:Code {_SCOPE}) OPTIONAL MATCH (n {_SCOPE})-[:CONTAINS]->(c:Code {_SCOPE}) WITH n.id AS id, count(c) AS kids WHERE kids > 2 RETURN id, kids")


@query(
    cte(
        LIVE, EDGES,
        body=f"""SELECT l.id, l.name FROM live l WHERE l.project = '{PROJECT}' AND l.node_type IN ('function', 'method') AND coalesce(len(l.external_calls), 0) = 0
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.project = l.project AND e.source = l.id AND e.edge_type = 'CALLS' AND (EXISTS (SELECT 1 FROM live t WHERE t.project = e.project AND t.id = e.target) OR EXISTS (SELECT 1 FROM externals t WHERE t.project = e.project AND t.id = e.target)))""",
    )
)
def cy09_leaves(spark, d):
    return _cy(spark, d, f"MATCH (n:Code {_SCOPE}) WHERE n.node_type IN ['function', 'method'] AND size(coalesce(n.external_calls, [])) = 0 AND NOT (n)-[:CALLS]->() RETURN n.id AS id, n.name AS name")


@query(cte(EDGES, LIVE, EXT, body=f"SELECT x.root, count(*) AS uses FROM edges e JOIN live l ON l.project = e.project AND l.id = e.source JOIN ext x ON x.project = e.project AND x.id = e.target WHERE e.project = '{PROJECT}' AND e.edge_type = 'IMPORTS' GROUP BY 1"))
def cy14_dependencies(spark, d):
    return _cy(spark, d, f"MATCH (a:Code {_SCOPE})-[:IMPORTS]->(e:External) RETURN e.root AS root, count(*) AS uses")


_GUARDED = [
    ("MATCH (n {project: $project}) RETURN n.id", True),
    ("MATCH (n {project: $project}) SET n.x = 1 RETURN n", False),
    ("MATCH (n {project: $project}) RETURN n LIMIT 5", False),
    ("MATCH (n) RETURN n", False),
    ("MATCH (n {project: $project}), (m) RETURN n, m", False),
    ("CALL x.load_all()", False),
    ("MATCH (n {project: $project}) WHERE n.call = 'x' RETURN n.set", True),
    ("MATCH (n {project: $project}) WHERE n.name = 'DELETE ME' RETURN n.id", True),
    ("MATCH (n {project: $project}) RETURN n.id; MATCH (m {project: $project}) RETURN m", False),
    ("LOAD CSV FROM 'x' AS r RETURN r", False),
    ("SHOW INDEX INFO", False),
    ("/* SET */ MATCH (n {project: $project}) RETURN n.id // LIMIT", True),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(q.replace("'", "''"), str(ok).lower()) for q, ok in _GUARDED) + ") t(statement, allowed)")
def gua01_refusals(spark, d):
    return spark.createDataFrame([(q, guard.refusal(q) is None) for q, _ in _GUARDED], "statement string, allowed boolean")
