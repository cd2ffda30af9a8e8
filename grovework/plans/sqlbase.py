"""Common table expressions of the SQL that queries are checked against."""

LIVE = """
live AS (
  SELECT project, id, r.* FROM (
    SELECT project, id, max(struct_pack(indexed_at := coalesce(indexed_at, TIMESTAMP '0001-01-01'), deleted_at, name, node_type, file_path, line_start, line_end, signature, docstring, summary,
           summary_input_hash, parent_id, external_calls, unresolved_calls, calls_provenance, has_vec := summary_embedding IS NOT NULL)) AS r
    FROM code_nodes WHERE project IS NOT NULL AND id IS NOT NULL GROUP BY project, id
  ) WHERE r.deleted_at IS NULL
)"""
EDGES = """
edges AS (
  SELECT project, source, edge_type, target, b.resolution, b.callee_text FROM (
    SELECT project, source, edge_type, target, min(struct_pack(rank := CASE resolution WHEN 'semantic' THEN 0 WHEN 'exact' THEN 1 WHEN 'import' THEN 2
             WHEN 'field-type' THEN 3 WHEN 'self' THEN 4 WHEN 'same-module' THEN 5 WHEN 'same-package' THEN 6 ELSE 7 END,
           resolution := coalesce(resolution, ''), callee_text := coalesce(callee_text, ''))) AS b
    FROM code_edges WHERE target IS NOT NULL GROUP BY project, source, edge_type, target)
)"""
EXT = """
ext AS (SELECT project, id, any_value(name) AS name, any_value(root) AS root, any_value(kind) AS kind, any_value(language) AS language FROM externals GROUP BY project, id)"""
CHUNKS = """
ch AS (
  SELECT project, id, r.node_id, r.file_path, r.content, r.start_line, r.end_line, r.language, coalesce(r.chunk_kind, 'fallback_text') AS chunk_kind, r.chunk_index FROM (
    SELECT project, id, max(struct_pack(indexed_at, owned := node_id IS NOT NULL, node_id, file_path, content, start_line, end_line, language, chunk_kind, chunk_index)) AS r
    FROM chunks WHERE project IS NOT NULL AND id IS NOT NULL GROUP BY project, id)
)"""
INNER = """
inn AS (SELECT e.* FROM edges e WHERE EXISTS (SELECT 1 FROM live a WHERE a.project = e.project AND a.id = e.source)
        AND EXISTS (SELECT 1 FROM live b WHERE b.project = e.project AND b.id = e.target))"""
REL = """
rel AS (
  SELECT project, source AS id, 'outgoing' AS direction, edge_type, target AS other FROM edges
  UNION ALL SELECT project, target, 'incoming', edge_type, source FROM edges WHERE source <> target
)"""


def cte(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body
