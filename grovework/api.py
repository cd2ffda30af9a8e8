"""The tool surface: twelve read tools over one graph, each a page of plain dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.functions.text import matches_any, path_allowed, preview, sanitize_query
from grovework.operators import search as S
from grovework.operators import stats as A
from grovework.operators import traverse as T
from grovework.operators.model import EDGE_TYPES, NODE_TYPES, RESOLUTIONS, CodeGraph
from grovework.operators.paging import GRAPH_LIMIT, SEARCH_LIMIT, clamp, envelope
from grovework.plans.cypher import CypherError, run
from grovework.plans.guard import refusal

ENTITY = ["id", "name", "node_type", "file_path", "line_start", "line_end", "summary"]
ORDER = ["file_path", "line_start", "name", "id"]


def _error(code: str, message: str) -> dict:
    return {"error": {"code": code, "message": message}}


class Tools:
    """Tools over a ``CodeGraph``; ``embed`` turns a query text into a vector (needed by the vector tools only)."""

    def __init__(self, graph: CodeGraph, embed: Callable[[str], list[float]] | None = None) -> None:
        self.graph, self.embed = graph, embed

    def _scope(self, project: str) -> CodeGraph | None:
        g = self.graph.project(project)
        return None if g.nodes.limit(1).isEmpty() else g

    @staticmethod
    def _refs(df: DataFrame) -> DataFrame:
        return df.select(*[preview(F.col(c)).alias(c) if c == "summary" else c for c in ENTITY], *[c for c in df.columns if c not in ENTITY and c != "project"])

    @staticmethod
    def _filter(df: DataFrame, node_types=None, include=None, exclude=None) -> DataFrame:
        df = T.by_type(df, node_types or None)
        return df.where(path_allowed(F.col("file_path"), include, exclude)) if include is not None or exclude else df

    def _page(self, project: str, make: Callable[[CodeGraph], DataFrame], order: list, limit: int, offset: int, most: int) -> dict:
        """A page; of a project that is not indexed searches give an error, graph tools an empty page."""
        if most == SEARCH_LIMIT and self._scope(project) is None:
            return _error("project_not_indexed", project)
        return envelope(make(self.graph.project(project)), order, limit, offset, most)

    def list_entities(self, project, node_types=None, include_paths=None, exclude_paths=None, limit=50, offset=0) -> dict:
        return self._page(project, lambda g: self._refs(self._filter(g.nodes.select("project", *ENTITY), node_types, include_paths, exclude_paths)), ORDER, limit, offset, GRAPH_LIMIT)

    def search_entities(self, project, query, node_types=None, include_paths=None, exclude_paths=None, limit=20, offset=0) -> dict:
        def make(g: CodeGraph) -> DataFrame:
            n = g.nodes.select("project", *ENTITY).where(F.contains(F.lower("name"), F.lit(query.lower())))
            return self._refs(self._filter(n, node_types, include_paths, exclude_paths))

        return self._page(project, make, ORDER, limit, offset, GRAPH_LIMIT)

    def get_entity_structure(self, project, node_id=None, file_path=None, depth=1, node_types=None, include_paths=None, exclude_paths=None, limit=50, offset=0) -> dict:
        g = self._scope(project)
        if g is None:
            return _error("project_not_indexed", project)
        if node_id:
            roots = g.nodes.where(F.col("id") == node_id)
        elif file_path:
            roots = g.nodes.where((F.col("file_path") == file_path) & F.col("node_type").isin(*A.FILE_TYPES))
        else:
            roots = g.nodes.where((F.col("node_type") == "directory") & F.col("parent_id").isNull())
        if roots.limit(1).isEmpty():
            return _error("not_found", node_id or file_path or project)
        below = T.structure(g, roots, depth).select("project", "id", "depth").groupBy("project", "id").agg(F.min("depth").alias("depth"))
        rows = self._filter(g.nodes.select("project", *ENTITY).join(below, ["project", "id"]), node_types, include_paths, exclude_paths)
        return envelope(self._refs(rows), ORDER, limit, offset) | {"roots": [r["id"] for r in roots.select("id").orderBy("id").limit(GRAPH_LIMIT).collect()]}

    def get_entity_context(self, project, node_id, relation_types=None, limit=25, offset=0) -> dict:
        g = self._scope(project)
        if g is None:
            return _error("project_not_indexed", project)
        own = g.nodes.where(F.col("id") == node_id).select("project", *ENTITY, "parent_id").limit(1).collect()
        if not own:
            return _error("not_found", node_id)
        near = CodeGraph(g.nodes, g.edges.where((F.col("source") == node_id) | (F.col("target") == node_id)), g.externals, g.chunks)
        if relation_types is not None:
            near.edges = near.edges.where(F.col("edge_type").isin(*relation_types, "CONTAINS"))
        rows = T.context_sections(near, clamp(limit, GRAPH_LIMIT), offset).where(F.col("id") == node_id).orderBy("section", "place").collect()
        up = self._refs(g.nodes.where(F.col("id") == own[0]["parent_id"])).limit(1).collect() if own[0]["parent_id"] else []
        parent = {k: v for k, v in up[0].asDict().items() if v is not None} if up else None
        out = {"entity": {k: v for k, v in own[0].asDict().items() if v is not None}, "parent": parent, "children": [], "incoming": [], "outgoing": []}
        for r in rows:
            out[r["section"]].append({"id": r["other"], "name": r["name"], "relation": r["edge_type"]})
        return out

    def get_related_entities(self, project, node_id, direction="both", relation_types=None, include_paths=None, exclude_paths=None, limit=50, offset=0) -> dict:
        def make(g: CodeGraph) -> DataFrame:
            rows = T.related(CodeGraph(g.nodes, g.edges.where((F.col("source") == node_id) | (F.col("target") == node_id)), g.externals, g.chunks), relation_types, direction)
            rows = rows.where(F.col("id") == node_id).drop("id").withColumnRenamed("other", "id")
            return self._refs(self._filter(rows, None, include_paths, exclude_paths))

        return self._page(project, make, [*ORDER, "edge_type", "direction"], limit, offset, GRAPH_LIMIT)

    def _hits(self, g: CodeGraph, hits: DataFrame, node_types, include, exclude, min_score) -> DataFrame:
        rows = g.nodes.select("project", *ENTITY).join(hits.where(F.coalesce("score", F.lit(0.0)) >= min_score), ["project", "id"])
        return self._refs(self._filter(rows, node_types, include, exclude))

    def _code(self, g: CodeGraph, vector: list[float]) -> DataFrame:
        c = g.chunks.where(F.col("node_id").isNotNull()).withColumnRenamed("id", "chunk_id")
        return S.group_hits(S.vector_search(c, "embedding", vector, None).withColumnRenamed("node_id", "id"), ["project", "id"])

    def search_code(self, project, query, node_types=None, include_paths=None, exclude_paths=None, min_score=0.0, limit=10, offset=0) -> dict:
        v = self.embed(query)
        return self._page(project, lambda g: self._hits(g, self._code(g, v), node_types, include_paths, exclude_paths, min_score), [F.desc("score"), "id"], limit, offset, SEARCH_LIMIT)

    def search_semantic(self, project, query, node_types=None, include_paths=None, exclude_paths=None, min_score=0.0, limit=10, offset=0) -> dict:
        v = self.embed(query)
        make = lambda g: self._hits(g, S.vector_search(g.nodes, "summary_embedding", v, None).select("project", "id", "score"), node_types, include_paths, exclude_paths, min_score)
        return self._page(project, make, [F.desc("score"), "id"], limit, offset, SEARCH_LIMIT)

    def search_hybrid(self, project, query, node_types=None, include_paths=None, exclude_paths=None, min_score=0.0, limit=10, offset=0) -> dict:
        v = self.embed(query)

        def make(g: CodeGraph) -> DataFrame:
            both = S.hybrid(self._code(g, v), S.vector_search(g.nodes, "summary_embedding", v, None), ["project", "id"], min_score)
            return self._hits(g, both, node_types, include_paths, exclude_paths, min_score)

        return self._page(project, make, [F.desc("score"), "id"], limit, offset, SEARCH_LIMIT)

    def search_text(self, project, query, node_types=None, include_paths=None, exclude_paths=None, min_score=0.0, limit=10, offset=0) -> dict:
        if not sanitize_query(query):
            return {"items": [], "page": {"limit": clamp(limit, SEARCH_LIMIT), "offset": max(0, offset), "next_offset": None, "has_more": False, "truncated": False}}

        def make(g: CodeGraph) -> DataFrame:
            key = ["project", "id"]
            symbol = g.nodes.withColumn("_sym", F.concat_ws(" ", "name", "signature"))
            chunks = g.chunks.where(F.col("node_id").isNotNull()).withColumnRenamed("id", "chunk_id")
            code = S.bm25(chunks, query, ["project", "node_id", "chunk_id", "start_line", "end_line"], "content")
            code = S.group_hits(code.withColumnRenamed("node_id", "id"), key)
            lists = {"summary": S.bm25(g.nodes, query, key, "summary"), "name": S.bm25(symbol, query, key, "_sym"), "code": code}
            return self._hits(g, S.fuse(lists, key, ["code", "summary", "name"]), node_types, include_paths, exclude_paths, min_score)

        return self._page(project, make, [F.desc("score"), "id"], limit, offset, SEARCH_LIMIT)

    def cypher_query(self, project, query, limit=100, offset=0, params=None) -> dict:
        why = refusal(query)
        if why:
            return _error("invalid_argument" if "limit and offset" in why else "unsafe_query", why)
        g = self._scope(project)
        if g is None:
            return _error("project_not_indexed", project)
        try:
            df = run(g, query, {"project": project, **(params or {})})
            limit, offset = clamp(limit, GRAPH_LIMIT), max(0, offset)
            rows = [r.asDict(recursive=True) for r in df.offset(offset).limit(limit + 1).collect()]
        except CypherError as e:
            return _error("query_failed", str(e))
        more = len(rows) > limit
        return {"items": rows[:limit], "page": {"limit": limit, "offset": offset, "next_offset": offset + limit if more else None, "has_more": more, "truncated": False}}

    def graph_schema(self) -> dict:
        return {
            "labels": [t.capitalize() for t in NODE_TYPES] + ["Code", "External"],
            "relations": EDGE_TYPES,
            "resolutions": RESOLUTIONS,
            "node_properties": dict(self.graph.nodes.dtypes),
            "external_properties": dict(self.graph.externals.dtypes),
            "scope": "every MATCH pattern needs a node with {project: $project}",
        }

    def list_projects(self) -> dict:
        return envelope(A.project_list(self.graph.nodes), [F.desc("entities"), "project"], GRAPH_LIMIT)


def files_matching(df: DataFrame, patterns: list[str]) -> DataFrame:
    return df.where(matches_any(F.col("file_path"), patterns))
