"""One-hop relations, containment to a depth, context sections, breadcrumbs, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovework.operators.hierarchy import hierarchy
from grovework.operators.model import CodeGraph
from grovework.runtime import cut, release

REF = ["name", "node_type", "file_path", "line_start", "line_end", "summary"]


def by_type(df: DataFrame, types: list[str] | None, column: str = "node_type") -> DataFrame:
    """Rows whose type is in the list; None keeps all. The row's type is lower-cased, the list is not."""
    return df if types is None else df.where(F.lower(column).isin(types))


def relations(g: CodeGraph, relation_types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """``project, id, direction, edge_type, other``: edges seen from both ends; a self-loop counts once, as outgoing."""
    e = g.edges if relation_types is None else g.edges.where(F.col("edge_type").isin(relation_types))
    out = e.select("project", F.col("source").alias("id"), F.lit("outgoing").alias("direction"), "edge_type", F.col("target").alias("other"))
    into = e.where(F.col("source") != F.col("target")).select(
        "project", F.col("target").alias("id"), F.lit("incoming").alias("direction"), "edge_type", F.col("source").alias("other")
    )
    both = out.unionByName(into)
    return both if direction == "both" else both.where(F.col("direction") == direction)


def related(g: CodeGraph, relation_types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """``relations`` between live nodes, with the other end's fields."""
    other = g.nodes.select("project", F.col("id").alias("other"), *REF)
    here = g.nodes.select("project", "id")
    return relations(g, relation_types, direction).join(here, ["project", "id"], "left_semi").join(other, ["project", "other"])


def structure(g: CodeGraph, roots: DataFrame, depth: int = 1) -> DataFrame:
    """``project, root, id, depth`` of what the roots contain within ``depth`` (1 to 3) levels; every node once per root."""
    contains = g.edges.where(F.col("edge_type") == "CONTAINS").select("project", F.col("source").alias("at"), F.col("target").alias("next"))
    level = roots.select("project", F.col("id").alias("root"), F.col("id").alias("at"))
    found = None
    for d in range(1, max(1, min(depth, 3)) + 1):
        level = level.join(contains, ["project", "at"]).select("project", "root", F.col("next").alias("at"))
        here = level.withColumn("depth", F.lit(d))
        found = here if found is None else found.unionByName(here)
    found = found.groupBy("project", "root", F.col("at").alias("id")).agg(F.min("depth").alias("depth"))
    return found.where(F.col("root") != F.col("id")).join(g.nodes.select("project", "id"), ["project", "id"], "left_semi")


def parents(g: CodeGraph) -> DataFrame:
    """Left join of each node with its parent by ``parent_id``."""
    up = g.nodes.select("project", F.col("id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("node_type").alias("parent_type"))
    return g.nodes.select("project", "id", "parent_id").join(up, ["project", "parent_id"], "left").select("project", "id", "parent_id", "parent_name", "parent_type")


def child_counts(g: CodeGraph) -> DataFrame:
    """Of each node how many live children it contains (left join, zero where none)."""
    child = g.nodes.select("project", F.col("id").alias("target"))
    edges = g.edges.where(F.col("edge_type") == "CONTAINS").join(child, ["project", "target"], "left_semi")
    n = edges.groupBy("project", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return g.nodes.select("project", "id", "node_type").join(n, ["project", "id"], "left").select("project", "id", "node_type", F.coalesce("n", F.lit(0)).alias("child_count"))


def context_sections(g: CodeGraph, limit: int = 25, offset: int = 0) -> DataFrame:
    """Of every node the pages of its three sections (children, incoming, outgoing), one row per listed item.

    Incoming ends must be nodes; outgoing ends may be externals. Sections are sorted by edge type and id.
    """
    ends = relations(g)
    named = g.nodes.select("project", F.col("id").alias("other"), "name").unionByName(g.externals.select("project", F.col("id").alias("other"), "name"))
    section = (
        F.when((F.col("direction") == "outgoing") & (F.col("edge_type") == "CONTAINS"), "children").when(F.col("direction") == "outgoing", "outgoing").otherwise("incoming")
    )
    listed = ends.withColumn("section", section).join(named, ["project", "other"])
    listed = listed.where((F.col("section") != "incoming") | ~F.col("other").startswith("ext:"))
    w = Window.partitionBy("project", "id", "section").orderBy("edge_type", "other")
    place = listed.withColumn("place", F.row_number().over(w)).where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return place.select("project", "id", "section", "place", "edge_type", "other", "name")


def missing_contains(g: CodeGraph) -> DataFrame:
    """Children whose parent exists but whose CONTAINS edge does not (anti join)."""
    child = g.nodes.select("project", F.col("parent_id").alias("source"), F.col("id").alias("target"))
    there = g.nodes.select("project", F.col("id").alias("source"))
    have = g.edges.where(F.col("edge_type") == "CONTAINS").select("project", "source", "target")
    return child.join(there, ["project", "source"], "left_semi").join(have, ["project", "source", "target"], "left_anti")


def orphan_externals(g: CodeGraph) -> DataFrame:
    return g.externals.join(g.edges.select("project", F.col("target").alias("id")), ["project", "id"], "left_anti").select("project", "id", "name", "kind")


def neighbourhood(g: CodeGraph, start: DataFrame, hops: int = 2, relation_types: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """``project, id, hop`` within 1 to 4 hops of ``start`` (project, id), CONTAINS always followed, both directions.

    Each hop joins the frontier with the edges and drops what was visited; results are cut from their lineage per hop.
    ``max_nodes`` keeps the nearest (then smallest) nodes of a large neighbourhood.
    """
    kinds = None if relation_types is None else sorted({*relation_types, "CONTAINS"})
    live = g.nodes.select("project", "id")
    steps = cut(relations(g, kinds).select("project", "id", "other").distinct(), "steps")
    visited = cut(start.select("project", "id").distinct().join(live, ["project", "id"], "left_semi").withColumn("hop", F.lit(0)), "visited")
    for hop in range(1, max(1, min(hops, 4)) + 1):
        frontier = visited.where(F.col("hop") == hop - 1).select("project", "id")
        new = (
            steps.join(frontier, ["project", "id"])
            .select("project", F.col("other").alias("id"))
            .distinct()
            .join(visited, ["project", "id"], "left_anti")
            .join(live, ["project", "id"], "left_semi")
            .withColumn("hop", F.lit(hop))
        )
        grown = cut(visited.unionByName(new), "visited")
        release(visited)
        visited = grown
    return visited if max_nodes is None else visited.orderBy("hop", "project", "id").limit(max_nodes)


def all_breadcrumbs(g: CodeGraph) -> DataFrame:
    """``project, id, path, depth, cycle_id`` of every live node, at any depth (``path``: names from the top down).

    A parent that is not live ends the path. On or below a loop, ``cycle_id`` is the loop's smallest id and the path
    starts there.
    """
    h = hierarchy(g.nodes.select("project", "id", "parent_id", F.lit(None).cast("timestamp").alias("indexed_at")))
    steps = h.select("project", "id", "depth", "cycle_id", F.posexplode("path").alias("_k", "_at"))
    names = g.nodes.select("project", F.col("id").alias("_at"), F.coalesce("name", F.lit("")).alias("_name"))
    ordered = F.array_sort(F.collect_list(F.struct("_k", "_name")))
    joined = steps.join(names, ["project", "_at"]).groupBy("project", "id", "depth", "cycle_id")
    return joined.agg(F.transform(ordered, lambda x: x["_name"]).alias("path"))


def module_edges(g: CodeGraph) -> DataFrame:
    """Weighted edges between modules of different files: each end is mapped to its file's module."""
    module = g.nodes.where(F.col("node_type").isin("module", "document")).groupBy("project", "file_path").agg(F.min("id").alias("module"))
    owner = g.nodes.select("project", "id", "file_path").join(module, ["project", "file_path"]).select("project", "id", "module", "file_path")
    a = owner.select("project", F.col("id").alias("source"), F.col("module").alias("from_module"), F.col("file_path").alias("_a"))
    b = owner.select("project", F.col("id").alias("target"), F.col("module").alias("to_module"), F.col("file_path").alias("_b"))
    e = g.edges.where(F.col("edge_type") != "CONTAINS").join(a, ["project", "source"]).join(b, ["project", "target"])
    return e.where(F.col("_a") != F.col("_b")).groupBy("project", "from_module", "to_module").agg(F.count(F.lit(1)).alias("weight"))


def degrees(g: CodeGraph) -> DataFrame:
    """Undirected degree of every live node that has edges to live nodes."""
    live = g.nodes.select("project", "id")
    both = g.edges.join(live.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").join(live.withColumnRenamed("id", "target"), ["project", "target"], "left_semi")
    ends = both.select("project", F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("project", "id").agg(F.count(F.lit(1)).alias("degree"))


def graph_cap(g: CodeGraph, max_nodes: int) -> DataFrame:
    """Per project the nodes a drawing keeps: directories, then modules, then by degree, at most ``max_nodes``."""
    rank = F.when(F.col("node_type") == "directory", 0).when(F.col("node_type") == "module", 1).otherwise(2)
    n = g.nodes.select("project", "id", "node_type").join(degrees(g), ["project", "id"], "left").select("project", "id", "node_type", F.coalesce("degree", F.lit(0)).alias("degree"))
    w = Window.partitionBy("project").orderBy(rank, F.desc("degree"), "id")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_nodes)


def innermost(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Range join: for each point (project, file_path, line) the innermost span (line_start <= line <= line_end) there.

    Equality on the file bounds the range part; the latest start wins, then the smallest id.
    """
    s = spans.where(F.col("line_start").isNotNull()).select("project", "file_path", F.col("id").alias("span"), "line_start", "line_end")
    hit = points.join(s, ["project", "file_path"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    best = F.min(F.struct((-F.col("line_start")).alias("k"), F.col("span"))).getField("span").alias("span")
    return hit.groupBy("project", "file_path", "line").agg(best)


def find_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``project, wanted, file_path``: the file each wanted path (project, wanted) means: the same path, else one that ends
    in it or that it ends in, else one of the same name; of several the first. Paths that mean none are left out."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    f = files.where(F.col("file_path").isNotNull()).select("project", "file_path", name(F.col("file_path")).alias("_name")).distinct()
    w = wanted.where(F.col("wanted").isNotNull()).select("project", "wanted", name(F.col("wanted")).alias("_name")).distinct()
    a, b = F.col("file_path"), F.col("wanted")
    near = F.when(a == b, 0).when(a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a)), 1).otherwise(2)
    best = F.min(F.struct(near.alias("k"), a.alias("p"))).getField("p").alias("file_path")
    return w.join(f, ["project", "_name"]).groupBy("project", "wanted").agg(best)


def graph_cap_edges(g: CodeGraph, max_nodes: int, max_edges: int) -> DataFrame:
    """Per project the edges between the nodes ``graph_cap`` keeps, at most ``max_edges``, in order of their keys."""
    kept = graph_cap(g, max_nodes).select("project", "id")
    e = g.edges.join(kept.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").join(kept.withColumnRenamed("id", "target"), ["project", "target"], "left_semi")
    w = Window.partitionBy("project").orderBy("source", "edge_type", "target")
    return e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_edges).select("project", "source", "edge_type", "target", "place")


def relations_list(g: CodeGraph, limit: int = 200) -> DataFrame:
    """Of every node and direction its relations but CONTAINS, by relation, file, line and id, at most ``limit``."""
    rows = related(g).where(F.col("edge_type") != "CONTAINS")
    w = Window.partitionBy("project", "id", "direction").orderBy("edge_type", "file_path", "line_start", "other")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("project", "id", "direction", "edge_type", "other", "place")


def entity_detail(g: CodeGraph) -> DataFrame:
    """``project, id, name, children, outgoing, incoming, chunks``: what the detail page of each live node counts."""
    rel = related(g)
    kind = F.when((F.col("direction") == "outgoing") & (F.col("edge_type") == "CONTAINS"), "children").when(F.col("edge_type") == "CONTAINS", None).otherwise(F.col("direction"))
    count = lambda k: F.sum(F.when(kind == k, 1).otherwise(0)).alias(k)
    ends = rel.groupBy("project", "id").agg(count("children"), count("outgoing"), count("incoming"))
    chunks = g.chunks.where(F.col("node_id").isNotNull()).groupBy("project", F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    j = g.nodes.select("project", "id", "name").join(ends, ["project", "id"], "left").join(chunks, ["project", "id"], "left")
    return j.select("project", "id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "outgoing", "incoming", "chunks")])
