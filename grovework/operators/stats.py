"""Aggregates over the graph; grouped by project, so that one pass serves every project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovework.functions.text import language_of
from grovework.operators.model import CodeGraph

FILE_TYPES = ("module", "document")


def _n(cond) -> "F.Column":
    return F.sum(F.when(cond, 1).otherwise(0))


def present(c: str):
    return F.col(c).isNotNull() & (F.col(c) != "")


def project_stats(g: CodeGraph) -> DataFrame:
    """Per project: nodes, edges between nodes and to chunks, chunks, embedded summaries."""
    live = g.nodes.select("project", "id")
    n = g.nodes.groupBy("project").agg(F.count(F.lit(1)).alias("nodes"), _n(F.col("summary_embedding").isNotNull()).alias("embedded_summaries"))
    c = g.chunks.groupBy("project").agg(F.count(F.lit(1)).alias("chunks"))
    owned = g.chunks.select("project", F.col("node_id").alias("id")).join(live, ["project", "id"], "left_semi").groupBy("project").agg(F.count(F.lit(1)).alias("has_chunk"))
    inner = g.edges.join(live.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").join(live.withColumnRenamed("id", "target"), ["project", "target"], "left_semi")
    e = inner.groupBy("project").agg(F.count(F.lit(1)).alias("code_edges"))
    z = lambda x: F.coalesce(x, F.lit(0))
    return n.join(c, "project", "left").join(owned, "project", "left").join(e, "project", "left").select(
        "project", "nodes", z("chunks").alias("chunks"), "embedded_summaries", (z("code_edges") + z("has_chunk")).alias("edges")
    )


def project_list(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project").agg(
        F.count(F.lit(1)).alias("entities"), _n(F.col("node_type").isin(*FILE_TYPES)).alias("files"), _n(present("summary")).alias("summaries")
    )


def type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "node_type").agg(F.count(F.lit(1)).alias("n"))


def relation_histogram(g: CodeGraph) -> DataFrame:
    live = g.nodes.select("project", "id")
    inner = g.edges.join(live.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").join(live.withColumnRenamed("id", "target"), ["project", "target"], "left_semi")
    return inner.groupBy("project", "edge_type").agg(F.count(F.lit(1)).alias("n"))


def totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project").agg(
        F.count(F.lit(1)).alias("entities"),
        _n(F.col("node_type").isin(*FILE_TYPES)).alias("files"),
        _n(present("summary")).alias("summarized"),
        _n(F.col("node_type") != "directory").alias("summarizable"),
        _n(F.col("summary_embedding").isNotNull()).alias("embeddings"),
    )


def top_targets(g: CodeGraph, edge_type: str, k: int = 8) -> DataFrame:
    """Per project the k nodes with the most incoming edges of a type (partial counts before the shuffle)."""
    n = g.edges.where(F.col("edge_type") == edge_type).groupBy("project", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    named = n.join(g.nodes.select("project", "id", "name", "file_path"), ["project", "id"])
    w = Window.partitionBy("project").orderBy(F.desc("n"), "id")
    return named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def largest_files(g: CodeGraph, k: int = 8) -> DataFrame:
    """Per project the k files with the most entities (directories and modules aside), with their module."""
    n = g.nodes.where(~F.col("node_type").isin("directory", "module") & F.col("file_path").isNotNull()).groupBy("project", "file_path").agg(F.count(F.lit(1)).alias("n"))
    module = g.nodes.where(F.col("node_type") == "module").groupBy("project", "file_path").agg(F.min("id").alias("module"))
    w = Window.partitionBy("project").orderBy(F.desc("n"), "file_path")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).join(module, ["project", "file_path"], "left")


def language_histogram(nodes: DataFrame) -> DataFrame:
    files = nodes.where(F.col("node_type") == "module")
    return files.groupBy("project", language_of(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def container_sizes(g: CodeGraph) -> DataFrame:
    return g.edges.where(F.col("edge_type") == "CONTAINS").groupBy("project", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def dependency_usage(g: CodeGraph) -> DataFrame:
    """Edges into externals by the package they belong to."""
    x = g.externals.select("project", F.col("id").alias("target"), "root", "kind")
    return g.edges.join(x, ["project", "target"]).groupBy("project", "root").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("source").alias("users"))


def external_kinds(externals: DataFrame) -> DataFrame:
    return externals.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("root").alias("roots"))


def call_leaves(g: CodeGraph) -> DataFrame:
    """Functions and methods that call nothing: no CALLS edge, no external and no unresolved call."""
    f = g.nodes.where(F.col("node_type").isin("function", "method"))
    none = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)) <= 0
    quiet = f.where(none("external_calls") & none("unresolved_calls")).select("project", "id", "name")
    calls = g.edges.where(F.col("edge_type") == "CALLS").select("project", F.col("source").alias("id"))
    return quiet.join(calls, ["project", "id"], "left_anti")


def calls_by_resolution(g: CodeGraph) -> DataFrame:
    return g.edges.where(F.col("edge_type") == "CALLS").groupBy("project", F.when(F.col("resolution") == "", None).otherwise(F.col("resolution")).alias("resolution")).agg(F.count(F.lit(1)).alias("n"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("node_id").isNotNull()).groupBy("project", "node_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).alias("chars"))


def child_lines(g: CodeGraph) -> DataFrame:
    """Ordered string reduce: of each container the lines ``type name: summary`` of its children, and their hash."""
    child = g.nodes.where(F.col("parent_id").isNotNull()).select(
        "project",
        F.col("parent_id").alias("id"),
        F.struct(
            F.coalesce("file_path", F.lit("")).alias("a"),
            F.coalesce("line_start", F.lit(0)).alias("b"),
            F.col("id").alias("c"),
            F.concat_ws(" ", "node_type", F.concat(F.coalesce("name", F.lit("")), F.lit(":")), F.coalesce("summary", F.lit(""))).alias("line"),
        ).alias("x"),
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return child.groupBy("project", "id").agg(F.count(F.lit(1)).alias("children"), F.sha2(lines, 256).alias("input_hash"))
