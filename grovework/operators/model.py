"""The code graph as DataFrames: live nodes, merged edges, externals and chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovework.runtime import current_rows, table

#: Types of nodes and edges, and the fields of a node.
NODE_TYPES = ["module", "class", "function", "method", "directory", "interface", "enum", "struct", "trait", "document"]
EDGE_TYPES = ["IMPORTS", "CALLS", "INHERITS", "CONTAINS", "IMPLEMENTS"]
#: How a call was resolved, in decreasing confidence.
RESOLUTIONS = ["semantic", "exact", "import", "field-type", "self", "same-module", "same-package"]
NODE_FIELDS = ["name", "node_type", "file_path", "line_start", "line_end", "signature", "docstring", "summary", "summary_input_hash", "parent_id", "external_calls", "unresolved_calls", "calls_provenance", "summary_embedding"]
EDGE_KEY = ["project", "source", "edge_type", "target"]

NODES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("project", "id", "name", "node_type", "file_path")]
    + [T.StructField(c, T.IntegerType()) for c in ("line_start", "line_end")]
    + [T.StructField(c, T.StringType()) for c in ("signature", "docstring", "summary", "summary_input_hash", "parent_id")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("external_calls", "unresolved_calls")]
    + [T.StructField("calls_provenance", T.StringType()), T.StructField("summary_embedding", T.ArrayType(T.FloatType()))]
)
EDGES = T.StructType([T.StructField(c, T.StringType()) for c in (*EDGE_KEY, "resolution", "callee_text")])
EXTERNALS = T.StructType([T.StructField(c, T.StringType()) for c in ("project", "id", "name", "root", "kind", "language")])


def live_nodes(nodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Current rows of nodes that were not removed, with the asked ``columns`` only (others are never shuffled)."""
    cols = [c for c in (columns or NODE_FIELDS)]
    now = current_rows(nodes, ["project", "id"], ["deleted_at", *cols])
    return now.where(F.col("deleted_at").isNull()).drop("deleted_at")


def resolution_rank(col: str = "resolution"):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(RESOLUTIONS) for x in (r, i)]), F.col(col)), F.lit(len(RESOLUTIONS)))


def merged_edges(edges: DataFrame) -> DataFrame:
    """One row per edge key with a target; of copies that differ, the most confident resolution stays."""
    best = F.min(F.struct(resolution_rank().alias("rank"), F.coalesce("resolution", F.lit("")).alias("resolution"), F.coalesce("callee_text", F.lit("")).alias("callee_text")))
    return edges.where(F.col("target").isNotNull()).groupBy(*EDGE_KEY).agg(best.alias("b")).select(*EDGE_KEY, "b.resolution", "b.callee_text")


def merged_chunks(chunks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per chunk key; a null kind becomes ``fallback_text``."""
    cols = columns or ["node_id", "file_path", "content", "start_line", "end_line", "language", "chunk_kind", "chunk_index", "embedding"]
    got = current_rows(chunks, ["project", "id"], cols)
    return got.withColumn("chunk_kind", F.coalesce("chunk_kind", F.lit("fallback_text"))) if "chunk_kind" in cols else got


@dataclass
class CodeGraph:
    """The four tables of the graph, as plain lazily evaluated DataFrames."""

    nodes: DataFrame
    edges: DataFrame
    externals: DataFrame
    chunks: DataFrame

    def project(self, name: str) -> "CodeGraph":
        """The same graph within one project; the filter reaches the scans."""
        return CodeGraph(*[df.where(F.col("project") == name) for df in (self.nodes, self.edges, self.externals, self.chunks)])


def load_graph(spark: SparkSession, sf_dir: str, node_columns: list[str] | None = None, chunk_columns: list[str] | None = None) -> CodeGraph:
    return CodeGraph(
        live_nodes(table(spark, sf_dir, "code_nodes"), node_columns),
        merged_edges(table(spark, sf_dir, "code_edges")),
        table(spark, sf_dir, "externals").dropDuplicates(["project", "id"]),
        merged_chunks(table(spark, sf_dir, "chunks"), chunk_columns),
    )
