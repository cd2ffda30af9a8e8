"""Problem 1: references to records that do not exist.

References and the keys they should find are co-partitioned by key, sorted by it and merged linearly (a sort-merge
join; adaptive execution splits the partitions of hot keys on the reference side). Every parent key carries its
validity interval, so that one pass tells missing, deleted and late parents apart.

Defined results
* a null reference is no reference; an empty string is one;
* keys match when all their columns are exactly equal; a null in the owner column (``project``) matches nothing,
  so such a reference is ``missing``;
* repeated edges count once; when copies of an edge differ in time, the earliest decides;
* a null edge time is never before a parent's first time, so it cannot be ``later``;
* a parent row without a time counts as oldest, and a parent all of whose rows lack one is never late;
* no edges: no rows; no parents: every reference is ``missing``; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = ["project", "source", "edge_type", "target"]


def parent_intervals(nodes: DataFrame, externals: DataFrame | None = None) -> DataFrame:
    """``project, id, in_nodes, valid_from, removed_at``: one row per key that some row names.

    ``valid_from`` is the earliest time a node was indexed (null: since ever, as for externals); ``removed_at`` is
    the current row's ``deleted_at`` (null: still there).
    """
    keys = nodes.where(F.col("project").isNotNull() & F.col("id").isNotNull()).select(
        "project", "id", "indexed_at", "deleted_at", F.lit(True).alias("in_nodes")
    )
    if externals is not None:
        keys = keys.unionByName(
            externals.where(F.col("project").isNotNull() & F.col("id").isNotNull()).select(
                "project",
                "id",
                F.lit(None).cast("timestamp").alias("indexed_at"),
                F.lit(None).cast("timestamp").alias("deleted_at"),
                F.lit(False).alias("in_nodes"),
            )
        )
    return keys.groupBy("project", "id").agg(
        F.max("in_nodes").alias("in_nodes"),
        F.max(~F.col("in_nodes")).alias("in_externals"),
        F.min("indexed_at").alias("valid_from"),
        F.max(F.struct("indexed_at", "deleted_at")).getField("deleted_at").alias("removed_at"),
    )


def references(edges: DataFrame) -> DataFrame:
    """One row per distinct edge and non-null end: ``project, source, edge_type, target, edge_at, side, ref``."""
    distinct = edges.groupBy(*EDGE).agg(F.min("indexed_at").alias("edge_at"))
    ends = F.explode(
        F.array(
            F.struct(F.lit("source").alias("side"), F.col("source").alias("ref")),
            F.struct(F.lit("target").alias("side"), F.col("target").alias("ref")),
        )
    ).alias("end")
    return distinct.select(*EDGE, "edge_at", ends).select(*EDGE, "edge_at", "end.side", "end.ref").where(F.col("ref").isNotNull())


def resolve_references(edges: DataFrame, nodes: DataFrame, externals: DataFrame) -> DataFrame:
    """Every reference with ``reason``: missing, deleted, later or null (sound)."""
    # One key of both columns: its shuffles are the join's own on both sides, directly below the sorts, which is what
    # adaptive execution can split where a key is hot (it cannot split the shuffle of an aggregate).
    key = lambda c: F.struct(F.col("project").alias("a"), F.col(c).alias("b")).alias("k")
    refs = references(edges).select("*", key("ref")).alias("r")
    parents = parent_intervals(nodes, externals).select("*", key("id")).alias("p")
    merged = refs.join(parents.hint("merge"), F.col("r.k") == F.col("p.k"), "left")
    external_ok = (F.col("side") == "target") & F.coalesce(F.col("in_externals"), F.lit(False))
    reason = (
        F.when(external_ok, F.lit(None).cast("string"))
        .when(~F.coalesce(F.col("in_nodes"), F.lit(False)), "missing")
        .when(F.col("removed_at").isNotNull(), "deleted")
        .when(F.col("valid_from") > F.col("edge_at"), "later")
    )
    return merged.select(*[F.col(f"r.{c}") for c in EDGE], "edge_at", "side", "ref", reason.alias("reason"))


def orphan_references(edges: DataFrame, nodes: DataFrame, externals: DataFrame) -> DataFrame:
    """``project, source, edge_type, target, side, reason`` of every dangling end."""
    return resolve_references(edges, nodes, externals).where(F.col("reason").isNotNull()).select(*EDGE, "side", "reason")


def orphan_report(edges: DataFrame, nodes: DataFrame, externals: DataFrame) -> DataFrame:
    """References per edge type, referenced table and month of the edge: all, sound and dangling by reason.

    The referenced table is ``externals`` for a target whose id starts with ``ext:``, else ``code_nodes``.
    """
    named = F.when((F.col("side") == "target") & F.col("ref").startswith("ext:"), "externals").otherwise("code_nodes")
    count = lambda r: F.sum(F.when(F.col("reason") == r, 1).otherwise(0)).alias(f"n_{r}")
    return (
        resolve_references(edges, nodes, externals)
        .groupBy("edge_type", named.alias("ref_table"), F.date_format("edge_at", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n_refs"), count("missing"), count("deleted"), count("later"))
        .withColumn("dangling_share", F.round((F.col("n_missing") + F.col("n_deleted") + F.col("n_later")) / F.col("n_refs"), 6))
    )
