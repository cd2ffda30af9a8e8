"""Incremental maintenance: what changed, what is provably gone, and merges in which stale beats empty."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.operators.hierarchy import hierarchy
from grovework.operators.model import EDGE_KEY, resolution_rank
from grovework.runtime import cut, ship

FILE_KEY = ["project", "file_path"]


def file_diff(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """``project, file_path, change`` (added, modified, deleted, same) by checksum, a full outer join.

    A null checksum on either side counts as modified, never as the same.
    """
    a = stored.select(*FILE_KEY, F.col("checksum").alias("old"), F.lit(True).alias("_a"))
    b = scanned.select(*FILE_KEY, F.col("checksum").alias("new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("old") == F.col("new"), "same").otherwise("modified")
    return a.join(b, FILE_KEY, "full").select(*FILE_KEY, change.alias("change"))


def stale_nodes(stored: DataFrame, produced: DataFrame, reconcilable: DataFrame) -> DataFrame:
    """Stored nodes of files that were parsed (``reconcilable``) and no longer give them; unparsed files keep theirs."""
    return stored.join(reconcilable, FILE_KEY, "left_semi").join(produced.select("project", "id"), ["project", "id"], "left_anti")


def stale_edges(stored: DataFrame, produced: DataFrame, produced_nodes: DataFrame) -> DataFrame:
    """Stored edges that were not produced although both their ends were."""
    n = produced_nodes.select("project", "id")
    gone = stored.join(produced.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return gone.join(n.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").join(n.withColumnRenamed("id", "target"), ["project", "target"], "left_semi")


def stale_chunks(stored: DataFrame, keep: DataFrame, files: DataFrame) -> DataFrame:
    return stored.join(files, FILE_KEY, "left_semi").join(keep.select("project", "id"), ["project", "id"], "left_anti")


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by key: incoming fields win, but an empty incoming summary keeps the stored summary and its hash."""
    key = ["project", "id"]
    cols = [c for c in stored.columns if c not in key]
    new = incoming.select(*key, F.struct(*cols).alias("n"))
    old = stored.select(*key, F.struct(*cols).alias("o"))
    keep = F.col("n").isNull() | ((F.coalesce(F.col("n.summary"), F.lit("")) == "") & (F.coalesce(F.col("o.summary"), F.lit("")) != ""))

    def field(c: str):
        if c in ("summary", "summary_input_hash", "summary_embedding"):
            return F.when(keep, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    return old.join(new, key, "full").select(*key, *[field(c) for c in cols])


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by edge key; incoming resolution and callee text replace stored ones, the most confident of several."""
    both = stored.withColumn("_old", F.lit(1)).unionByName(incoming.withColumn("_old", F.lit(0)))
    best = F.min(F.struct("_old", resolution_rank().alias("_r"), "resolution", "callee_text")).alias("b")
    return both.groupBy(*EDGE_KEY).agg(best).select(*EDGE_KEY, "b.resolution", "b.callee_text")


def write_checked(edges: DataFrame, nodes: DataFrame, externals: DataFrame) -> DataFrame:
    """Edges whose both ends resolve (targets may be externals): what a write really stores."""
    n = nodes.select("project", "id")
    ends = n.unionByName(externals.select("project", "id"))
    return edges.join(n.withColumnRenamed("id", "source"), ["project", "source"], "left_semi").join(ends.withColumnRenamed("id", "target").distinct(), ["project", "target"], "left_semi")


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ``gone`` nodes (project, id) and the edges at them."""
    g = gone.select("project", "id").distinct()
    e = edges.join(g.withColumnRenamed("id", "source"), ["project", "source"], "left_anti").join(g.withColumnRenamed("id", "target"), ["project", "target"], "left_anti")
    return nodes.join(g, ["project", "id"], "left_anti"), e


def repair_contains(edges: DataFrame, missing: DataFrame) -> DataFrame:
    new = missing.select("project", "source", F.lit("CONTAINS").alias("edge_type"), "target", F.lit("").alias("resolution"), F.lit("").alias("callee_text"))
    return edges.unionByName(new.select(*edges.columns)).dropDuplicates(EDGE_KEY)


def missing_summaries(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("node_type").isin("directory") & (F.coalesce("summary", F.lit("")) == "")).select("project", "id", "node_type")


def stale_embeddings(nodes: DataFrame) -> DataFrame:
    """Nodes with a summary that have no vector."""
    return nodes.where((F.coalesce("summary", F.lit("")) != "") & F.col("summary_embedding").isNull()).select("project", "id")


def reuse_vectors(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks with the stored vector of the same id; ``to_embed`` marks those that still need one."""
    old = stored.select("project", "id", F.col("embedding").alias("_v"))
    return chunks.join(old, ["project", "id"], "left").withColumn("embedding", F.coalesce("_v", "embedding") if "embedding" in chunks.columns else F.col("_v")).withColumn("to_embed", F.col("embedding").isNull()).drop("_v")


def summarise(nodes: DataFrame, hashes: DataFrame, stored: DataFrame) -> DataFrame:
    """Summaries by hash: reuse where the input hash is unchanged, else the first sentence of the documentation.

    Without a new text the previous summary stays and its hash is blanked, so that it is tried again.
    """
    old = stored.select("project", "id", F.col("summary").alias("_s"), F.col("summary_input_hash").alias("_h"))
    first = F.regexp_extract(F.regexp_replace(F.coalesce("docstring", F.lit("")), r"^[\s/*#\"']+", ""), r"^(.+?[.!?])(\s|$)", 1)
    j = nodes.join(hashes, ["project", "id"]).join(old, ["project", "id"], "left")
    same = F.coalesce(F.col("_h") == F.col("input_hash"), F.lit(False)) & (F.coalesce("_s", F.lit("")) != "")
    return j.select(
        "project",
        "id",
        F.when(same, F.col("_s")).when(first != "", first).otherwise(F.col("_s")).alias("summary"),
        F.when(same | (first != ""), F.col("input_hash")).otherwise(F.lit("")).alias("summary_input_hash"),
        F.when(same, "reused").when(first != "", "generated").otherwise("failed").alias("outcome"),
    )


def stale_summary_vectors(nodes: DataFrame, stored: DataFrame) -> DataFrame:
    """Nodes to embed again: no stored vector, or one made from another input hash (a null stored hash is taken as fresh).

    ``nodes``: project, id, summary, summary_input_hash; ``stored``: project, id, vector_hash, summary_embedding.
    """
    old = stored.select("project", "id", "vector_hash", F.col("summary_embedding").isNotNull().alias("_has"))
    j = nodes.where(F.coalesce("summary", F.lit("")) != "").join(old, ["project", "id"], "left")
    fresh = F.coalesce("_has", F.lit(False)) & (F.col("vector_hash").isNull() | F.coalesce(F.col("vector_hash") == F.col("summary_input_hash"), F.lit(False)))
    return j.where(~fresh).select("project", "id")


def split_long(text: str, most: int) -> list[str]:
    """Parts of at most ``most`` characters that overlap by a fifth."""
    step = max(1, most - most // 5)
    return [text[i : i + most] for i in range(0, max(1, len(text) - most // 5), step)]


def pack_lines(lines: list[str], most: int) -> list[str]:
    """Lines in order, joined greedily to texts of at most ``most`` characters (a longer line stands alone)."""
    out: list[str] = []
    for x in lines:
        if out and len(out[-1]) + 1 + len(x) <= most:
            out[-1] += "\n" + x
        else:
            out.append(x)
    return out


def map_reduce(parts: list[str], summarise_text: Callable[[str], str], most: int) -> str:
    """The summary of the summaries of parts, until they fit into ``most`` characters at once."""
    while len(parts) > 1:
        made = [summarise_text(p) for p in parts]
        packed = pack_lines(made, most)
        parts = packed if len(packed) < len(parts) else ["\n".join(made)[:most]]
    return summarise_text(parts[0]) if parts else ""


def first_sentence(text: str) -> str:
    """The bundled text generator: the first sentence, or the first line."""
    m = re.search(r"^(.+?[.!?])(\s|$)", text.strip(), re.S)
    return m.group(1) if m else text.strip().split("\n")[0]


def drain_summaries(nodes: DataFrame, stored: DataFrame, summarise_text: Callable[[str], str] = first_sentence, most: int = 12_000) -> DataFrame:
    """``project, id, summary, summary_input_hash, outcome`` bottom up: leaves first, a container once all its children were
    tried; an unchanged input hash reuses the stored summary, a failure keeps it and blanks its hash.

    ``nodes``: project, id, parent_id, name, node_type, file_path, line_start, source, signature, docstring. One round per
    level of the tree; each round is cut, so that a lost executor repeats no earlier one.
    """
    ship(nodes.sparkSession)
    spark = nodes.sparkSession
    h = cut(hierarchy(nodes.select("project", "id", "parent_id", F.lit(None).cast("timestamp").alias("indexed_at"))).select("project", "id", "depth", "n_descendants"), "levels")
    rows = nodes.join(h, ["project", "id"])
    kids = F.coalesce("file_path", F.lit("")), F.coalesce("line_start", F.lit(0)), F.col("id")
    schema = "project string, id string, summary string, summary_input_hash string, outcome string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.same:
                    out.append((r.project, r.id, r.old, r.input_hash, "reused"))
                    continue
                parts = split_long(r.text, most) if r.leaf else pack_lines(r.text.split("\n"), most)
                try:
                    made = map_reduce([p for p in parts if p.strip()], summarise_text, most)
                except Exception:  # whatever the generator raises
                    made = ""
                out.append((r.project, r.id, made, r.input_hash, "generated") if made else (r.project, r.id, r.old, "", "failed"))
            yield pd.DataFrame(out, columns=["project", "id", "summary", "summary_input_hash", "outcome"])

    old = stored.select("project", "id", F.col("summary").alias("old"), F.col("summary_input_hash").alias("_h"))
    done = spark.createDataFrame([], schema)
    deepest = rows.agg(F.max("depth").alias("d")).first()["d"]
    for d in range(-1 if deepest is None else deepest, -1, -1):
        here = rows.where(F.col("depth") == d)
        leaf = F.col("n_descendants") == 0
        text = F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in ("source", "signature", "docstring")])
        leaves = here.where(leaf).select("project", "id", F.lit(True).alias("leaf"), F.coalesce(F.nullif("docstring", F.lit("")), F.nullif("source", F.lit("")), "signature", F.lit("")).alias("text"), F.sha2(text, 256).alias("input_hash"))
        line = F.concat_ws(" ", "node_type", F.concat(F.coalesce("name", F.lit("")), F.lit(":")), F.coalesce("summary", F.lit("")))
        below = rows.where(F.col("depth") == d + 1).join(done.select("project", "id", "summary"), ["project", "id"], "left")
        listed = below.groupBy("project", F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(kids)], line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
        inner = here.where(~leaf).select("project", "id").join(listed, ["project", "id"]).select("project", "id", F.lit(False).alias("leaf"), "text", F.sha2("text", 256).alias("input_hash"))
        todo = leaves.unionByName(inner).join(old, ["project", "id"], "left")
        same = F.coalesce(F.col("_h") == F.col("input_hash"), F.lit(False)) & (F.coalesce("old", F.lit("")) != "")
        level = todo.select("project", "id", "leaf", "text", "input_hash", "old", same.alias("same")).mapInPandas(work, schema)
        done = cut(done.unionByName(level), "summaries")
    return done
