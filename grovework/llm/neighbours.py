"""Problem 7: the most similar vectors for every vector, by an inverted multi-index.

1. Rows with exactly equal vectors form a group; one representative of each group is indexed.
2. Per field two codebooks, one for each half of the (normalised) vector, are fitted by k-means on a bounded sample;
   every representative is indexed by its pair of centroids (its cell).
3. For each query a heap walks centroid pairs by summed distance; it stops once the cells met hold ``candidates``
   vectors. Queries travel to the partitions of those cells and are compared there block by block with all vectors of
   the cell (reranking by exact cosine). A cell that holds too many rows for one task is split into blocks, as are the
   queries that travel to it; every block of queries meets every block of the cell.
4. The best k of all partitions are kept and expanded from representatives to the rows of their groups. Row numbers
   follow the order of keys, so that equal cosines are settled by key in every step and k places are enough throughout.

What is broadcast: the codebooks and the cell counts, at most ``MAX_CENTROIDS`` squared numbers.

Defined results
* only vectors of 64 (``dim``) finite values that are not all zero take part; null vectors and null elements do not;
* rows of the same field, project and id count once (the greatest vector, should they differ);
* among equal cosines (to six decimals) the smaller key (project, id) is the nearer one, however many are equal; a row
  is no neighbour of itself; neighbours are of the same field, also where both fields hold equal vectors;
* a key with a null project or id does not take part; no rows give no pairs; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovework.runtime import current_rows, cut, release, ship

SAMPLE = 20_000  # rows of each field the codebooks are fitted on
CELL_ROWS = 256  # wanted mean occupancy of a cell
MAX_CENTROIDS = 1024  # of each half
CANDIDATES = 1500  # vectors a query for near pairs meets at least
NEAREST_CANDIDATES = 6000  # and a query for the nearest ones, however far they are
GROUP_ROWS = 20_000  # rows of a partition of cells; a cell of more is split into blocks
QUERY_ROWS = 200_000  # queries that meet one block of a cell in one task


def usable(v: str, dim: int = 64):
    c = F.col(v)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) == dim) & ~bad & F.exists(c, lambda x: x != 0)


def vectors_of(chunks: DataFrame, nodes: DataFrame, dim: int = 64) -> DataFrame:
    """``vec_field, project, id, vec``: usable vectors, one row per key; of nodes the current rows."""
    # ranges of keys, so that rows can be numbered in the order of their keys without another shuffle
    by_key = lambda df: df.repartitionByRange("project", "id")
    keyed = F.col("project").isNotNull() & F.col("id").isNotNull()
    a = by_key(chunks.where(keyed & usable("embedding", dim)).select("project", "id", "embedding")).groupBy("project", "id").agg(F.max("embedding").alias("vec"))
    b = current_rows(by_key(nodes.where(keyed).select("project", "id", "indexed_at", "summary_embedding")), ["project", "id"], ["summary_embedding"])
    b = b.where(usable("summary_embedding", dim))
    return a.select(F.lit("embedding").alias("vec_field"), "project", "id", "vec").unionByName(
        b.select(F.lit("summary_embedding").alias("vec_field"), "project", "id", F.col("summary_embedding").alias("vec"))
    )


def _stack(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype="<f4").reshape(len(col), -1)


def _normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors as float32 bytes, and a digest of them."""
    import hashlib

    for pdf in batches:
        if not len(pdf):
            continue
        x = np.array(pdf["vec"].tolist(), dtype="f8")
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        raw = [v.tobytes() for v in x.astype("<f4")]
        out = pdf.drop(columns="vec")
        out["unit"] = raw
        out["digest"] = [hashlib.blake2b(v, digest_size=16).digest() for v in raw]
        yield out


def kmeans(x: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm on the distinct rows of ``x``; empty centroids move to the farthest rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].astype("f4")
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        sums = np.zeros_like(c)
        filled = np.flatnonzero(n)
        sums[filled] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[filled])[:-1]]), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype("f4")
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(d.min(1))[-len(empty) :]]
    return c


def _half_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Non-empty cells by summed distance until they hold ``enough`` vectors (multi-sequence traversal with a heap)."""
    o1, o2 = d1.argsort(), d2.argsort()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, seen, met, cells = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, 0, []
    while heap and met < enough:
        _, i, j = heapq.heappop(heap)
        n = counts[o1[i], o2[j]]
        if n:
            met += n
            cells.append((int(o1[i]), int(o2[j])))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < len(s2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return cells


def _best(qv: np.ndarray, xv: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int, floor: float, cells: int = 4_000_000):
    """Per query the k nearest of ``xv`` (in ascending ``xid``) with cosine >= floor: arrays of query, neighbour, cosine.

    Among cosines that are equal to six decimals the smaller ``xid`` comes first.
    """
    out, n = [], len(xv)
    xv, back = xv.astype("f8").T, np.arange(n - 1, -1, -1)
    block = max(1, cells // max(1, n))
    for i in range(0, len(qv), block):
        s = qv[i : i + block].astype("f8") @ xv
        s[qid[i : i + block, None] == xid[None, :]] = -2
        if n > k:
            order = np.rint(s * 1e6).astype("i8") * n + back
            top = np.argpartition(order, n - k, axis=1)[:, n - k :]
            val = np.take_along_axis(s, top, axis=1)
        else:
            top, val = np.broadcast_to(np.arange(n), s.shape), s
        r, c = np.nonzero(val >= max(floor, -1.5))
        out.append((qid[i : i + block][r], xid[top[r, c]], val[r, c]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "f8"))


def _search(reps: DataFrame, queries, k: int, floor: float, candidates: int, group_rows: int, query_rows: int) -> DataFrame:
    """``qid, nid, cos`` among representatives (vec_field, rid, unit); ``queries`` is a condition on them or None."""
    spark = reps.sparkSession
    sizes = {r["vec_field"]: r["n"] for r in reps.groupBy("vec_field").agg(F.count(F.lit(1)).alias("n")).collect()}  # two fields
    books: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for f, n in sizes.items():
        own = reps.where(F.col("vec_field") == f)
        share = SAMPLE * 1.2 / n
        if share < 1:
            own = own.where(F.pmod(F.xxhash64("unit"), F.lit(1_000_000)) < int(share * 1_000_000))
        x = _stack(own.select("unit").limit(SAMPLE).toPandas()["unit"])
        half = x.shape[1] // 2
        c = min(MAX_CENTROIDS, max(1, math.isqrt(n // CELL_ROWS)), max(1, len(x) // 8))
        books[f] = kmeans(x[:, :half], c), kmeans(x[:, half:], c)
    shared = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, part in pdf.groupby("vec_field"):
                x, (a, b) = _stack(part["unit"]), shared.value[f]
                half = a.shape[1]
                yield part.assign(c1=_half_distances(x[:, :half], a).argmin(1).astype("int32"), c2=_half_distances(x[:, half:], b).argmin(1).astype("int32"))

    schema = ", ".join(f"`{n}` {t}" for n, t in reps.dtypes)
    index = cut(reps.mapInPandas(assign, schema + ", c1 int, c2 int"), "multi-index")
    counts = {f: np.zeros((len(a), len(b)), dtype="int64") for f, (a, b) in books.items()}
    for r in index.groupBy("vec_field", "c1", "c2").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        counts[r["vec_field"]][r["c1"], r["c2"]] = r["n"]
    # cells side by side in one first half share a partition as far as GROUP_ROWS goes
    width = {}
    for f, (a, b) in books.items():
        per = sizes[f] / max(1, len(a))
        width[f] = max(1, math.ceil(len(b) / max(1, math.ceil(per / group_rows))))
    # (blocks of held rows, blocks of queries) of the groups of cells with too many rows for one task
    split: dict[tuple[str, int, int], tuple[int, int]] = {}
    for f, n in counts.items():
        wide, near = width[f], max(1.0, candidates * (n > 0).sum() / max(1, n.sum()))  # cells a query meets about
        for i, row in enumerate(n):
            for g, size in enumerate(np.add.reduceat(row, np.arange(0, len(row), wide)).tolist()):
                blocks = math.ceil(size / group_rows), math.ceil(size * near / query_rows)
                if max(blocks) > 1:
                    split[f, i, g] = blocks
    shared_counts = spark.sparkContext.broadcast((counts, width, split))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, part in pdf.groupby("vec_field"):
                x, (a, b) = _stack(part["unit"]), shared.value[f]
                half, (cells, wide), hot = a.shape[1], (shared_counts.value[0][f], shared_counts.value[1][f]), shared_counts.value[2]
                d1, d2 = _half_distances(x[:, :half], a), _half_distances(x[:, half:], b)
                rows = []
                for rid, unit, p, q in zip(part["rid"], part["unit"], d1, d2):
                    places: dict[tuple[int, int], list[int]] = {}
                    for i, j in walk(p, q, cells, candidates):
                        places.setdefault((i, j // wide), []).append(j)
                    for (i, g), js in places.items():
                        held, asking = hot.get((f, i, g), (1, 1))
                        rows += [(f, i, g, h, rid % asking, rid, unit, js) for h in range(held)]
                yield pd.DataFrame(rows, columns=["vec_field", "c1", "grp", "hb", "qb", "rid", "unit", "cells"])

    asked = index if queries is None else index.where(queries)
    routed = asked.select("vec_field", "rid", "unit").mapInPandas(route, "vec_field string, c1 int, grp int, hb int, qb int, rid long, unit binary, cells array<int>")
    grp = F.lit(0)
    for f, w in width.items():
        grp = F.when(F.col("vec_field") == f, F.floor(F.col("c2") / F.lit(w)).cast("int")).otherwise(grp)
    held = index.select("vec_field", "c1", grp.alias("grp"), "c2", "rid", "unit")
    one = F.lit(0)
    if split:  # at most one row for each group_rows vectors, and no more than there are cells
        hot = spark.createDataFrame([(*key, *blocks) for key, blocks in split.items()], "vec_field string, c1 int, grp int, _hb int, _qb int")
        held = held.join(F.broadcast(hot), ["vec_field", "c1", "grp"], "left")
        each = F.explode(F.sequence(F.lit(0), F.coalesce("_qb", F.lit(1)) - 1)).alias("qb")
        held = held.select("vec_field", "c1", "grp", F.pmod("rid", F.coalesce("_hb", F.lit(1))).cast("int").alias("hb"), each, "c2", "rid", "unit")
    else:
        held = held.withColumn("hb", one).withColumn("qb", one)

    def compare(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            qv = _stack(asked["unit"])
            own = own.sort_values("rid")
            xv = _stack(own["unit"])
            xid, qid, c2 = own["rid"].to_numpy(), asked["rid"].to_numpy(), own["c2"].to_numpy()
            lists = asked["cells"].tolist()
            at = np.repeat(np.arange(len(lists)), [len(z) for z in lists])
            cell = np.concatenate([np.asarray(z) for z in lists])
            for c in np.unique(cell):
                mine, theirs = at[cell == c], np.flatnonzero(c2 == c)
                if len(theirs):
                    found.append(_best(qv[mine], xv[theirs], qid[mine], xid[theirs], k, floor))
        q, n, s = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "f8"))
        return pd.DataFrame({"qid": q, "nid": n, "cos": s})

    by = ["vec_field", "c1", "grp", "hb", "qb"]
    return held.groupBy(*by).cogroup(routed.groupBy(*by)).applyInPandas(compare, "qid long, nid long, cos double")


def nearest(
    vectors: DataFrame, k: int = 5, floor: float = -1.0, candidates: int = CANDIDATES, queries=None, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS, in_order: bool = False
) -> DataFrame:
    """``vec_field, project, id, n_project, n_id, cos, rank``: of each row its k most similar with cosine >= floor.

    ``vectors`` hold one row per key; ``in_order`` says that their partitions follow the order of keys within each field,
    as those of ``vectors_of`` do.
    ``queries`` limits the rows asked for to those of a condition on vec_field, project and id (all are searched).
    """
    ship(vectors.sparkSession)
    ordered = (vectors if in_order else vectors.repartitionByRange("vec_field", "project", "id")).sortWithinPartitions("vec_field", "project", "id")
    unit = ordered.mapInPandas(_normalise, "vec_field string, project string, id string, unit binary, digest binary")
    # numbers in the order of keys; they are read from the written table from here on
    rows = cut(unit.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    same = Window.partitionBy("vec_field", "digest").orderBy("project", "id")
    # of a group of equal vectors only its k + 1 smallest keys can be anybody's neighbours
    members = cut(
        rows.select("vec_field", "project", "id", "digest", "rid").withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1), "members"
    )
    rep = members.where("place = 1").select("vec_field", "digest", F.col("rid").alias("rep"))
    reps = rows.join(rep.select(F.col("rep").alias("rid")), "rid", "left_semi").select("vec_field", "rid", "unit")
    asked = None
    if queries is not None:
        wanted = rows.where(queries).select("vec_field", "digest").distinct().join(rep, ["vec_field", "digest"])
        reps = reps.join(wanted.select(F.col("rep").alias("rid"), F.lit(True).alias("asked")), "rid", "left")
        asked = F.col("asked")
    hits = _search(reps, asked, k, floor, candidates, group_rows, query_rows)
    # a row among the k nearest belongs to one of the k nearest groups, since a group is placed by its smallest key
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("cos", 6)), "nid"))
    hits = cut(hits.withColumn("_place", best).where(F.col("_place") <= k).drop("_place"), "hits")
    # groups of equal vectors: their members are each other's neighbours of cosine 1
    own = members.select("digest", "vec_field", F.col("project").alias("n_project"), F.col("id").alias("n_id"))
    many = members.where("place = 2").select("vec_field", "digest")
    keys = rows.select("vec_field", "project", "id", "digest") if queries is None else rows.where(queries).select("vec_field", "project", "id", "digest")
    twins = keys.join(many, ["vec_field", "digest"], "left_semi").join(own, ["vec_field", "digest"]).withColumn("cos", F.lit(1.0))
    pairs = (
        hits.join(rep.select(F.col("rep").alias("qid"), "vec_field", "digest"), "qid")
        .join(rep.select(F.col("rep").alias("nid"), F.col("digest").alias("n_digest")), "nid")
        .select("vec_field", "digest", "n_digest", "cos")
    )
    others = keys.join(pairs, ["vec_field", "digest"]).join(own.withColumnRenamed("digest", "n_digest"), ["vec_field", "n_digest"])
    cols = ["vec_field", "project", "id", "n_project", "n_id", "cos"]
    allp = twins.select(cols).unionByName(others.select(cols)).where((F.col("project") != F.col("n_project")) | (F.col("id") != F.col("n_id")))
    rank = F.row_number().over(Window.partitionBy("vec_field", "project", "id").orderBy(F.desc(F.round("cos", 6)), "n_project", "n_id"))
    return allp.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_pairs(near: DataFrame) -> DataFrame:
    """``vec_field, project_a, id_a, project_b, id_b`` of each pair of which one is among the other's nearest."""
    first = (F.col("project") < F.col("n_project")) | ((F.col("project") == F.col("n_project")) & (F.col("id") < F.col("n_id")))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return near.select(
        "vec_field",
        pick("project", "n_project").alias("project_a"),
        pick("id", "n_id").alias("id_a"),
        pick("n_project", "project").alias("project_b"),
        pick("n_id", "id").alias("id_b"),
    ).distinct()


def found(chunks: DataFrame, nodes: DataFrame, k: int = 5, floor: float = 0.95) -> DataFrame:
    return similar_pairs(nearest(vectors_of(chunks, nodes), k, floor, in_order=True))
