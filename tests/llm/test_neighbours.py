import numpy as np
import pytest

from grovework.llm import neighbours as N

SCHEMA = "vec_field string, project string, id string, vec array<float>"


def brute(rows, k, floor):
    out = set()
    for f in {r[0] for r in rows}:
        own = sorted((p, i, np.array(v, dtype="f8")) for g, p, i, v in rows if g == f)
        x = np.array([v / np.linalg.norm(v) for _, _, v in own])
        s = np.round(x @ x.T, 6)
        np.fill_diagonal(s, -2)
        for a in range(len(own)):
            for b in np.argsort(-s[a], kind="stable")[:k]:
                if s[a, b] >= floor and a != b:
                    out.add((f, *own[a][:2], *own[b][:2]))
    return out


def clustered(n, copies, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 64))
    rows = [("embedding", f"p{i % 3}", f"c{i:05d}", v.astype("f4").tolist()) for i, v in enumerate(base)]
    for i in range(n // 3):
        rows.append(("embedding", "q", f"near{i:05d}", (base[i] + rng.normal(scale=0.02, size=64)).astype("f4").tolist()))
    rows += [("embedding", "q", f"copy{i:05d}", base[0].astype("f4").tolist()) for i in range(copies)]
    rows += [("summary_embedding", "p", f"s{i}", base[i % 5].astype("f4").tolist()) for i in range(10)]
    return rows


def test_recall_and_copies(spark):
    rows = clustered(1500, 400)
    got = {(r["vec_field"], r["project"], r["id"], r["n_project"], r["n_id"]) for r in N.nearest(spark.createDataFrame(rows, SCHEMA), 5, 0.9, candidates=400).collect()}
    want = brute(rows, 5, 0.9)
    assert len(got & want) / len(want) >= 0.9 and len(got - want) / len(got) < 0.05


def test_queries_are_searched_against_all(spark):
    rows = clustered(200, 0, 3)
    v = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    got = N.nearest(v, 3, 0.9, queries=F.col("id").startswith("near")).collect()
    assert got and all(r["id"].startswith("near") for r in got) and any(not r["n_id"].startswith("near") for r in got)


def test_unusable_vectors(spark):
    c = "project string, id string, embedding array<float>, vec string"
    good = [float(i + 1) for i in range(64)]
    rows = [("p", "a", good, "x"), ("p", "a", good, "x"), ("p", "b", good, "x"), ("p", "zero", [0.0] * 64, "x"), ("p", "old", [1.0] * 32, "x"), ("p", "nan", [float("nan")] + good[1:], "x"), ("p", "none", None, "x"), (None, "k", good, "x"), ("p", "hole", [None] + good[1:], "x")]
    n = spark.createDataFrame([], "project string, id string, indexed_at timestamp, summary_embedding array<float>")
    got = [tuple(r) for r in N.found(spark.createDataFrame(rows, c), n).collect()]
    assert got == [("embedding", "p", "a", "p", "b")]


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(1)
    d1, d2, counts = rng.random(6), rng.random(5), rng.integers(0, 3, (6, 5))
    cells = N.walk(d1, d2, counts, 10**9)
    sums = [d1[i] + d2[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == int((counts > 0).sum())


def full(rows, k):
    """Every row's k nearest by cosine to six decimals, then by key."""
    out = {}
    for f in {r[0] for r in rows}:
        own = sorted((p, i, np.array(v, dtype="f8")) for g, p, i, v in rows if g == f)
        for p, i, v in own:
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), q, j) for q, j, w in own if (q, j) != (p, i))
            out[f, p, i] = [(q, j) for _, q, j in near[:k]]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault((r["vec_field"], r["project"], r["id"]), []).append((r["n_project"], r["n_id"]))
    return out


def test_ties_are_settled_by_key_in_every_order_of_rows(spark):
    unit = np.eye(64, dtype="f4")
    rows = [("embedding", "p", f"x{i:02d}", (unit[0] + unit[1 + i % 40]).tolist()) for i in range(60)]  # all pairs of cosine 0.5 or 1
    rows = [rows[i] for i in np.random.default_rng(2).permutation(60)]
    assert collected(N.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), 5)) == full(rows, 5)


def test_equal_vectors_in_both_fields(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 64)).astype("f4").tolist()
    rows = [(f, "p", f"x{i:02d}", v) for f in ("embedding", "summary_embedding") for i, v in enumerate(base)]
    got = collected(N.nearest(spark.createDataFrame(rows, SCHEMA), 5))
    assert got == full(rows, 5) and all(len(set(v)) == 5 for v in got.values())


def test_hot_cells_are_split(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    rows = [("embedding", "p", f"h{i:03d}", (centre + rng.normal(scale=0.01, size=64)).astype("f4").tolist()) for i in range(200)]
    rows += [("embedding", "q", f"o{i:03d}", rng.normal(size=64).astype("f4").tolist()) for i in range(100)]
    got = N.nearest(spark.createDataFrame(rows, SCHEMA), 4, candidates=1000, group_rows=30, query_rows=40)
    got, want = collected(got), full(rows, 4)
    assert got.keys() == want.keys() and all(set(got[x]) == set(want[x]) for x in want)


def test_empty(spark):
    assert N.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_tiny(spark, n):
    rows = [("embedding", "p", f"i{k}", [1.0] * 64) for k in range(n)]
    assert N.nearest(spark.createDataFrame(rows, SCHEMA)).count() == n * (n - 1)
