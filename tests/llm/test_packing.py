import random

from hypothesis import given, settings
from hypothesis import strategies as st

from grovework.llm import packing as P


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(30, 60))
def test_plan_is_exact(counts, capacity):
    plan = P.pack_counts(counts, capacity)
    used = {}
    for times, pattern in plan:
        assert times > 0 and sum(x * n for x, n in pattern.items()) <= capacity
        for x, n in pattern.items():
            used[x] = used.get(x, 0) + n * times
    assert used == counts


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 40))
def test_best_fill_against_enumeration(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    best = max(s for s in sums if s <= room)
    got = P.best_fill(room, sorted(counts, reverse=True), counts)
    assert sum(x * n for x, n in got.items()) == best and all(n <= counts[x] for x, n in got.items())


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BLOCK", 7)  # a length shared by more rows is numbered in blocks
    rnd = random.Random(1)
    rows = [(i, rnd.choice([5, 5, 5, 20, 33, 64, 100, 101, 250, 0, None]), "clash") for i in range(150)] + [(3, 5, "clash"), (3, 5, "clash"), (None, 7, "clash")]
    out = P.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, container string"), 100).collect()
    want = sum(x or 0 for _, x, _ in rows)
    assert sum(r["size"] for r in out) == want
    fill = {}
    for r in out:
        if r["container"] is not None:
            fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        assert (r["n_pieces"] > 1) == (r["token_to"] > 100 or r["piece"] > 0 or r["n_pieces"] > 1)
        assert (r["container"] is None) == (r["size"] == 0)
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= -(-want // 100) + 2
    split = {r["doc_id"] for r in out if r["n_pieces"] > 1}
    assert split == {i for i, n, _ in rows if n and n > 100}
    assert sum(r["doc_id"] == 3 and r["piece"] == 0 for r in out) == 3 and any(r["doc_id"] is None for r in out)


def test_invariants_see_faults(spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(i, 1 + i * 7 % 130) for i in range(200)] + [(1, None), (1, 8), (1, 8)], "doc_id long, n_tokens long")
    packed = P.pack(items, 100)
    good = P.invariants(packed, 100).first()
    assert good.asDict() == {"n_items": 203, "n_empty": 1, "split_though_fitting": 0, "not_covered_once": 0, "over_capacity": 0, "well_filled": True}
    bad = P.invariants(packed.withColumn("container", F.col("container") % 7), 100).first()
    assert bad["over_capacity"] == 7
    assert P.invariants(packed.where("piece = 0"), 100).first()["not_covered_once"] > 0
    assert P.invariants(packed.withColumn("container", F.col("copy")), 100).first()["well_filled"] is False


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10).count() == 0
