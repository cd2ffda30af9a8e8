import pytest

from grovework.llm import mixing as M

SIZES = "doc_id long, source string, n_tokens long, passes string"
TARGETS = "source string, target_share double, max_repeats int"


def test_solve_exact_targets():
    w, size, a = M.solve({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1), "none": (0.3, 9)})
    assert w == {"a": 0.5, "b": 0.5} and size == 400 and a == 1.0


def test_solve_bisects_to_the_repetition_limit():
    tokens, targets = {"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 2)}
    w, size, a = M.solve(tokens, targets, 1000)
    assert size == 1000 and 0 < a < 1 and w["a"] * size == pytest.approx(200, rel=1e-6)
    w, size, a = M.solve(tokens, targets, 5000)
    assert a == 0.0 and size == 2200 and w["a"] * size == pytest.approx(200)


def test_entropy():
    w = M.weights_of_entropy({"a": 0.9, "b": 0.1}, 0.6)
    assert M.entropy(w) == pytest.approx(0.6, abs=1e-6)
    assert M.solve({}, {}) == ({}, 0.0, 1.0)


def run(spark, rows, targets, **k):
    s = spark.createDataFrame([(*r, "clash") for r in rows], SIZES)
    t = spark.createDataFrame(targets, TARGETS)
    return M.mix(s, t, **k), M.report(s, t)


def test_mix(spark):
    rows = [(i, "big", 10) for i in range(900)] + [(1000 + i, "small", 10) for i in range(100)] + [(2000, None, 10), (2001, "big", None), (2002, "big", 0), (2003, "none", 10)]
    drawn, report = run(spark, rows, [("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.1, 5)], block_rows=60)
    got = drawn.collect()
    per = {}
    for r in got:
        per.setdefault((r["source"], r["doc_id"]), []).append(r["use"])
    assert all(sorted(u) == list(range(1, len(u) + 1)) or len(set(u)) == len(u) for u in per.values())
    assert max(len(u) for (s, _), u in per.items() if s == "big") == 1 and max(len(u) for (s, _), u in per.items() if s == "small") <= 3
    tokens = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in ("big", "small")}
    assert tokens["big"] / sum(tokens.values()) == pytest.approx(0.7, abs=0.01)
    rep = {r["source"]: r for r in report.collect()}
    assert rep["absent"]["drawn_tokens"] == 0 and rep["none"]["target_share"] == 0 and rep["small"]["most_uses"] <= 3


def test_prefixes_have_the_weights(spark):
    rows = [(i, "big", 10) for i in range(900)] + [(1000 + i, "small", 5) for i in range(200)]
    drawn, _ = run(spark, rows, [("big", 0.7, 1), ("small", 0.3, 3)], block_rows=30)
    got = sorted(drawn.collect(), key=lambda r: r["position"])
    assert len({(r["source"], r["position"]) for r in got}) == len(got) and 0 <= got[0]["position"] and got[-1]["position"] < 1
    for part in (0.1, 0.3, 0.6, 1.0):
        head = got[: int(len(got) * part)]
        assert sum(r["n_tokens"] for r in head if r["source"] == "big") / sum(r["n_tokens"] for r in head) == pytest.approx(0.7, abs=0.02)
    orders = [[r["doc_id"] for r in got if r["source"] == "small" and r["use"] == u] for u in (1, 2)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]  # another permutation in each pass


def test_mix_of_a_wanted_entropy(spark):
    rows = [(i, "big", 10) for i in range(900)] + [(1000 + i, "small", 10) for i in range(100)]
    drawn, _ = run(spark, rows, [("big", 0.5, 2), ("small", 0.5, 2)], wanted_entropy=0.6)
    tokens = {}
    for r in drawn.collect():
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
    assert M.entropy(M.normalised(tokens)) == pytest.approx(0.6, abs=0.01)
    assert M.exponent_of_entropy({"a": 0.6, "b": 0.4}, 0.3) > 1  # below the natural entropy


def test_invariants_see_faults(spark, monkeypatch):
    rows = [(i, "a", 10) for i in range(200)] + [(1000 + i, "b", 10) for i in range(200)]
    s, t = spark.createDataFrame([(*r, "clash") for r in rows], SIZES), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("none", 0.2, 1)], TARGETS)
    good = M.invariants(s, t).collect()
    assert len(good) == 2 and all(r["share_met"] and r["repeats_met"] and r["positions_met"] for r in good)
    whole = M.mix
    monkeypatch.setattr(M, "mix", lambda *a: whole(*a).where("source = 'a' or doc_id < 1100").unionByName(whole(*a).where("source = 'a'")))
    bad = {r["source"]: r for r in M.invariants(s, t).collect()}
    assert not bad["b"]["share_met"] and not bad["a"]["repeats_met"] and not bad["a"]["positions_met"]


def test_same_draw_again(spark):
    rows = [(i, "a", 3 + i % 5) for i in range(300)]
    one, _ = run(spark, rows, [("a", 1.0, 1)], budget=500)
    two, _ = run(spark, rows[::-1], [("a", 1.0, 1)], budget=500)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(r["doc_id"] for r in two.collect())
    assert 500 - 8 < sum(r["n_tokens"] for r in one.collect()) <= 500


def test_empty(spark):
    drawn, report = run(spark, [], [("a", 1.0, 1)])
    assert drawn.count() == 0 and report.count() == 1
    drawn, _ = run(spark, [(1, "a", 5)], [])
    assert drawn.count() == 0


def test_tempered_query_bisects(spark, sf):
    from grovework.llm.queries import QUERIES
    from grovework.runtime import table

    sizes, targets = M.sized(table(spark, sf, "documents")), table(spark, sf, "mix_targets")
    there = {r["source"]: r["n"] for r in sizes.where("source is not null").groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    longest = {r["source"]: r["m"] for r in sizes.groupBy("source").agg({"n_tokens": "max"}).withColumnRenamed("max(n_tokens)", "m").collect()}
    limits = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect()}
    budget = M.whole_budget(sizes, targets)
    assert budget == sum(there.get(k, 0) for k in limits)
    weights, size, a = M.solve(there, limits, budget)
    assert size == budget and 0 < a < 1
    drawn = QUERIES["p9_tempered"](spark, sf).collect()
    total = sum(r["n_tokens"] for r in drawn)
    assert budget - sum(longest[k] for k in weights) < total <= budget
    assert all(r["use"] <= limits[r["source"]][1] for r in drawn)
