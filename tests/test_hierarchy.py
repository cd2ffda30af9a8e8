import random

import pytest

from grovework.operators import hierarchy as H

NODES = "project string, id string, parent_id string, indexed_at timestamp, root string, path string"


def frame(spark, links):
    from datetime import datetime

    return spark.createDataFrame([(p, i, q, datetime(2024, 1, 1), "clash", "clash") for p, i, q in links], NODES)


def brute(links):
    """Paths, descendants and loops by walking every node's parents."""
    parent = {(p, i): q for p, i, q in links}
    parent = {k: (q if (k[0], q) in parent else None) for k, q in parent.items()}
    out = {}
    for k in parent:
        seen, at = [], k[1]
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[k[0], at]
        ring = seen[seen.index(at) :] if at is not None else []
        cycle = min(ring) if ring else None
        up = seen if not ring else seen[: seen.index(cycle) + 1] if cycle in seen else seen
        out[k] = (seen[-1] if not ring else None, tuple(reversed(up)), cycle, k[1] in ring, cycle == k[1])
    below = dict.fromkeys(parent, 0)
    for k, (_, path, *_) in out.items():
        for a in path[:-1]:
            below[k[0], a] += 1
    return {k: (*v[:2], below[k], *v[2:]) for k, v in out.items()}


def result(df):
    return {(r["project"], r["id"]): (r["root"], tuple(r["path"]), r["n_descendants"], r["cycle_id"], r["on_cycle"], r["back_edge"]) for r in df.collect()}


@pytest.mark.parametrize("bound", [1000, 2])
def test_against_walking(spark, bound):
    rnd = random.Random(bound)
    links = []
    for p in ("p", "q"):
        for i in range(60):
            links.append((p, f"n{i:02d}", rnd.choice([None, f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}", "nowhere"])))
    links += [("p", "self", "self"), ("p", "below", "self")]
    got = result(H.hierarchy(frame(spark, links), bound))
    assert got == brute(links)
    loops = result(H.loops(frame(spark, links), bound))
    assert loops == {k: v for k, v in got.items() if v[3] is not None}


def test_long_chain_and_repeats(spark):
    links = [("p", f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(150)]
    got = result(H.hierarchy(frame(spark, links * 2)))
    assert got["p", "n149"][1] == tuple(f"n{i:03d}" for i in range(150)) and got["p", "n000"][2] == 149


def test_one_back_edge_per_loop(spark):
    links = [("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "d", "a")]
    rows = H.hierarchy(frame(spark, links)).collect()
    assert [r["id"] for r in rows if r["back_edge"]] == ["a"] and {r["cycle_id"] for r in rows} == {"a"}


def test_back_edge_does_not_depend_on_the_order_of_rows():
    import itertools

    import pandas as pd

    for rows in itertools.permutations([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a")]):
        got = H.traverse(pd.DataFrame(rows, columns=["project", "id", "parent_id"]))
        assert got[got["back_edge"]]["id"].tolist() == ["a"]


def test_deep_component_is_not_gathered(spark):
    links = [("p", f"n{i:04d}", f"n{i - 1:04d}" if i else None) for i in range(300)] + [("q", f"m{i}", "m0" if i else None) for i in range(300)]
    got = result(H.hierarchy(frame(spark, links), 10_000))  # the chain has 300 rows but over 45,000 path elements
    assert got == brute(links)


def test_nulls_and_empty(spark):
    assert H.hierarchy(frame(spark, [])).count() == 0 and H.loops(frame(spark, [])).count() == 0
    got = result(H.hierarchy(frame(spark, [(None, "a", None), ("p", None, "a"), ("p", "a", None)])))
    assert set(got) == {("p", "a")}


def test_descendants(spark):
    rows = H.descendants(H.hierarchy(frame(spark, [("p", "a", None), ("p", "b", "a"), ("p", "c", "b")]))).collect()
    assert sorted((r["ancestor"], r["descendant"], r["distance"]) for r in rows) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_breadcrumbs_of_any_depth(spark):
    from types import SimpleNamespace

    from grovework.operators import traverse as T

    links = [("p", f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(40)]
    links += [("p", "b", "c"), ("p", "c", "b"), ("p", "d", "c"), ("p", "self", "self"), ("p", "alone", "nowhere")]
    nodes = spark.createDataFrame([(p, i, q, None if i == "n000" else i.upper()) for p, i, q in links], "project string, id string, parent_id string, name string")
    got = {(r["project"], r["id"]): (tuple(r["path"]), r["depth"], r["cycle_id"]) for r in T.all_breadcrumbs(SimpleNamespace(nodes=nodes)).collect()}
    want = {k: (tuple("" if x == "n000" else x.upper() for x in path), len(path) - 1, cycle) for k, (_, path, _, cycle, *_) in brute(links).items()}
    assert got == want and got["p", "n025"][1] == 25 and len(got["p", "n039"][0]) == 40


def test_breadcrumbs_query_leaves_no_node_out(spark, sf):
    from grovework.operators import model as M
    from grovework.plans import all_queries
    from grovework.runtime import table

    got = {(r["project"], r["id"]): r["crumbs"] for r in all_queries()["jn12_all_breadcrumbs"](spark, sf).collect()}
    short = {(r["project"], r["id"]): r["crumbs"] for r in all_queries()["jn12_breadcrumbs"](spark, sf).collect()}
    assert short.items() <= got.items() and len(got) == M.live_nodes(table(spark, sf, "code_nodes"), ["name"]).count()


@pytest.mark.parametrize("bound", [1000, 2])
def test_loop_of_over_200_nodes(spark, bound):
    links = [("p", f"r{i:03d}", f"r{(i + 1) % 260:03d}") for i in range(260)]
    links += [("p", f"t{i:03d}", f"t{i - 1:03d}" if i else "r100") for i in range(230)]
    got = result(H.loops(frame(spark, links), bound))
    assert got == brute(links) and {v[3] for v in got.values()} == {"r000"}
