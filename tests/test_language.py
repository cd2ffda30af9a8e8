import pytest

from grovework import api
from grovework.operators.model import CodeGraph
from grovework.plans import cypher, guard

P = "{project: $project}"


@pytest.mark.parametrize(
    "query,why",
    [
        (f"MATCH (n {P}) RETURN n", None), (f"OPTIONAL MATCH (n {P})-[r]->(m) RETURN n", None), (f"MATCH (n:Code {P}), (m {P}) RETURN n", None), (f"MATCH (n {P}) WHERE n.name = 'SET LIMIT' RETURN n.set, n.limit", None), (f"MATCH (n {P}) /* DELETE */ RETURN n", None), (f"MATCH (n {P}) RETURN `drop`", None),
        (f"MATCH (n {P}) DETACH DELETE n", "write"), (f"MATCH (n {P}) RETURN n SKIP 3", "limit"), ("MATCH (n) RETURN n", "scoped"), (f"MATCH (n {P}), (m) RETURN n", "scoped"), ("CALL x.y() YIELD z RETURN z", "procedure"), ("LOAD CSV FROM 'a' AS x RETURN x", "loading"), ("SHOW INDEXES", "admin"),
        (f"MATCH (n {P}) RETURN n; MATCH (m {P}) RETURN m", "one statement"), ("RETURN 1", "begin"), ("UNWIND [1] AS x RETURN x", "needs a MATCH"), (f"MATCH (n {{x: '{P}'}}) RETURN n", "scoped"),
    ],
)
def test_guard(query, why):
    got = guard.refusal(query)
    assert (got is None) if why is None else (got and why in got)


@pytest.fixture(scope="module")
def graph(spark):
    cols = "project string, id string, name string, node_type string, file_path string, line_start int, line_end int, signature string, docstring string, summary string, parent_id string, external_calls array<string>, unresolved_calls array<string>, summary_embedding array<float>"
    n = lambda i, t, parent=None, s="": ("p", i, i, t, f"{i}.py", 1, 9, f"def {i}()", "", s, parent, [], [], None)
    nodes = [n("mod", "module"), n("hub", "class", "mod", "Reset the ledger cache."), *[n(f"c{k}", "method", "hub") for k in (1, 2, 3)], n("s1", "function"), n("s2", "module"), n("t1", "function"), n("t2", "class"), ("q", "mod", "mod", "module", "m.py", 1, 1, None, None, None, None, None, None, None)]
    e = [("mod", "CONTAINS", "hub"), *[("hub", "CONTAINS", f"c{k}") for k in (1, 2, 3)], ("s1", "CALLS", "hub"), ("s2", "IMPORTS", "hub"), ("hub", "CALLS", "t1"), ("hub", "INHERITS", "t2"), ("s1", "CALLS", "s1"), ("s2", "IMPORTS", "ext:module:lib")]
    edges = spark.createDataFrame([("p", a, t, b, "self" if t == "CALLS" else "", "") for a, t, b in e], "project string, source string, edge_type string, target string, resolution string, callee_text string")
    ext = spark.createDataFrame([("p", "ext:module:lib", "lib", "lib", "module", "python")], "project string, id string, name string, root string, kind string, language string")
    chunks = spark.createDataFrame([("p", "k1", "c1", "restore the ledger", 1, 3, [1.0, 0.0]), ("p", "k2", "c1", "ledger", 4, 5, [0.6, 0.8]), ("p", "k3", "c2", "nothing", 1, 2, [0.0, 1.0]), ("p", "k4", None, "ledger", 1, 1, None)], "project string, id string, node_id string, content string, start_line int, end_line int, embedding array<float>")
    return CodeGraph(spark.createDataFrame(nodes, cols).cache(), edges.cache(), ext, chunks.cache())


def rows(graph, q, **params):
    return [tuple(r) for r in cypher.run(graph, q, {"project": "p", **params}).collect()]


def test_cypher(graph):
    assert rows(graph, f"MATCH (a {P})-[:CALLS]->(b {P}) RETURN a.id AS a, b.id AS b ORDER BY a, b") == [("hub", "t1"), ("s1", "hub"), ("s1", "s1")]
    assert rows(graph, f"MATCH (a {P})<-[r:CALLS|IMPORTS]-(b {P}) WHERE a.id = $id RETURN b.id AS b, type(r) AS t ORDER BY b", id="hub") == [("s1", "CALLS"), ("s2", "IMPORTS")]
    assert rows(graph, f"MATCH (a:Module {P})-[:CONTAINS*1..2]->(b {P}) RETURN a.id AS a, count(*) AS n") == [("mod", 4)]
    assert rows(graph, f"MATCH (a:Class {P}) OPTIONAL MATCH (a {P})-[:CONTAINS]->(c {P}) WITH a.id AS id, collect(c.name) AS kids RETURN id, size(kids) AS n, kids[..2] AS two ORDER BY id") == [("hub", 3, ["c1", "c2"]), ("t2", 0, [])]
    assert rows(graph, f"MATCH (n {P}) WHERE NOT (n)-[]->() AND n.node_type IN ['function', 'class'] RETURN n.id AS id ORDER BY id DESC") == [("t2",), ("t1",)]
    assert rows(graph, f"MATCH (n {P}) WHERE (n)-[:IMPORTS]->(:External) RETURN n.id AS id") == [("s2",)]
    assert rows(graph, f"MATCH (a {P})-[r]-(b {P}) WHERE a.id = 's1' RETURN b.id AS b, CASE WHEN startNode(r) = a.id THEN 'out' ELSE 'in' END AS d ORDER BY b") == [("hub", "out"), ("s1", "out")]
    assert rows(graph, f"UNWIND $ids AS i MATCH (n {P}) WHERE n.id = i AND n.name STARTS WITH 'c' RETURN DISTINCT n.id AS id ORDER BY id", ids=["c2", "c1", "hub", "c1"]) == [("c1",), ("c2",)]
    assert rows(graph, f"MATCH (n {P}) WHERE ANY(x IN ['hub', 't1'] WHERE x = n.id) AND n.summary IS NOT NULL RETURN n.id AS id, coalesce(n.docstring, '-') AS d, toUpper(n.name) AS u ORDER BY id") == [("hub", "", "HUB"), ("t1", "", "T1")]
    for bad in (f"MATCH (n {P}) RETURN", f"MATCH (n {P}) RETURN foo(n)", f"MATCH (n {P}) RETURN m.id", f"MATCH (n {P})", f"MATCH (n {P}) RETURN n.id ; x"):
        with pytest.raises(cypher.CypherError):
            rows(graph, bad)


def test_tools(graph):
    t = api.Tools(graph, lambda q: [1.0, 0.0])
    page = t.list_entities("p", ["class", "module"], limit=3)
    assert [x["id"] for x in page["items"]] == ["hub", "mod", "s2"] and page["page"]["next_offset"] == 3 and page["page"]["has_more"]
    assert t.list_entities("p", ["class", "module"], limit=3, offset=3)["page"] == {"limit": 3, "offset": 3, "next_offset": None, "has_more": False, "truncated": False}
    assert t.list_entities("none")["items"] == [] and t.search_text("none", "x y")["error"]["code"] == "project_not_indexed" and t.list_entities("p", include_paths=[])["items"] == []
    assert {x["id"] for x in t.get_entity_structure("p", "mod", depth=2)["items"]} == {"hub", "c1", "c2", "c3"} and t.get_entity_structure("p", "nope")["error"]["code"] == "not_found"
    c = t.get_entity_context("p", "hub")
    assert [x["id"] for x in c["children"]] == ["c1", "c2", "c3"] and {x["relation"] for x in c["incoming"]} == {"CALLS", "IMPORTS", "CONTAINS"} and {x["id"] for x in c["outgoing"]} == {"t1", "t2"}
    assert {x["id"] for x in t.get_related_entities("p", "hub", "incoming", ["CALLS"])["items"]} == {"s1"}
    assert [x["id"] for x in t.search_entities("p", "C")["items"]] == ["c1", "c2", "c3"]
    code = t.search_code("p", "x")["items"]
    assert [(x["id"], x["score"], len(x["matches"])) for x in code] == [("c1", 1.0, 2), ("c2", 0.0, 1)]
    assert {x["source_type"] for x in t.search_hybrid("p", "x", min_score=0.5)["items"]} == {"hybrid"} and t.search_semantic("p", "x")["items"] == []
    text = {x["id"]: x["source_type"] for x in t.search_text("p", "ledger: (cache)")["items"]}
    assert text == {"c1": "code", "hub": "summary"} and t.search_text("p", "+-(")["items"] == []
    q = t.cypher_query("p", f"MATCH (n:Method {P}) RETURN n.id AS id ORDER BY id", limit=2)
    assert q["items"] == [{"id": "c1"}, {"id": "c2"}] and q["page"]["has_more"]
    assert t.cypher_query("p", "MATCH (n) RETURN n")["error"]["code"] == "unsafe_query" and t.cypher_query("p", f"MATCH (n {P}) RETURN n LIMIT 1")["error"]["code"] == "invalid_argument"
    assert t.cypher_query("p", f"MATCH (n {P}) RETURN zz(n)")["error"]["code"] == "query_failed" and "CALLS" in t.graph_schema()["relations"] and t.list_projects()["items"][0]["project"] == "p"
