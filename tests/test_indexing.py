import json

import pytest

from grovework.operators import chunking as K
from grovework.operators import reconcile as RC
from grovework.operators import resolve as R
from grovework.sources import parsers as P
from grovework.sources import repository, scip
from grovework.sources.store import GraphStore
from grovework.streaming import changes as C

FILES = {
    "pkg/__init__.py": "",
    "pkg/util.py": "import json\n\n\ndef helper():\n    return len([])\n\n\ndef other():\n    pass\n",
    "pkg/main.py": (
        "from pkg.util import helper\nimport json\nimport os.path as osp\n\n\nclass Base:\n    def ping(self):\n        pass\n\n\nclass Child(Base):\n    \"\"\"Doc.\"\"\"\n    @property\n    def value(self):\n        return 1\n\n    @value.setter\n    def value(self, v):\n        pass\n\n"
        "    def run(self):\n        self.stop()\n        self.missing()\n\n    def stop(self):\n        pass\n\n\ndef own():\n    pass\n\n\ndef caller():\n    helper()\n    own()\n    json.dumps(1)\n    len([])\n    helper()\n\n\ndef shadow(helper):\n    helper()\n\n\nif True:\n    import sys\nunknown_thing()\n"
    ),
    "web/app.ts": "import def, { save as keep } from './lib';\nimport axios from 'axios';\n\n/** Runs it. */\nexport class App extends Base implements One, Two {\n  run(x: number): void {\n    this.stop();\n    keep(1);\n    if (x) { log(\"a } b\"); }\n  }\n  stop() {\n  }\n}\nexport interface Shape {\n  a: number;\n}\nconst go = (a) => {\n  run(a);\n};\n",
    "srv/main.go": 'package main\n\nimport (\n\t"fmt"\n\tu "app/util"\n)\n\ntype Store struct {\n\tlog string\n}\n\n// Save keeps it.\nfunc (s *Store) Save(x int) error {\n\ts.Flush()\n\treturn helper(x)\n}\n\nfunc (s *Store) Flush() {\n}\n\nfunc helper(x int) error {\n\tfmt.Println(x)\n\treturn nil\n}\n',
    "srv/lib.rs": "use std::io;\n\npub struct S {\n    a: u8,\n}\n\nimpl Tr for S {\n    /// Doc.\n    pub fn m(&self) -> u8 {\n        helper(1)\n    }\n}\n\nfn helper(x: u8) -> u8 {\n    x\n}\n",
    "README.md": "# Title\ntext\n",
    "bad.py": "def f(:\n",
    "nul.py": "x = '\0'",
}


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([("p", k, v) for k, v in FILES.items()] + [("p", "none.py", None), ("p", "x.unknown", "?")], "project string, file_path string, content string")
    return P.parse(files).cache()


def test_nodes(parsed):
    n = {r["id"]: r for r in P.parsed_nodes(parsed).collect()}
    assert n["pkg/main.py::Child"]["node_type"] == "class" and n["pkg/main.py::Child"]["docstring"] == "Doc."
    assert {"pkg/main.py::Child.value", "pkg/main.py::Child.value.setter", "pkg/main.py::caller", "pkg/main.py"} <= set(n)
    assert n["README.md"]["node_type"] == "document" and n["README.md"]["line_end"] == 2
    assert n["web/app.ts::App.run"]["node_type"] == "method" and (n["web/app.ts::App.run"]["line_start"], n["web/app.ts::App.run"]["line_end"]) == (6, 10)
    assert n["web/app.ts::App"]["docstring"] == "Runs it." and n["web/app.ts::go"]["node_type"] == "function" and n["web/app.ts::Shape"]["node_type"] == "interface"
    assert n["srv/main.go::Store.Save"]["parent_id"] == "srv/main.go" and n["srv/main.go::Store"]["node_type"] == "struct"
    assert n["srv/lib.rs::S.m"]["parent_id"] == "srv/lib.rs::S" and n["srv/lib.rs::helper"]["node_type"] == "function"
    assert {r["file_path"] for r in P.failures(parsed).collect()} == {"bad.py", "nul.py"}
    assert not any(i.startswith(("bad", "nul")) for i in n)


def test_edges(parsed):
    e = {(r["source"], r["edge_type"], r["target"]) for r in P.parsed_edges(parsed).collect()}
    assert ("pkg/main.py", "IMPORTS", "pkg.util.helper") in e and ("pkg/main.py::Child", "INHERITS", "Base") in e and ("pkg/main.py", "CALLS", "unknown_thing") in e
    assert ("pkg/main.py", "IMPORTS", "sys") not in e  # only direct children of the module
    assert ("web/app.ts::App", "INHERITS", "Base") in e and ("web/app.ts::App", "IMPLEMENTS", "Two") in e and ("web/app.ts", "IMPORTS", "./lib") in e
    assert ("srv/main.go::Store.Save", "CALLS", "helper") in e and ("srv/main.go", "IMPORTS", "app/util") in e
    assert ("srv/lib.rs::S", "IMPLEMENTS", "Tr") in e and ("srv/lib.rs::S.m", "CALLS", "helper") in e


def test_resolution(spark, parsed):
    n = P.parsed_nodes(parsed)
    calls = P.parsed_edges(parsed).where("edge_type = 'CALLS'").selectExpr("project", "source", "target AS callee", "ordinal")
    r = R.resolve_calls(n, calls, P.parsed_facts(parsed)).cache()
    got = {(x["source"], x["callee"]): (x["outcome"], x["resolution"], x["target"]) for x in r.collect()}
    main = "pkg/main.py::"
    assert got[main + "caller", "helper"] == ("bound", "import", "pkg/util.py::helper")
    assert got[main + "caller", "own"] == ("bound", "same-module", main + "own")
    assert got[main + "caller", "json.dumps"][0] == "external" and got[main + "caller", "len"][0] == "skipped"
    assert got[main + "Child.run", "self.stop"] == ("bound", "self", main + "Child.stop") and got[main + "Child.run", "self.missing"][0] == "unresolved"
    assert got[main + "shadow", "helper"][0] == "unresolved" and got["pkg/main.py", "unknown_thing"][0] == "unresolved"
    assert got["srv/main.go::Store.Save", "helper"][1] == "same-module"
    edges = {(x["source"], x["target"]) for x in R.call_edges(r).collect()}
    assert (main + "caller", "pkg/util.py::helper") in edges
    lists = {x["source"]: x for x in R.honest_lists(r).collect()}
    assert lists[main + "caller"]["external_calls"] == ["json.dumps"] and lists[main + "Child.run"]["unresolved_calls"] == ["self.missing"]


def test_ambiguity_is_never_guessed(spark):
    n = spark.createDataFrame([("p", f"{f}::{x}", x, "function", f, f) for f, x in (("a.go", "f"), ("b.go", "f"), ("c.go", "g"))], "project string, id string, name string, node_type string, file_path string, parent_id string")
    calls = spark.createDataFrame([("p", "c.go::g", "f", 1), ("p", "c.go::g", "f(x)[0]", 2)], "project string, source string, callee string, ordinal int")
    assert {x["outcome"] for x in R.resolve_calls(n, calls).collect()} == {"unresolved"}


def test_bases_externals_directories(spark):
    n = spark.createDataFrame([("p", "a.py::B", "B", "class", "a.py"), ("p", "b.py::B", "B", "class", "b.py"), ("p", "b.py::C", "C", "class", "b.py")], "project string, id string, name string, node_type string, file_path string")
    b = spark.createDataFrame([("p", "b.py::C", "INHERITS", "B"), ("p", "a.py::B", "INHERITS", "lib.Model")], "project string, source string, edge_type string, base string")
    got = {x["source"]: (x["target"], x["bound"]) for x in R.resolve_bases(n, b).collect()}
    assert got == {"b.py::C": ("b.py::B", True), "a.py::B": ("lib.Model", False)}
    e = spark.createDataFrame([("p", "a.py::B", "INHERITS", "lib.Model", "", ""), ("p", "a.py::B", "CALLS", "gone", "", ""), ("p", "b.py::C", "CALLS", "a.py::B", "", "")], "project string, source string, edge_type string, target string, resolution string, callee_text string")
    edges, ext = R.externalise(e, n)
    assert {x["target"] for x in edges.collect()} == {"ext:type:lib.Model", "a.py::B"} and ext.first()["root"] == "lib"
    d = {(x["edge_source"], x["edge_target"]) for x in R.directories(spark.createDataFrame([("p", "a/b/c.py"), ("p", "d.py")], "project string, file_path string")).collect()}
    assert d == {("dir:.", "dir:a"), ("dir:a", "dir:a/b"), ("dir:a/b", "a/b/c.py"), ("dir:.", "d.py")}


def test_semantic_calls(spark):
    n = spark.createDataFrame([("p", "a.go", "a", "module", "a.go", 1, 40), ("p", "F", "F", "function", "a.go", 3, 10), ("p", "B", "B", "function", "a.go", 12, 20)], "project string, id string, name string, node_type string, file_path string, line_start int, line_end int")
    o = spark.createDataFrame([("p", "a.go", 2, "pkg F().", 1), ("p", "a.go", 11, "pkg B().", 1), ("p", "a.go", 13, "pkg F().", 0), ("p", "a.go", 14, "fmt Println().", 0), ("p", "a.go", 15, "pkg B().", 0), ("p", "a.go", 29, "pkg F().", 0), ("p", "a.go", 13, "local 1", 0)], "project string, file_path string, line int, symbol string, roles int")
    assert {(x["source"], x["target"], x["external"]) for x in R.semantic_calls(o, n).collect()} == {("B", "F", None), ("B", None, "Println")}


def test_scip_wire():
    def field(n, b):
        return bytes([n << 3 | 2, len(b)]) + b

    occ = field(1, bytes([3, 0, 5])) + field(2, b"Foo") + bytes([3 << 3, 1])
    doc = field(1, b"a.go") + field(2, occ) + field(2, field(1, bytes([7, 0, 1])) + field(2, b"Bar"))
    assert list(scip.occurrences(field(2, doc) + bytes([9 << 3 | 1]) + b"12345678")) == [("a.go", 3, "Foo", 1), ("a.go", 7, "Bar", 0)]
    with pytest.raises(ValueError):
        list(scip.occurrences(bytes([1 << 3 | 3])))


def test_reconcile(spark):
    f = lambda rows: spark.createDataFrame(rows, "project string, file_path string, checksum string")
    diff = RC.file_diff(f([("p", "a", "1"), ("p", "b", "1"), ("p", "c", "1"), ("p", "n", None)]), f([("p", "a", "1"), ("p", "b", "2"), ("p", "d", "1"), ("p", "n", None)]))
    assert {r["file_path"]: r["change"] for r in diff.collect()} == {"a": "same", "b": "modified", "c": "deleted", "d": "added", "n": "modified"}
    s = lambda rows: spark.createDataFrame(rows, "project string, id string, name string, summary string, summary_input_hash string")
    merged = {r["id"]: tuple(r)[2:] for r in RC.upsert_nodes(s([("p", "a", "old", "kept", "h1"), ("p", "b", "old", "x", "h")]), s([("p", "a", "new", "", "h2"), ("p", "c", "new", None, None)])).collect()}
    assert merged == {"a": ("new", "kept", "h1"), "b": ("old", "x", "h"), "c": ("new", None, None)}
    n = lambda rows: spark.createDataFrame(rows, "project string, id string, file_path string")
    stale = RC.stale_nodes(n([("p", "a", "f"), ("p", "b", "f"), ("p", "c", "g")]), n([("p", "a", "f")]), f([("p", "f", None)]))
    assert [r["id"] for r in stale.collect()] == ["b"]  # g was not parsed: kept


def test_windows_and_stitching(spark):
    lines = [f"l{i}" for i in range(1, 31)]
    b = spark.createDataFrame([("n", 5, 34, lines), ("blank", 1, 2, ["", " "])], "id string, line_start int, line_end int, lines array<string>")
    w = sorted((r["window"], r["start_line"], r["end_line"], r["content"]) for r in K.body_windows(b, 20, 5).collect())
    assert [(x[1], x[2]) for x in w] == [(5, 24), (20, 34)]
    c = spark.createDataFrame([("n", f"c{k}", x[1], x[3]) for k, x in enumerate(w)] + [("n", "far", 40, "z")], "node_id string, id string, start_line int, content string")
    r = K.stitch(c, ["node_id"]).first()
    assert r["first_line"] == 5 and r["text"] == "\n".join(lines) + "\n\nz"
    d = spark.createDataFrame([("a", "x" * 120)], "id string, t string")
    assert K.char_windows(d, ["id"], "t", 50, 500).count() == 71


def test_scan(spark, tmp_path):
    tree = {"a.py": "x = 1\n", "sub/b.py": "y = 1\n", "sub/skip/c.py": "z", ".gitignore": "skip/\n*.log\n", "sub/keep.log": "", "node_modules/d.js": "x", "gen.pb.go": "package a", "e.go": "// Code generated by x. DO NOT EDIT.\n", "big.md": "x" * 2000, "bin.py": "a\0b", "img.png": "x", "sub/.gitignore": "!b.py\n"}
    for k, v in tree.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    root = str(tmp_path)
    rows = repository.scan(repository.read_tree(spark, root), rules=repository.ignore_rules(spark, root), max_bytes=1000)
    got = {r["file_path"]: r["verdict"] for r in rows.collect()}
    assert got["a.py"] == got["sub/b.py"] == "keep" and got["sub/skip/c.py"] == "ignored" and got["node_modules/d.js"] == "excluded"
    assert got["gen.pb.go"] == got["e.go"] == "generated" and got["big.md"] == "too large" and got["bin.py"] == "binary" and got["img.png"] == "suffix"
    assert {r["language"]: r["files"] for r in repository.preview(rows).collect()} == {"python": 2}


def test_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    df = spark.createDataFrame([("p", 1), ("q", 2)], "project string, x int")
    store.commit(nodes=df)
    store.commit(nodes=df.where("x = 2"), edges=df)
    assert store.load("nodes").count() == 1 and store.load("edges").count() == 2 and store.load("none") is None
    store.drop_project("q")
    assert store.load("nodes").count() == 0
    assert store.acquire("p", "a") and not store.acquire("p", "b") and store.acquire("p", "a")
    store.release("p", "a")
    assert store.acquire("p", "b")


def test_stream(spark, tmp_path):
    from datetime import datetime as D

    t = [D(2024, 1, 1, 0, 0, s) for s in range(0, 60, 4)]
    rows = [("p", "a.py", "modified", t[0], t[0]), ("p", "b.py", "added", t[1], t[1]), ("p", "x.log", "added", t[1], t[1]), ("p", "c.py", "added", t[9], t[9])]
    events = spark.createDataFrame(rows, C.CHANGES)
    bursts = C.debounce(C.relevant(events, [".py"], ["skip"])).orderBy("start").collect()
    assert [r["paths"] for r in bursts] == [["a.py", "b.py"], ["c.py"]]
    events.write.parquet(str(tmp_path / "in"))
    seen = []
    stored = spark.createDataFrame([("p", "a.py", "1"), ("p", "b.py", "1")], "project string, file_path string, checksum string")
    now = spark.createDataFrame([("p", "a.py", "1"), ("p", "b.py", "2"), ("p", "c.py", "1")], stored.schema)
    q = C.apply_incrementally(C.relevant(C.read_changes(spark, str(tmp_path / "in")), [".py"], []), lambda: stored, lambda paths: now.join(paths, ["project", "file_path"], "left_semi"), lambda diff, _: seen.extend(diff.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {(r["file_path"], r["change"]) for r in seen} == {("b.py", "modified"), ("c.py", "added")}
    assert json.dumps(sorted(r["kind"] for r in C.latest_changes(events.union(events)).collect())) == '["added", "added", "added", "modified"]'


N = "project string, id string, name string, node_type string, file_path string, parent_id string"
C3 = "project string, source string, callee string, ordinal int"


def test_methods_through_bases_and_classes(spark):
    f = "m.py"
    names = [("A", None), ("B", None), ("C", None), ("D", None)]
    nodes = [("p", f, "m", "module", f, None)] + [("p", f"{f}::{c}", c, "class", f, f) for c, _ in names]
    for c, m in (("A", "top"), ("B", "mid"), ("A", "mid"), ("C", "own"), ("D", "x"), ("B", "x")):
        nodes.append(("p", f"{f}::{c}.{m}", m, "method", f, f"{f}::{c}"))
    bases = [("p", f"{f}::C", f"{f}::B"), ("p", f"{f}::B", f"{f}::A"), ("p", f"{f}::A", f"{f}::C"), ("p", f"{f}::C", f"{f}::D"), ("p", f"{f}::C", None)]
    calls = [("p", f"{f}::C.own", c, i) for i, c in enumerate(["self.top", "self.mid", "self.own", "self.none", "self.x", "A.top", "E.top", "ValueError", "A.top()"])]
    n, b = spark.createDataFrame(nodes, N), spark.createDataFrame(bases, "project string, source string, target string")
    got = {r["callee"]: (r["outcome"], r["target"]) for r in R.resolve_calls(n, spark.createDataFrame(calls, C3), None, b).collect()}
    assert got["self.top"] == ("bound", f"{f}::A.top") and got["self.mid"] == ("bound", f"{f}::B.mid") and got["self.own"] == ("bound", f"{f}::C.own")
    assert got["self.none"][0] == "unresolved" and got["self.x"][0] == "unresolved"  # two bases at the same distance
    assert got["A.top"] == ("bound", f"{f}::A.top") and got["E.top"][0] == "unresolved" and got["ValueError"][0] == "skipped" and got["A.top()"][0] == "unresolved"


def test_go_imports_and_project_packages(spark):
    nodes = [("p", "cmd/m.go", "m", "module", "cmd/m.go", None), ("p", "cmd/m.go::main", "main", "function", "cmd/m.go", "cmd/m.go"), ("p", "lib/a.go::F", "F", "function", "lib/a.go", "lib/a.go"), ("p", "lib/b.go::T.M", "M", "method", "lib/b.go", "lib/b.go"),
             ("p", "app/x.py", "x", "module", "app/x.py", None), ("p", "app/x.py::f", "f", "function", "app/x.py", "app/x.py")]
    facts = spark.createDataFrame([("p", "cmd/m.go", {"lib": "ex.org/app/lib", "fmt": "fmt"}, None, None, None), ("p", "app/x.py", {"y": "app.y", "json": "json"}, None, None, None)],
        "project string, file_path string, imports map<string,string>, local_names map<string,array<string>>, receiver_names map<string,string>, struct_fields map<string,map<string,string>>")
    go = spark.createDataFrame([("p", "cmd/m.go", "ex.org/app", "")], "project string, file_path string, go_module string, go_folder string")
    calls = [("p", "cmd/m.go::main", c, i) for i, c in enumerate(["lib.F", "lib.T.M", "lib.Gone", "fmt.Println", "lib.M"])] + [("p", "app/x.py::f", c, i) for i, c in enumerate(["y.g", "json.dumps"])]
    got = {r["callee"]: (r["outcome"], r["target"]) for r in R.resolve_calls(spark.createDataFrame(nodes, N), spark.createDataFrame(calls, C3), facts, None, go).collect()}
    assert got["lib.F"] == ("bound", "lib/a.go::F") and got["lib.T.M"] == ("bound", "lib/b.go::T.M")
    assert got["lib.Gone"][0] == "unresolved" and got["fmt.Println"] == ("external", "fmt") and got["lib.M"][0] == "unresolved"
    assert got["y.g"][0] == "unresolved" and got["json.dumps"][0] == "external"


def test_provenance(spark):
    n = spark.createDataFrame([("p", "a", "a", "module", "a.py", None), ("p", "b", "b", "module", "b.py", None), ("p", "f", "f", "function", "a.py", "a")], N)
    got = {r["id"]: r["calls_provenance"] for r in R.with_provenance(n, spark.createDataFrame([("p", "a.py"), ("p", "a.py")], "project string, file_path string"), "scip-go").collect()}
    assert got == {"a": "scip-go", "b": "heuristic", "f": None}


def test_binary_bytes_at_any_offset(spark):
    from pyspark.sql import functions as F

    rows = [("a.py", bytearray([0x10, 0x01, 0x00])), ("b.py", bytearray([0x10, 0x02])), ("c.py", None), ("d.png", bytearray(b"x")), ("e.py", bytearray(b"x" * 9000 + b"\0"))]
    df = spark.createDataFrame(rows, "p string, b binary").select("p", repository.looks_binary(F.col("p"), F.col("b")).alias("x"))
    assert {r["p"]: r["x"] for r in df.collect()} == {"a.py": True, "b.py": False, "c.py": False, "d.png": True, "e.py": False}


def test_words_of_other_scripts_are_found(spark):
    from pyspark.sql import functions as F

    from grovework.operators import search as S

    docs = spark.createDataFrame([("p", "a", "Die Größe der Datei"), ("p", "b", "размер файла"), ("p", "c", "gr e"), ("p", "d", None), ("p", "e", "")], "project string, id string, text string")
    find = lambda q: {r["id"] for r in S.bm25(docs, q, ["project", "id"], "text").collect()}
    assert find("größe") == {"a"} and find("размер") == {"b"} and find("???") == set()
    assert S.tokens(F.lit("x")) is not None


def test_two_writers_of_a_store(spark, tmp_path):
    a, b = GraphStore(spark, str(tmp_path / "g")), GraphStore(spark, str(tmp_path / "g"))
    df = spark.createDataFrame([("p", 1)], "project string, x int")
    number, now = a._latest("current")
    b.commit(other=df)
    assert not a._put("current", {"lost": {}}, number) and a.tables().keys() == {"other"}
    a.commit(mine=df)
    assert b.tables().keys() == {"other", "mine"}
    (tmp_path / "g" / "current" / "000000000099.json").write_text('{"cut off')  # a writer was lost
    assert b.tables().keys() == {"other", "mine"}
    b.commit(third=df)
    assert a.tables().keys() == {"other", "mine", "third"}
    assert a.acquire("p", "one") and not b.acquire("p", "two") and b.acquire("q", "two") and not b.acquire_within("p", "two", 0.2, 0.1)
    a.release("p", "one")
    assert b.acquire_within("p", "two", 1)


def test_bursts_merged_by_spans(spark):
    import random
    from datetime import datetime, timedelta

    rnd, t0 = random.Random(3), datetime(2024, 1, 1)
    rows = [(p, f"f{rnd.randrange(9)}.py", "modified", t0 + timedelta(seconds=rnd.choice([rnd.randrange(600), rnd.randrange(60) * 10])), None) for p in "pq" for _ in range(60)]
    rows += [("p", "n.py", "added", None, None)]
    want = []
    for p in "pq":
        own = sorted((r for r in rows if r[0] == p and r[3]), key=lambda r: r[3])
        burst = []
        for r in [*own, None]:
            if burst and (r is None or r[3] - burst[-1][3] > timedelta(seconds=10)):
                want.append((p, burst[0][3], burst[-1][3], len(burst), sorted({x[1] for x in burst})))
                burst = []
            if r:
                burst.append(r)
    got = C.debounce(spark.createDataFrame(rows, C.CHANGES), "10 seconds").select("project", "start", "last", "n_events", "paths").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 10


def test_appended_batches_survive_a_replay(spark, tmp_path):
    from datetime import datetime as D

    a = spark.createDataFrame([("p", "x", "added", D(2024, 1, 1), D(2024, 1, 1)), ("p", "y", "added", D(2024, 1, 1), D(2024, 1, 1))], C.CHANGES)
    b = spark.createDataFrame([("p", "x", "deleted", D(2024, 1, 2), D(2024, 1, 2)), ("p", "y", "late", D(2023, 1, 1), D(2024, 1, 3))], C.CHANGES)
    assert C.appended(spark, str(tmp_path / "none")).count() == 0
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for df, check in ((a, "c1"), (b, "c2")):
        df.coalesce(1).write.mode("append").parquet(src)
        C.append_latest(C.read_changes(spark, src, 1), out, str(tmp_path / check)).awaitTermination()  # the second checkpoint replays the first batch
    assert {(r["path"], r["kind"]) for r in C.appended(spark, out).collect()} == {("x", "deleted"), ("y", "added")}


def test_model_parser_and_fallback():
    reply = '```json\n{"nodes": [{"id": "a.py::f", "node_type": "function", "line_start": 2}, {"id": "no type"}, 7], "edges": [{"source": "a.py", "edge_type": "CALLS", "target": "f"}, {}]}\n```'
    seen = []
    parser = P.with_fallback(P.python_file, P.model_file(lambda t: seen.append(t) or reply))
    got = parser("def f(:\n" + "x" * 9000, "a.py")
    assert [r["record"] for r in got] == ["node", "edge"] and got[0]["line_end"] == 2 and len(seen[0]) == 8000
    assert len(parser("x = 1\n", "a.py")) == 2 and len(seen) == 1
    for bad in ("[]", "no json", '{"nodes": [{"id": "x", "node_type": "y", "line_start": "z"}]}'):
        with pytest.raises(ValueError):
            P.model_file(lambda t, bad=bad: bad)("x", "a.py")


def test_files_found_by_path_or_name(spark):
    from grovework.operators import traverse as T

    f = spark.createDataFrame([("p", x) for x in ("a/b.py", "b.py", "x/c.py", "y/c.py", "z/d.py")] + [("p", None)], "project string, file_path string")
    w = spark.createDataFrame([("p", x) for x in ("b.py", "root/a/b.py", "c.py", "q/d.py", "none.py", None)] + [("o", "b.py")], "project string, wanted string")
    assert {r["wanted"]: r["file_path"] for r in T.find_files(f, w).collect()} == {"b.py": "b.py", "root/a/b.py": "a/b.py", "c.py": "x/c.py", "q/d.py": "z/d.py"}
