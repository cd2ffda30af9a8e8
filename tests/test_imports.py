from grovework.operators import imports as I

FILES = ["src/app/__init__.py", "src/app/core.py", "src/app/sub/__init__.py", "src/app/sub/mod.py", "tools/run.py", "web/a.ts", "web/lib/index.tsx", "web/lib/b.js", "web/lib/b.ts", "go.mod", "cmd/main.go", "pkg/util/a.go", "pkg/util/z.go", "inner/go.mod", "inner/x/y.go", "crate1/src/lib.rs", "crate1/src/net/mod.rs", "crate1/src/net/tcp.rs"]
MODS = {"go.mod": "module example.org/app\n\ngo 1.22\n", "inner/go.mod": "// c\nmodule \"example.org/inner\"\n"}
IMPORTS = [
    ("src/app/core.py", "app.sub.mod.Thing", "src/app/sub/mod.py"), ("src/app/core.py", ".sub", "src/app/sub/__init__.py"), ("src/app/core.py", ".sub.mod.f", "src/app/sub/mod.py"), ("src/app/sub/mod.py", "..core.g", "src/app/core.py"), ("src/app/sub/mod.py", ".", "src/app/sub/__init__.py"),
    ("src/app/sub/mod.py", "....far", None), ("src/app/core.py", "json", None), ("src/app/core.py", "app.missing.x", "src/app/__init__.py"), ("tools/run.py", "app.core", "src/app/core.py"),
    ("web/a.ts", "./lib", "web/lib/index.tsx"), ("web/a.ts", "./lib/b", "web/lib/b.ts"), ("web/a.ts", "./lib/b.js", "web/lib/b.js"), ("web/lib/b.js", "../a", "web/a.ts"), ("web/lib/b.js", "../../../a", None), ("web/a.ts", "react", None), ("web/a.ts", "./none", None),
    ("cmd/main.go", "example.org/app/pkg/util", "pkg/util/z.go"), ("cmd/main.go", "example.org/application/pkg/util", None), ("cmd/main.go", "fmt", None), ("inner/x/y.go", "example.org/app/pkg/util", None),
    ("crate1/src/net/tcp.rs", "crate::net::mod_item", "crate1/src/net/mod.rs"), ("crate1/src/lib.rs", "crate::net::tcp::{Listener, Stream}", "crate1/src/net/tcp.rs"), ("crate1/src/lib.rs", "std::io", None), ("crate1/src/net/tcp.rs", "crate::other", None),
]


def frames(spark):
    files = spark.createDataFrame([("p", f, MODS.get(f)) for f in FILES] + [("q", "web/none.ts", None)], "project string, file_path string, content string")
    imports = spark.createDataFrame([("p", f, s, "clash") for f, s, _ in IMPORTS] * 2 + [("p", None, "x", None), ("p", "a.py", None, None), (None, "a.py", "x", None)], "project string, file_path string, spec string, target string")
    return files, imports


def test_every_kind_of_import(spark):
    files, imports = frames(spark)
    got = {(r["file_path"], r["spec"]): r["target"] for r in I.resolve_imports(imports, files, I.go_modules(files)).collect()}
    assert got == {(f, s): t for f, s, t in IMPORTS}


def test_nearest_go_module(spark):
    files, _ = frames(spark)
    got = {r["file_path"]: (r["go_module"], r["go_folder"]) for r in I.go_owner(files, I.go_modules(files)).collect()}
    assert got["inner/x/y.go"] == ("example.org/inner", "inner") and got["cmd/main.go"] == ("example.org/app", "")


def test_edges_and_empty(spark):
    nodes = spark.createDataFrame([("p", f, "module") for f in FILES], "project string, file_path string, node_type string")
    edges = spark.createDataFrame([("p", "web/a.ts", "IMPORTS", "./lib"), ("p", "web/a.ts", "IMPORTS", "react"), ("p", "web/a.ts", "CALLS", "./lib")], "project string, source string, edge_type string, target string")
    got = {tuple(r) for r in I.import_edges(edges, nodes).collect()}
    assert got == {("p", "web/a.ts", "IMPORTS", "web/lib/index.tsx"), ("p", "web/a.ts", "IMPORTS", "react"), ("p", "web/a.ts", "CALLS", "./lib")}
    assert I.import_edges(edges.limit(0), nodes).count() == 0 and I.import_edges(edges, nodes.limit(0)).count() == 3
