import pytest

from grovework.llm import docpairs as D
from grovework.sources.trees import functions_of

SIG = "def reset_session(items, limit=10)"


@pytest.mark.parametrize(
    "doc",
    [
        "Drops rows older than a week.", "Blocks until the queue drains.", "Half-open interval; the end is excluded.", "// TODO: cache this. Picks the column that failed before.", "/**\n * @returns what is left after the pass\n */",
        "Sorts the list.", "リストを並べ替える。", "按时间顺序删除旧记录", "Args:\n    limit: upper bound, counted in units", "Schreibt nur geänderte Zeilen und lässt den Rest unberührt.", "Reparte la carga entre los nodos libres.", "Same as the other variant, but sorts ties by their id.", "Resets session. When the lease is missing it waits.",
    ],
)
def test_says_something(doc):
    assert D.says_something(doc, "reset_session", SIG)


@pytest.mark.parametrize(
    "doc",
    [
        None, "", " \n\t", "TODO", "TODO(ann): comment", "WIP", "noqa: E501", "// eslint-disable-next-line eqeqeq", "type: ignore", "#[clippy]", "Copyright (c) 2020 the contributors. All rights reserved.", "SPDX-License-Identifier: MIT", "author: platform team", "----------------", "~~~~ helpers ~~~~",
        "待办", "Args:\n    extra (list): extra", "Returns the value.", "return old_session(limit)", "if (session > 3) { return; }", "session = session + 1;", "@param items\n@returns", ":param limit:\n:return:", "Args:\n    limit (int): limit\n\nReturns:\n    None", "@override", "{@inheritDoc}", "See above.", "See base class.", "Inherited.", "Same as before", "Resets session.",
        "Reset the session", "reset_session function.", "The reset_session method", "This function is used to reset session.", "Parameters\n----------\nlimit", "...", "???", "Description goes here.", "Auto-generated method stub", "Getter.", "@return value", "lorem ipsum",
    ],
)
def test_says_nothing(doc):
    assert not D.says_something(doc, "reset_session", SIG)


def test_name_of_several_words():
    assert not D.says_something("Looks up banner.", "lookupBanner", "lookupBanner(rows)")


FILES = {
    "a.py": "# About something else entirely.\n\n@retry(3)\ndef far(x):\n    pass\n\n\n# Drops rows older than a week.\n@cached\nasync def near(x):\n    pass\n\n\nclass A:\n    def own(self):\n        '''Blocks until drained.'''\n",
    "b.js": "/**\n * Drops old rows first.\n */\nexport async function near(a = {b: 1}) {\n  const s = `// no } comment`;\n}\nclass A {\n  // Blocks until drained.\n  own(x) {\n    if (x) { y() }\n  }\n}\n// Waits for all workers.\nconst arrow = (a) => {\n}\n",
    "c.go": "package c\n\n/*\nDrops old rows first.\n*/\nfunc near(a int) error {\n\treturn nil\n}\n\n// Blocks until drained.\nfunc (s *T) own() {}\n",
    "d.rs": '/// Drops old rows first.\n#[inline]\npub fn near(a: u8) {}\n\nimpl A {\n    #[doc = "Blocks until \\"drained\\" fully."]\n    pub async fn own(&self) {}\n}\n',
}


def test_documentation_in_files():
    lang = {"a.py": "python", "b.js": "javascript", "c.go": "go", "d.rs": "rust"}
    for path, text in FILES.items():
        near, own = D.documentation_in(text, lang[path], "near", None), D.documentation_in(text, lang[path], "own", None)
        assert "Drops" in near and "Blocks" in own, path
        damaged = text + "\n<<<<<<< HEAD\n(\n"
        assert "Drops" in D.documentation_in(damaged, lang[path], "near", None), path
    assert D.documentation_in(FILES["a.py"], "python", "far", None) is None
    assert "Waits" in D.documentation_in(FILES["b.js"], "javascript", "arrow", None)
    ranges = {f.name: (f.top, f.line, f.last) for f in functions_of(FILES["b.js"], "javascript")}
    assert ranges["near"] == (4, 4, 6) and ranges["own"] == (9, 9, 11)
    assert {f.name: (f.top, f.line) for f in functions_of(FILES["a.py"], "python")}["near"] == (9, 10)


def names(text, language):
    return [f.name for f in functions_of(text, language)]


def test_trees_of_unusual_layouts():
    assert names("class K { m(a) { return 1 } n(b) { return { x() {} } } static async *g() {} get v() { return 1 } p = (a) => a\n q = 1\n r() {} }", "javascript") == ["m", "n", "x", "g", "v", "p", "r"]
    assert names("package a\nfunc A() int { return 1 }; func B() {}\ntype I interface {\n M(a int) error\n}\nfunc (r *T[K]) G(f func(int) int) map[string]struct{} { g := func() {}; g(); return nil }\n", "go") == ["A", "B", "M", "G"]
    assert names("impl S { fn a() {} fn b() {} }\nfn c<T: Fn(i32) -> i32>(f: fn(u8)) -> [u8; 3] where T: X { fn inner() {} go!{ fn not() {} } }\nmacro_rules! m { () => { fn no() {} } }", "rust") == ["a", "b", "c", "inner"]
    assert names('foo(1);\nexpect(x)\nit("a", () => { function inner() {} })\nif (x) { y() } else { z() }\nfor (;;) {}\nswitch (a) { case 1: { b() } }\n', "javascript") == ["inner"]
    typed = "const f = async <T>(a: number): Promise<{x: T}> => { return 1 }, g = function () {}\nclass A<T> extends B<T> { @x() m(a: {b: number} = {b: 1}): { c: number } { return 1 }\n abstract n(): void\n p: () => void = () => {}\n t: () => void\n}\nlet cb: (a: number) => void = (a) => {}\nexports.z = (a) =>\n  a.b()\n"
    assert names(typed, "typescript") == ["f", "g", "m", "n", "p", "cb", "z"]
    assert names("const re = a / b; const q = /[}{]/.test(x)\nfunction f() { if (x) /}/.test(y); return `${ { a() {} } }` }\nfunction g() {}", "javascript") == ["f", "a", "g"]


def test_exact_ranges_and_code():
    text = "class K {\n  /** Drops old rows first. */\n  @dec({a: 1})\n  m(a) {\n    return a\n  }\n}\n"
    f = functions_of(text, "typescript")[0]
    assert text[f.start : f.end] == "@dec({a: 1})\n  m(a) {\n    return a\n  }" and (f.top, f.line, f.last) == (3, 4, 6)
    text = "x = 'ü'\n@a\n@b(1)\ndef f(x):\n    return 'é'\n\n\n# after\n"
    f = functions_of(text, "python")[0]
    assert text[f.start : f.end] == "@a\n@b(1)\ndef f(x):\n    return 'é'" and (f.top, f.last) == (2, 5)
    f = functions_of(text + "(\n", "python")[0]  # no syntax tree
    assert text[f.start : f.end] == "@a\n@b(1)\ndef f(x):\n    return 'é'"


def test_comments_belong_to_what_follows_them():
    assert D.documentation_in("// Drops old rows first.\nfoo(1);\n", "javascript", "foo", None) is None
    assert D.documentation_in("// Drops old rows first.\nclass K { m(a) {} }\n", "javascript", "m", None) is None
    assert "Drops" in D.documentation_in("class K { /** Drops old rows first. */ m(a) {} }\n", "javascript", "m", None)
    assert "Drops" in D.documentation_in("/// Drops old rows first.\nimpl S { fn b() {}\n/// Drops rows.\nfn a() {} }\n", "rust", "a", None)


def test_damaged_lines_are_left_out():
    text = "function a() {}\nlet s = 'open\nfunction b() {}\n"
    assert names(text, "javascript") == ["a", "b"]
    assert names("fn a() {}\nlet s = ` ;\n" * 500, "rust") == ["a"] * 500


def test_nearest_definition_of_a_name():
    text = "# Drops old rows first.\ndef f():\n    pass\n\n\nclass A:\n    # Waits for every worker.\n    def f(self):\n        pass\n"
    assert "Drops" in D.documentation_in(text, "python", "f", 2) and "Waits" in D.documentation_in(text, "python", "f", 8)


NODES = "project string, id string, name string, node_type string, file_path string, line_start int, line_end int, signature string, docstring string, deleted_at timestamp, indexed_at timestamp, content string, description string"
SRC = "project string, file_path string, content string, indexed_at timestamp, docstring string"


def test_frame(spark):
    from datetime import datetime as T

    t1, t2 = T(2024, 1, 1), T(2024, 2, 1)
    n = lambda i, doc, path="b.js", name="near", deleted=None, at=t1, kind="function": ("p", i, name, kind, path, 4, 6, "near(a)", doc, deleted, at, "clash", "clash")
    nodes = spark.createDataFrame(
        [n("doc", "Waits for every worker."), n("doc", "Waits for every worker."), n("file", None), n("blank", " \n"), n("todo", "TODO"), n("gone", "Waits for all of it.", deleted=t2), n("old", "Waits for all of it."), n("old", "WIP", at=t2), n("type", "Waits for all of it.", kind="class"), n("nofile", None, "zz.js"), n("b.js::near", None, None, None)],
        NODES,
    )
    files = spark.createDataFrame([("p", k, v, t1, "clash") for k, v in FILES.items()] + [("p", "b.js", FILES["b.js"], t1, "clash"), ("p", "n.js", None, t1, "clash")], SRC)
    got = {r["id"]: r["origin"] for r in D.pairs(nodes, files).collect()}
    rows = {r["id"]: r for r in D.pairs(nodes, files, 1).collect()}  # several lists for one file
    assert rows.keys() == got.keys() and rows["file"]["code"].startswith("export async function near(") and (rows["file"]["line_start"], rows["file"]["line_end"]) == (4, 6)
    assert got == {"doc": "docstring", "file": "file", "blank": "file", "b.js::near": "file"}
    assert D.found(spark.createDataFrame([], NODES), files).count() == 0
    assert {r["id"] for r in D.found(nodes, spark.createDataFrame([], SRC)).collect()} == {"doc"}
