import pytest

from grovework.operators import chunking as K
from grovework.operators import reconcile as RC
from grovework.operators import search as S


def test_sentence_windows_cover_the_text():
    text = "".join(f"Sentence number {i} has a few words. " + ("\n\n" if i % 7 == 0 else "") for i in range(300)) + "long " * 950
    w = K.sentence_windows(text, 800, 200)
    words = lambda a, b: len(text[a:b].split())
    assert all(words(a, b) <= 800 for a, b in w) and w[0][0] == 0 and w[-1][1] == len(text)
    for (a, b), (c, d) in zip(w, w[1:]):
        assert a < c <= b < d and words(c, b) <= 200
    assert "".join(text[max(a, b0) : b] for (a, b), b0 in zip(w, [0] + [b for _, b in w])) == text
    assert K.sentence_windows("") == [] and K.sentence_windows(" \n ") == [] and K.sentence_windows("One.") == [(0, 4)]


def test_repository_chunks(spark):
    nodes = spark.createDataFrame(
        [("p", "a.py", "a", "module", "a.py", 1, 100, "", "Doc.", None), ("p", "a.py::C", "C", "class", "a.py", 1, 100, "class C(B)", "", "a.py"), ("p", "a.py::C.m", "m", "method", "a.py", 2, 100, "def m(self)", None, "a.py::C"), ("p", "d.md", "d.md", "document", "d.md", 1, 3, None, None, None), ("p", "s", "S", "struct", "a.py", 1, 2, None, None, "a.py")],
        "project string, id string, name string, node_type string, file_path string, line_start int, line_end int, signature string, docstring string, parent_id string",
    )
    files = spark.createDataFrame([("p", "a.py", "\n".join(f"line {i}" for i in range(1, 101))), ("p", "d.md", "# Title\n\nOne. Two.")], "project string, file_path string, content string")
    got = {}
    for r in K.repository_chunks(nodes, files).collect():
        got.setdefault(r["chunk_kind"], []).append(r)
    assert sorted(got) == ["class_context", "document", "function_body", "module_context"] and len({r["id"] for v in got.values() for r in v}) == sum(map(len, got.values()))
    assert [(r["start_line"], r["end_line"]) for r in sorted(got["function_body"], key=lambda r: r["start_line"])] == [(2, 81), (70, 100)]
    assert got["class_context"][0]["content"] == "class C(B)\nmethod def m(self)" and (got["class_context"][0]["start_line"], got["class_context"][0]["end_line"]) == (1, 81)
    assert got["document"][0]["content"] == "# Title\n\nOne. Two." and (got["document"][0]["start_line"], got["document"][0]["end_line"]) == (1, 3)


def test_line_of(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\nccc\nd", "ccc\nd"), ("a\nb", "zz"), ("abc", "abc"), (None, "a")], "t string, p string")
    assert [r[0] for r in df.select(K.line_of(F.col("t"), F.col("p"))).collect()][:3] == [3, 1, 1]


def test_embedding_is_aligned(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("busy")
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(i, "x" * (i + 1)) for i in range(120)] + [(500, "bad"), (501, ""), (502, None), (503, "y" * 200_000)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r["id"]: r["vector"] for r in K.embed(df, "text", model).collect()}
    assert all(got[i] == [i + 1, 1.0] for i in range(100)) and got[500] is None and got[503] == [200_000.0, 1.0]
    assert K.embed(df.limit(0), "text", model).count() == 0
    short = {r["id"]: r["vector"] for r in K.embed(df.where("id < 3"), "text", lambda t: [[1.0]]).collect()}
    assert set(map(str, short.values())) == {"None"}  # another number of vectors than texts


N = "project string, id string, parent_id string, name string, node_type string, file_path string, line_start int, source string, signature string, docstring string"


def test_summaries_bottom_up(spark):
    rows = [("p", "m", None, "m", "module", "a.py", 1, None, None, None), ("p", "c", "m", "C", "class", "a.py", 5, None, None, "ignored"), ("p", "f", "c", "f", "method", "a.py", 6, "src", "f()", "Does it. More."), ("p", "g", "c", "g", "method", "a.py", 9, "", "", ""), ("p", "h", "m", "h", "function", "a.py", 2, "return 1", "h()", None)]
    nodes = spark.createDataFrame(rows, N)
    none = spark.createDataFrame([], "project string, id string, summary string, summary_input_hash string")
    done = RC.drain_summaries(nodes, none)
    got = {r["id"]: r for r in done.collect()}
    assert got["f"]["summary"] == "Does it." and got["h"]["summary"] == "return 1" and got["g"]["outcome"] == "failed" and got["g"]["summary_input_hash"] == ""
    assert got["c"]["summary"] == "method f: Does it." and got["m"]["outcome"] == "generated" and "function h: return 1" in got["m"]["summary"]
    again = {r["id"]: r for r in RC.drain_summaries(nodes, done.select("project", "id", "summary", "summary_input_hash"), lambda t: 1 / 0).collect()}
    assert {r["outcome"] for i, r in again.items() if i != "g"} == {"reused"} and again["g"]["outcome"] == "failed"
    changed = nodes.withColumn("docstring", __import__("pyspark").sql.functions.expr("if(id = 'f', 'Changed.', docstring)"))
    kept = {r["id"]: r for r in RC.drain_summaries(changed, done.select("project", "id", "summary", "summary_input_hash"), lambda t: 1 / 0).collect()}
    assert kept["f"]["summary"] == "Does it." and kept["f"]["summary_input_hash"] == "" and kept["c"]["outcome"] == "reused"
    assert RC.drain_summaries(nodes.limit(0), none).count() == 0


def test_long_texts_are_summarised_in_parts():
    parts = RC.split_long("abcdefghij" * 10, 30)
    assert all(len(p) <= 30 for p in parts) and parts[0] + "".join(p[6:] for p in parts[1:]) == "abcdefghij" * 10
    assert RC.pack_lines(["aa", "bb", "c" * 9, "d"], 5) == ["aa\nbb", "c" * 9, "d"]
    seen = []
    assert RC.map_reduce(["one", "two", "three"], lambda t: seen.append(t) or t[:2], 100) == "on" and seen[-1] == "on\ntw\nth"


def test_fused_hits_keep_their_matches(spark):
    m = "project string, id string, score double, matches array<struct<chunk_id:string,score:double>>"
    code = spark.createDataFrame([("p", "a", 0.9, [("c1", 0.9)]), ("p", "b", 0.2, [("c2", 0.2)])], m)
    summ = spark.createDataFrame([("p", "a", 0.5), ("p", "c", 0.4)], "project string, id string, score double")
    got = {r["id"]: r for r in S.hybrid(code, summ, ["project", "id"]).collect()}
    assert [x["chunk_id"] for x in got["a"]["matches"]] == ["c1"] and got["a"]["source_type"] == "hybrid" and got["c"]["source_type"] == "summary" and not got["c"]["matches"]
    fused = {r["id"]: r for r in S.fuse({"code": code, "summary": summ}, ["project", "id"], ["code", "summary"]).collect()}
    assert fused["a"]["source_type"] == "text" and fused["a"]["score"] == 0.9 and [x["chunk_id"] for x in fused["b"]["matches"]] == ["c2"]


def test_stale_vectors_by_hash(spark):
    n = spark.createDataFrame([("p", "same", "s", "h1"), ("p", "other", "s", "h2"), ("p", "legacy", "s", "h3"), ("p", "new", "s", "h4"), ("p", "empty", "", "h5")], "project string, id string, summary string, summary_input_hash string")
    v = [1.0]
    old = spark.createDataFrame([("p", "same", "h1", v), ("p", "other", "h1", v), ("p", "legacy", None, v), ("p", "new", "h4", None)], "project string, id string, vector_hash string, summary_embedding array<float>")
    assert {r["id"] for r in RC.stale_summary_vectors(n, old).collect()} == {"other", "new"}


@pytest.mark.parametrize("text", ["First. Second.", "no stop\nnext"])
def test_first_sentence(text):
    assert RC.first_sentence(text) in ("First.", "no stop")
