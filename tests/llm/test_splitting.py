from hypothesis import given, settings
from hypothesis import strategies as st

from grovework.llm import splitting as S

CHUNKS = "project string, id string, node_id string, file_path string, content string, start_line int, end_line int, language string, chunk_kind string, chunk_index int, max_chars string, piece string, rid string, indexed_at timestamp"
LIMITS = "chunk_kind string, max_chars int, overlap_chars int"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\r\té😀", max_size=300), st.integers(1, 80), st.integers(0, 60))
def test_round_trip(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    assert "".join(text[new:hi] for _, new, hi in pieces) == text
    assert all(hi - lo <= limit for lo, _, hi in pieces)
    keep = min(overlap, limit - 1)
    if len(text) > limit:
        assert all(new - lo == min(keep, new) for lo, new, _ in pieces)


def test_natural_boundaries():
    text = "def a():\n    x = 1\n    y = 2\n\n\ndef b():\n    z = 3\n    return z\n"
    assert [text[new:hi] for _, new, hi in S.split_text(text, 40, 4)] == ["def a():\n    x = 1\n    y = 2\n\n\n", "def b():\n    z = 3\n    return z\n"]
    text = "One one. Two two. Three."
    assert [text[new:hi] for _, new, hi in S.split_text(text, 20, 0)] == ["One one. Two two.", " Three."]
    pieces = S.split_text("\n".join(f"    line {i}" for i in range(100)), 200, 20)
    assert len(pieces) <= 8  # no boundary is lost while merging


def run(spark, rows, limits=(("function_body", 10, 2), ("fallback_text", 8, 0), ("class_context", 10, 2))):
    c = spark.createDataFrame([(*r, "clash", "clash", "clash", None) for r in rows], CHUNKS)
    return S.split_oversized(c, spark.createDataFrame(list(limits), LIMITS)), S.found(c, spark.createDataFrame(list(limits), LIMITS))


def test_lines_and_index(spark):
    rows = [
        ("p", "a", "n", "f", "aaa\nbbb\nccc\nddd", 5, 8, None, "function_body", 3),
        ("p", "a", "n", "f", "aaa\nbbb\nccc\nddd", 5, 8, None, "function_body", 3),
        ("p", "b", "n", "f", "zzzzzzzzzzzz", 9, 9, None, "function_body", 4),
        ("p", "fits", "n", "f", "0123456789", 1, 1, None, "function_body", 1),
        ("p", "other", None, None, "x" * 9, None, None, None, None, None),
        ("p", "ctx", "n", "f", "line\nline\nline\n", 3, 40, None, "class_context", 0),
        ("p", "free", "n", "f", "y" * 99, 1, 1, None, "no_limit", 0),
        ("p", "none", "n", "f", None, 1, 1, None, "function_body", 0),
    ]
    pieces, found = run(spark, rows)
    got = {}
    for r in pieces.orderBy("id", "piece").collect():
        got.setdefault(r["id"], []).append(r)
    assert {k for k, v in got.items() if len(v) > 1} == {"a", "b", "other", "ctx"} == {r["id"] for r in found.collect()}
    assert {k for k, v in got.items() if len(v) == 1} == {"fits", "free", "none"} and got["free"][0]["content"] == "y" * 99
    a = got["a"]
    assert "".join(r["content"][r["overlap_chars"] :] for r in a) == "aaa\nbbb\nccc\nddd"
    assert (a[0]["start_line"], a[-1]["end_line"]) == (5, 8)
    assert [r["chunk_index"] for r in a] == list(range(3, 3 + len(a)))
    assert got["b"][0]["chunk_index"] == 4 + len(a) - 1
    assert {(r["start_line"], r["end_line"]) for r in got["ctx"]} == {(3, 40)}
    assert got["other"][0]["start_line"] is None


def test_the_asked_overlap_is_kept():
    pieces = S.split_text("word " * 100, 100, 80)
    assert all(new - lo == min(80, new) for lo, new, _ in pieces) and len(pieces) > 15
    assert S.split_text("x" * 10, 4, 9) == [(0, 0, 4)] + [(i - 3, i, i + 1) for i in range(4, 10)]


def test_indexes_do_not_collide(spark):
    long = lambda i, node="n", n=35: ("p", i, node, "f", "x" * n, 1, 1, None, "function_body", int(i[1:]) if node else None)
    rows = [long("i0"), long("i1", n=5), long("i2"), long("i3", n=5), long("i9", n=5), long("i600"), long("i601", n=5)]
    rows += [long(f"t{k}", None) for k in range(5)] + [("p", f"s{k}", "m", "f", "y" * (30 if k % 2 else 3), 1, 1, None, "function_body", 7) for k in range(40)]
    pieces, _ = run(spark, rows)
    got = pieces.collect()
    of = {}
    for r in got:
        of.setdefault((r["node_id"], r["id"]), []).append(r["chunk_index"])
    assert all(sorted(v) == list(range(min(v), min(v) + len(v))) for v in of.values())
    n = [x for k, v in of.items() if k[0] == "n" for x in v]
    assert len(n) == len(set(n)) and of["n", "i1"] == [len(of["n", "i0"])] and of["n", "i9"] == [9 + len(of["n", "i0"]) + len(of["n", "i2"]) - 2]
    assert of["n", "i601"][0] == of["n", "i600"][-1] + 1 if of["n", "i600"] == sorted(of["n", "i600"]) else True
    tied = [x for k, v in of.items() if k[0] == "m" for x in v]  # equal indexes: all pieces between the first and the last of them
    assert len(of) == len(rows) and len(tied) == sum(len(v) for k, v in of.items() if k[0] == "m")


def test_newest_of_differing_rows(spark):
    from datetime import datetime as T

    row = lambda text, at: ("p", "a", "n", "f", text, 1, 1, None, "function_body", 0, "clash", "clash", "clash", at)
    c = spark.createDataFrame([row("a" * 30, T(2024, 1, 1)), row("b" * 40, T(2024, 2, 1)), row("c", T(2024, 3, 1))], CHUNKS)
    got = S.split_oversized(c, spark.createDataFrame([("function_body", 10, 0)], LIMITS)).collect()
    assert "".join(r["content"] for r in sorted(got, key=lambda r: r["piece"])) == "b" * 40


def test_empty(spark):
    pieces, found = run(spark, [])
    assert pieces.count() == 0 and found.count() == 0


def test_very_long_line(spark):
    pieces, _ = run(spark, [("p", "a", "n", "f", "é" * 200_000, 1, 1, None, "function_body", 0)], [("function_body", 1000, 100)])
    rows = pieces.orderBy("piece").collect()
    assert sum(len(r["content"]) - r["overlap_chars"] for r in rows) == 200_000 and max(len(r["content"]) for r in rows) <= 1000
