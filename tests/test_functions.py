import fnmatch

import pytest
from pyspark.sql import functions as F

from grovework.functions import text as X


@pytest.mark.parametrize("pattern", ["*.py", "a/*", "?b*", "[ab]*.c", "[!a]*", "[", "a[b", "x.y", "**/z", "[]]x"])
def test_glob_like_fnmatch(pattern):
    import re

    for name in ("a.py", "a/b/c.py", "ab", "xb", "a.c", "z.c", "a[b", "[", "x.y", "xzy", "q/z", "z", "]x"):
        assert bool(re.match(X.glob_regex(pattern), name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "p string")


def test_path_filter(spark):
    df = paths(spark, "src/app.py", "app.py", "./src/fixtures/x.py", "fixtures/a.py", "app.ts", None)
    keep = lambda inc, exc: {r.p for r in df.where(X.path_allowed(F.col("p"), inc, exc)).collect()}
    assert keep(["**/*.py"], ["**/fixtures/**"]) == {"src/app.py", "app.py"}
    assert keep([], None) == set() and keep(None, ["*.ts"]) == {"src/app.py", "app.py", "./src/fixtures/x.py", "fixtures/a.py"}


def test_scan_match(spark):
    df = paths(spark, "node_modules/a.js", "src/node_modules/b.js", "docs/x.md", "docs2/x.md", "a/b/test_x.py")
    got = lambda *p: {r.p for r in df.where(X.scan_match(F.col("p"), list(p))).collect()}
    assert got("node_modules") == {"node_modules/a.js", "src/node_modules/b.js"} and got("docs/") == {"docs/x.md"} and got("test_*.py") == {"a/b/test_x.py"}


def test_previews_and_names(spark):
    r = spark.range(1).select(
        X.preview(F.lit("abc  def"), 4).alias("a"), X.preview(F.lit("abc"), 3).alias("b"), X.trimmed(F.lit("abcdef"), 4).alias("c"), X.trimmed(F.lit(""), 4).alias("d"), X.display_name(F.lit("my_app_1a2b")).alias("e"),
        X.external_root(F.lit("@scope/pkg/x"), F.lit("typescript")).alias("f"), X.external_root(F.lit("github.com/a/b/c"), F.lit("go")).alias("g"), X.external_root(F.lit("net/http"), F.lit("go")).alias("h"), X.external_root(F.lit("a.b.c"), F.lit("python")).alias("i"),
        X.external_root(F.lit("serde::de::X"), F.lit("rust")).alias("j"), X.language_of(F.lit("a/b.TSX")).alias("k"), X.language_of(F.lit("Makefile")).alias("l"),
    ).first()
    assert tuple(r) == ("abc…", "abc", "abc…", None, "my_app", "@scope/pkg", "github.com/a/b", "net", "a", "serde", "typescript", "other")


def test_sanitize():
    assert X.sanitize_query("ValueError: invalid literal (arr[0])") == "ValueError invalid literal arr 0"
    assert X.sanitize_query('+-"*') == ""
