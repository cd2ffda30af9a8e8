"""Reading source trees: distributed scan with include, exclude, ignore, size and generated-file rules."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovework.functions.text import glob_regex, language_of, scan_match, suffix

MAX_BYTES = 262_144
SUFFIXES = ["py", "js", "jsx", "ts", "tsx", "go", "rs", "md", "rst", "txt"]
GENERATED_GLOBS = ["*_pb2.py", "*_pb2_grpc.py", "*.pb.go", "*.min.js", "*.generated.*", "*.g.dart", "*_generated.go", "zz_generated*"]
EXCLUDED_FOLDERS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", "vendor"]
BINARY_SUFFIXES = "png jpg jpeg gif ico pdf zip gz tar jar class so dll exe woff woff2 ttf mp3 mp4 bin pyc o a".split()


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``file_path`` (relative), ``bytes``, ``length``, ``modified`` of all files below a folder of any Hadoop file system."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^\w+:(//[^/]*)?", "")
    return raw.select(F.substring(rel, len(base) + 2 if base.startswith("/") else len(base) + 3, 1_000_000).alias("file_path"), F.col("content").alias("bytes"), "length", F.col("modificationTime").alias("modified"))


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(folder, pattern) of every line of the ignore files below ``root``, and linked work trees as whole folders."""
    rules = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n != ".git"]
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        if ".gitignore" in files:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                rules += [(rel, x.rstrip("\n").rstrip()) for x in f if x.strip() and not x.startswith("#")]
        if rel and ".git" in files:
            with open(os.path.join(folder, ".git"), encoding="utf-8", errors="replace") as f:
                if "/worktrees/" in f.read():
                    rules.append(("", f"/{rel}/"))
    return rules


def _ignore_regex(folder: str, pattern: str) -> tuple[str, bool]:
    """(regex on the relative path, negated) of one ignore line."""
    negated = pattern.startswith("!")
    pattern = pattern[1:] if negated else pattern
    only_folder = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    anchored = "/" in pattern
    pattern = pattern.lstrip("/")
    body = ""
    for part in PurePosixPath(pattern).parts:
        if part == "**":
            body += "(?:[^/]+/)*"
        else:
            body += glob_regex(part)[5:-1].replace(".*", "[^/]*") + "/"
    body = body.rstrip("/") if not body.endswith(")*") else body + ".+"
    prefix = "^" + (glob_regex(folder)[5:-1] + "/" if folder else "") + ("" if anchored else "(?:.*/)?")
    return prefix + body + ("/.*$" if only_folder else "(?:/.*)?$"), negated


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether a path is ignored: per ignore file the last matching line decides, and any file may ignore."""
    whole = F.lit(False)
    for folder in dict.fromkeys(f for f, _ in rules):
        state = F.lit(False)
        for f, p in rules:
            if f == folder:
                rx, negated = _ignore_regex(f, p)
                state = F.when(path.rlike(rx), F.lit(not negated)).otherwise(state)
        whole = whole | state
    return whole


def looks_generated(path: Column, head: Column) -> Column:
    """By file name, or by a marker in the first 2048 characters."""
    name = F.element_at(F.split(path, "/"), -1)
    by_name = F.lit(False)
    for g in GENERATED_GLOBS:
        by_name = by_name | name.rlike(glob_regex(g))
    start = F.substring(head, 1, 2048)
    return by_name | F.coalesce(start.contains("@generated") | (start.contains("Code generated") & start.contains("DO NOT EDIT")), F.lit(False))


def looks_binary(path: Column, data: Column) -> Column:
    return suffix(path).isin(BINARY_SUFFIXES) | F.coalesce(F.contains(F.substring(data, 1, 8192), F.lit(bytearray(b"\0"))), F.lit(False))


def scan(tree: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, rules: list[tuple[str, str]] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every file with ``verdict``: keep, suffix, excluded, ignored, not included, too large, binary or generated.

    Rules apply in this order; kept files have ``content``, ``language`` and ``checksum``.
    """
    p = F.col("file_path")
    folders = F.exists(F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1), lambda x: x.isin(EXCLUDED_FOLDERS))
    text = F.decode(F.col("bytes"), "UTF-8")
    verdict = (
        F.when(~suffix(p).isin(SUFFIXES), "suffix")
        .when(folders | (scan_match(p, exclude) if exclude else F.lit(False)), "excluded")
        .when(ignored(p, rules) if rules else F.lit(False), "ignored")
        .when(~(F.lit(True) if include is None else scan_match(p, include) if include else F.lit(False)), "not included")
        .when(F.col("length") > max_bytes, "too large")
        .when(looks_binary(p, F.col("bytes")), "binary")
        .when(looks_generated(p, text), "generated")
        .otherwise("keep")
    )
    v = tree.withColumn("verdict", verdict)
    kept = F.col("verdict") == "keep"
    return v.select("file_path", "length", "verdict", F.when(kept, text).alias("content"), language_of(p).alias("language"), F.md5("bytes").alias("checksum"))


def preview(files: DataFrame) -> DataFrame:
    """Statistics of kept files per language: files, bytes, lines // 10 as nodes and bytes // 4 as tokens."""
    k = files.where(F.col("verdict") == "keep")
    lines = F.length(F.regexp_replace("content", "[^\n]", "")) + 1
    return k.groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.floor(F.sum(lines) / 10).alias("nodes"), F.floor(F.sum("length") / 4).alias("tokens")
    )
