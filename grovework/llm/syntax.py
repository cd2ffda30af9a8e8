"""Problem 6: source files that do not parse.

The token stream of each file runs through the memoised derivatives of its language's grammar (``derivatives``). An empty
derivative marks the exact failing token; a final state that is not nullable means truncation. Files are judged one by
one where they are read; only verdicts are shuffled.

Defined results
* judged are .py, .js, .ts, .go and .rs files (as the path ends, upper or lower case); others have no verdict;
* empty or blank files are valid except in Go; null content has no verdict; NUL bytes are invalid;
* names, types and rules beyond the context-free grammar (such as targets that cannot be assigned) are not judged;
* repeated rows of a file count once, the newest row of a file decides; null projects or paths are left out;
* files are read in whole, of any length; no files: no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.llm import grammars
from grovework.llm.derivatives import Grammar
from grovework.runtime import ship
from grovework.sources import lexers

SUFFIXES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust"}

_grammars: dict[str, Grammar] = {}


@dataclass(frozen=True)
class Verdict:
    status: str  # valid, error or truncated
    line: int | None = None
    token: str | None = None


VALID = Verdict("valid")


def grammar(language: str) -> Grammar:
    if language not in _grammars:
        _grammars[language] = Grammar(grammars.TEXT[language], grammars.START[language])
    return _grammars[language]


def parse(text: str, language: str) -> Verdict:
    """The verdict on ``text`` in ``language``."""
    g = grammar(language)
    if text.startswith("﻿"):
        text = text[1:]
    if language == "python":
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    state = g.begin()
    step = g.step
    ecma = language in ("javascript", "typescript")

    def where(at: int) -> int:
        return text.count("\n", 0, at) + 1

    def accepts(classes: tuple) -> bool:
        return bool(step(state, classes))

    tokens = (
        lexers.python_tokens(text)
        if language == "python"
        else lexers.ecma_tokens(text, accepts)
        if ecma
        else lexers.go_tokens(text)
        if language == "go"
        else lexers.rust_tokens(text)
    )
    asi = ("ASI",)
    try:
        for classes, fresh, at, s in tokens:
            after = step(state, classes)
            if ecma and (fresh or s == "}"):  # a semicolon may be missing here
                ended = step(state, asi)
                if ended:
                    more = step(ended, classes)
                    after = after | more if after else more
            if not after:
                return Verdict("error", where(at), s)
            state = after
    except lexers.Broken as e:
        return Verdict("truncated" if e.cut else "error", where(e.at), e.what)
    if g.complete(step(state, ("END",))) or (ecma and g.complete(step(step(state, asi), ("END",)))):
        return VALID
    return Verdict("truncated", where(len(text)))


def language_of(path: str) -> str | None:
    return SUFFIXES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def check(files: DataFrame) -> DataFrame:
    """``project, file_path, language, status, line, token`` of every judged file."""
    ship(files.sparkSession)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            languages = [language_of(p) for p in pdf["file_path"]]
            verdicts = [parse(t, x) for t, x in zip(pdf["content"], languages)]
            out = pdf[["project", "file_path", "indexed_at"]].copy()
            out["language"] = languages
            out["status"] = [v.status for v in verdicts]
            out["line"] = pd.array([v.line for v in verdicts], dtype="Int32")
            out["token"] = [v.token for v in verdicts]
            yield out

    named = F.col("project").isNotNull() & F.col("file_path").rlike(r"(?i)\.(py|js|ts|go|rs)$")
    rows = files.where(named & F.col("content").isNotNull()).select("project", "file_path", "indexed_at", "content")
    judged = rows.mapInPandas(judge, "project string, file_path string, indexed_at timestamp, language string, status string, line int, token string")
    newest = F.max(F.struct("indexed_at", "status", "line", "token", "language")).alias("v")
    return judged.groupBy("project", "file_path").agg(newest).select("project", "file_path", "v.language", "v.status", "v.line", "v.token")


def found(files: DataFrame) -> DataFrame:
    return check(files).where(F.col("status") != "valid").select("project", "file_path")


def rates(files: DataFrame) -> DataFrame:
    """Per project and language: files, those with an error, those cut off, and the share of both."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    return (
        check(files)
        .groupBy("project", "language")
        .agg(F.count(F.lit(1)).alias("files"), n("error"), n("truncated"))
        .withColumn("invalid_share", F.round((F.col("error") + F.col("truncated")) / F.col("files"), 6))
    )
