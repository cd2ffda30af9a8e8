"""Problem 3: generated, minified, vendored and data-only source files.

A file is judged as a whole, in one pass over its text, by layout statistics with thresholds per language: mean and
longest line, share of white space and of letters and digits, density of numeric literals, long encoded runs. They are
taken after comments are set aside and string literals are reduced to their length, so that hand-written code which
embeds an image, a word list or the text of a generator's header keeps the layout of hand-written code. Beside layout:
the header comment of generated files, the file names code generators use, the folders third-party copies live in, and
near-identity with a known library file (five-word shingles, similarity of 0.8 or more). The known files are broadcast
while they are few (their size is checked), beyond that they are joined: two sets of that similarity share one of their
first shingles in any fixed order, so only prefixes of the sets are joined, and the pairs that meet are compared in full.

Defined results
* null, empty and blank files are hand-written; so are files whose text only mentions generators or minifiers;
* names alone do not make a file generated unless generators write them (``gen_x.py``, ``vendor_x.js`` are hand-written);
* repeated rows of a file give one row; the newest row of a file decides; null projects or paths are left out;
* layout is judged in files of the five languages; other files (prose, tables) are judged by name, folder and header;
* no files: no rows; without known libraries only the other rules apply; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.runtime import cut, ship

SHINGLE_WORDS = 5
SIMILARITY = 0.8
MAX_LIBRARY_CHARS = 50_000_000

#: Comment and string syntax per language.
LINE_COMMENT = {"python": "#", "javascript": "//", "typescript": "//", "go": "//", "rust": "//"}
SUFFIXES = {".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust"}

#: Folders that hold third-party copies.
VENDOR_FOLDERS = {"vendor", "vendored", "_vendor", "node_modules", "bower_components", "third_party", "third-party", "thirdparty", "site-packages", "dist-packages", "extern", "externals", "godeps", "jspm_packages"}
#: Folders that generators write to.
GENERATED_FOLDERS = {"__generated__", "_generated", "autogen", "__autogen__"}
_RELEASE_FOLDER = re.compile(r"(^|/)(deps|packages|pods)/[^/]*[a-z][^/]*-v?\d+(\.\d+)+[^/]*/", re.I)

#: Names that code generators give to files.
GENERATED_NAMES = re.compile(r"(_pb2|_pb2_grpc)\.pyi?$|\.pb(\.gw)?\.go$|_grpc\.pb\.\w+$|_pb\.(d\.)?[jt]s$|\.(generated|g|gen|designer)\.\w+$|(^|/)zz_generated[._]\w+\.go$|_(generated|string)\.go$|\.min\.(js|mjs|cjs)$|\.bundle\.(js|mjs|cjs)$", re.I)

#: What headers of machine-made files say, in four languages.
_HEADER = re.compile(
    r"code generated\b.*\bdo not (edit|modify)|@generated\b|<auto-?generated|\bmachine[- ](made|generated|written|produced)\b"
    r"|\b(do not|don't|never) (edit|modify|change|touch)\b\s*([:.!,;]|by hand|manually|this file|directly|$)|\b(edit|change|modify) the (source|schema|template|grammar|generator|input)\b.{0,20}\binstead\b"
    r"|\b(changes|edits|modifications)\b.{0,30}\b(lost|overwritten|discarded|reverted)\b"
    r"|\b(file|code|module|source)\b.{0,20}\b(automatically|machine|auto)[- ]?(generated|created|made|produced|written|built)\b"
    r"|^\W*(this (file|code|module) (is|was|has been) )?((auto(matically)?)[- ]?)?(generated|created|produced|built|compiled|emitted) (automatically )?(from|by|with|using)\b"
    r"|\bautomatisch (erzeugt|generiert|erstellt)\b|\bnicht (bearbeiten|ändern|editieren|verändern)\b"
    r"|\b(généré|créé|produit)e? automatiquement|\bautomatiquement (généré|créé)|\bne pas (modifier|éditer|changer)\b"
    r"|\b(generad|cread)[oa] automáticamente|\bautomáticamente (generad|cread)[oa]|\b(genera|generó|creó) automáticamente|\bno (editar|modificar|edite|modifique)\b",
    re.I,
)
_BY_HAND = re.compile(r"\bby hand since\b|\b(maintained|edited|written|changed) by hand\b|\bnot generated\b|\bhand-?(written|edited)\b", re.I)


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language, between what people write and what minifiers and serialisers write in it."""

    longest: int = 300  # a line beyond this is long
    long_share: float = 0.5  # share of all characters in long lines
    mean: float = 110.0
    white: float = 0.12  # minified text has less white space
    wrapped_mean: float = 60.0  # the same for minified text that is wrapped at some width
    wrapped_white: float = 0.065
    dense_mean: float = 46.0  # and for text wrapped at a smaller width, which has fewer letters and digits as well
    dense_white: float = 0.055
    dense_alnum: float = 0.72
    data_share: float = 0.55  # share of literals among what is no white space
    data_chars: int = 300
    numbers: float = 0.4  # numeric literals among all words
    encoded_share: float = 0.55  # share of long encoded runs among what is no white space


LIMITS = {
    "python": Limits(white=0.1, wrapped_mean=80.0, wrapped_white=0.05, dense_mean=60.0, dense_white=0.04),
    "javascript": Limits(dense_mean=40.0),
    "typescript": Limits(),
    "go": Limits(dense_white=0.06),  # formatted with tabs
    "rust": Limits(dense_mean=52.0, dense_alnum=0.66),  # signatures hold more punctuation
}

_LEX = {
    "python": re.compile(r"(?P<doc>(?:[rRbBuUfF]{0,2})(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)))|(?P<str>[rRbBuUfF]{0,2}(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|(?P<com>#[^\n]*)"),
    "": re.compile(r"(?P<com>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){1,40}'|'(?:[^'\\\n]|\\.){41,}')|(?P<doc>`(?:[^`\\]|\\[\s\S])*`)"),
}
_IMPORT = re.compile(r"^\s*(import|from|use|package|require|mod)\b[^\n]*$|^\s*(const|var|let)\s+[^\n=]*=\s*require\([^\n]*$", re.M)
_DEFINES = re.compile(r"\b(def|func|fn|function|class|struct|interface|trait|impl|enum)\b|=>")
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\w*")
_WORDS = re.compile(r"\w+")
_NOT_ALNUM = re.compile(r"[\W_]+")
ENCODED_RUN, ENCODED_DIGITS = 60, 0.04  # characters of an encoded run at least, share of digits in it at least
_VALUES = re.compile(r"(?=[\s\S]*\d)[\w+/=,;:.\-\\\s]*")


def language_of(path: str) -> str:
    dot = path.rfind(".")
    return SUFFIXES.get(path[dot:].lower(), "") if dot >= 0 else ""


def header_of(text: str, language: str) -> list[str]:
    """The lines of the comment (or Python docstring) that the file begins with, up to the first code."""
    body = text.lstrip("﻿")
    out, at = [], 0
    lex = _LEX["python" if language == "python" else ""]
    while True:
        while at < len(body) and body[at].isspace():
            at += 1
        m = lex.match(body, at)
        if not m or not (m.lastgroup == "com" or (language == "python" and m.lastgroup in ("doc", "str"))):
            return out
        out += m.group().split("\n")
        at = m.end()


def is_generated(path: str, text: str, language: str) -> bool:
    if GENERATED_NAMES.search(path) or GENERATED_FOLDERS & set(path.split("/")[:-1]):
        return True
    lines = [x.strip().strip("#/*\"'!- \t\r").strip() for x in header_of(text, language)]
    return any(_HEADER.search(x) for x in lines) and not any(_BY_HAND.search(x) for x in lines)


def is_vendored(path: str) -> bool:
    folders = path.split("/")[:-1]
    return any(x.casefold() in VENDOR_FOLDERS for x in folders) or bool(_RELEASE_FOLDER.search(path))


def _solid(text: str) -> int:
    """Characters that are no white space."""
    return len("".join(text.split()))


def _is_encoded(body: str) -> bool:
    """A long run without white space in which digits are mixed: encoded bytes or serialised values, no pattern of words."""
    return len(body) >= ENCODED_RUN and not any(map(str.isspace, body)) and sum(map(str.isdigit, body)) >= ENCODED_DIGITS * len(body)


def layout(text: str, language: str) -> dict[str, float]:
    """Layout statistics of a file with comments removed and literals reduced to blanks of no width."""
    lex = _LEX["python" if language == "python" else ""]
    literal, pieces, at, encoded = 0, [], 0, 0
    for m in lex.finditer(text):
        pieces.append(text[at : m.start()])
        at = m.end()
        if m.lastgroup == "com":
            pieces.append("\n" * m.group().count("\n"))
            continue
        body = m.group()
        if m.lastgroup == "doc" and language == "python":
            before = m.start() - 1
            while before >= 0 and text[before].isspace():
                before -= 1
            if before < 0 or text[before] in ":\"'":
                continue  # a docstring
        size = _solid(body)
        run = _is_encoded(body.strip("\"'`"))
        if len(body) < 40 or run or _VALUES.fullmatch(body.strip("\"'`rbRB")):
            literal += size  # a value, not prose or a pattern
        if run:
            encoded += size
        pieces.append('""' + "\n" * body.count("\n"))
    pieces.append(text[at:])
    code = _IMPORT.sub("", "".join(pieces))
    numbers = _NUMBER.findall(code)
    words = len(_WORDS.findall(code))
    number_chars = sum(map(len, numbers))
    marks = sum(code.count(x) for x in ",;:()[]{}|")
    solid = _solid(code)
    lines = [x for x in code.split("\n") if x.strip()]
    total = sum(map(len, lines)) or 1
    everything = max(1, literal + solid - 2 * code.count('""'))
    return {
        "longest": max(map(len, lines), default=0),
        "mean": total / max(1, len(lines)),
        "long_chars": sum(len(x) for x in lines if len(x) > 300) / total,
        "white": sum(len(x.strip()) - _solid(x) for x in lines) / total,
        "alnum": len(_NOT_ALNUM.sub("", code)) / max(1, solid),
        "numbers": len(numbers) / max(1, words),
        "n_numbers": len(numbers),
        "literal": literal + number_chars,
        "data_share": (literal + number_chars + marks) / everything,
        "encoded": encoded,
        "encoded_share": encoded / everything,
        "defines": len(_DEFINES.findall(code)),
        "lines": len(lines),
    }


def is_minified(s: dict[str, float], limits: Limits) -> bool:
    if not s["defines"]:
        return False
    long = s["longest"] > limits.longest and s["long_chars"] >= limits.long_share
    wrapped = s["mean"] > limits.wrapped_mean and s["white"] < limits.wrapped_white
    dense = s["mean"] > limits.dense_mean and s["white"] < limits.dense_white and s["alnum"] < limits.dense_alnum
    return wrapped or dense or (s["white"] < limits.white and (long or s["mean"] > limits.mean))


def is_data(s: dict[str, float], limits: Limits) -> bool:
    if s["defines"] or s["literal"] < limits.data_chars:
        return False
    return s["data_share"] >= limits.data_share or s["numbers"] >= limits.numbers or s["encoded_share"] >= limits.encoded_share


def shingles(text: str) -> set[int]:
    words = _WORDS.findall(text)
    joined = (" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1) if words else 0))
    return {int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in joined}


def reason_of(path: str, text: str, libraries: tuple[dict[int, list[int]], list[int]] = ({}, [])) -> str | None:
    """``generated``, ``vendored``, ``copied``, ``minified``, ``data`` or None for hand-written."""
    if not text.strip():
        return None
    if is_vendored(path):
        return "vendored"
    language = language_of(path)
    if is_generated(path, text, language):
        return "generated"
    if not language:
        return None
    postings, sizes = libraries
    if sizes:
        own, met = shingles(text), {}
        for x in own:
            for k in postings.get(x, ()):
                met[k] = met.get(k, 0) + 1
        if any(n >= SIMILARITY * (len(own) + sizes[k] - n) for k, n in met.items()):
            return "copied"
    stats = layout(text, language)
    if is_minified(stats, LIMITS[language]):
        return "minified"
    return "data" if is_data(stats, LIMITS[language]) else None


def _postings(texts: list[str]) -> tuple[dict[int, list[int]], list[int]]:
    postings: dict[int, list[int]] = {}
    sizes = []
    for k, text in enumerate(texts):
        own = shingles(text)
        sizes.append(len(own))
        for x in own:
            postings.setdefault(x, []).append(k)
    return postings, sizes


def _shingled(df: DataFrame, name: str) -> DataFrame:
    """``df`` without its text, with its sorted ``shingles`` and a ``rid``."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [sorted(x - (1 << 64) if x >> 63 else x for x in shingles(t)) for t in pdf["content"]]
            yield pdf.drop(columns="content").assign(shingles=pd.Series(own, index=pdf.index, dtype="object"))

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "content")
    out = df.mapInPandas(add, (schema + ", " if schema else "") + "shingles array<long>")
    return cut(out.where(F.size("shingles") > 0).withColumn("rid", F.monotonically_increasing_id()), name)


def copies_of(files: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``files`` (columns and ``content``) whose text is nearly that of a known file, without the text."""
    a, b = _shingled(files, "shingles"), _shingled(known.select("content").distinct(), "known-shingles")
    # n shingles and a similarity of at least s: one of the first n - ceil(s n) + 1 is shared
    first = F.explode(F.slice("shingles", 1, (F.size("shingles") - F.ceil(F.lit(SIMILARITY) * F.size("shingles")) + 1).cast("int"))).alias("x")
    n = F.size("shingles").alias("n")
    left, right = a.select("rid", n, first), b.select(F.col("rid").alias("kid"), F.size("shingles").alias("kn"), first)
    alike = (F.col("kn") >= F.col("n") * SIMILARITY) & (F.col("n") >= F.col("kn") * SIMILARITY)
    pairs = left.join(right, "x").where(alike).select("rid", "kid").distinct()
    both = pairs.join(a.select("rid", "shingles"), "rid").join(b.select(F.col("rid").alias("kid"), F.col("shingles").alias("other")), "kid")
    shared = F.size(F.array_intersect("shingles", "other"))
    near = both.where(shared >= SIMILARITY * (F.size("shingles") + F.size("other") - shared)).select("rid").distinct()
    return a.join(near, "rid", "left_semi").drop("rid", "shingles")


def classify(files: DataFrame, known: DataFrame | None = None, broadcast_chars: int = MAX_LIBRARY_CHARS) -> DataFrame:
    """``project, file_path, reason`` of every file; ``reason`` is null for hand-written ones."""
    spark = files.sparkSession
    ship(spark)
    rows = files.where(F.col("project").isNotNull() & F.col("file_path").isNotNull()).select("project", "file_path", "indexed_at", "content")
    texts: list[str] = []
    joined = False
    if known is not None:
        known = known.where(F.trim("content") != "")
        joined = known.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n")).first()["n"] > broadcast_chars
        texts = [] if joined else [r["content"] for r in known.select("content").distinct().collect()]
    shared = spark.sparkContext.broadcast(_postings(texts))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            why = [reason_of(p, t or "", shared.value) for p, t in zip(pdf["file_path"], pdf["content"])]
            yield pdf.drop(columns="content").assign(reason=pd.Series(why, index=pdf.index, dtype="object"))

    judged = rows.mapInPandas(judge, "project string, file_path string, indexed_at timestamp, reason string")
    # judged before repeated rows are merged, so that only verdicts are shuffled, not texts
    newest = F.max(F.struct("indexed_at", "reason")).getField("reason").alias("reason")
    if joined:
        code = F.lower(F.regexp_extract("file_path", r"(\.\w+)$", 1)).isin(list(SUFFIXES)) & (F.trim("content") != "")
        same = copies_of(rows.where(code), known).withColumn("reason", F.lit("copied")).distinct()
        before = F.col("reason").isin("vendored", "generated")
        same = same.select(F.col("project").alias("_p"), F.col("file_path").alias("_f"), F.col("indexed_at").alias("_at"), F.lit(True).alias("_copied"))
        on = (F.col("project") == F.col("_p")) & (F.col("file_path") == F.col("_f")) & F.col("indexed_at").eqNullSafe(F.col("_at"))
        why = F.when(F.col("_copied") & ~F.coalesce(before, F.lit(False)), "copied").otherwise(F.col("reason")).alias("reason")
        judged = judged.join(same, on, "left").select("project", "file_path", "indexed_at", why)
    return judged.groupBy("project", "file_path").agg(newest)


def found(files: DataFrame, known: DataFrame) -> DataFrame:
    return classify(files, known).where(F.col("reason").isNotNull()).select("project", "file_path")
