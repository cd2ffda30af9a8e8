"""Problem 2: functions paired with their documentation.

Every source file that holds a function of the graph is parsed into a syntax tree (``trees``), whose function nodes give
the exact source of each function. It takes its documentation from the current row of the graph or, if that has none,
from the comment that ends directly above the definition (or above its decorators or attributes), or from its
documentation attribute. Pairs whose documentation is empty, trivial or only repeats names are dropped.

Files are joined with lists of their functions; a file that very many functions name gets several lists.

Defined results
* only functions and methods whose current row has no ``deleted_at``; null keys are left out; older and repeated rows do
  not matter; a null name is taken from the id;
* a docstring of white space counts as none; a comment divided from the definition by a blank line is not its own;
* without its file, or without a definition of that name in it, a function has only its docstring and no code;
* of several definitions of a name in a file the one next to ``line_start`` counts, of two as near the upper one;
* whole files and texts are read; no nodes: no rows; no files: docstrings only; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.sources import trees
from grovework.runtime import current_rows, ship

LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust"}

_DOC_ATTRIBUTE = re.compile(r"#\[\s*doc\s*=\s*r?#*\"((?:[^\"\\]|\\.)*)\"#*\s*\]")


def comment_before(text: str, at: int, language: str) -> str | None:
    """The comment that ends directly before offset ``at``: on the line above, or before it on its own line."""
    begun = text.rfind("\n", 0, at) + 1
    before = text[begun:at].strip()
    if before:  # other code, or a comment, stands before it on its line
        open_ = before.rfind("/*") if language != "python" and before.endswith("*/") else -1
        return before[open_:] if open_ >= 0 and "*/" not in before[open_:-2] else None
    if not begun:
        return None
    end = begun - 1
    line = text.rfind("\n", 0, end) + 1
    last = text[line:end].strip()
    mark = "#" if language == "python" else "//"
    if last.startswith(mark) and not last.startswith("#!"):
        first = line
        while first:
            above = text.rfind("\n", 0, first - 1) + 1
            if not text[above : first - 1].strip().startswith(mark):
                break
            first = above
        return text[first:end]
    if language != "python" and last.endswith("*/"):
        open_ = text.rfind("/*", 0, end)
        line = text.rfind("\n", 0, open_) + 1
        if open_ >= 0 and not text[line:open_].strip():
            return text[line:end]
    return None


def documentation_of(f: trees.Function, text: str, language: str) -> str | None:
    """Documentation the file has for a function node."""
    above = comment_before(text, f.start, language)
    if above:
        return above
    if language == "rust":
        doc = _DOC_ATTRIBUTE.findall(text[f.start : f.head])
        if doc:
            return "\n".join(x.replace('\\"', '"').replace("\\n", "\n") for x in doc)
    # attributes may stand above the comment, or between comment and definition
    at = f.head
    while at > f.start:
        above = comment_before(text, at, language)
        if above:
            return above
        at = text.rfind("\n", 0, at)
        while at > f.start and text[at].isspace():
            at -= 1
        at = text.rfind("\n", 0, at) + 1
    return f.doc


class Definitions:
    """The function nodes of one file, found by name."""

    def __init__(self, text: str, language: str) -> None:
        self.by_name: dict[str, list[trees.Function]] = {}
        for f in trees.functions_of(text, language):
            self.by_name.setdefault(f.name, []).append(f)

    def nearest(self, name: str, line: int | None) -> trees.Function | None:
        """The definition of ``name`` at or next to ``line`` (the first one without a line)."""
        own = self.by_name.get(name)
        if not own:
            return None
        if line is None or line != line or len(own) == 1:
            return own[0]
        i = bisect.bisect_left(own, line, key=lambda f: f.line)
        return min(own[max(0, i - 1) : i + 1], key=lambda f: (abs(f.line - line), f.line))


def documentation_in(text: str, language: str, name: str, near: int | None) -> str | None:
    """Documentation the file has for the function ``name`` defined at about line ``near``."""
    f = Definitions(text, language).nearest(name, near)
    return documentation_of(f, text, language) if f else None


# ---- what a documentation says ----

_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?=\s|$|\*)|///?!?|//|#+(?=\s|$|!)|\"\"\"|'''|--)?\s?")
#: Words that say nothing about a function by themselves.
_EMPTY_WORDS = set(
    "a an the this that these those of for to in on at by with from and or is are be it its as will does do done done. given some any "
    "function functions method methods func fn def class object helper util utility routine procedure member operation wrapper implementation impl "
    "getter setter constructor destructor ctor accessor property property. stub autogenerated generated auto docstring doc docs documentation comment comments "
    "description describe pending missing here goes fill me add write text placeholder lorem ipsum dolor tbd tba todo fixme xxx wip hack none null nil void "
    "value values result results return returns returned param params parameter parameters arg args argument arguments input output data thing things "
    "inherited inherit inheritdoc inherits override overrides overridden deprecated internal private public static async see above below base parent super same "
    "before previous again non-javadoc non javadoc self cls int str string float number bool boolean list dict any unknown object array section type types "
    "used use uses up out "
    "raises yields example examples note notes throws errors panics safety der die das ein eine el la los las un una le les des de".split()
)
#: Words for what functions work on; beside a word that is new they say what is done to what.
_THINGS = set("data value values result results input output list string number array object section type types class function method property".split())
#: Scripts written without spaces between words: their words are counted by pairs of characters.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")
_TOOL = re.compile(
    r"^\W*(?:noqa\b|nosec\b|pragma\b|pylint\s*:|type\s*:\s*ignore|mypy\s*:|pyright\s*:|flake8\s*:|ruff\s*:|fmt\s*:|yapf\s*:|isort\s*:|coding\s*[:=]|-\*-|vim?\s*:|eslint\b|tslint\b|jshint\b|jslint\b|prettier-ignore|"
    r"istanbul\b|c8\b\s+ignore|v8\b\s+ignore|@ts-|ts-ignore|nolint\b|go:[a-z]|\+build\b|lint:|clippy::|rustfmt|region\b|endregion\b|sourcemappingurl|codecov|nocover|no\s*cover\b|stylelint|biome-ignore|deno-)",
    re.I,
)
_LEGAL = re.compile(
    r"^\W*(?:copyright\b|\(c\)|©|spdx\b|licen[cs]e\b|licen[cs]ed under|all rights reserved|distributed under|author\s*s?\b\s*[:=]?|@author|written by|created (?:on|by|at)\b|creator\b|maintainer|@?since\b|@?version\b|@?date\b|modified (?:on|by)\b|last (?:modified|changed|updated|edited)\b|@copyright|@license|owner\s*:)",
    re.I,
)
_PLACE = re.compile(r"^\W*(?:to\s?-?do|fixme|xxx|tbd|tba|wip|hack)\b(?:\s*\([^)]*\))?\s*[:\-]?\s*", re.I)
_POINTER = re.compile(
    r"^\W*(?:\{?@?inherit-?doc\}?|(?:please\s+)?(?:see|cf|refer to|compare)\b.*|same as (?:above|before|below|the [\w\s]{1,40})|(?:like|as) (?:above|before|below)|inherited(?: from .*)?|overrides? .{0,40}|implements .{0,40}|ditto|as the name says|self[- ]explanatory|non-javadoc|@see\b.*|@link\b.*|everything about .* lives .*|deprecated(?: in favou?r of .*|[,;:]? use .*)?|moved to .*)\W*$",
    re.I,
)
_CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:let|const|var|return|import|from|print|console\.|if\s*\(|for\s*\(|while\s*\(|fn |def |func |function |self\.|this\.)[^.]*[()=\[\];:{}]|^\s*[\w.\[\]]+\s*(?:[-+*/|&]?=(?!=)|:=)\s*\S+|^\s*[\w.]+\([^()]*\)\s*;?\s*$|^\s*(?:return\s+[\w.]+\(.*\)|end|pass|break|continue)\s*$"
)
_TAG = re.compile(r"^\s*(?:[@:\\](?P<tag>\w+)\b:?\s*)(?P<rest>.*)$")
_SECTION = re.compile(r"^\s*#*\s*(?:args|arguments|parameters|params|returns?|return value|raises|throws|yields|errors|panics|safety|examples?|notes?|attributes|keyword args|argumentos|parámetros|devuelve|paramètres|retourne|parameter|rückgabe)\s*:?\s*$", re.I)
_ITEM = re.compile(r"^\s*[-*]?\s*(?P<name>[\w*.]+)\s*(?:\((?P<type>[^)]*)\))?\s*(?::\s*(?P<rest>.*))?$")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def split_name(name: str) -> set[str]:
    return {x.lower() for x in _CAMEL.findall(name)} | {name.lower()}


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ies", "ing", "es", "ed", "s", "e"):
        if len(w) - len(end) >= 3 and w.endswith(end):
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] in "iy":
        w = w[:-1]
    return w[:-1] if len(w) > 4 and w[-1] == w[-2] else w


def clean(text: str) -> list[str]:
    """The lines of a documentation without comment marks."""
    body = text.strip()
    body = re.sub(r"^(?:[rRuUbB]{0,2})(\"\"\"|''')([\s\S]*?)\1$", r"\2", body)
    out = []
    for x in body.split("\n"):
        x = _MARKS.sub("", x.rstrip(), count=1)
        x = re.sub(r"\s*\*+/\s*$|\s*(?:\"\"\"|''')\s*$", "", x)
        out.append(re.sub(r"</?[A-Za-z][^<>]*>", "", x).rstrip())
    return out


def says_something(text: str | None, name: str, signature: str | None = None) -> bool:
    """Whether a documentation tells what a function does, needs or returns, beyond its name and parameter names."""
    if not text or not text.strip():
        return False
    known = {_stem(w) for w in split_name(name)}
    if signature:
        inside = signature[signature.find("(") :] if "(" in signature else signature
        known |= {_stem(w) for x in re.findall(r"\w+", inside) for w in split_name(x)}
    news: set[str] = set()
    things: set[str] = set()
    listed = False
    for raw in clean(text):
        x = raw.strip()
        if not x or not any(ch.isalpha() for ch in x):
            continue
        own: set[str] = set()
        if _SECTION.match(x):
            listed = True
            continue
        if _TOOL.match(x) or _LEGAL.match(x):
            continue
        if re.match(r"^([-=~#*_+.<>])\1{2,}.*", x) and re.search(r"([-=~#*_+.<>])\1{2,}\s*$", x):
            continue  # a divider with a title
        m = _TAG.match(x)
        if m:
            tag, x = m.group("tag").lower(), re.sub(r"^\{[^}]*\}\s*", "", m.group("rest").strip())
            if tag in ("param", "arg", "argument", "parameter", "throws", "raises", "exception", "type", "property", "tparam", "typeparam"):
                x = re.sub(r"^[\w.\[\]$]+\s*[:\-–]?\s*", "", x)
            elif tag in ("see", "link", "author", "since", "version", "date", "license", "copyright", "override", "ts", "inheritdoc"):
                continue
            if not x:
                continue
        else:
            m = _ITEM.match(x)
            if m and (m.group("rest") is not None) and len(m.group("name")) < 40 and (_stem(m.group("name")) in known or listed):
                x = m.group("rest") or ""
                own = {_stem(w) for w in split_name(m.group("name"))}  # an item of a list of parameters may repeat its name
        for part in re.split(r"(?<=[.!?;])\s+", x):
            if _TOOL.match(part) or _LEGAL.match(part):
                continue
            place = _PLACE.match(part)
            if place and place.group(0).strip():
                continue
            if _POINTER.match(part) or _CODE.search(part):
                continue
            for run in _UNSPACED.findall(part):
                news.update(a + b for a, b in zip(run, run[1:]) if a + b not in known)
            for w in _WORD.findall(_UNSPACED.sub(" ", part)):
                low = w.lower()
                if low in _THINGS and _stem(low) not in known:
                    things.add(low)
                if low in _EMPTY_WORDS or low.isdigit() or len(low) < 2:
                    continue
                if _stem(low) in known or _stem(low) in own or all(_stem(p) in known for p in split_name(w) if p != low) and len(split_name(w)) > 1:
                    continue
                news.add(low)
    return len(news) >= 2 or (len(news) == 1 and len(things) > 0)


_COLS = ["project", "id", "name", "node_type", "file_path", "line_start", "line_end", "signature", "docstring"]
_PAIR = (
    "project string, id string, name string, language string, file_path string, signature string, description string, origin string, "
    "code string, line_start int, line_end int"
)
_NAMES = [x.split()[0] for x in _PAIR.split(", ")]

FILE_FUNCTIONS = 5_000  # functions of a file that one row carries; a file named by more gets several rows


def _language(path: str | None) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def _paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for project, path, functions, content in zip(pdf["project"], pdf["file_path"], pdf["functions"], pdf["content"]):
            language = _language(path)
            text = content.replace("\r\n", "\n").replace("\r", "\n") if language and content is not None else None
            known = Definitions(text, language) if text is not None else None
            for r in functions:
                name = r["name"] or r["id"].split("::")[-1].split(".")[-1]
                f = known.nearest(name, r["line_start"]) if known else None
                doc, origin = r["docstring"], "docstring"
                if (doc is None or not doc.strip()) and f:
                    doc, origin = documentation_of(f, text, language), "file"
                if says_something(doc, name, r["signature"]):
                    source = (text[f.start : f.end], f.top, f.last) if f else (None, None, None)
                    rows.append((project, r["id"], name, language, path, r["signature"], "\n".join(clean(doc)).strip(), origin, *source))
        out = pd.DataFrame(rows, columns=_NAMES)
        yield out.astype({"line_start": "Int32", "line_end": "Int32"})


def current_functions(nodes: DataFrame) -> DataFrame:
    cols = ["deleted_at", "node_type", "name", "file_path", "line_start", "line_end", "signature", "docstring"]
    now = current_rows(nodes.where(F.col("node_type").isin("function", "method")), ["project", "id"], cols)
    return now.where(F.col("deleted_at").isNull()).select(*_COLS)


def pairs(nodes: DataFrame, files: DataFrame, file_functions: int = FILE_FUNCTIONS) -> DataFrame:
    """``project, id, name, language, file_path, signature, description, origin, code, line_start, line_end`` of every
    documented function. ``code`` is its exact source with decorators, ``line_start`` and ``line_end`` the lines of that.
    """
    ship(nodes.sparkSession)
    by = ["project", "file_path"]
    functions = current_functions(nodes).withColumn("file_path", F.coalesce("file_path", F.split("id", "::").getItem(0)))
    crowded = functions.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(file_functions)).alias("_rows")).where("_rows > 1")
    part = F.pmod(F.xxhash64("id"), F.coalesce("_rows", F.lit(1))).alias("_part")
    listed = (
        functions.join(crowded, by, "left")
        .groupBy(*by, part)
        .agg(F.collect_list(F.struct("id", "name", "signature", "line_start", "docstring")).alias("functions"))
    )
    newest = (
        files.where(F.col("project").isNotNull() & F.col("file_path").isNotNull())
        .groupBy(*by)
        .agg(F.max(F.struct("indexed_at", "content")).getField("content").alias("content"))
    )
    return listed.join(newest, by, "left").select(*by, "functions", "content").mapInPandas(_paired, _PAIR)


def found(nodes: DataFrame, files: DataFrame) -> DataFrame:
    return pairs(nodes, files).select("project", "id")
