"""Parsers: source text to nodes, edges and resolver facts, in Arrow batches.

Python is read by its standard syntax tree. The brace languages are read into a tree of brackets and definitions
(``trees``, ``outline``): modules, types, functions, methods, imports, bases, fields, local names and dotted calls. Parsers are looked up
by suffix in a registry that users may extend. A file that fails gives no rows: its stored nodes are kept (a failure is
no deletion), and it is listed by ``failures``.
"""

from __future__ import annotations

import ast
import bisect
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovework.runtime import ship
from grovework.sources import outline, trees

ROWS = (
    "project string, record string, id string, name string, node_type string, file_path string, line_start int, line_end int, signature string, "
    "docstring string, parent_id string, edge_type string, target string, ordinal int, facts string"
)
NAMES = [x.strip().split()[0] for x in ROWS.split(",")]
Parser = Callable[[str, str], list[dict]]


def node(id: str, name: str, kind: str, path: str, start: int, end: int, signature: str = "", doc: str = "", parent: str | None = None) -> dict:
    return {"record": "node", "id": id, "name": name, "node_type": kind, "file_path": path, "line_start": start, "line_end": end, "signature": signature, "docstring": doc, "parent_id": parent}


def edge(source: str, kind: str, target: str, ordinal: int = 0) -> dict:
    return {"record": "edge", "id": source, "edge_type": kind, "target": target, "ordinal": ordinal}


def _dotted(n: ast.AST) -> str:
    """A name or attribute chain; below a call only the attribute itself."""
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute):
        base = _dotted(n.value) if isinstance(n.value, (ast.Name, ast.Attribute)) else ""
        return f"{base}.{n.attr}" if base else n.attr
    return ""


def python_file(text: str, path: str) -> list[dict]:
    tree = ast.parse(text)
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out = [node(path, stem, "module", path, 1, max(1, text.count("\n") + 1), "", ast.get_docstring(tree) or "")]
    imports: dict[str, str] = {}
    shadows: dict[str, list[str]] = {}
    n = 0

    def calls(source: str, body: list) -> None:
        nonlocal n
        for stmt in body:
            for x in ast.walk(stmt):
                if isinstance(x, ast.Call) and (callee := _dotted(x.func)):
                    n += 1
                    out.append(edge(source, "CALLS", callee, n))

    def function(f, parent: str, prefix: str, kind: str) -> None:
        own = f"{prefix}{f.name}"
        for d in f.decorator_list:
            if isinstance(d, ast.Attribute) and d.attr in ("setter", "deleter"):
                own += f".{d.attr}"
        head = "async def" if isinstance(f, ast.AsyncFunctionDef) else "def"
        returns = f" -> {ast.unparse(f.returns)}" if f.returns else ""
        out.append(node(own, f.name, kind, path, f.lineno, f.end_lineno or f.lineno, f"{head} {f.name}({ast.unparse(f.args)}){returns}", ast.get_docstring(f) or "", parent))
        out.append(edge(parent, "CONTAINS", own))
        a = f.args
        names = {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]}
        names |= {x.id for s in f.body for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
        names |= {x.name for s in f.body for x in ast.walk(s) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
        shadows[own] = sorted(names - {"self", "cls"})
        calls(own, f.body)

    rest = []
    for s in tree.body:
        if isinstance(s, ast.Import):
            for a in s.names:
                imports[a.asname or a.name.split(".")[0]] = a.name
                out.append(edge(path, "IMPORTS", a.name))
        elif isinstance(s, ast.ImportFrom):
            base = "." * s.level + (s.module or "")
            for a in s.names:
                target = base if a.name == "*" else f"{base}.{a.name}" if base.strip(".") else f"{base}{a.name}"
                if a.name != "*":
                    imports[a.asname or a.name] = target
                out.append(edge(path, "IMPORTS", target))
        elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(s, path, f"{path}::", "function")
        elif isinstance(s, ast.ClassDef):
            own = f"{path}::{s.name}"
            bases = ", ".join(ast.unparse(b) for b in s.bases)
            out.append(node(own, s.name, "class", path, s.lineno, s.end_lineno or s.lineno, f"class {s.name}({bases})" if bases else f"class {s.name}", ast.get_docstring(s) or "", path))
            out.append(edge(path, "CONTAINS", own))
            out += [edge(own, "INHERITS", b) for x in s.bases if (b := _dotted(x))]
            for m in s.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(m, own, f"{own}.", "method")
        else:
            rest.append(s)
    calls(path, rest)
    out.append({"record": "fact", "id": path, "file_path": path, "facts": json.dumps({"imports": imports, "local_names": shadows})})
    return out


def _comment_before(text: str, at: int) -> str:
    """The comment that ends on the line before offset ``at``, without its marks."""
    lines = text[: text.rfind("\n", 0, at) + 1].split("\n")[:-1]
    out: list[str] = []
    j = len(lines) - 1
    while j >= 0 and re.match(r"\s*(//|\*|/\*)", lines[j]):
        out.append(re.sub(r"^\s*(/\*\*?|\*/|\*|///?!?)\s?|\s*\*/\s*$", "", lines[j]))
        j -= 1
    return "\n".join(x for x in reversed(out) if x.strip()).strip()


def brace_file(text: str, path: str, language: str) -> list[dict]:
    """Nodes, edges and facts of a JavaScript, TypeScript, Go or Rust file, from its bracket tree.

    Functions within functions are no nodes; their calls belong to the outer one.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    tree = trees.bracket_tree(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect.bisect_right(starts, at)
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out = [node(path, stem, "module", path, 1, max(1, text.count("\n") + 1), "", "")]
    found = trees.functions_of(text, language, tree)
    ecma = language in ("javascript", "typescript")
    functions, reach = [], -1
    for f in found:  # in the order they begin
        if f.start >= reach:
            functions.append(f)
            reach = f.end
    bodies = {f.body.at for f in found if isinstance(f.body, trees.Group)}
    types = outline.ecma_types(tree, bodies) if ecma else outline.go_types(tree) if language == "go" else outline.rust_types(tree)
    head_of = lambda f: " ".join(text[f.head : f.body.at if isinstance(f.body, trees.Group) else f.end].split()).rstrip("{=> ").rstrip()
    imports: dict[str, str] = {}
    for spec, bound in outline.imports_of(tree, language, text):
        out.append(edge(path, "IMPORTS", spec))
        imports |= bound
    fields: dict[str, dict[str, str]] = {}
    known: set[str] = set()
    for t in types:
        own = f"{path}::{t.name}"
        if t.kind != "impl" and own not in known:
            known.add(own)
            signature = " ".join(text[t.head : t.body.at if t.body else t.end].split()).rstrip(";")
            out.append(node(own, t.name, t.kind, path, line(t.head), line(max(t.head, t.end - 1)), signature, _comment_before(text, t.start), path))
            out.append(edge(path, "CONTAINS", own))
        out += [edge(own, "INHERITS", b) for b in t.bases] + [edge(own, "IMPLEMENTS", b) for b in t.interfaces]
        if t.fields:
            fields[t.name] = t.fields
    receivers: dict[str, str] = {}
    shadows: dict[str, list[str]] = {}
    spans: list[tuple[int, int, str]] = []
    for f in functions:
        owner = next((t for t in types if t.body and t.body.at < f.start < t.end), None)
        if language == "go" and owner is not None:
            continue  # methods an interface asks for
        if f.receiver:
            own, parent, kind = f"{path}::{f.receiver[1]}.{f.name}", path, "method"
            receivers[own] = f.receiver[0]
        elif owner is not None:
            own, parent, kind = f"{path}::{owner.name}.{f.name}", f"{path}::{owner.name}", "method"
        else:
            own, parent, kind = f"{path}::{f.name}", path, "function"
        if ecma and owner is not None and owner.kind == "interface":
            continue
        out.append(node(own, f.name, kind, path, f.line, f.last, head_of(f), _comment_before(text, f.start), parent))
        out.append(edge(parent, "CONTAINS", own))
        spans.append((f.start, f.end, own))
        if language != "rust":
            shadows[own] = outline.local_names(f.params, f.body, language)
    own_lists = {f.params.at for f in found if isinstance(f.params, trees.Group)}
    inside = [t for t in types if t.kind in ("class", "interface", "impl", "trait", "enum")]
    begins = [a for a, _, _ in spans]
    for n, (at, callee) in enumerate(outline.calls_of(tree, own_lists, language), 1):
        k = bisect.bisect_right(begins, at) - 1
        if k >= 0 and at < spans[k][1]:
            out.append(edge(spans[k][2], "CALLS", callee, n))
        elif not any(t.start <= at < t.end for t in inside):
            out.append(edge(path, "CALLS", callee, n))
    facts = {"imports": imports, "receiver_names": receivers, "local_names": shadows, "struct_fields": fields}
    out.append({"record": "fact", "id": path, "file_path": path, "facts": json.dumps(facts)})
    return out


def document_file(text: str, path: str) -> list[dict]:
    return [node(path, path.rsplit("/", 1)[-1], "document", path, 1, max(1, len(text.splitlines())))]


def model_file(generate: Callable[[str], str], most: int = 8000) -> Parser:
    """A parser that asks a text generator for the nodes and edges of a file, as JSON (a fence around it is removed).

    The reply is an object with ``nodes`` (id, name, node_type, line_start, line_end) and ``edges`` (source, edge_type,
    target); entries that lack these are left out, and anything else is a failure. Only the first ``most`` characters are
    sent.
    """

    def parse_file(text: str, path: str) -> list[dict]:
        reply = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", generate(text[:most]))
        found = json.loads(reply)
        if not isinstance(found, dict):
            raise ValueError("the reply is no object")
        out = []
        for n in found.get("nodes") or []:
            if isinstance(n, dict) and n.get("id") and n.get("node_type"):
                out.append(node(str(n["id"]), str(n.get("name") or n["id"]), str(n["node_type"]), path, int(n.get("line_start") or 1), int(n.get("line_end") or n.get("line_start") or 1), str(n.get("signature") or ""), str(n.get("docstring") or ""), n.get("parent_id")))
        for e in found.get("edges") or []:
            if isinstance(e, dict) and e.get("source") and e.get("edge_type") and e.get("target"):
                out.append(edge(str(e["source"]), str(e["edge_type"]), str(e["target"]), len(out)))
        return out

    return parse_file


def with_fallback(first: Parser, second: Parser) -> Parser:
    """``first``, and for files on which it fails ``second``."""

    def parse_file(text: str, path: str) -> list[dict]:
        try:
            return first(text, path)
        except (SyntaxError, ValueError, RecursionError):
            return second(text, path)

    return parse_file


REGISTRY: dict[str, Parser] = {".py": python_file}
REGISTRY |= {s: document_file for s in (".md", ".rst", ".txt")}
REGISTRY |= {s: (lambda t, p: brace_file(t, p, "javascript")) for s in (".js", ".jsx")}
REGISTRY |= {s: (lambda t, p: brace_file(t, p, "typescript")) for s in (".ts", ".tsx")}
REGISTRY |= {".go": lambda t, p: brace_file(t, p, "go"), ".rs": lambda t, p: brace_file(t, p, "rust")}


def register(suffix: str, parser: Parser) -> None:
    """Add a parser of files with ``suffix``: a function of text and path that returns rows like ``node`` and ``edge``."""
    REGISTRY[suffix] = parser


def parse(files: DataFrame) -> DataFrame:
    """Tagged rows (``record`` node, edge, fact or failure) of files (project, file_path, content)."""
    ship(files.sparkSession)
    registry = dict(REGISTRY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for project, path, text in zip(pdf["project"], pdf["file_path"], pdf["content"]):
                parser = registry.get("." + path.rsplit(".", 1)[-1]) if "." in path else None
                if parser is None or text is None:
                    continue
                try:
                    if "\0" in text:
                        raise ValueError("NUL")
                    found = parser(text, path)
                except (SyntaxError, ValueError, RecursionError) as e:
                    found = [{"record": "failure", "id": path, "file_path": path, "facts": str(e)[:200]}]
                rows += [(project, *[r.get(c) for c in NAMES[1:]]) for r in found]
            out = pd.DataFrame(rows, columns=NAMES)
            for c in ("line_start", "line_end", "ordinal"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.where(F.col("file_path").isNotNull()).select("project", "file_path", "content").mapInPandas(run, ROWS)


def parsed_nodes(rows: DataFrame) -> DataFrame:
    cols = ["project", "id", "name", "node_type", "file_path", "line_start", "line_end", "signature", "docstring", "parent_id"]
    return rows.where("record = 'node'").select(*cols).dropDuplicates(["project", "id"])


def parsed_edges(rows: DataFrame) -> DataFrame:
    return rows.where("record = 'edge'").select("project", F.col("id").alias("source"), "edge_type", "target", "ordinal")


def parsed_facts(rows: DataFrame) -> DataFrame:
    schema = "imports map<string,string>, local_names map<string,array<string>>, receiver_names map<string,string>, struct_fields map<string,map<string,string>>"
    return rows.where("record = 'fact'").select("project", "file_path", F.from_json("facts", schema).alias("f")).select("project", "file_path", "f.*")


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("record = 'failure'").select("project", "file_path", F.col("facts").alias("reason"))
