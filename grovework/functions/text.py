"""String functions of paths, names and previews, as Spark columns (no Python workers)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix to language.
LANGUAGE_BY_SUFFIX = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "php": "php", "sh": "shell",
    "md": "markdown", "rst": "restructuredtext", "txt": "text", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css", "sql": "sql",
}
QUERY_METACHARACTERS = r"""[+\-!(){}\[\]^"~*?:\\/&|<>=@#$%;,.'`]"""


def glob_regex(pattern: str) -> str:
    """A whole-string regular expression of an fnmatch pattern: ``*`` crosses ``/``, ``[!x]`` negates."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 if pattern[i : i + 1] != "!" else i + 2)
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[i:end].replace("\\", "\\\\").replace("]", "\\]").replace("[", "\\[")
                body = "^" + body[1:] if body.startswith("!") else ("\\" + body if body.startswith("^") else body)
                out.append(f"[{body}]")
                i = end + 1
        else:
            out.append(re.escape(c))
    return r"(?s)^" + "".join(out) + "$"


def normal_path(path: Column) -> Column:
    """A path with leading ``.`` and ``/`` characters removed and forward slashes only."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[./]+", "")


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs; a pattern ``**/x`` also matches ``x`` at the top."""
    found = F.lit(False)
    for p in patterns:
        p = p.replace("\\", "/").lstrip("./")
        found = found | path.rlike(glob_regex(p))
        if p.startswith("**/"):
            found = found | path.rlike(glob_regex(p[3:]))
    return found


def path_allowed(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Path filter: ``include`` None lets all pass, an empty list none; ``exclude`` wins. A null path never passes a filter."""
    p = normal_path(path)
    ok = F.lit(True) if include is None else matches_any(p, include) if include else F.lit(False)
    return F.coalesce(ok & ~matches_any(p, exclude) if exclude else ok, F.lit(False))


def _like(rx: str):
    return lambda x: x.rlike(rx)


def scan_match(path: Column, patterns: list[str]) -> Column:
    """Scan pattern: equal, below a folder, a glob on the path, on the base name, or on any component."""
    parts = F.split(path, "/")
    found = F.lit(False)
    for p in patterns:
        p = p.strip().lstrip("./").rstrip("/")
        rx = glob_regex(p)
        found = found | (path == p) | path.startswith(p + "/") | path.rlike(rx) | F.exists(parts, _like(rx))
    return found


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column, default: str | None = "other") -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_SUFFIX.items() for x in kv])
    return F.coalesce(F.element_at(table, suffix(path)), F.lit(default))


def sanitize_query(query: str) -> str:
    """Search text without the metacharacters of query syntax, white space collapsed."""
    return " ".join(re.sub(QUERY_METACHARACTERS, " ", query).split())


def preview(text: Column, n: int = 200) -> Column:
    """The first ``n`` characters without trailing white space and an ellipsis, or the text if it is not longer."""
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n), r"\s+$", ""), F.lit("…"))).otherwise(text)


def trimmed(text: Column, limit: int) -> Column:
    """At most ``limit`` characters with the ellipsis; an empty text becomes null."""
    short = F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"\s+$", ""), F.lit("…"))
    return F.when(text == "", None).when(F.length(text) > limit, short).otherwise(text)


def display_name(project: Column) -> Column:
    """A project's id without its last ``_hash``."""
    return F.regexp_replace(project, r"_[^_]*$", "")


def root_matches(project: Column, root_path: Column) -> Column:
    """Whether a project's id ends in the first eight hex digits of the MD5 of its root path."""
    return F.element_at(F.split(project, "_"), -1) == F.substring(F.md5(root_path), 1, 8)


def external_root(spec: Column, language: Column) -> Column:
    """The package an import belongs to: npm scope and name, Go host/owner/name, else the first dotted segment."""
    parts = F.split(spec, "/")
    scoped = F.concat_ws("/", F.slice(parts, 1, 2))
    npm = F.when(spec.startswith("@"), scoped).otherwise(F.get(parts, F.lit(0)))
    go = F.when(F.get(parts, F.lit(0)).contains("."), F.concat_ws("/", F.slice(parts, 1, 3))).otherwise(F.get(parts, F.lit(0)))
    other = F.get(F.split(F.get(F.split(spec, "::"), F.lit(0)), r"\."), F.lit(0))
    return F.when(language.isin("javascript", "typescript"), npm).when(language == "go", go).otherwise(other)


def chunk_id(node_id: Column, path: Column, start: Column, end: Column, kind: Column, content: Column) -> Column:
    """Content-derived id: ``chunk:`` and 16 hex digits of SHA-256 over the NUL-joined parts."""
    joined = F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("")) for c in (node_id, path, start, end, kind, content)])
    return F.concat(F.lit("chunk:"), F.substring(F.sha2(joined, 256), 1, 16))


def source_hash(source: Column, signature: Column, docstring: Column) -> Column:
    """Input hash of a leaf: SHA-256 over source, signature and docstring."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in (source, signature, docstring)]), 256)


def container_hash(lines: Column) -> Column:
    """Input hash of a container: SHA-256 over its ordered child lines."""
    return F.sha2(F.array_join(lines, "\n"), 256)
