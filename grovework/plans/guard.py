"""Read-only guard for ad-hoc graph queries: refuses anything but a scoped, unpaged read of one statement."""

from __future__ import annotations

import re

WRITES = re.compile(r"\b(?:create|merge|set|delete|detach|remove|drop|foreach)\b", re.I)
CALLS = re.compile(r"(?<![.\w])call\b", re.I)
LOADS = re.compile(r"(?<![.\w])load\b", re.I)
ADMIN = re.compile(r"(?<![.\w])(?:grant|revoke|deny|show|use|start|stop|alter|rename|terminate|analyze|dump|lock|unlock|explain|profile)\b", re.I)
PAGING = re.compile(r"\b(?:limit|skip)\b", re.I)
LEADING = re.compile(r"^\s*(?:optional\s+match|match|with|unwind)\b", re.I)
MATCH = re.compile(r"\bmatch\b(.*?)(?=\b(?:optional\s+match|match|where|with|return|unwind|order|union)\b|$)", re.I | re.S)
SCOPED = re.compile(r"\(\s*\w*\s*(?::\s*[\w|&:`]+\s*)?\{[^}]*\bproject\s*:\s*\$project\b[^}]*\}")


def blanked(query: str) -> str:
    """The query with comments, string literals and backticked names replaced by spaces of the same length."""
    out, i, n = list(query), 0, len(query)
    while i < n:
        c, two = query[i], query[i : i + 2]
        if two == "//":
            j = query.find("\n", i)
            j = n if j < 0 else j
        elif two == "/*":
            j = query.find("*/", i + 2)
            j = n if j < 0 else j + 2
        elif c in "'\"`":
            j = i + 1
            while j < n and query[j] != c:
                j += 2 if query[j] == "\\" and c != "`" else 1
            j = min(n, j + 1)
        else:
            i += 1
            continue
        for k in range(i, j):
            if out[k] != "\n":
                out[k] = " "
        i = j
    return "".join(out)


def parts(pattern: str) -> list[str]:
    """A pattern split at commas outside all brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(pattern):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
    return [p for p in [*out, pattern[start:]] if p.strip()]


def refusal(query: str) -> str | None:
    """Why a query is refused, or None. Words after a dot (``n.set``, ``n.limit``) are property names and pass."""
    text = blanked(query)
    words = re.sub(r"\.\s*\w+", lambda m: " " * len(m.group()), text)
    body = text.rstrip()
    if body.endswith(";"):
        body = body[:-1]
    if WRITES.search(words):
        return "write clauses are not allowed"
    if CALLS.search(words):
        return "procedure calls are not allowed"
    if LOADS.search(words):
        return "loading data is not allowed"
    if ADMIN.search(words):
        return "administrative statements are not allowed"
    if PAGING.search(words):
        return "use the limit and offset arguments"
    if not LEADING.match(body):
        return "a query must begin with MATCH, OPTIONAL MATCH, WITH or UNWIND"
    if ";" in body:
        return "only one statement is allowed"
    found = MATCH.findall(body)
    if not found:
        return "a query needs a MATCH"
    if not all(SCOPED.search(p) for m in found for p in parts(m)):
        return "every pattern needs a node scoped by {project: $project}"
    return None
