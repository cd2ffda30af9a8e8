"""Syntax trees of source files, as far as definitions go: which functions there are, where they begin and end.

Python files go through the standard syntax tree. Files of the brace languages are read by the lexers of ``lexers`` into
a tree of brackets; a visitor for each language then walks it with the rules of its definitions: declarations, methods
of classes, interfaces, traits and object literals, functions bound to a name, nested ones included. A call, a control
statement or a macro is no definition. Brackets that do not match end where the next outer one ends, so that a damaged
file still has a tree; a line that cannot be split into tokens is left out of it.
"""

from __future__ import annotations

import ast
import bisect
import re

from grovework.sources import lexers


class Function:
    """A function node: name, line of its definition, offsets with decorators and attributes, own docstring."""

    __slots__ = ("name", "start", "head", "end", "line", "top", "last", "doc", "params", "receiver", "body")

    def __init__(self, name: str, start: int, head: int, end: int, doc: str | None = None, params=None, receiver: tuple[str, str] | None = None, body=None) -> None:
        self.name, self.start, self.head, self.end, self.doc, self.params, self.receiver, self.body = name, start, head, end, doc, params, receiver, body
        self.line = self.top = self.last = 0


class Leaf:
    __slots__ = ("s", "kind", "at", "end", "fresh")

    def __init__(self, s: str, kind: str, at: int, fresh: bool) -> None:
        self.s, self.kind, self.at, self.end, self.fresh = s, kind, at, at + len(s), fresh


class Group:
    """What stands between two brackets."""

    __slots__ = ("s", "at", "end", "fresh", "items", "kind")

    def __init__(self, s: str, at: int, fresh: bool) -> None:
        self.s, self.at, self.end, self.fresh, self.items, self.kind = s, at, at, fresh, [], "group"


_CLOSES = {")": "(", "]": "[", "}": "{"}
_CONTROL = {"if", "while", "for", "with", "switch", "catch"}


def _stream(text: str, language: str, start: int):
    if language == "go":
        return lexers.go_tokens(text, start)
    if language == "rust":
        return lexers.rust_tokens(text, start)
    state = ["", []]  # the last token, and for each open parenthesis whether a control word is before it

    def accepts(_: tuple) -> bool:
        return state[0] in (")", "]", "}", "word")

    def tokens():
        for t in lexers.ecma_tokens(text, accepts, start):
            classes, s = t[0], t[3]
            if s == "(" and classes[0] == "(":
                state[1].append(state[0] in _CONTROL)
            yield t
            if s == ")" and classes[0] == ")":
                state[0] = "control" if state[1] and state[1].pop() else ")"
            elif "ID" in classes or classes[0] in ("this", "super", "NUMBER", "STRING", "TEMPLATE", "TTAIL", "REGEX", "PRIVATE", "null", "true", "false"):
                state[0] = "word"
            else:
                state[0] = s

    return tokens()


def _place(open_: list[Group], classes: tuple, fresh: bool, at: int, s: str) -> None:
    kind = classes[0]
    if kind in ("(", "[", "{", "THEAD"):
        g = Group("`" if kind == "THEAD" else s, at, fresh)
        open_[-1].items.append(g)
        open_.append(g)
    elif kind in _CLOSES or kind == "TTAIL":
        want = "`" if kind == "TTAIL" else _CLOSES[kind]
        while any(g.s == want for g in open_[1:]):
            g = open_.pop()
            g.end = at + len(s)
            if g.s == want:
                break
    elif kind != "TMIDDLE":
        open_[-1].items.append(Leaf(s, "ID" if "ID" in classes else kind, at, fresh))


def bracket_tree(text: str, language: str) -> Group:
    """The tokens of a file by brackets; the root has no bracket."""
    root = Group("", 0, False)
    open_, start = [root], 0
    while start < len(text):
        try:
            for token in _stream(text, language, start):
                _place(open_, *token)
            break
        except lexers.Broken as e:  # on behind the line that cannot be read
            start = text.find("\n", max(e.at, start)) + 1 or len(text)
    for g in open_:
        g.end = len(text)
    return root


def _is(x, *words: str) -> bool:
    return isinstance(x, Leaf) and x.s in words and x.kind not in ("STRING", "CHAR", "TEMPLATE")


def _group(x, s: str) -> bool:
    return isinstance(x, Group) and x.s == s


def _name(x) -> bool:
    return isinstance(x, Leaf) and (x.kind == "ID" or (x.s[:1].isalpha() or x.s[:1] in "_$#") and x.kind not in ("STRING", "CHAR", "NUMBER", "TEMPLATE", "REGEX"))


def _past_angles(items: list, i: int) -> int:
    """The place after ``< ... >`` at ``i`` (or ``i``)."""
    if i >= len(items) or not _is(items[i], "<"):
        return i
    depth = 0
    for j in range(i, len(items)):
        x = items[j]
        if isinstance(x, Leaf):
            if x.s == "<":
                depth += 1
            elif x.s == ">":
                depth -= 1
            elif x.s == ">>":
                depth -= 2
            elif x.s == ";":
                return i
            if depth <= 0:
                return j + 1
    return i


class Ecma:
    """JavaScript and TypeScript."""

    _BEFORE_OBJECT = set("= ( , ? [ return yield await throw in of default + - * / % & | ^ ! ~ && || ?? += -= ... => == === != !== < > as satisfies typeof void new".split())
    _BEFORE_TYPE = {":", "|", "&", "=>", "<", ",", "is", "extends", "?", "=", "[", "("}
    _MODIFIERS = set("static public private protected readonly override abstract declare accessor async get set".split())
    _LEADING = set("export default declare const let var async abstract public private protected static readonly override".split())

    def __init__(self) -> None:
        self.found: list[Function] = []

    def body_after(self, items: list, i: int) -> tuple[int, Group | None]:
        """(place after, body) of a function whose parameter list ends before ``i``: a return type may come first."""
        if i < len(items) and _is(items[i], ":"):
            i += 1
            while i < len(items):
                x = items[i]
                if _group(x, "{") and not (isinstance(items[i - 1], Leaf) and items[i - 1].s in self._BEFORE_TYPE):
                    return i + 1, x
                if _is(x, ";", "=", "=>") and not (_is(x, "=>") and _group(items[i - 1], "(")):
                    break
                if x.fresh and not _is(x, "|", "&") and not (isinstance(items[i - 1], Leaf) and items[i - 1].s in self._BEFORE_TYPE):
                    break
                i += 1
            return i, None
        if i < len(items) and _group(items[i], "{"):
            return i + 1, items[i]
        return i, None

    def add(self, name: str, start: int, head: int, end: int, params=None, body=None) -> None:
        self.found.append(Function(name, start, head, end, params=params, body=body))

    def first_of(self, items: list, i: int) -> int:
        """The first token of the declaration whose word or name is at ``i``."""
        while i > 0 and (
            (isinstance(items[i - 1], Leaf) and items[i - 1].s in self._LEADING and not items[i].fresh)
            or (_is(items[i - 1], ".") and i > 1 and (_name(items[i - 2]) or isinstance(items[i - 2], Group)))
        ):
            i -= 2 if _is(items[i - 1], ".") else 1
        return i

    def decorated(self, items: list, i: int) -> int:
        """The first decorator before ``i``."""
        while True:
            j = i - 1
            if j >= 0 and _group(items[j], "("):
                j -= 1
            while j >= 1 and _name(items[j]) and _is(items[j - 1], "."):
                j -= 2
            if j >= 1 and (_name(items[j]) or _group(items[j], "(")) and _is(items[j - 1], "@"):
                i = j - 1
            else:
                return i

    def is_object(self, items: list, i: int, inside: str) -> bool:
        if i == 0:
            return inside in ("(", "[", "`")
        before = items[i - 1]
        if _is(before, ":"):
            for j in range(i - 2, -1, -1):
                if _is(items[j], "case", "default", "?"):
                    return items[j].s == "?"
                if _is(items[j], ";", "{", ",") or _group(items[j], "{"):
                    break
            return inside != "{" and inside != ""
        return isinstance(before, Leaf) and before.kind not in ("STRING", "NUMBER", "TEMPLATE", "REGEX") and before.s in self._BEFORE_OBJECT and before.s != "=>"

    def bound_name(self, items: list, i: int, low: int) -> tuple[str, int] | None:
        """(name, place of its declaration's first token) if the value that begins at ``i`` is given a name."""
        if i <= low or not _is(items[i - 1], "=", ":"):
            return None
        j = i - 2
        if _is(items[i - 1], "="):  # a type may stand between name and value
            k = j
            while k > low and not _is(items[k], ";", ",", "=", "{"):
                if _is(items[k], ":") and _name(items[k - 1]):
                    j = k - 1
                    break
                if items[k].fresh and k != j:
                    break
                k -= 1
        if j < low or not (_name(items[j]) or (isinstance(items[j], Leaf) and items[j].kind == "STRING")):
            return None
        return items[j].s.strip("'\""), self.first_of(items, j)

    def visit(self, group: Group) -> None:
        items, i = group.items, 0
        while i < len(items):
            i = self.one(items, i, group.s)

    def one(self, items: list, i: int, inside: str, low: int = 0) -> int:
        """Look at the item at ``i`` of statements or expressions; the place of the next one."""
        x = items[i]
        if isinstance(x, Group):
            if x.s == "{" and self.is_object(items, i, inside):
                self.members(x, False)
            else:
                self.visit(x)
            return i + 1
        after_dot = i > 0 and _is(items[i - 1], ".", "?.")
        if after_dot or x.kind in ("STRING", "TEMPLATE", "REGEX"):
            return i + 1
        if x.s == "function" and not (i + 1 < len(items) and _is(items[i + 1], ":", "=", ",")):
            return self.function(items, i, low)
        if x.s == "class" and x.kind != "ID":
            return self.class_(items, i)
        if x.s == "interface" and i + 1 < len(items) and _name(items[i + 1]):
            j = i + 2
            while j < len(items) and not _group(items[j], "{") and not _is(items[j], ";", "="):
                j += 1
            if j < len(items) and _group(items[j], "{"):
                self.members(items[j], True)
                return j + 1
            return i + 1
        if x.s == "=>":
            return self.arrow(items, i, low)
        return i + 1

    def function(self, items: list, i: int, low: int) -> int:
        j = i + 1
        if j < len(items) and _is(items[j], "*"):
            j += 1
        name = None
        if j < len(items) and _name(items[j]):
            name = items[j].s
            j += 1
        j = _past_angles(items, j)
        if j >= len(items) or not _group(items[j], "("):
            return i + 1
        params = items[j]
        self.visit(params)
        end = params.end
        j, body = self.body_after(items, j + 1)
        head = i - 1 if i > low and _is(items[i - 1], "async") else i
        bound = self.bound_name(items, head, low)
        start = self.first_of(items, head)
        if name is None and bound:
            name, start = bound
        end = body.end if body else items[j - 1].end if j > i else end
        if name is not None:
            at = self.decorated(items, start)
            self.add(name, items[at].at, items[start].at, end, params, body)
        if body:
            self.visit(body)
        return j

    def arrow(self, items: list, i: int, low: int) -> int:
        h = i - 1
        if h < low:
            return i + 1
        if not (_group(items[h], "(") or (_name(items[h]) and not (h > low and _is(items[h - 1], ":", ".", "|", "&", "is")))):
            k = h  # a return type: its colon follows the parameter list
            while k > low and not (_is(items[k], ":") and _group(items[k - 1], "(")):
                if _is(items[k], ";", "=", ","):
                    return i + 1
                k -= 1
            h = k - 1
        elif _name(items[h]) and h > low and _is(items[h - 1], ":"):
            h = max(low, h - 2)
        if h > low and _is(items[h - 1], ">"):
            k, depth = h - 1, 0
            while k > low:
                depth += (1 if _is(items[k], ">") else -1 if _is(items[k], "<") else 0) if isinstance(items[k], Leaf) else 0
                if not depth:
                    break
                k -= 1
            h = k
        if h > low and _is(items[h - 1], "async"):
            h -= 1
        bound = self.bound_name(items, h, low)
        j = i + 1
        if h > low and _is(items[h - 1], ":"):
            k = j  # the arrow of a type: a value follows after an equals sign
            while k < len(items) and not _is(items[k], ",", ";", "=") and not (items[k].fresh and self.ends_at(items, k)):
                k += 1
            if k < len(items) and _is(items[k], "="):
                return k
        if j < len(items) and _group(items[j], "{"):
            self.visit(items[j])
            end, j = items[j].end, j + 1
        else:
            begun = j
            while j < len(items) and not _is(items[j], ",", ";"):
                x = items[j]
                if j > begun and x.fresh and self.ends_at(items, j):
                    break
                j = max(j + 1, self.one(items, j, "=", begun))
            j = min(j, len(items))
            end = items[j - 1].end
        if bound:
            at = self.decorated(items, bound[1])
            params = next((x for x in items[h:i] if _group(x, "(")), items[i - 1])
            self.add(bound[0], items[at].at, items[bound[1]].at, end, params, items[i + 1] if i + 1 < len(items) else None)
        return j

    _GOES_ON = re.compile(r"[.?:=+\-*/%&|^<>,)\]]|&&|instanceof$|in$|as$")

    def ends_at(self, items: list, j: int) -> bool:
        """Whether the line break before ``j`` ends an expression."""
        before, x = items[j - 1], items[j]
        if isinstance(x, Leaf) and self._GOES_ON.match(x.s) and x.kind not in ("STRING", "TEMPLATE"):
            return False
        return not (isinstance(before, Leaf) and before.kind not in ("ID", "STRING", "NUMBER", "TEMPLATE", "REGEX") and self._GOES_ON.match(before.s))

    def class_(self, items: list, i: int) -> int:
        j = i + 1
        while j < len(items) and not (_group(items[j], "{") and not _is(items[j - 1], ",")):
            if _is(items[j], ";"):
                return i + 1
            if isinstance(items[j], Group):
                self.visit(items[j])
            j += 1
        if j < len(items):
            self.members(items[j], True)
            return j + 1
        return i + 1

    def members(self, group: Group, of_class: bool) -> None:
        """Members of a class or interface body, or of an object literal."""
        items, i = group.items, 0
        while i < len(items):
            begun = i
            while i < len(items) and _is(items[i], "@"):  # decorators
                i += 1
                if i < len(items) and _group(items[i], "("):
                    i += 1
                    continue
                while i < len(items) and (_name(items[i]) or _is(items[i], ".")):
                    if i + 1 < len(items) and _name(items[i]) and not _is(items[i + 1], "."):
                        i += 1
                        break
                    i += 1
                if i < len(items) and _group(items[i], "("):
                    self.visit(items[i])
                    i += 1
            head = i
            while i + 1 < len(items) and isinstance(items[i], Leaf) and items[i].s in self._MODIFIERS and not (_group(items[i + 1], "(") or _is(items[i + 1], "=", ":", ",", ";", "?", "!", "<")):
                i += 1
            if i < len(items) and _is(items[i], "*"):
                i += 1
            if i >= len(items):
                return
            x = items[i]
            if _is(x, ",", ";"):
                i += 1
                continue
            name = x.s.strip("'\"") if isinstance(x, Leaf) and (_name(x) or x.kind in ("STRING", "NUMBER", "PRIVATE")) else None
            if name is None and not _group(x, "["):
                i = self.one(items, i, group.s, begun)
                continue
            j = i + 1
            while j < len(items) and _is(items[j], "?", "!"):
                j += 1
            j = _past_angles(items, j)
            if j < len(items) and _group(items[j], "("):
                params = items[j]
                self.visit(params)
                end = params.end
                j, body = self.body_after(items, j + 1)
                if body or of_class:
                    if name is not None:
                        self.add(name, items[begun].at, items[head].at, body.end if body else max(end, items[j - 1].end), params, body)
                    if body:
                        self.visit(body)
                i = max(j, i + 1)
                continue
            # a property: on to its end
            i = j
            value = None
            while i < len(items) and not _is(items[i], ",", ";"):
                if of_class and i > j and items[i].fresh and self.ends_at(items, i):
                    break
                if value is None and _is(items[i], "=" if of_class else ":"):
                    value = i
                if of_class and value is None:  # the type of a field
                    i += 1
                else:
                    i = max(i + 1, self.one(items, i, "=" if value is not None else group.s, head))
            i = max(i, j)


class Go:
    def __init__(self) -> None:
        self.found: list[Function] = []

    def visit(self, group: Group) -> None:
        items, i = group.items, 0
        while i < len(items):
            x = items[i]
            if isinstance(x, Group):
                if x.s == "{" and i and _is(items[i - 1], "interface"):
                    self.methods(x)
                else:
                    self.visit(x)
            elif x.s == "func" and x.kind == "func":
                i = self.function(items, i, group.s == "" and (i == 0 or _is(items[i - 1], ";", "\n")))
                continue
            i += 1

    def function(self, items: list, i: int, declared: bool) -> int:
        j, name, receiver = i + 1, None, None
        if declared and j + 1 < len(items) and _group(items[j], "(") and _name(items[j + 1]):
            own = [x.s for x in items[j].items if isinstance(x, Leaf) and x.s != "*"]
            receiver = (own[0], own[1]) if len(own) > 1 else ("", own[0]) if own else None
            j += 1
        if declared and j < len(items) and _name(items[j]):
            name = items[j].s
            j += 1
            if j < len(items) and _group(items[j], "["):
                j += 1
        if j >= len(items) or not _group(items[j], "("):
            return i + 1
        params = items[j]
        self.visit(params)
        j, body = self.past_result(items, j + 1)
        if name:
            self.found.append(Function(name, items[i].at, items[i].at, body.end if body else items[j - 1].end, params=params, receiver=receiver, body=body))
        if body:
            self.visit(body)
        return max(j, i + 1)

    @staticmethod
    def past_result(items: list, j: int) -> tuple[int, Group | None]:
        while j < len(items) and not _is(items[j], ";", "\n", ",", "=", ":="):
            if _group(items[j], "{") and not _is(items[j - 1], "struct", "interface"):
                return j + 1, items[j]
            j += 1
        return j, None

    def methods(self, group: Group) -> None:
        items, i = group.items, 0
        while i + 1 < len(items):
            if _name(items[i]) and _group(items[i + 1], "(") and (i == 0 or _is(items[i - 1], ";", "\n")):
                j, _ = self.past_result(items, i + 2)
                self.found.append(Function(items[i].s, items[i].at, items[i].at, items[j - 1].end, params=items[i + 1]))
                i = j
            else:
                i += 1


class Rust:
    _BEFORE = {"pub", "const", "async", "unsafe", "extern", "default"}

    def __init__(self) -> None:
        self.found: list[Function] = []

    def visit(self, group: Group) -> None:
        items, i = group.items, 0
        while i < len(items):
            x = items[i]
            if isinstance(x, Group):
                macro = i and (_is(items[i - 1], "!") or (i > 1 and _name(items[i - 1]) and _is(items[i - 2], "!") and i > 2 and _is(items[i - 3], "macro_rules")))
                if not macro and not (i and _is(items[i - 1], "#")):
                    self.visit(x)
            elif x.s == "fn" and x.kind == "fn" and i + 1 < len(items) and _name(items[i + 1]):
                i = self.function(items, i)
                continue
            i += 1

    def function(self, items: list, i: int) -> int:
        j = _past_angles(items, i + 2)
        if j >= len(items) or not _group(items[j], "("):
            return i + 1
        params = items[j]
        j += 1
        while j < len(items) and not _group(items[j], "{") and not _is(items[j], ";"):
            j += 1
        body = items[j] if j < len(items) and isinstance(items[j], Group) else None
        head = i
        while head and ((isinstance(items[head - 1], Leaf) and (items[head - 1].s in self._BEFORE or items[head - 1].kind == "STRING")) or (_group(items[head - 1], "(") and head > 1 and _is(items[head - 2], "pub"))):
            head -= 1
        start = head
        while start > 1 and _group(items[start - 1], "[") and _is(items[start - 2], "#"):
            start -= 2
        last = items[min(j, len(items) - 1)]
        self.found.append(Function(items[i + 1].s, items[start].at, items[head].at, last.end, params=params, body=body))
        if body:
            self.visit(body)
        return j + 1


def _python(text: str, starts: list[int]) -> list[Function]:
    lines = text.split("\n")
    offset = lambda line, column: starts[line - 1] + len(lines[line - 1].encode()[:column].decode(errors="ignore"))
    out = []
    for n in ast.walk(ast.parse(text)):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            head = offset(n.lineno, n.col_offset)
            start = min([head, *(text.rfind("@", 0, offset(d.lineno, d.col_offset)) for d in n.decorator_list)])
            out.append(Function(n.name, start, head, offset(n.end_lineno, n.end_col_offset), ast.get_docstring(n)))
    return out


_PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", re.M)


def _python_damaged(text: str) -> list[Function]:
    """Definitions of a file without a syntax tree, by their first lines; a block ends at the next less indented line."""
    out = []
    for m in _PY_DEF.finditer(text):
        begun = m.start() + len(m.group()) - len(m.group().lstrip())
        indent, end = begun - m.start(), text.find("\n", begun)
        end = len(text) if end < 0 else end
        for x in re.finditer(r"\n([ \t]*)\S[^\n]*", text[end:]):
            if len(x.group(1)) <= indent:
                break
            stop = end + x.end()
        else:
            stop = len(text.rstrip())
        stop = max(end, locals().get("stop", end))
        start = begun
        while True:  # decorators
            line = text.rfind("\n", 0, max(0, text.rfind("\n", 0, start))) + 1
            above = text[line : max(line, text.rfind("\n", 0, start))]
            if line < start and above.lstrip().startswith("@"):
                start = line + len(above) - len(above.lstrip())
            else:
                break
        out.append(Function(m.group(1), start, begun, stop))
    return out


_VISITORS = {"javascript": Ecma, "typescript": Ecma, "go": Go, "rust": Rust}


def functions_of(text: str, language: str, tree: Group | None = None) -> list[Function]:
    """All function nodes of a file with their lines (from 1) and offsets, in the order they begin."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    if language == "python":
        try:
            found = _python(text, starts)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            found = _python_damaged(text)
    else:
        visitor = _VISITORS[language]()
        visitor.visit(tree or bracket_tree(text, language))
        found = visitor.found
    line = lambda at: bisect.bisect_right(starts, at)
    for f in found:
        f.line, f.top, f.last = line(f.head), line(f.start), line(max(f.start, f.end - 1))
    return sorted(found, key=lambda f: (f.head, f.end))
