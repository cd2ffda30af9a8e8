"""Types, imports, calls and local names of a file of a brace language, from its bracket tree (``trees``)."""

from __future__ import annotations

from grovework.sources.trees import Group, Leaf, _group, _is, _name, _past_angles

#: Words before a parenthesis that call nothing.
NOT_CALLED = set("if for while switch catch return function func fn match loop typeof await go defer select case else do throw in of and or not super constructor void delete yield import type var const package struct interface map chan macro_rules".split())


class Type:
    __slots__ = ("name", "kind", "start", "head", "end", "bases", "interfaces", "body", "fields")

    def __init__(self, name: str, kind: str, start: int, head: int, end: int, body: Group | None) -> None:
        self.name, self.kind, self.start, self.head, self.end, self.body = name, kind, start, head, end, body
        self.bases: list[str] = []
        self.interfaces: list[str] = []
        self.fields: dict[str, str] = {}


def _dotted(items: list, i: int) -> tuple[str, int]:
    """A dotted name from ``i`` on, without type arguments, and the place after it."""
    out = ""
    while i < len(items) and _name(items[i]):
        out += items[i].s
        i = _past_angles(items, i + 1)
        if i + 1 < len(items) and _is(items[i], ".", "::") and _name(items[i + 1]):
            out += "."
            i += 1
        else:
            break
    return out, i


def _start(items: list, i: int, words: set[str]) -> int:
    while i and isinstance(items[i - 1], Leaf) and items[i - 1].s in words:
        i -= 1
    return i


def ecma_types(group: Group, skip: set[int]) -> list[Type]:
    out, items = [], group.items
    for i, x in enumerate(items):
        if isinstance(x, Group):
            if x.at not in skip:
                out += ecma_types(x, skip)
        elif x.s in ("class", "interface", "enum") and i + 1 < len(items) and _name(items[i + 1]) and not (i and _is(items[i - 1], ".")) and not _is(items[i + 1], "extends"):
            j = i + 2
            while j < len(items) and not _group(items[j], "{") and not _is(items[j], ";"):
                j += 1
            if j < len(items) and isinstance(items[j], Group):
                head = _start(items, i, {"export", "default", "declare", "abstract", "const"})
                t = Type(items[i + 1].s, x.s, items[head].at, items[head].at, items[j].end, items[j])
                k, into = i + 2, None
                while k < j:
                    if _is(items[k], "extends"):
                        into = t.bases
                    elif _is(items[k], "implements"):
                        into = t.interfaces
                    elif into is not None and _name(items[k]):
                        name, k = _dotted(items, k)
                        into.append(name)
                        continue
                    k += 1
                out.append(t)
    return out


def go_types(group: Group) -> list[Type]:
    out, items = [], group.items
    for i, x in enumerate(items):
        if not _is(x, "type"):
            continue
        specs = items[i + 1].items if i + 1 < len(items) and _group(items[i + 1], "(") else items[i + 1 : i + 8]
        for k in range(len(specs)):
            if not (_name(specs[k]) and (k == 0 or _is(specs[k - 1], ";", "\n"))):
                continue
            j = k + 1
            if j < len(specs) and _group(specs[j], "[") and j + 1 < len(specs) and _is(specs[j + 1], "struct", "interface"):
                j += 1
            if j + 1 < len(specs) and _is(specs[j], "struct", "interface") and _group(specs[j + 1], "{"):
                begun = x.at if specs is not items[i + 1 : i + 2] and not _group(items[i + 1], "(") else specs[k].at
                t = Type(specs[k].s, specs[j].s, begun, begun, specs[j + 1].end, specs[j + 1])
                line: list = []
                for y in [*specs[j + 1].items, None]:
                    if y is None or _is(y, ";", "\n"):
                        _go_field(t, [z for z in line if not (isinstance(z, Leaf) and z.kind == "STRING")])
                        line = []
                    else:
                        line.append(y)
                out.append(t)
            if not _group(items[i + 1], "("):
                break
    return out


def _go_field(t: Type, line: list) -> None:
    if not line or t.kind != "struct":
        return
    bare = line[1:] if _is(line[0], "*") else line
    if all(isinstance(z, Leaf) and (_name(z) or z.s == ".") for z in bare) and (len(bare) == 1 or (len(bare) == 3 and _is(bare[1], "."))):
        t.bases.append("".join(z.s for z in bare))
        return
    names, k = [], 0
    while k < len(line) and _name(line[k]):
        names.append(line[k].s)
        if k + 1 < len(line) and _is(line[k + 1], ","):
            k += 2
        else:
            break
    kind = "".join(z.s if isinstance(z, Leaf) else z.s + {"[": "]", "(": ")", "{": "}"}[z.s] for z in line[k + 1 :])
    t.fields.update(dict.fromkeys(names, kind))


def rust_types(group: Group) -> list[Type]:
    out, items = [], group.items
    for i, x in enumerate(items):
        if isinstance(x, Group):
            if x.s == "{" and i > 1 and _is(items[i - 2], "mod"):
                out += rust_types(x)
            continue
        if x.s in ("struct", "enum", "trait") and i + 1 < len(items) and _name(items[i + 1]):
            j = i + 2
            while j < len(items) and not _group(items[j], "{") and not _is(items[j], ";"):
                j += 1
            head = _start(items, i, {"pub", "unsafe"})
            if head and _group(items[head - 1], "(") and head > 1 and _is(items[head - 2], "pub"):
                head -= 2
            body = items[j] if j < len(items) and isinstance(items[j], Group) else None
            out.append(Type(items[i + 1].s, x.s, items[head].at, items[head].at, items[min(j, len(items) - 1)].end, body))
        elif x.s == "impl" and x.kind == "impl" and (i == 0 or not _is(items[i - 1], "->", ":", "<", "=", ",", "&")):
            j = _past_angles(items, i + 1)
            first, k = _dotted(items, j)
            trait = None
            if k < len(items) and _is(items[k], "for"):
                trait, (first, k) = first, _dotted(items, k + 1)
            while k < len(items) and not _group(items[k], "{") and not _is(items[k], ";"):
                k += 1
            if first and k < len(items) and isinstance(items[k], Group):
                t = Type(first.split(".")[-1], "impl", x.at, x.at, items[k].end, items[k])
                t.interfaces = [trait] if trait else []
                out.append(t)
    return out


def imports_of(root: Group, language: str, text: str) -> list[tuple[str, dict[str, str]]]:
    """(specification, names it binds) of the imports of a file."""
    out: list[tuple[str, dict[str, str]]] = []
    items = root.items
    string = lambda x: isinstance(x, Leaf) and x.kind == "STRING"
    if language == "go":
        for i, x in enumerate(items):
            if _is(x, "import") and i + 1 < len(items):
                specs = items[i + 1].items if isinstance(items[i + 1], Group) else items[i + 1 : i + 3]
                for k, y in enumerate(specs):
                    if string(y):
                        spec = y.s[1:-1]
                        alias = specs[k - 1].s if k and isinstance(specs[k - 1], Leaf) and not _is(specs[k - 1], ";", "\n") else spec.rsplit("/", 1)[-1]
                        out.append((spec, {alias: spec}))
                        if not isinstance(items[i + 1], Group):
                            break
        return out
    if language == "rust":
        for i, x in enumerate(items):
            if _is(x, "use") and x.kind == "use":
                j = i + 1
                while j < len(items) and not _is(items[j], ";"):
                    j += 1
                if j > i + 1:
                    out.append((" ".join(text[items[i + 1].at : items[j - 1].end].split()), {}))
        return out
    for i, x in enumerate(items):
        if _is(x, "import", "export") and x.kind in ("import", "export"):
            j = i + 1
            while j < len(items) and not string(items[j]) and not _is(items[j], ";") and not (j > i + 1 and _is(items[j], "import", "export")):
                if _group(items[j], "{") and x.s == "export" and not (j + 1 < len(items) and _is(items[j + 1], "from")):
                    break
                j += 1
            if j < len(items) and string(items[j]) and (j == i + 1 or _is(items[j - 1], "from")):
                spec = items[j].s[1:-1]
                out.append((spec, _ecma_bindings(items[i + 1 : j - 1], spec) if x.s == "import" else {}))
        elif _is(x, "require") and i + 1 < len(items) and _group(items[i + 1], "(") and items[i + 1].items and string(items[i + 1].items[0]):
            spec, bound = items[i + 1].items[0].s[1:-1], {}
            if i > 1 and _is(items[i - 1], "="):
                left = items[i - 2]
                bound = _ecma_bindings([left], spec) if _group(left, "{") else {left.s: f"{spec}:*"} if _name(left) else {}
            out.append((spec, bound))
    return out


def _ecma_bindings(clause: list, spec: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, x in enumerate(clause):
        if _group(x, "{"):
            inner = [y for y in x.items if not (_is(y, "type"))]
            j = 0
            while j < len(inner):
                if _name(inner[j]):
                    renamed = j + 2 < len(inner) and _is(inner[j + 1], "as", ":") and _name(inner[j + 2])
                    out[inner[j + 2].s if renamed else inner[j].s] = f"{spec}:{inner[j].s}"
                    j += 2 if renamed else 0
                j += 1
        elif _is(x, "*") and k + 2 < len(clause):
            out[clause[k + 2].s] = f"{spec}:*"
        elif _name(x) and not _is(x, "type", "as") and not (k and _is(clause[k - 1], "as")):
            out[x.s] = f"{spec}:{x.s}"
    return out


def calls_of(group: Group, own: set[int], language: str) -> list[tuple[int, str]]:
    """(offset, dotted callee) of the calls in a tree, in order; a callee that is no dotted name is left out.

    ``own``: offsets of the parameter lists of definitions.
    """
    out: list[tuple[int, str]] = []
    items = group.items
    for i, x in enumerate(items):
        if not isinstance(x, Group):
            continue
        if x.s == "(" and x.at not in own and i and not (language == "rust" and i > 1 and _is(items[i - 1], "!")):
            j = i - 1
            if _is(items[j], ">"):  # type arguments
                depth = 0
                while j >= 0:
                    depth += (1 if _is(items[j], ">") else -1 if _is(items[j], "<") else 0) if isinstance(items[j], Leaf) else 0
                    j -= 1
                    if not depth:
                        break
                if j >= 0 and _is(items[j], "::"):
                    j -= 1
            names: list[str] = []
            while j >= 0 and _name(items[j]):
                names.append(items[j].s)
                if j >= 1 and _is(items[j - 1], ".", "::", "?."):
                    j -= 2
                else:
                    j -= 1
                    break
            else:
                if names and j >= -1 and (j < 0 or not _name(items[j])):
                    names = []  # the chain begins with another call, an index or a literal
            if names and names[-1] not in NOT_CALLED and not (names == ["new"]):
                out.append((x.at, ".".join(reversed(names))))
        out += calls_of(x, own, language)
    return sorted(out) if group.s == "" else out


def local_names(params, body, language: str) -> list[str]:
    """Names a function binds itself: parameters and declared variables."""
    found: set[str] = set()

    def pattern(items: list, typed: bool) -> None:
        """Names of a parameter list or destructuring pattern, element by element."""
        element: list = []
        for x in [*items, None]:
            if x is not None and not _is(x, ","):
                element.append(x)
                continue
            e = [y for y in element if not _is(y, "...", "public", "private", "protected", "readonly")]
            element = []
            if not e:
                continue
            if isinstance(e[0], Group):
                pattern(e[0].items, False)
            elif _name(e[0]):
                if len(e) > 2 and _is(e[1], ":") and not typed:  # a key with another name
                    pattern(e[2:], False)
                else:
                    found.add(e[0].s)

    def go_list(items: list) -> None:
        pending: list[str] = []
        element: list = []
        for x in [*items, None]:
            if x is not None and not _is(x, ","):
                element.append(x)
                continue
            if len(element) == 1 and _name(element[0]):
                pending.append(element[0].s)
            elif len(element) > 1 and _name(element[0]) and not _is(element[1], "."):
                found.update([*pending, element[0].s])
                pending = []
            element = []

    def walk(g: Group) -> None:
        items = g.items
        for i, x in enumerate(items):
            if isinstance(x, Group):
                walk(x)
            elif language == "go":
                if x.s == ":=":
                    j = i - 1
                    while j >= 0 and _name(items[j]):
                        found.add(items[j].s)
                        j -= 2 if j >= 1 and _is(items[j - 1], ",") else j + 1
                elif x.s == "var" and i + 1 < len(items) and _name(items[i + 1]):
                    found.add(items[i + 1].s)
            elif x.s in ("const", "let", "var") and i + 1 < len(items):
                pattern(items[i + 1 : i + 2], True)
            elif x.s in ("function", "class") and i + 1 < len(items) and _name(items[i + 1]):
                found.add(items[i + 1].s)

    if isinstance(params, Group):
        (go_list if language == "go" else lambda z: pattern(z, True))(params.items)
    elif isinstance(params, Leaf):
        found.add(params.s)
    if isinstance(body, Group):
        walk(body)
    return sorted(found - {"_", "this"})
