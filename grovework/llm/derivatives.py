"""Parsing with derivatives: memoised partial derivatives of hash-consed grammar expressions.

A parser's state is a set of grammar expressions, each one way in which the rest of the input may look. The derivative
of the state by a token is the set of what may follow that token. Expressions are hash-consed (equal expressions are the
same number), derivatives are memoised per expression and token, and whole states are memoised too, so that code that
looks like code seen before costs one look-up per token. An empty derivative marks the token at which the input fails; a
state in which no expression is nullable, at the end of the input, means that the input was cut off.

Readings that begin with the same expression share it: ``a b | a c`` is kept as ``a (b | c)``, so the continuations form
a graph instead of a list of whole stacks. A state then holds at most one entry for each expression of the grammar,
however deeply the text is nested and however many readings there are.

Grammars are written as text: ``name = alternatives ;`` with 'literal' tokens, UPPER-case token classes, lower-case
rules, ``( )`` groups, ``[ ]`` optional, ``{ }`` repeated parts. Rules must not be left-recursive.
"""

from __future__ import annotations

import re

_META = re.compile(r"\s*(?:#[^\n]*\n\s*)*('(?:[^'\\]|\\.)+'|[A-Za-z_]\w*|[=;|()\[\]{}])")

MEMO_LIMIT = 400_000


class Grammar:
    EMPTY = 0  # the expression that matches nothing more: the end of a rule

    def __init__(self, text: str, start: str) -> None:
        self.kind: list[tuple] = [("eps",)]
        self.number: dict[tuple, int] = {("eps",): 0}
        self.rules: dict[str, int] = {}
        self._read(text)
        self._nullable: dict[int, bool] = {0: True}
        self._settle()
        self._fixed = len(self.kind)
        self.start = self._node(("rule", start))
        self._reset()

    def _reset(self) -> None:
        """Forget memoised states and expressions made while parsing (they are made again when needed)."""
        for k in self.kind[self._fixed + 1 :]:
            del self.number[k]
        del self.kind[self._fixed + 1 :]
        self._nullable = {n: v for n, v in self._nullable.items() if n <= self._fixed}
        self._memo: dict[tuple[int, str], tuple[int, ...]] = {}
        self._state_memo: dict[tuple[frozenset, tuple], frozenset] = {}

    # construction
    def _node(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.kind)
            self.kind.append(key)
        return n

    def seq(self, a: int, b: int) -> int:
        if a == 0:
            return b
        if b == 0:
            return a
        k = self.kind[a]
        if k[0] == "seq":  # right-nested, so that equal rests are the same number
            return self._node(("seq", k[1], self.seq(k[2], b)))
        return self._node(("seq", a, b))

    def _read(self, text: str) -> None:
        tokens, at = [], 0
        text = text.rstrip() + "\n"
        while at < len(text.rstrip()):
            m = _META.match(text, at)
            if not m:
                raise ValueError(f"grammar text at {text[at:at + 40]!r}")
            tokens.append(m.group(1))
            at = m.end()
        pos = 0

        def alternatives(closing: str) -> int:
            nonlocal pos
            parts = []
            while True:
                node = []
                while tokens[pos] not in (closing, "|"):
                    node.append(item())
                whole = 0
                for x in reversed(node):
                    whole = self.seq(x, whole)
                parts.append(whole)
                pos += 1
                if tokens[pos - 1] == closing:
                    break
            return parts[0] if len(parts) == 1 else self._node(("alt", *dict.fromkeys(parts)))

        def item() -> int:
            nonlocal pos
            t = tokens[pos]
            pos += 1
            if t == "(":
                return alternatives(")")
            if t == "[":
                return self._node(("alt", alternatives("]"), 0))
            if t == "{":
                return self._node(("star", alternatives("}")))
            if t[0] == "'":
                return self._node(("tok", t[1:-1].replace("\\'", "'")))
            return self._node(("tok", t) if t.isupper() else ("rule", t))

        while pos < len(tokens):
            name = tokens[pos]
            if tokens[pos + 1] != "=":
                raise ValueError(f"no = after rule {name}")
            pos += 2
            if name in self.rules:
                raise ValueError(f"two rules {name}")
            self.rules[name] = alternatives(";")
        for k in self.kind:
            if k[0] == "rule" and k[1] not in self.rules:
                raise ValueError(f"no rule {k[1]}")

    def _settle(self) -> None:
        """Least fixed point of nullability over the grammar's own expressions."""
        value = [False] * len(self.kind)
        changed = True
        while changed:
            changed = False
            for n, k in enumerate(self.kind):
                if value[n]:
                    continue
                v = (
                    k[0] in ("eps", "star")
                    or (k[0] == "rule" and value[self.rules[k[1]]])
                    or (k[0] == "alt" and any(value[x] for x in k[1:]))
                    or (k[0] == "seq" and value[k[1]] and value[k[2]])
                )
                if v:
                    value[n] = changed = True
        self._nullable = dict(enumerate(value))

    # parsing
    def nullable(self, n: int) -> bool:
        v = self._nullable.get(n)
        if v is None:
            k = self.kind[n]
            if k[0] == "seq":
                v = self.nullable(k[1]) and self.nullable(k[2])
            elif k[0] == "rule":
                v = self.nullable(self.rules[k[1]])
            else:
                v = k[0] in ("eps", "star") or (k[0] in ("alt", "any") and any(self.nullable(x) for x in k[1:]))
            self._nullable[n] = v
        return v

    def derive(self, n: int, t: str) -> tuple[int, ...]:
        """The partial derivatives of expression ``n`` by token class ``t``."""
        key = (n, t)
        out = self._memo.get(key)
        if out is not None:
            return out
        k = self.kind[n]
        op = k[0]
        if op == "tok":
            out = (0,) if k[1] == t else ()
        elif op == "rule":
            out = self.derive(self.rules[k[1]], t)
        elif op == "seq":
            rest = k[2]
            found = [self.seq(x, rest) for x in self.derive(k[1], t)]
            if self.nullable(k[1]):
                found += self.derive(rest, t)
            out = self.shared(found)
        elif op in ("alt", "any"):
            out = self.shared([x for a in k[1:] for x in self.derive(a, t)])
        elif op == "star":
            out = tuple(self.seq(x, n) for x in self.derive(k[1], t))
        else:
            out = ()
        self._memo[key] = out
        return out

    def shared(self, found: list[int]) -> tuple[int, ...]:
        """The same language with one expression for each beginning: continuations after equal beginnings are united."""
        if len(found) < 2:
            return tuple(found)
        rests: dict[int, set[int]] = {}
        for n in found:
            k = self.kind[n]
            first, rest = (k[1], k[2]) if k[0] == "seq" else (n, 0)
            rests.setdefault(first, set()).add(rest)
        return tuple(self.seq(first, self._united(rest)) for first, rest in rests.items())

    def _united(self, rests: set[int]) -> int:
        if len(rests) == 1:
            return next(iter(rests))
        flat: set[int] = set()
        for n in rests:
            k = self.kind[n]
            flat.update(k[1:] if k[0] == "any" else (n,))
        ways = self.shared(sorted(flat))  # the beginnings of the continuations are shared as well
        return ways[0] if len(ways) == 1 else self._node(("any", *sorted(ways)))

    def begin(self) -> frozenset:
        if len(self._memo) > MEMO_LIMIT or len(self._state_memo) > MEMO_LIMIT or len(self.kind) > MEMO_LIMIT:
            self._reset()
        return frozenset((self.start,))

    def step(self, state: frozenset, classes: tuple) -> frozenset:
        """The derivative of a state by a token of any of the ``classes``."""
        key = (state, classes)
        out = self._state_memo.get(key)
        if out is None:
            if len(self._memo) > MEMO_LIMIT or len(self._state_memo) > MEMO_LIMIT:  # within a file: expressions stay valid
                self._memo.clear()
                self._state_memo.clear()
            out = frozenset(self.shared([x for n in state for t in classes for x in self.derive(n, t)]))
            self._state_memo[key] = out
        return out

    def complete(self, state: frozenset) -> bool:
        return any(self.nullable(n) for n in state)
