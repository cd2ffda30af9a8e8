"""A read-only subset of Cypher compiled to DataFrame plans over the graph.

``[OPTIONAL] MATCH`` of comma-separated linear patterns (labels, property maps, directed, undirected, typed and
variable-length relations), ``WHERE``, ``WITH`` (projection, aggregation, filter), ``UNWIND`` of a parameter list or list
expression, ``RETURN [DISTINCT] ... ORDER BY``. Expressions: literals, parameters, properties, comparison, AND/OR/NOT,
IN, CONTAINS, STARTS WITH, ENDS WITH, IS [NOT] NULL, =~, CASE, pattern predicates, list slices, ANY(x IN ...), and the functions below.
Every variable becomes a struct column, every relation a join, so Catalyst plans the query like any other.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovework.operators.model import CodeGraph
from grovework.plans.guard import refusal
from grovework.runtime import cut

_TOKEN = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.(?!\.)\d+)?)|(?P<par>\$\w+)|(?P<name>`[^`]+`|\w+)|(?P<op><>|<=|>=|=~|\.\.|->|<-|[-+*/%=<>()\[\]{},.:|;]))"
)
KEYWORDS = {"match", "optional", "where", "with", "unwind", "return", "as", "order", "by", "distinct", "and", "or", "not", "in", "is", "null", "contains", "starts", "ends", "case", "when", "then", "else", "end", "desc", "descending", "asc", "ascending", "true", "false", "any", "all", "exists"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
MAX_HOPS = 25


class CypherError(ValueError):
    pass


@dataclass
class Node:
    var: str
    labels: list[str]
    props: dict


@dataclass
class Rel:
    var: str | None
    types: list[str]
    direction: str  # out, in, both
    low: int = 1
    high: int = 1


@dataclass
class Item:
    expr: tuple
    name: str


@dataclass
class Clause:
    kind: str
    patterns: list = field(default_factory=list)
    where: tuple | None = None
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    order: list = field(default_factory=list)
    optional: bool = False


class Parser:
    def __init__(self, text: str) -> None:
        text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
        self.t, at = [], 0
        text = text.rstrip().rstrip(";").rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"cannot read {text[at:at + 20]!r}")
            self.t.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.i = 0
        self.fresh = (f"_v{k}" for k in itertools.count())

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1].lower() if self.i + k < len(self.t) and self.t[self.i + k][0] in ("name", "op") else ("" if self.i + k >= len(self.t) else self.t[self.i + k][1])

    def take(self, *want: str) -> str:
        got = self.peek()
        if want and got not in want:
            raise CypherError(f"expected {' or '.join(want)}, found {got or 'the end'}")
        self.i += 1
        return self.t[self.i - 1][1]

    def on(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def name(self) -> str:
        kind, s = self.t[self.i]
        if kind != "name":
            raise CypherError(f"expected a name, found {s}")
        self.i += 1
        return s.strip("`")

    def query(self) -> list[Clause]:
        out = []
        while self.i < len(self.t):
            if self.on("optional", "match"):
                out.append(self.match(True))
            elif self.on("match"):
                out.append(self.match(False))
            elif self.on("unwind"):
                e = self.expr()
                self.take("as")
                out.append(Clause("unwind", items=[Item(e, self.name())]))
            elif self.on("with"):
                out.append(self.projection("with"))
            elif self.on("return"):
                out.append(self.projection("return"))
                if self.i < len(self.t):
                    raise CypherError(f"unexpected {self.peek()} after RETURN")
            else:
                raise CypherError(f"unexpected {self.peek()}")
        if not out or out[-1].kind != "return":
            raise CypherError("a query must end with RETURN")
        return out

    def match(self, optional: bool) -> Clause:
        c = Clause("match", optional=optional)
        c.patterns.append(self.pattern())
        while self.on(","):
            c.patterns.append(self.pattern())
        if self.on("where"):
            c.where = self.expr()
        return c

    def pattern(self) -> list:
        path = [self.node()]
        while self.peek() in ("-", "<-", "<") or (self.peek() == "<" and self.peek(1) == "-"):
            path.append(self.rel())
            path.append(self.node())
        return path

    def node(self) -> Node:
        self.take("(")
        var = self.name() if self.t[self.i][0] == "name" else next(self.fresh)
        labels, props = [], {}
        while self.on(":") or (labels and self.on("|")):
            labels.append(self.name())
        if self.on("{"):
            while not self.on("}"):
                k = self.name()
                self.take(":")
                props[k] = self.expr()
                self.on(",")
        self.take(")")
        return Node(var, labels, props)

    def rel(self) -> Rel:
        into = self.on("<-") or (self.on("<") and bool(self.take("-")))
        if not into:
            self.take("-")
        var, types, low, high = None, [], 1, 1
        if self.on("["):
            if self.t[self.i][0] == "name":
                var = self.name()
            while self.on(":") or (types and self.on("|")):
                types.append(self.name())
            if self.on("*"):
                low, high = 1, MAX_HOPS
                if self.t[self.i][0] == "num":
                    low = high = int(self.take())
                if self.on(".."):
                    high = int(self.take()) if self.t[self.i][0] == "num" else MAX_HOPS
            self.take("]")
        out = self.on("->") or (self.on("-") and self.on(">"))
        if not out and self.t[self.i - 1][1] != "-":
            self.take("-")
        return Rel(var, types, "in" if into else "out" if out else "both", low, min(high, MAX_HOPS))

    def projection(self, kind: str) -> Clause:
        c = Clause(kind, distinct=self.on("distinct"))
        while True:
            start = self.i
            e = self.expr()
            name = self.name() if self.on("as") else "".join(s for _, s in self.t[start : self.i])
            c.items.append(Item(e, name))
            if not self.on(","):
                break
        if self.on("order", "by"):
            while True:
                e = self.expr()
                down = self.on("desc") or self.on("descending")
                if not down:
                    self.on("asc") or self.on("ascending")
                c.order.append((e, down))
                if not self.on(","):
                    break
        if kind == "with" and self.on("where"):
            c.where = self.expr()
        return c

    # expressions, as tuples
    def expr(self) -> tuple:
        e = self.conj()
        while self.on("or"):
            e = ("or", e, self.conj())
        return e

    def conj(self) -> tuple:
        e = self.neg()
        while self.on("and"):
            e = ("and", e, self.neg())
        return e

    def neg(self) -> tuple:
        return ("not", self.neg()) if self.on("not") else self.comparison()

    def comparison(self) -> tuple:
        e = self.sum()
        while True:
            op = self.peek()
            if op in ("=", "<>", "<", ">", "<=", ">=", "=~"):
                self.take()
                e = (op, e, self.sum())
            elif op == "in":
                self.take()
                e = ("in", e, self.sum())
            elif op == "contains":
                self.take()
                e = ("contains", e, self.sum())
            elif op in ("starts", "ends") and self.peek(1) == "with":
                self.i += 2
                e = (op, e, self.sum())
            elif op == "is":
                self.take()
                no = self.on("not")
                self.take("null")
                e = ("notnull" if no else "isnull", e)
            else:
                return e

    def sum(self) -> tuple:
        e = self.product()
        while self.peek() in ("+", "-"):
            e = (self.take(), e, self.product())
        return e

    def product(self) -> tuple:
        e = self.postfix()
        while self.peek() in ("*", "/", "%"):
            e = (self.take(), e, self.postfix())
        return e

    def postfix(self) -> tuple:
        e = self.atom()
        while True:
            if self.on("."):
                e = ("prop", e, self.name())
            elif self.on("["):
                a = None if self.peek() == ".." else self.expr()
                if self.on(".."):
                    b = None if self.peek() == "]" else self.expr()
                    e = ("slice", e, a, b)
                else:
                    e = ("index", e, a)
                self.take("]")
            else:
                return e

    def atom(self) -> tuple:
        kind, s = self.t[self.i] if self.i < len(self.t) else ("", "")
        low = s.lower()
        if kind == "str":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", r"\1", s[1:-1]))
        if kind == "num":
            self.i += 1
            return ("lit", float(s) if "." in s else int(s))
        if kind == "par":
            self.i += 1
            return ("param", s[1:])
        if s == "(":
            save = self.i
            try:  # a pattern used as a predicate
                p = self.pattern()
                if len(p) > 1:
                    return ("pattern", p)
            except (CypherError, IndexError):
                pass
            self.i = save + 1
            e = self.expr()
            self.take(")")
            return e
        if s == "[":
            self.i += 1
            items = []
            while not self.on("]"):
                items.append(self.expr())
                self.on(",")
            return ("list", items)
        if s == "{":
            self.i += 1
            pairs = []
            while not self.on("}"):
                k = self.name()
                self.take(":")
                pairs.append((k, self.expr()))
                self.on(",")
            return ("map", pairs)
        if s == "-":
            self.i += 1
            return ("-", ("lit", 0), self.atom())
        if kind != "name":
            raise CypherError(f"unexpected {s or 'end'}")
        if low in ("true", "false", "null"):
            self.i += 1
            return ("lit", {"true": True, "false": False, "null": None}[low])
        if low == "case":
            self.i += 1
            arms, other = [], None
            subject = None if self.peek() == "when" else self.expr()
            while self.on("when"):
                c = self.expr()
                self.take("then")
                arms.append((c if subject is None else ("=", subject, c), self.expr()))
            if self.on("else"):
                other = self.expr()
            self.take("end")
            return ("case", arms, other)
        if low in ("any", "all") and self.peek(1) == "(":
            self.i += 2
            v = self.name()
            self.take("in")
            xs = self.expr()
            self.take("where")
            c = self.expr()
            self.take(")")
            return (low, v, xs, c)
        if self.peek(1) == "(":
            self.i += 2
            distinct = self.on("distinct")
            args = []
            while not self.on(")"):
                if self.on("*"):
                    args.append(("star",))
                else:
                    args.append(self.expr())
                self.on(",")
            return ("call", low, args, distinct)
        return ("var", self.name())


class Compiler:
    def __init__(self, graph: CodeGraph, params: dict) -> None:
        self.g, self.params = graph, params
        cols = [c for c in graph.nodes.columns]
        ext_fields = {"name": F.col("name"), "node_type": F.lit("external"), "root": F.col("root"), "kind": F.col("kind"), "language": F.col("language")}
        types = dict(graph.nodes.dtypes)
        extra = [c for c in ("root", "kind", "language") if c not in cols]
        nodes = graph.nodes.select(*cols, *[F.lit(None).cast("string").alias(c) for c in extra])
        ext = graph.externals.select(
            *[(F.col(c) if c in ("project", "id") else ext_fields[c] if c in ext_fields else F.lit(None).cast(types[c])).alias(c) for c in cols], *[ext_fields[c].alias(c) for c in extra]
        )
        self.all = nodes.unionByName(ext)
        self.fields = [*cols, *extra]
        self.lists: dict[str, str] = {}
        self.n = itertools.count()

    def node_table(self, node: Node) -> DataFrame:
        """Rows a node pattern can bind: labels and literal properties are pushed into the scan's filter."""
        df = self.all
        if node.labels:
            wanted = [x for x in node.labels if x.lower() != "code"]
            if any(x.lower() == "code" for x in node.labels):
                df = df.where(F.col("node_type") != "external")
            if wanted:
                df = df.where(F.lower("node_type").isin([x.lower() for x in wanted]))
        for k, e in node.props.items():
            if k not in self.fields:
                raise CypherError(f"unknown property {k}")
            if e[0] in ("lit", "param"):
                df = df.where(F.col(k) == F.lit(self.value(e)))
        return df.select(F.struct(*self.fields).alias(node.var))

    def value(self, e: tuple):
        if e[0] == "lit":
            return e[1]
        if e[1] not in self.params:
            raise CypherError(f"no parameter ${e[1]}")
        return self.params[e[1]]

    def step(self, df: DataFrame, left: str, rel: Rel, node: Node) -> DataFrame:
        """Join along one relation (of a range of lengths) to a node variable, new or bound."""
        e = self.g.edges.select("project", "source", "target", "edge_type", "resolution", "callee_text")
        if rel.types:
            e = e.where(F.col("edge_type").isin([t.upper() for t in rel.types]))
        info = F.struct("source", "target", "edge_type", "resolution", "callee_text").alias("_rel")
        out = e.select("project", F.col("source").alias("_from"), F.col("target").alias("_to"), info)
        into = e.select("project", F.col("target").alias("_from"), F.col("source").alias("_to"), info)
        hop = out if rel.direction == "out" else into if rel.direction == "in" else out.unionByName(into.where(F.col("_from") != F.col("_to")))
        rel_var = rel.var or f"_r{next(self.n)}"
        single = rel.low == rel.high == 1
        hop = hop.withColumnRenamed("project", "_p")
        state = df.withColumn("_at", F.col(f"{left}.id")).withColumn("_proj", F.col(f"{left}.project"))
        reached = None
        if rel.low == 0:
            reached = state.withColumn("_end", F.col("_at"))
            reached = reached.withColumn(rel_var, F.array().cast("array<struct<source:string,target:string,edge_type:string,resolution:string,callee_text:string>>"))
        walk = state if single else state.withColumn(rel_var, F.array().cast("array<struct<source:string,target:string,edge_type:string,resolution:string,callee_text:string>>"))
        for k in range(1, rel.high + 1):
            walk = walk.join(hop, (F.col("_proj") == F.col("_p")) & (F.col("_at") == F.col("_from")))
            if single:
                walk = walk.withColumn(rel_var, F.col("_rel"))
            else:  # a relation is walked once per path
                walk = walk.where(~F.array_contains(F.col(rel_var), F.col("_rel"))).withColumn(rel_var, F.concat(F.col(rel_var), F.array("_rel")))
            walk = walk.withColumn("_at", F.col("_to")).drop("_p", "_from", "_to", "_rel")
            if k >= max(1, rel.low):
                here = walk.withColumn("_end", F.col("_at"))
                reached = here if reached is None else reached.unionByName(here)
            if k >= 3 and k < rel.high:  # long walks are cut, so that no hop is walked again to see whether it is the last
                walk = cut(walk, "walk")
                if walk.isEmpty():
                    break
        reached = reached.drop("_at")
        if node.var in df.columns:
            return reached.where(F.col("_end") == F.col(f"{node.var}.id")).drop("_end", "_proj")
        far = self.node_table(node).withColumn("_fid", F.col(f"{node.var}.id")).withColumn("_fp", F.col(f"{node.var}.project"))
        return reached.join(far, (F.col("_end") == F.col("_fid")) & (F.col("_proj") == F.col("_fp"))).drop("_end", "_proj", "_fid", "_fp")

    def bind(self, df: DataFrame | None, path: list) -> DataFrame:
        first = path[0]
        if df is None:
            df = self.node_table(first)
        elif first.var not in df.columns:
            known = next((n.var for n in path[2::2] if n.var in df.columns), None)
            if known is not None:  # walk the pattern from its bound end
                flip = {"out": "in", "in": "out", "both": "both"}
                return self.bind(df, [x if isinstance(x, Node) else Rel(x.var, x.types, flip[x.direction], x.low, x.high) for x in reversed(path)])
            raise CypherError("patterns without a common variable would be a cross join and are not supported")
        df = self.props(df, first)
        for k in range(1, len(path), 2):
            df = self.props(self.step(df, path[k - 1].var, path[k], path[k + 1]), path[k + 1])
        return df

    def props(self, df: DataFrame, node: Node) -> DataFrame:
        for k, e in node.props.items():
            df = df.where(F.col(f"{node.var}.{k}") == self.col(e, df))
        return df

    def match(self, df: DataFrame | None, c: Clause) -> DataFrame:
        if c.optional and df is not None:
            key = f"_k{next(self.n)}"
            # rows are told apart by their bound columns, so the left join is on those
            shared = [x for x in df.columns]
            inner = df.select(*shared).distinct().withColumn(key, F.sha2(F.to_json(F.struct(*shared)), 256))
            found = inner
            for p in c.patterns:
                found = self.bind(found, p)
            if c.where is not None:
                found = self.filtered(found, c.where)
            new = [x for x in found.columns if x not in shared and x != key]
            return df.withColumn(key, F.sha2(F.to_json(F.struct(*shared)), 256)).join(found.select(key, *new), key, "left").drop(key)
        if df is not None and not any(t.startswith("struct<project") for _, t in df.dtypes):
            return self.linked(df, c)
        for p in c.patterns:
            df = self.bind(df, p)
        return df if c.where is None else self.filtered(df, c.where)

    def linked(self, df: DataFrame, c: Clause) -> DataFrame:
        """Rows of values (from UNWIND) meet a pattern by the equality in WHERE that links them; there is no cross join."""
        found = None
        for p in c.patterns:
            found = self.bind(found, p)

        def conjuncts(e):
            return conjuncts(e[1]) + conjuncts(e[2]) if e and e[0] == "and" else [e] if e else []

        for e in conjuncts(c.where):
            for a, b in ((e[1], e[2]), (e[2], e[1])) if e[0] == "=" else ():
                if a[0] == "prop" and a[1][0] == "var" and a[1][1] in found.columns and b[0] == "var" and b[1] in df.columns:
                    both = df.join(found, F.col(f"{a[1][1]}.{a[2]}") == F.col(f"`{b[1]}`"))
                    return self.filtered(both, c.where)
        raise CypherError("a pattern after UNWIND needs an equality with the unwound value")

    def filtered(self, df: DataFrame, e: tuple) -> DataFrame:
        """Conjuncts one by one; pattern predicates become semi and anti joins."""
        if e[0] == "and":
            return self.filtered(self.filtered(df, e[1]), e[2])
        negative, inner = (True, e[1]) if e[0] == "not" else (False, e)
        if inner[0] == "pattern":
            path = inner[1]
            bound = next((i for i, n in enumerate(path[::2]) if n.var in df.columns), None)
            if bound is None:
                raise CypherError("a pattern predicate needs a bound variable")
            var = path[bound * 2].var
            probe = self.bind(df.select(var).distinct(), path if bound == 0 else list(path))
            hit = probe.select(F.col(f"{var}.project").alias("_hp"), F.col(f"{var}.id").alias("_hi")).distinct()
            on = (F.col(f"{var}.project") == F.col("_hp")) & (F.col(f"{var}.id") == F.col("_hi"))
            return df.join(hit, on, "left_anti" if negative else "left_semi")
        return df.where(self.col(e, df))

    def aggregates(self, e) -> bool:
        if isinstance(e, tuple):
            return (e[0] == "call" and e[1] in AGGREGATES) or any(self.aggregates(x) for x in e)
        return isinstance(e, list) and any(self.aggregates(x) for x in e)

    def project(self, df: DataFrame, c: Clause) -> DataFrame:
        agg = [i for i in c.items if self.aggregates(i.expr)]
        if agg:
            keys = [self.col(i.expr, df).alias(i.name) for i in c.items if not self.aggregates(i.expr)]
            out = df.groupBy(*keys).agg(*[self.col(i.expr, df).alias(i.name) for i in agg])
        else:
            order = [(self.col(e, df), down) for e, down in c.order] if not c.distinct and all(not self.named(e, c) for e, _ in c.order) else None
            if order:
                df = df.orderBy(*[o.desc() if d else o.asc() for o, d in order])
            out = df.select(*[self.col(i.expr, df).alias(i.name) for i in c.items])
            if order:
                return out if c.where is None else self.filtered(out, c.where)
        out = out.select(*[F.col(f"`{i.name}`") for i in c.items])
        if c.distinct:
            out = out.distinct()
        if c.order:
            by = []
            for e, down in c.order:
                item = next((i for i in c.items if i.expr == e or (e[0] == "var" and e[1] == i.name)), None)
                k = F.col(f"`{item.name}`") if item else self.col(e, out)
                by.append(k.desc() if down else k.asc())
            out = out.orderBy(*by)
        return out if c.where is None else self.filtered(out, c.where)

    def named(self, e: tuple, c: Clause) -> bool:
        return any(e == ("var", i.name) or e == i.expr for i in c.items)

    def col(self, e: tuple, df: DataFrame, scope: dict | None = None) -> Column:
        scope = scope or {}
        c = lambda x: self.col(x, df, scope)
        op = e[0]
        if op in ("lit", "param"):
            v = self.value(e)
            return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
        if op == "var":
            if e[1] in scope:
                return scope[e[1]]
            if e[1] not in df.columns:
                raise CypherError(f"unknown variable {e[1]}")
            return F.col(f"`{e[1]}`")
        if op == "prop":
            return c(e[1])[e[2]]
        if op == "list":
            return F.array(*[c(x) for x in e[1]])
        if op == "map":
            return F.struct(*[c(x).alias(k) for k, x in e[1]])
        if op == "index":
            return F.get(c(e[1]), c(e[2]))
        if op == "slice":
            a = F.lit(0) if e[2] is None else c(e[2])
            n = F.size(c(e[1])) if e[3] is None else c(e[3])
            return F.slice(c(e[1]), a + 1, F.greatest(n - a, F.lit(0)))
        if op == "case":
            out = None
            for w, t in e[1]:
                out = F.when(c(w), c(t)) if out is None else out.when(c(w), c(t))
            return out if e[2] is None else out.otherwise(c(e[2]))
        if op in ("any", "all"):
            f = F.exists if op == "any" else F.forall
            return f(c(e[2]), lambda x: self.col(e[3], df, {**scope, e[1]: x}))
        if op == "call":
            return self.call(e, df, scope)
        two = {
            "and": lambda a, b: a & b, "or": lambda a, b: a | b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
            "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "contains": F.contains, "starts": F.startswith, "ends": F.endswith, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
            "/": lambda a, b: a / b, "%": lambda a, b: a % b, "in": lambda a, b: F.array_contains(b, a), "=~": lambda a, b: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
        }
        if op == "+":
            text = any(x[0] == "lit" and isinstance(x[1], str) for x in (e[1], e[2]))
            return F.concat(c(e[1]).cast("string"), c(e[2]).cast("string")) if text else c(e[1]) + c(e[2])
        if op in two:
            return two[op](c(e[1]), c(e[2]))
        if op == "not":
            return ~c(e[1])
        if op in ("isnull", "notnull"):
            return c(e[1]).isNull() if op == "isnull" else c(e[1]).isNotNull()
        raise CypherError(f"{op} is not supported here")

    def call(self, e: tuple, df: DataFrame, scope: dict) -> Column:
        _, name, args, distinct = e
        if name == "count" and args == [("star",)]:
            return F.count(F.lit(1))
        a = [self.col(x, df, scope) for x in args]
        if name == "count":
            x = a[0]["id"] if args[0][0] == "var" and args[0][1] in df.columns and "id:string" in dict(df.dtypes)[args[0][1]] else a[0]
            return F.count_distinct(x) if distinct else F.count(x)
        if name == "collect":
            return F.sort_array(F.collect_set(a[0]) if distinct else F.collect_list(a[0]))
        if name in ("sum", "avg", "min", "max"):
            return getattr(F, name)(a[0])
        plain = {
            "tolower": lambda x: F.lower(x), "toupper": lambda x: F.upper(x), "trim": lambda x: F.trim(x), "size": lambda x: F.size(x), "length": lambda x: F.size(x),
            "coalesce": lambda *x: F.coalesce(*x), "type": lambda r: r["edge_type"], "id": lambda n: n["id"], "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.cast("int"),
            "labels": lambda n: F.array(F.initcap(n["node_type"])), "startnode": lambda r: r["source"], "endnode": lambda r: r["target"], "split": lambda x, y: F.split(x, F.concat(F.lit("\\Q"), y, F.lit("\\E"))),
            "substring": lambda x, i, n=None: F.substring(x, i + 1, n if n is not None else F.length(x)), "replace": lambda x, y, z: F.replace(x, y, z), "abs": F.abs, "round": F.round, "head": lambda x: F.get(x, F.lit(0)),
        }
        if name not in plain:
            raise CypherError(f"unknown function {name}")
        return plain[name](*a)


def run(graph: CodeGraph, query: str, params: dict | None = None, checked: bool = True) -> DataFrame:
    """The result of a query as a DataFrame; ``checked`` applies the read-only guard first."""
    why = refusal(query) if checked else None
    if why:
        raise CypherError(why)
    comp, df = Compiler(graph, params or {}), None
    for c in Parser(query).query():
        if c.kind == "match":
            df = comp.match(df, c)
        elif c.kind == "unwind":
            base = df if df is not None else graph.nodes.sparkSession.range(1).select(F.lit(1).alias("_one"))
            df = base.select("*", F.explode(comp.col(c.items[0].expr, base)).alias(c.items[0].name))
        else:
            df = comp.project(df, c)
    return df
