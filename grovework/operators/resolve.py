"""Name resolution as a relational program: ordered rungs of joins, never a guess.

Input: ``nodes`` (project, id, name, node_type, file_path, parent_id), ``calls`` (project, source, callee, ordinal) and
``facts`` (project, file_path, language, imports map, local_names map of function id to shadowed names, struct_fields map
of type to map of field to type, receiver_names map of method id to receiver). Every rung is an equi-join; a rung binds
only when exactly one candidate exists; what no rung binds is external, skipped or reported as unresolved.
"""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovework.functions.text import external_root, language_of
from grovework.operators.imports import absolute_python, go_folder_of, python_module, resolve_imports
from grovework.runtime import cut

#: Names that are part of a language and never bound to the project.
BUILTINS = {
    "python": sorted(n for n in dir(builtins) if not n.startswith("__")),
    "go": (
        "any append bool byte cap clear close comparable complex complex128 complex64 copy delete error float32 float64 imag int int16 int32 int64 int8 len make max "
        "min new panic print println real recover rune string uint uint16 uint32 uint64 uint8 uintptr"
    ).split(),
    "javascript": (
        "AbortController AggregateError Array ArrayBuffer Atomics BigInt Blob Boolean Buffer DataView Date Error EvalError Event File FinalizationRegistry Float32Array Float64Array FormData "
        "Function Headers Infinity Int16Array Int32Array Int8Array Intl JSON Map Math NaN Number Object Promise Proxy RangeError ReferenceError Reflect RegExp Request Response Set "
        "SharedArrayBuffer String Symbol SyntaxError TextDecoder TextEncoder TypeError URIError URL URLSearchParams Uint16Array Uint32Array Uint8Array WeakMap WeakRef WeakSet WebSocket Worker "
        "alert atob btoa clearImmediate clearInterval clearTimeout confirm console decodeURI decodeURIComponent document encodeURI encodeURIComponent escape eval exports fetch global globalThis "
        "isFinite isNaN localStorage module navigator parseFloat parseInt performance process prompt queueMicrotask requestAnimationFrame require sessionStorage setImmediate setInterval "
        "setTimeout structuredClone undefined unescape window"
    ).split(),
}
BUILTINS["typescript"] = BUILTINS["javascript"]
MAX_BASES = 8
MAX_LIST, MAX_TEXT = 100, 200
CALLABLE = ("function", "method", "class", "struct")


def _flat(col: str, language: Column) -> Column:
    """Whether a name is a builtin of the row's language."""
    found = F.lit(False)
    for lang, names in BUILTINS.items():
        found = found | ((language == lang) & F.col(col).isin(names))
    return found


def _single(candidates: DataFrame, keys: list[str], rung: str) -> DataFrame:
    """Candidates (keys, target) that are the only one of their key."""
    one = candidates.groupBy(*keys).agg(F.min("target").alias("target"), F.countDistinct("target").alias("_n"))
    return one.where(F.col("_n") == 1).select(*keys, "target", F.lit(rung).alias("resolution"))


def ancestors(bases: DataFrame) -> DataFrame:
    """``project, owner, base, depth`` of classes and those they inherit from, the nearest depth of each, at most
    ``MAX_BASES`` steps. ``bases``: project, source, target (class ids)."""
    step = bases.where(F.col("target").isNotNull()).select("project", F.col("source").alias("base"), F.col("target").alias("_next")).distinct()
    level = cut(step.select("project", F.col("base").alias("owner"), F.col("_next").alias("base"), F.lit(1).alias("depth")), "bases")
    whole = level
    for d in range(2, MAX_BASES + 1):
        nxt = level.join(step, ["project", "base"]).select("project", "owner", F.col("_next").alias("base"), F.lit(d).alias("depth"))
        level = cut(nxt.join(whole.select("project", "owner", "base"), ["project", "owner", "base"], "left_anti").where("owner <> base").distinct(), "bases")
        if level.isEmpty():
            break
        whole = whole.unionByName(level)
    return whole.groupBy("project", "owner", "base").agg(F.min("depth").alias("depth"))


def _owner(id_: Column, path: Column, parent: Column) -> Column:
    """What a method belongs to: its parent, in Go the type named in its id, within its folder."""
    go_type = F.regexp_extract(id_, r"::(\w+)\.\w+$", 1)
    return F.when(path.rlike(r"\.go$") & (go_type != ""), F.concat(F.regexp_replace(path, r"/?[^/]*$", ""), F.lit("::"), go_type)).otherwise(parent)


def resolve_calls(nodes: DataFrame, calls: DataFrame, facts: DataFrame | None = None, bases: DataFrame | None = None, go: DataFrame | None = None) -> DataFrame:
    """``project, source, callee, target, resolution, outcome`` of every distinct (source, callee), the first kept.

    Outcomes: bound (with the rung), external (``target`` is the imported name), skipped (builtin) or unresolved.
    ``bases`` (project, source, target) lets methods be found in the classes a class inherits from; ``go`` (project,
    file_path, go_module, go_folder) lets Go imports be found in the folders of the project.
    """
    key = ["project", "source", "callee"]
    calls = calls.groupBy(*key).agg(F.min("ordinal").alias("ordinal"))
    owner = nodes.select(
        "project", F.col("id").alias("source"), F.col("file_path").alias("file"), _owner(F.col("id"), F.col("file_path"), F.col("parent_id")).alias("owner"), language_of(F.col("file_path")).alias("language")
    )
    c = calls.join(owner, ["project", "source"], "left")
    parts = F.split("callee", r"\.")
    c = c.select("*", F.size(parts).alias("n"), F.get(parts, F.lit(0)).alias("head"), F.element_at(parts, -1).alias("last"))
    c = c.withColumn("folder", F.regexp_replace("file", r"/?[^/]*$", "")).withColumn("plain", ~F.col("callee").rlike(r"[(\[ ]") & (F.col("callee") != ""))
    empty_map = F.expr("map()").cast("map<string,string>")
    if facts is None:
        c = c.withColumn("imported", F.lit(None).cast("string")).withColumn("shadowed", F.lit(False)).withColumn("receiver", F.lit(None).cast("string")).withColumn("field_type", F.lit(None).cast("string"))
    else:
        f = facts.select("project", F.col("file_path").alias("file"), F.coalesce("imports", empty_map).alias("_imports"), "local_names", "receiver_names", "struct_fields")
        c = c.join(f, ["project", "file"], "left")
        c = c.withColumn("imported", F.try_element_at("_imports", "head")).withColumn("receiver", F.try_element_at("receiver_names", "source"))
        c = c.withColumn("shadowed", F.coalesce(F.array_contains(F.try_element_at("local_names", "source"), F.col("head")), F.lit(False)))
        owner_name = F.element_at(F.split(F.element_at(F.split("owner", "::"), -1), r"\."), -1)
        field = F.try_element_at(F.try_element_at("struct_fields", owner_name), F.get(parts, F.lit(1)))
        c = c.withColumn("field_type", F.regexp_replace(field, r"^[*\[\]]+|\[.*$", "")).drop("_imports", "local_names", "receiver_names", "struct_fields")
    c = cut(c, "calls")  # every rung reads it
    named = nodes.where(F.col("node_type").isin(*CALLABLE)).select(
        "project", F.col("id").alias("target"), "name", "node_type", F.col("file_path").alias("t_file"), _owner(F.col("id"), F.col("file_path"), F.col("parent_id")).alias("t_owner"), F.regexp_replace("file_path", r"/?[^/]*$", "").alias("t_folder")
    )
    ok = c.where("plain")
    # exact: the callee is an id
    exact = ok.join(nodes.select("project", F.col("id").alias("callee"), F.col("id").alias("target")), ["project", "callee"]).select(*key, "target", F.lit("exact").alias("resolution"))
    # self: this.m, self.m, receiver.m within the owner
    self_calls = ok.where((F.col("n") == 2) & (F.col("head").isin("self", "cls", "this") | (F.col("head") == F.col("receiver"))))
    own = named.select("project", F.col("t_owner").alias("owner"), F.col("name").alias("last"), "target")
    self_ = _single(self_calls.join(own, ["project", "owner", "last"]), key, "self")
    if bases is not None:  # the nearest class of those inherited from that has the method, if it is the only one
        up = self_calls.join(self_, key, "left_anti").join(ancestors(bases), ["project", "owner"])
        met = up.join(own.withColumnRenamed("owner", "base"), ["project", "base", "last"]).withColumn("_near", F.min("depth").over(Window.partitionBy(*key)))
        self_ = self_.unionByName(_single(met.where(F.col("depth") == F.col("_near")), key, "self"))
    # field type: receiver.field.m
    typed = named.where(F.col("t_owner").isNotNull()).withColumn("_type", F.element_at(F.split(F.element_at(F.split("t_owner", "::"), -1), r"\."), -1))
    fields = ok.where((F.col("n") == 3) & F.col("field_type").isNotNull())
    typed = fields.join(typed.select("project", F.col("_type").alias("field_type"), F.col("name").alias("last"), "target", "t_folder"), ["project", "field_type", "last"])
    field_ = _single(typed.where((F.col("language") != "go") | (F.col("t_folder") == F.col("folder"))), key, "field-type")
    # import: the head is bound by an import to a module of the project
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("t_file", r"\.[^./]+$", ""), r"(^|/)__init__$|/index$", ""), "/", ".")
    by_import = ok.where(F.col("imported").isNotNull() & ~F.col("shadowed"))
    python = F.col("language") == "python"
    spec = F.when(python, absolute_python(F.col("imported"), F.col("file"))).otherwise(F.regexp_replace(F.regexp_replace("imported", r"^\.+/?", ""), "/", "."))
    module = F.when(F.col("t_file").rlike(r"\.pyi?$"), python_module(F.col("t_file"))).otherwise(module)
    wanted = by_import.withColumn("want", F.when(F.col("n") == 1, F.regexp_replace(spec, r"[.:][^.:]*$", "")).otherwise(spec)).withColumn("name", F.when(F.col("n") == 1, F.element_at(F.split(spec, "[.:]"), -1)).otherwise(F.col("last")))
    import_ = _single(wanted.join(named.withColumn("want", module).select("project", "want", "name", "target"), ["project", "want", "name"]), key, "import")
    # JavaScript and TypeScript: a relative specification names a file; name and module are divided by a colon
    ecma = by_import.where(F.col("language").isin("javascript", "typescript") & F.col("imported").startswith("."))
    ecma = ecma.withColumn("spec", F.regexp_replace("imported", r":[^:]*$", "")).withColumn("_orig", F.regexp_extract("imported", r":([^:]*)$", 1))
    ecma = ecma.withColumn("name", F.when(F.col("n") == 1, F.col("_orig")).when((F.col("n") == 2) & (F.col("_orig") == "*"), F.col("last")))
    files = nodes.where(F.col("file_path").isNotNull()).select("project", "file_path").distinct()
    meant = resolve_imports(ecma.select("project", F.col("file").alias("file_path"), "spec"), files).where(F.col("target").isNotNull()).select("project", F.col("file_path").alias("file"), "spec", F.col("target").alias("t_file"))
    top_level = named.where(F.col("node_type") != "method").select("project", "t_file", "name", "target")
    import_ = import_.unionByName(_single(ecma.join(meant, ["project", "file", "spec"]).join(top_level, ["project", "t_file", "name"]), key, "import"))
    if go is not None:  # package.F and package.T.M in the folder that the import path names
        at = by_import.where((F.col("language") == "go") & F.col("n").isin(2, 3)).join(go.withColumnRenamed("file_path", "file"), ["project", "file"])
        at = at.withColumn("t_folder", go_folder_of(F.col("imported"), F.col("go_module"), F.col("go_folder"))).where(F.col("t_folder").isNotNull())
        of_type = F.regexp_extract(F.col("target"), r"::(?:(\w+)\.)?\w+$", 1)
        there = named.select("project", "t_folder", F.col("name").alias("last"), of_type.alias("_owner"), "target", F.col("t_file").rlike(r"\.go$").alias("_go")).where("_go")
        at = at.withColumn("_owner", F.when(F.col("n") == 3, F.get(parts, F.lit(1))).otherwise(F.lit("")))
        import_ = import_.unionByName(_single(at.join(there, ["project", "t_folder", "last", "_owner"]), key, "import"))
    # Class.method of the same file
    in_class = ok.where((F.col("n") == 2) & (F.col("language") == "python") & ~F.col("shadowed"))
    classes = named.where(F.col("node_type") == "method").withColumn("head", F.element_at(F.split(F.element_at(F.split("t_owner", "::"), -1), r"\."), -1))
    of_class = _single(in_class.join(classes.select("project", F.col("t_file").alias("file"), "head", F.col("name").alias("last"), "target"), ["project", "file", "head", "last"]), key, "same-module")
    # bare names: same module, then (Go) the same package
    bare = ok.where((F.col("n") == 1) & ~F.col("shadowed"))
    top = named.where(F.col("node_type") != "method")
    same = _single(bare.join(top.select("project", F.col("t_file").alias("file"), F.col("name").alias("callee"), "target"), ["project", "file", "callee"]), key, "same-module")
    package = bare.where(F.col("language") == "go").join(top.select("project", F.col("t_folder").alias("folder"), F.col("name").alias("callee"), "target"), ["project", "folder", "callee"])
    package = _single(package, key, "same-package")
    rungs = [exact, import_, field_, self_, same, package, of_class]
    found = None
    for i, r in enumerate(rungs):
        r = r.withColumn("_rank", F.lit(i))
        found = r if found is None else found.unionByName(r)
    best = found.groupBy(*key).agg(F.min(F.struct("_rank", "target", "resolution")).alias("b"))
    whole = c.join(best, key, "left")
    # an import of the project itself that no rung could bind is unresolved, not external
    top = F.regexp_extract("imported", r"^([^.:/]*)", 1)
    packages = nodes.where(F.col("node_type").isin("module") & F.col("file_path").rlike(r"\.py$")).select("project", F.regexp_extract(python_module(F.col("file_path")), r"^([^.]+)", 1).alias("_top")).distinct()
    whole = whole.withColumn("_top", top).join(packages.withColumn("_own", F.lit(True)), ["project", "_top"], "left")
    inside = F.when(F.col("language") == "python", F.col("_own").isNotNull() | F.col("imported").startswith(".")).when(F.col("language").isin("javascript", "typescript"), F.col("imported").startswith("."))
    if go is not None:
        whole = whole.join(go.withColumnRenamed("file_path", "file"), ["project", "file"], "left")
        inside = inside.when(F.col("language") == "go", go_folder_of(F.col("imported"), F.col("go_module"), F.col("go_folder")).isNotNull())
    inside = F.coalesce(inside, F.lit(False))
    outcome = (
        F.when(F.col("b").isNotNull(), "bound").when(F.col("plain") & F.col("imported").isNotNull() & ~F.col("shadowed") & ~inside, "external").when(F.col("plain") & (F.col("n") == 1) & ~F.col("shadowed") & _flat("callee", F.col("language")), "skipped").otherwise("unresolved")
    )
    return whole.select(*key, "ordinal", F.coalesce("b.target", F.when(outcome == "external", F.col("imported"))).alias("target"), F.col("b.resolution").alias("resolution"), outcome.alias("outcome"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """CALLS edges, one per (source, target): of several callees the first by ordinal."""
    w = Window.partitionBy("project", "source", "target").orderBy("ordinal", "callee")
    bound = resolved.where(F.col("outcome") == "bound").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return bound.select("project", "source", F.lit("CALLS").alias("edge_type"), "target", "resolution", F.col("callee").alias("callee_text"))


def with_provenance(nodes: DataFrame, covered: DataFrame | None = None, tool: str = "scip") -> DataFrame:
    """Modules with ``calls_provenance``: ``heuristic``, or the index tool's name for files (project, file_path) it covers.

    Other nodes keep what they have.
    """
    mark = F.lit("heuristic")
    if covered is not None:
        nodes = nodes.join(covered.select("project", "file_path", F.lit(tool).alias("_tool")).distinct(), ["project", "file_path"], "left")
        mark = F.coalesce("_tool", mark)
    kept = F.col("calls_provenance") if "calls_provenance" in nodes.columns else F.lit(None).cast("string")
    return nodes.withColumn("calls_provenance", F.when(F.col("node_type") == "module", mark).otherwise(kept)).drop("_tool")


def honest_lists(resolved: DataFrame) -> DataFrame:
    """Of each source the sorted distinct external and unresolved callees, at most 100 of at most 200 characters."""
    pick = lambda o: F.slice(F.sort_array(F.collect_set(F.when(F.col("outcome") == o, F.substring("callee", 1, MAX_TEXT)))), 1, MAX_LIST)
    return resolved.groupBy("project", "source").agg(pick("external").alias("external_calls"), pick("unresolved").alias("unresolved_calls"))


def resolve_bases(nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """INHERITS and IMPLEMENTS by name (project, source, edge_type, base): a single match, else one of the same file,
    else the smallest id; without a match the raw name stays."""
    named = nodes.where(F.col("node_type").isin("class", "struct", "interface", "enum", "trait")).select("project", F.col("name").alias("base"), F.col("id").alias("target"), F.col("file_path").alias("t_file"))
    own = nodes.select("project", F.col("id").alias("source"), "file_path")
    c = bases.join(own, ["project", "source"], "left").join(named, ["project", "base"], "left")
    best = F.min(F.struct((F.coalesce(F.col("t_file"), F.lit("")) != F.coalesce(F.col("file_path"), F.lit(""))).alias("far"), "target")).getField("target")
    return c.groupBy("project", "source", "edge_type", "base").agg(F.coalesce(best, F.col("base")).alias("target"), (best.isNotNull()).alias("bound"))


def externalise(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, externals): unknown targets of IMPORTS and INHERITS become ``ext:`` nodes, other unknown edges are dropped."""
    known = nodes.select("project", F.col("id").alias("target"))
    good = edges.join(known, ["project", "target"], "left_semi")
    unknown = edges.join(known, ["project", "target"], "left_anti").where(F.col("edge_type").isin("IMPORTS", "INHERITS") & F.col("target").isNotNull())
    files = nodes.select("project", F.col("id").alias("source"), language_of(F.col("file_path"), None).alias("language"))
    kind = F.when(F.col("edge_type") == "IMPORTS", "module").otherwise("type")
    out = unknown.join(files, ["project", "source"], "left").withColumn("kind", kind).withColumn("ext", F.concat(F.lit("ext:"), kind, F.lit(":"), F.col("target")))
    externals = out.groupBy("project", F.col("ext").alias("id")).agg(
        F.min("target").alias("name"), F.min(external_root(F.col("target"), F.col("language"))).alias("root"), F.min("kind").alias("kind"), F.min("language").alias("language")
    )
    return good.unionByName(out.withColumn("target", F.col("ext")).select(*good.columns)), externals


def directories(files: DataFrame) -> DataFrame:
    """Directory nodes and CONTAINS edges of file paths (project, file_path): ``project, id, name, parent_id, edge_source, edge_target``."""
    parts = F.split("file_path", "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k")
    levels = files.select("project", "file_path", parts.alias("p"), depth)
    folder = lambda n: F.when(n <= 0, F.lit("dir:.")).otherwise(F.concat(F.lit("dir:"), F.array_join(F.slice("p", 1, n), "/")))
    here = folder(F.col("k"))
    child = F.when(F.col("k") == F.size("p") - 1, F.col("file_path")).otherwise(folder(F.col("k") + 1))
    return levels.select("project", here.alias("edge_source"), child.alias("edge_target")).distinct()


def semantic_calls(occurrences: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls from index occurrences (project, file_path, line from 0, symbol, roles): definitions name nodes, references
    within the innermost callable become edges; self-calls and module-level references are left out."""
    from grovework.operators.traverse import innermost

    occ = occurrences.where(~F.col("symbol").startswith("local ")).withColumn("line", F.col("line") + 1)
    callables = nodes.where(F.col("node_type").isin("function", "method"))
    # what a symbol may name follows from its suffix: types only in Python files, where a call of a class is a call
    of_type, of_call = F.col("symbol").endswith("#") & F.col("file_path").endswith(".py"), F.col("symbol").endswith(".")
    defs = occ.where((F.col("roles").bitwiseAND(1) == 1) & (of_type | of_call))
    spans = nodes.where(F.col("node_type").isin("function", "method", "class", "struct"))
    starts = spans.select("project", "file_path", F.col("line_start").alias("line"), F.col("id").alias("node"), F.col("node_type").isin("class", "struct").alias("_type"))
    first = F.min(F.struct("file_path", "line", "node")).getField("node").alias("target")
    symbol = defs.join(starts, ["project", "file_path", "line"]).where(F.col("_type") == of_type).groupBy("project", "symbol").agg(first)
    refs = occ.where(F.col("roles").bitwiseAND(1) == 0)
    at = innermost(callables, refs.select("project", "file_path", "line").distinct())
    joined = refs.join(at, ["project", "file_path", "line"]).join(symbol, ["project", "symbol"], "left")
    name = F.regexp_replace(F.element_at(F.split("symbol", " "), -1), r"[`()#]|\.$", "")
    return joined.where((F.col("target").isNull() & F.col("symbol").endswith("().")) | (F.col("target") != F.col("span"))).select(
        "project", F.col("span").alias("source"), "target", F.when(F.col("target").isNull(), name).alias("external"), F.lit("semantic").alias("resolution")
    ).distinct()


def clear_unresolved(nodes: DataFrame, covered: DataFrame) -> DataFrame:
    """Nodes with an empty ``unresolved_calls`` where their file (project, file_path) is covered by an index."""
    c = nodes.join(covered.select("project", "file_path", F.lit(True).alias("_c")).distinct(), ["project", "file_path"], "left")
    empty = F.array().cast("array<string>")
    gone = F.col("_c") & F.col("node_type").isin("function", "method")
    return c.withColumn("unresolved_calls", F.when(gone, empty).otherwise(F.col("unresolved_calls"))).select(*nodes.columns)


def merge_semantic(heuristic: DataFrame, semantic: DataFrame, nodes: DataFrame, covered: DataFrame) -> DataFrame:
    """Covered files replace the heuristic calls of their functions and methods by semantic ones; other edges stay."""
    inside = nodes.where(F.col("node_type").isin("function", "method")).join(covered, ["project", "file_path"], "left_semi").select("project", F.col("id").alias("source"))
    stay = heuristic.where(F.col("edge_type") != "CALLS").unionByName(heuristic.where(F.col("edge_type") == "CALLS").join(inside, ["project", "source"], "left_anti"))
    new = semantic.where(F.col("target").isNotNull()).select("project", "source", F.lit("CALLS").alias("edge_type"), "target", "resolution", F.lit("").alias("callee_text"))
    return stay.unionByName(new.select(*stay.columns))
