"""Import specifications to files of the project: module index, prefix popping, relative paths, Go directories.

Defined results
* a specification that names no file of the project has a null ``target``; of several readings the longest, then the
  first in the order of suffixes wins; files of other projects are never met;
* a null specification or file gives no row; repeated imports of a file give one row; no files: no targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovework.functions.text import language_of

#: Suffixes a JavaScript or TypeScript specification may leave out, in the order they are tried.
ECMA_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def python_module(path: Column) -> Column:
    """Dotted name of a Python file: without suffix, leading ``src`` and trailing ``__init__``."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"(^|/)__init__$", "")
    return F.regexp_replace(F.regexp_replace(bare, "/", "."), r"^src\.", "")


def rust_module(path: Column) -> Column:
    """``crate::`` path of a Rust file: what is below ``src``, without ``mod``, ``lib`` and ``main``."""
    below = F.regexp_replace(F.regexp_replace(path, r"\.rs$", ""), r"^(.*/)?src/", "")
    bare = F.regexp_replace(below, r"(^|/)(mod|lib|main)$", "")
    return F.when(bare == "", F.lit("crate")).otherwise(F.concat(F.lit("crate::"), F.regexp_replace(bare, "/", "::")))


def module_index(files: DataFrame) -> DataFrame:
    """``project, language, key, target``: by what a file of (project, file_path) is imported.

    Python by dotted name, JavaScript and TypeScript by path, Go by folder (its last file), Rust by crate path.
    """
    path, lang = F.col("file_path"), language_of(F.col("file_path"), None)
    lang = F.when(lang == "typescript", "javascript").otherwise(lang).alias("language")
    rows = files.where(F.col("project").isNotNull() & path.isNotNull()).select("project", "file_path", lang).distinct()
    key = (
        F.when(F.col("language") == "python", python_module(path))
        .when(F.col("language") == "javascript", path)
        .when(F.col("language") == "go", folder_of(path))
        .when(F.col("language") == "rust", rust_module(path))
    )
    return rows.withColumn("key", key).where(F.col("key").isNotNull()).groupBy("project", "language", "key").agg(F.max("file_path").alias("target"))


def joined_path(folder: Column, spec: Column) -> Column:
    """``spec`` seen from ``folder``, with ``.`` and ``..`` resolved; null if it leaves the top."""
    parts = F.split(F.concat_ws("/", folder, spec), "/")
    step = lambda acc, x: (
        F.when(acc.isNull() | x.isin("", "."), acc)
        .when(x != "..", F.concat(acc, F.array(x)))
        .when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def absolute_python(spec: Column, path: Column) -> Column:
    """The dotted name a Python specification stands for: leading dots count from the file's package."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.regexp_replace(spec, r"^\.+", "")
    package = F.filter(F.split(F.regexp_replace(folder_of(path), r"^src(/|$)", ""), "/"), lambda x: x != "")
    kept = F.size(package) - (dots - 1)
    base = F.array_join(F.slice(package, 1, F.greatest(kept, F.lit(0))), ".")
    relative = F.when(kept >= 0, F.concat_ws(".", F.when(base != "", base), F.when(rest != "", rest)))
    return F.when(dots == 0, spec).otherwise(relative)


def _prefixes(name: Column, mark: str) -> Column:
    parts = F.split(name, mark)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), mark.replace("\\", "")))


def go_modules(files: DataFrame) -> DataFrame:
    """``project, folder, go_module`` of every go.mod among files (project, file_path, content)."""
    mod = F.regexp_extract("content", r"(?m)^\s*module\s+\"?([^\s\"]+)", 1)
    own = files.where(F.col("file_path").rlike(r"(^|/)go\.mod$")).select("project", folder_of(F.col("file_path")).alias("folder"), mod.alias("go_module"))
    return own.where(F.col("go_module") != "").groupBy("project", "folder").agg(F.max("go_module").alias("go_module"))


def go_owner(files: DataFrame, modules: DataFrame) -> DataFrame:
    """``project, file_path, go_module, go_folder`` of Go files: the go.mod of the nearest folder above."""
    go = files.where(F.col("file_path").rlike(r"\.go$")).select("project", "file_path").distinct()
    parts = F.split(folder_of(F.col("file_path")), "/")
    ups = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder")
    hit = go.select("project", "file_path", ups).join(modules, ["project", "folder"])
    nearest = F.max(F.struct(F.length("folder").alias("n"), "folder", "go_module")).alias("m")
    return hit.groupBy("project", "file_path").agg(nearest).select("project", "file_path", "m.go_module", F.col("m.folder").alias("go_folder"))


def go_folder_of(spec: Column, go_module: Column, go_folder: Column) -> Column:
    """The folder of the project an import path names; null outside its module."""
    inside = (spec == go_module) | spec.startswith(F.concat(go_module, F.lit("/")))
    rest = F.regexp_replace(F.substr(spec, F.length(go_module) + 1), "^/", "")
    return F.when(inside, F.concat_ws("/", F.when(go_folder != "", go_folder), F.when(rest != "", rest)))


def resolve_imports(imports: DataFrame, files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """``project, file_path, spec, target`` of imports (project, file_path, spec): the file meant, or null.

    ``files`` are (project, file_path); ``modules`` as of ``go_modules``.
    """
    index = module_index(files)
    lang = language_of(F.col("file_path"), None)
    rows = imports.where(F.col("project").isNotNull() & F.col("file_path").isNotNull() & F.col("spec").isNotNull()).select("project", "file_path", "spec").distinct()
    rows = rows.withColumn("language", F.when(lang == "typescript", "javascript").otherwise(lang))
    if modules is not None:
        rows = rows.join(go_owner(files, modules), ["project", "file_path"], "left")
    else:
        rows = rows.withColumn("go_module", F.lit(None).cast("string")).withColumn("go_folder", F.lit(None).cast("string"))
    spec, none = F.col("spec"), F.array().cast("array<string>")
    dotted = absolute_python(spec, F.col("file_path"))
    near = joined_path(folder_of(F.col("file_path")), spec)
    # candidates from the least to the most wanted
    ecma = F.transform(F.array(*[F.lit(x) for x in reversed(ECMA_SUFFIXES)]), lambda x: F.concat(near, x))
    crate = F.regexp_replace(F.regexp_replace(spec, r"\s+as\s+\w+$", ""), r"\s|\{.*$|::\*$|::$", "")
    wanted = (
        F.when((F.col("language") == "python") & dotted.isNotNull() & (dotted != ""), _prefixes(dotted, "\\."))
        .when((F.col("language") == "javascript") & spec.startswith("."), ecma)
        .when((F.col("language") == "go"), F.array_compact(F.array(go_folder_of(spec, F.col("go_module"), F.col("go_folder")))))
        .when((F.col("language") == "rust"), _prefixes(crate, "::"))
        .otherwise(none)
    )
    tried = rows.select("project", "file_path", "spec", "language", F.posexplode(F.coalesce(wanted, none)).alias("place", "key"))
    # a bare ``crate`` is the top of every path and says nothing
    tried = tried.where(~((F.col("language") == "rust") & (F.col("key") == "crate") & (F.col("spec") != "crate")))
    met = tried.join(index, ["project", "language", "key"]).where(F.col("target") != F.col("file_path"))
    best = met.groupBy("project", "file_path", "spec").agg(F.max(F.struct("place", "target")).getField("target").alias("target"))
    return rows.select("project", "file_path", "spec").join(best, ["project", "file_path", "spec"], "left")


def import_edges(edges: DataFrame, nodes: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Edges (project, source, edge_type, target, ...) with the targets of IMPORTS turned into file ids where they are known."""
    files = nodes.where(F.col("node_type").isin("module", "document")).select("project", "file_path")
    imports = edges.where(F.col("edge_type") == "IMPORTS").select("project", F.col("source").alias("file_path"), F.col("target").alias("spec"))
    found = resolve_imports(imports, files, modules).where(F.col("target").isNotNull())
    found = found.select("project", F.col("file_path").alias("source"), F.col("spec").alias("target"), F.col("target").alias("_file"), F.lit("IMPORTS").alias("edge_type"))
    return edges.join(found, ["project", "source", "target", "edge_type"], "left").withColumn("target", F.coalesce("_file", "target")).select(*edges.columns).distinct()
