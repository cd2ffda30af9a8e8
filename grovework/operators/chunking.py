"""Chunk windows, context texts, stitching of chunks back to source."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovework.functions.text import chunk_id, scan_match
from grovework.runtime import ship

WINDOW_LINES, OVERLAP_LINES = 80, 12


def lines_of(text) -> "F.Column":
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def body_windows(bodies: DataFrame, size: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> DataFrame:
    """Windows of ``size`` lines that overlap by ``overlap`` over bodies (keys, ``line_start``, ``line_end``, ``lines``)."""
    step = size - overlap
    n = F.size("lines")
    count = F.greatest(F.ceil((n - F.lit(overlap)) / F.lit(float(step))).cast("int"), F.lit(1))
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)
    rest = [c for c in bodies.columns if c not in ("line_start", "line_end", "lines")]
    w = bodies.where(n > 0).select(*rest, "line_start", "lines", F.posexplode(starts).alias("window", "_at"))
    text = F.array_join(F.slice("lines", F.col("_at") + 1, size), "\n")
    end = F.col("line_start") + F.least(F.col("_at") + size, F.size("lines")) - 1
    out = w.select(*rest, "window", text.alias("content"), (F.col("line_start") + F.col("_at")).alias("start_line"), end.alias("end_line"))
    return out.where(F.col("content").rlike(r"\S"))


def node_bodies(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Functions and methods with the lines of their source range."""
    n = nodes.where(F.col("node_type").isin("function", "method") & F.col("line_start").isNotNull() & (F.col("line_end") >= F.col("line_start")))
    body = F.slice(lines_of(F.col("content")), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
    return n.select("project", "id", "file_path", "line_start", "line_end").join(files.select("project", "file_path", "content"), ["project", "file_path"]).select(
        "project", "id", "file_path", "line_start", "line_end", body.alias("lines")
    )


def char_windows(docs: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """Fixed windows of characters: step = size - min(overlap, size - 1); blank windows are dropped."""
    overlap = min(overlap, size - 1)
    step = size - overlap
    n = F.length(F.col(text))
    count = F.greatest(F.ceil((n - F.lit(overlap)) / F.lit(float(step))).cast("int"), F.lit(1))
    w = docs.where(n > 0).select(*keys, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    return w.select(*keys, "window", F.substring("_t", F.col("window") * step + 1, F.lit(size)).alias("content")).where(F.col("content").rlike(r"\S"))


def with_ids(chunks: DataFrame) -> DataFrame:
    c = F.col
    return chunks.withColumn("derived_id", chunk_id(c("node_id"), c("file_path"), c("start_line"), c("end_line"), c("chunk_kind"), c("content")))


def stitch(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping chunks of a group merged to one text: every line once (from the first chunk that has it), a blank line
    where lines are missing; ``first_line`` is where the text starts."""
    line = chunks.select(*keys, "start_line", "id", F.posexplode(lines_of(F.col("content"))).alias("_i", "text")).withColumn("line", F.col("start_line") + F.col("_i"))
    one = line.groupBy(*keys, "line").agg(F.min(F.struct("start_line", "id", "text")).getField("text").alias("text"))
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    merged = one.groupBy(*keys).agg(rows.alias("r"))
    gap = F.transform(
        F.col("r"),
        lambda x, i: F.when((i > 0) & (x["line"] > F.get(F.col("r"), i - 1)["line"] + 1), F.concat(F.lit("\n"), x["text"])).otherwise(x["text"]),
    )
    return merged.select(*keys, F.get("r", F.lit(0))["line"].alias("first_line"), F.size("r").alias("n_lines"), F.array_join(gap, "\n").alias("text"))


def module_context(nodes: DataFrame) -> DataFrame:
    """Of each module the text of its context chunk: path, docstring and its direct children in order; lines 1 to 80 at most."""
    kid = nodes.where(F.col("parent_id").isNotNull()).select(
        "project",
        F.col("parent_id").alias("id"),
        F.struct(F.coalesce("line_start", F.lit(0)).alias("a"), F.col("id").alias("b"), F.concat_ws(" ", "node_type", F.coalesce("signature", "name")).alias("t")).alias("x"),
    )
    kids = kid.groupBy("project", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("kids"))
    m = nodes.where(F.col("node_type") == "module").join(kids, ["project", "id"], "left")
    return m.select(
        "project",
        "id",
        F.lit("module_context").alias("chunk_kind"),
        F.concat_ws("\n", F.concat(F.lit("module "), "file_path"), F.when(F.col("docstring") != "", F.col("docstring")), "kids").alias("content"),
        F.lit(1).alias("start_line"),
        F.least(F.greatest(F.coalesce("line_end", F.lit(1)), F.lit(1)), F.lit(80)).alias("end_line"),
    )


def class_context(nodes: DataFrame) -> DataFrame:
    """Of each class (no struct, interface, enum or trait) its context: signature, docstring and members in order.

    The range begins at the class and has 80 lines at most.
    """
    kid = nodes.where(F.col("parent_id").isNotNull()).select(
        "project",
        F.col("parent_id").alias("id"),
        F.struct(F.coalesce("line_start", F.lit(0)).alias("a"), F.col("id").alias("b"), F.concat_ws(" ", "node_type", F.coalesce("signature", "name")).alias("t")).alias("x"),
    )
    kids = kid.groupBy("project", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("kids"))
    c = nodes.where(F.col("node_type") == "class").join(kids, ["project", "id"], "left")
    start = F.coalesce("line_start", F.lit(1))
    return c.select(
        "project",
        "id",
        F.lit("class_context").alias("chunk_kind"),
        F.concat_ws("\n", F.coalesce(F.when(F.col("signature") != "", F.col("signature")), F.concat(F.lit("class "), F.coalesce("name", F.lit("")))), F.when(F.col("docstring") != "", F.col("docstring")), "kids").alias("content"),
        start.alias("start_line"),
        F.least(F.greatest(F.coalesce("line_end", start), start), start + WINDOW_LINES).alias("end_line"),
    )


_SENTENCES = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|\n+|$)\s*")


def sentence_windows(text: str, size: int = 800, overlap: int = 200) -> list[tuple[int, int]]:
    """(from, to) of windows of at most ``size`` words made of whole sentences, each beginning with the sentences of at
    most ``overlap`` words before it; a longer sentence is cut between words."""
    parts: list[tuple[int, int, int]] = []
    for m in _SENTENCES.finditer(text):
        words = [w.span() for w in re.finditer(r"\S+", m.group())]
        for k in range(0, len(words), size):
            own = words[k : k + size]
            end = m.end() if k + size >= len(words) else m.start() + words[k + size][0]
            parts.append((m.start() + own[0][0], end, len(own)))
    out, i = [], 0
    while i < len(parts):
        j, n = i, 0
        while j < len(parts) and n + parts[j][2] <= size:
            n += parts[j][2]
            j += 1
        out.append((parts[i][0], parts[j - 1][1]))
        if j == len(parts):
            break
        back, n = j, 0
        while back - 1 > i and n + parts[back - 1][2] <= overlap and n + parts[back - 1][2] + parts[j][2] <= size:
            back -= 1
            n += parts[back][2]
        i = back
    return out


def document_windows(docs: DataFrame, keys: list[str], text: str, size: int = 800, overlap: int = 200) -> DataFrame:
    """``keys, window, content, start_line, end_line`` of sentence windows over whole texts; blank texts have none."""
    ship(docs.sparkSession)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own in pdf.itertuples(index=False, name=None):
                t = own[-1] or ""
                for k, (a, b) in enumerate(sentence_windows(t, size, overlap)):
                    piece = t[a:b].rstrip()
                    first = t.count("\n", 0, a) + 1
                    rows.append((*own[:-1], k, piece, first, first + piece.count("\n")))
            yield pd.DataFrame(rows, columns=[*keys, "window", "content", "start_line", "end_line"])

    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("window", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
    return docs.where(F.col(text).isNotNull()).select(*keys, F.regexp_replace(text, "\r\n?", "\n").alias(text)).mapInPandas(cut_up, schema)


def repository_chunks(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """All chunks of a code graph: ``project, node_id, file_path, chunk_kind, content, start_line, end_line, id``.

    Documents in sentence windows; of code the contexts of modules and classes and the bodies of functions and methods.
    Blank chunks are dropped.
    """
    cols = ["project", "node_id", "file_path", "chunk_kind", "content", "start_line", "end_line"]
    docs = nodes.where(F.col("node_type") == "document").select("project", F.col("id").alias("node_id"), "file_path").join(files.select("project", "file_path", "content"), ["project", "file_path"])
    windows = document_windows(docs, ["project", "node_id", "file_path"], "content").withColumn("chunk_kind", F.lit("document"))
    bodies = body_windows(node_bodies(nodes, files)).withColumn("chunk_kind", F.lit("function_body")).withColumnRenamed("id", "node_id")
    path = nodes.select("project", F.col("id").alias("node_id"), "file_path")
    contexts = module_context(nodes).unionByName(class_context(nodes)).withColumnRenamed("id", "node_id").join(path, ["project", "node_id"])
    every = windows.select(cols).unionByName(bodies.select(cols)).unionByName(contexts.select(cols)).where(F.col("content").rlike(r"\S"))
    c = F.col
    return every.withColumn("id", chunk_id(c("node_id"), c("file_path"), c("start_line"), c("end_line"), c("chunk_kind"), c("content")))


def line_of(text: Column, piece: Column) -> Column:
    """The line (from 1) on which the first 200 characters of a piece are found in a text; 1 if they are not."""
    at = F.instr(text, F.substring(piece, 1, 200))
    return F.when(at > 0, F.length(F.regexp_replace(F.substr(text, F.lit(1), at - 1), "[^\n]", "")) + 1).otherwise(1)


def upsert_chunks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by id: incoming chunks win, but keep the stored vector where they have none."""
    key = ["project", "id"]
    old = stored.select(*key, F.col("embedding").alias("_v"))
    new = incoming.join(old, key, "left").withColumn("embedding", F.coalesce("embedding", "_v")).drop("_v")
    return stored.join(incoming.select(*key), key, "left_anti").unionByName(new.select(*stored.columns))


def embed(df: DataFrame, text: str, function: Callable[[list[str]], list[list[float]]], most_texts: int = 50, most_chars: int = 80_000, tries: int = 5) -> DataFrame:
    """``df`` with ``vector``: texts in order, in batches of at most ``most_texts`` and ``most_chars`` characters.

    Blank and null texts are embedded as one space. A batch that fails ``tries`` times, or gives another number of
    vectors than texts, has null vectors; other batches are not affected.
    """
    ship(df.sparkSession)

    def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and end - at < most_texts and (end == at or chars + len(texts[end]) <= most_chars):
                chars += len(texts[end])
                end += 1
            yield at, end
            at = end

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [t if t and t.strip() else " " for t in pdf[text]]
            vectors: list = [None] * len(texts)
            for a, b in batches_of(texts):
                for _ in range(tries):
                    try:
                        got = function(texts[a:b])
                    except Exception:  # whatever the model's client raises
                        continue
                    if len(got) == b - a:
                        vectors[a:b] = [list(map(float, v)) for v in got]
                        break
            yield pdf.assign(vector=pd.Series(vectors, index=pdf.index, dtype="object"))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def covered_files(chunks: DataFrame) -> DataFrame:
    """``project, file_path`` of the files all of whose chunks have a vector (only these are stamped as covered)."""
    missing = F.max(F.col("embedding").isNull()).alias("_m")
    return chunks.where(F.col("file_path").isNotNull()).groupBy("project", "file_path").agg(missing).where(~F.col("_m")).drop("_m")


def cost_of_paths(files: DataFrame, patterns: list[str]) -> DataFrame:
    """``cost`` of the files that match any of the patterns."""
    return cost(files.where(scan_match(F.col("file_path"), patterns)))


def over_budget(costs: DataFrame, budget: float) -> DataFrame:
    """Projects whose estimated cost exceeds ``budget``: these need a confirmation first."""
    return costs.where(F.col("cost") > budget).select("project", "cost")


def cost(files: DataFrame, in_price: float = 0.25, out_price: float = 1.5, embed_price: float = 0.02) -> DataFrame:
    """Estimated cost of indexing per project: tokens are bytes // 4, nodes are lines // 10, prices per million tokens."""
    f = files.select("project", F.octet_length("content").alias("bytes"), (F.length(F.regexp_replace("content", "[^\n]", "")) + 1).alias("lines")).where(F.col("bytes").isNotNull())
    t = f.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.floor(F.col("lines") / 10)).alias("nodes"), F.sum(F.floor(F.col("bytes") / 4)).alias("tokens"))
    spent = ((F.col("tokens") + 250 * F.col("nodes")) * in_price + 90 * F.col("nodes") * out_price + (F.col("tokens") + 90 * F.col("nodes")) * embed_price) / 1e6
    return t.withColumn("cost", F.round(spent, 4))
