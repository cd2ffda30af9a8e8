"""Problem 5: splitting oversized items at natural boundaries.

Only items over the limit reach Python (the limit is joined in the JVM; ``chunk_limits`` has one row per kind). Each is
cut by agglomerative merging: its atomic segments (lines, and for longer lines sentences, words, at last bare character
runs) form a chain; a heap holds the boundaries between neighbours, and the weakest boundary is merged first while the
merged piece plus the overlap stays within the limit. What remains are the strong boundaries: blank lines before less
indented text, blank lines, line ends, sentence ends, spaces.

Defined results
* a length is a number of code points; an item exactly at the limit is not cut;
* every piece but the first starts with the last ``overlap`` characters of the text before it, so that a piece without
  its overlap (``overlap_chars`` column) joined to the others gives the text back exactly;
* the overlap is kept as it is asked for as long as it is below the limit; one of the limit or more is reduced to the
  limit less one, so that every piece brings new text; it begins where the text begins;
* a null kind means ``fallback_text``; a kind without a limit is never cut; null or empty content is never cut;
* repeated rows of an item (same project and id) count once, of different ones one that is over its limit, then
  the newest, then the greatest; a null id is a key like any other value;
* ``start_line``/``end_line`` are the lines of a piece's first and last character; where the content only describes its
  range (the context kinds) or the item has no lines, the item's own values stay;
* every item is returned, an unsplit one as a single piece; ``chunk_index``: the items of one node, file and kind keep
  their order (by index, among equal ones by a hash of the id), each moved on by the pieces the items before it gained, so that pieces collide with no later item; an
  item of no node and no file is numbered by itself; a null index counts as 0;
* no items: no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovework.runtime import cut, ship

CONTEXT_KINDS = ["class_context", "module_context"]

_SENTENCE = re.compile(r"(?<=[.!?;:])(?=\s)|(?<=[。！？])")
_WORD = re.compile(r"(?<=\s)(?=\S)")


def _atoms(text: str, most: int) -> list[tuple[int, float]]:
    """(end, strength of the boundary at that end) of atomic segments of at most ``most`` characters."""
    out: list[tuple[int, float]] = []
    lines = text.splitlines(keepends=True)
    indents = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines]
    following, nxt = [0] * len(lines), 0
    for i in range(len(lines) - 1, -1, -1):
        following[i] = nxt
        if indents[i] >= 0:
            nxt = indents[i]
    at = 0
    for i, line in enumerate(lines):
        end = at + len(line)
        if len(line) > most:
            out += _finer(text, at, end, most, (_SENTENCE, _WORD), 2.0)
        # a boundary is the stronger the less the text after it is indented
        indent = min(following[i], 40) / 41
        out.append((end, (4.0 if indents[i] < 0 else 3.0) + (1 - indent) * 0.99))
        at = end
    return out


def _finer(text: str, at: int, end: int, most: int, levels: tuple, strength: float) -> list[tuple[int, float]]:
    """Boundaries strictly inside text[at:end]: at matches of the first level, and finer ones in longer parts."""
    out: list[tuple[int, float]] = []
    if not levels:
        return [(x, 0.0) for x in range(at + most, end, most)]
    cuts = [m.start() for m in levels[0].finditer(text, at + 1, end - 1)] + [end]
    for c in cuts:
        if c - at > most:
            out += _finer(text, at, c, most, levels[1:], strength - 1)
        if c < end:
            out.append((c, strength))
        at = c
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, start of new text, end) of each piece of ``text``."""
    if limit < 1:
        raise ValueError("a limit must be positive")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    most = limit - overlap
    atoms = _atoms(text, most)
    n = len(atoms)
    start = [0] + [e for e, _ in atoms[:-1]]
    end = [e for e, _ in atoms]
    right, last, alive = list(range(1, n + 1)), list(range(n)), [True] * n
    # (strength, left segment, right segment): among equal boundaries the leftmost first, so that pieces fill up
    heap = [(atoms[i][1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or right[a] != b:
            continue
        if end[b] - start[a] > (limit if start[a] == 0 else most):
            continue  # segments only grow: this boundary stays
        end[a], alive[b] = end[b], False
        right[a], last[a] = right[b], last[b]
        if right[a] < n:  # the boundary on the right now belongs to the merged segment
            heapq.heappush(heap, (atoms[last[a]][1], a, right[a]))
    return [(max(0, start[i] - overlap) if start[i] else 0, start[i], end[i]) for i in range(n) if alive[i]]


_PIECES = (
    "rid long, project string, id string, node_id string, file_path string, chunk_kind string, language string, item_index int, "
    "piece int, n_pieces int, content string, start_line int, end_line int, overlap_chars int"
)
_COLUMNS = [x.split()[0] for x in _PIECES.split(", ")]
_NAMES = _COLUMNS[1:]
_ITEM = ["node_id", "file_path", "chunk_kind", "language", "content", "start_line", "end_line", "chunk_index"]

INDEX_BLOCK = 512  # indexes of a node that one task numbers


def _cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            text = r.content
            spans = split_text(text, int(r.max_chars), int(r.overlap_chars))
            plain = r.chunk_kind not in CONTEXT_KINDS and pd.notna(r.start_line)
            line, at = (int(r.start_line) if plain else 0), 0
            for k, (lo, new, hi) in enumerate(spans):
                if plain:
                    line, at = line + text.count("\n", at, lo), lo
                    first, last = line, line + text.count("\n", lo, hi - 1)
                else:
                    first, last = (None if pd.isna(x) else int(x) for x in (r.start_line, r.end_line))
                rows.append(
                    (r.rid, r.project, r.id, r.node_id, r.file_path, r.chunk_kind, r.language, r.chunk_index, k, len(spans), text[lo:hi], first, last, new - lo)
                )
        out = pd.DataFrame(rows, columns=_COLUMNS)
        for c in ("item_index", "start_line", "end_line"):
            out[c] = out[c].astype("Int32")
        yield out


def limited(chunks: DataFrame, limits: DataFrame, only_over: bool) -> DataFrame:
    """Items once each, with ``over`` and the ``max_chars`` and ``overlap_chars`` of their kind (null without a limit)."""
    caps = limits.where(F.col("max_chars").isNotNull()).groupBy("chunk_kind").agg(
        F.min("max_chars").alias("max_chars"), F.coalesce(F.max("overlap_chars"), F.lit(0)).alias("overlap_chars")
    )
    kind = F.coalesce("chunk_kind", F.lit("fallback_text")).alias("chunk_kind")
    rows = chunks.select("project", "id", "indexed_at", *[kind if c == "chunk_kind" else c for c in _ITEM])
    rows = rows.join(F.broadcast(caps), "chunk_kind", "left")  # one row for each kind
    rows = rows.withColumn("over", F.coalesce(F.length("content") > F.col("max_chars"), F.lit(False)))
    if only_over:
        rows = rows.where("over")
    cols = [*_ITEM, "max_chars", "overlap_chars"]
    best = rows.groupBy("project", "id").agg(F.max(F.struct("over", "indexed_at", *cols)).alias("_r"))
    return best.select("project", "id", "_r.over", *[F.col(f"_r.{c}").alias(c) for c in cols])


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Items longer than the limit of their kind, once each, with ``max_chars`` and ``overlap_chars``."""
    return limited(chunks, limits, True)


def _shifts(items: DataFrame, gained: DataFrame) -> DataFrame:
    """``rid, shift`` of the items whose group gained pieces: by how many the items before each of them grew.

    Prefix sums in three steps (blocks of indexes, places within a block, items of a place), so that no window holds a
    whole group. ``items``: rid, g, i, id; ``gained``: rid, g, more.
    """
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda window: F.coalesce(F.sum("more").over(window), F.lit(0))
    rows = (
        items.join(gained.select("g").distinct(), "g", "left_semi")
        .join(gained.select("rid", "more"), "rid", "left")
        .select("rid", "g", "i", F.floor(F.col("i") / INDEX_BLOCK).alias("b"), F.xxhash64("id").alias("h"), "id", F.coalesce("more", F.lit(0)).alias("more"))
        .withColumn("s", F.shiftright("h", 58))
    )
    rows = cut(rows, "shifts")
    places = rows.groupBy("g", "b", "i", "s").agg(F.sum("more").alias("more"))
    blocks = places.groupBy("g", "b").agg(F.sum("more").alias("more"))
    blocks = blocks.select("g", "b", summed(before("g").orderBy("b")).alias("_block"))
    places = places.select("g", "b", "i", "s", summed(before("g", "b").orderBy("i", "s")).alias("_place"))
    offsets = places.join(blocks, ["g", "b"]).select("g", "i", "s", (F.col("_block") + F.col("_place")).alias("_offset"))
    within = summed(before("g", "i", "s").orderBy("h", "id", "rid"))
    return rows.withColumn("_within", within).join(offsets, ["g", "i", "s"]).select("rid", (F.col("_offset") + F.col("_within")).alias("shift"))


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Every item, oversized ones in pieces, with their lines, overlap and new ``chunk_index``."""
    ship(chunks.sparkSession)
    index = F.coalesce("chunk_index", F.lit(0)).alias("i")
    # the group an item is numbered in: without node and file it stands alone
    alone = F.when(F.col("node_id").isNull() & F.col("file_path").isNull(), F.coalesce("id", F.lit("")))
    group = F.xxhash64(*[F.coalesce(c, F.lit("\0")) for c in ("project", "node_id", "file_path", "chunk_kind", alone)]).alias("g")
    numbered = limited(chunks, limits, False).withColumn("rid", F.monotonically_increasing_id())
    items = cut(numbered.select("*", group, index), "items")
    pieces = cut(items.where("over").mapInPandas(_cut_batches, _PIECES), "pieces")
    gained = items.select("rid", "g").join(pieces.where("piece = 0").select("rid", (F.col("n_pieces") - 1).alias("more")), "rid")
    shifts = _shifts(items.select("rid", "g", "i", "id"), gained)
    single = items.where("not over").select(
        "rid", "project", "id", "node_id", "file_path", "chunk_kind", "language", F.col("chunk_index").alias("item_index"),
        F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), "content", "start_line", "end_line", F.lit(0).alias("overlap_chars"),
    )
    everything = single.unionByName(pieces).join(shifts, "rid", "left")
    new = F.coalesce("item_index", F.lit(0)) + F.coalesce("shift", F.lit(0)) + F.col("piece")
    return everything.select(*_NAMES, new.cast("int").alias("chunk_index"))


def round_trip(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Of each item ``n_chars, text_md5`` of the text its pieces give without overlaps, and whether all are in the limit."""
    caps = limits.where(F.col("max_chars").isNotNull()).groupBy("chunk_kind").agg(F.min("max_chars").alias("max_chars"))
    pieces = split_oversized(chunks, limits).join(F.broadcast(caps), "chunk_kind", "left")
    new = F.struct("piece", F.expr("substr(content, overlap_chars + 1)").alias("t"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(new)), lambda x: x["t"]), "")
    text = F.when(F.max("content").isNotNull(), whole)
    fits = F.min(F.coalesce(F.length("content") <= F.col("max_chars"), F.lit(True)))
    out = pieces.groupBy("project", "id").agg(text.alias("_t"), fits.alias("within_limit"))
    return out.select("project", "id", F.length("_t").cast("long").alias("n_chars"), F.md5("_t").alias("text_md5"), "within_limit")


def found(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``id`` of every item that the splitting cut into two pieces or more."""
    ship(chunks.sparkSession)
    items = oversized(chunks, limits).withColumn("rid", F.lit(0).cast("long"))
    return items.mapInPandas(_cut_batches, _PIECES).where("n_pieces > 1").select("id").distinct()
