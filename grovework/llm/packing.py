"""Problem 8: filling fixed-capacity containers with items, by minimum bin slack.

What a plan needs is only how many items of each length there are (at most ``capacity`` numbers, whatever the input).
On that histogram the driver runs the minimum-bin-slack step again and again: seed a container with the longest
remaining length, find by bitset subset-sum over the remaining lengths (each with its count) the multiset that comes
closest to the capacity, backtrack it, and use the pattern as often as the counts allow. Every use exhausts the length
that limits it or at least halves its count, so there are at most capacity x log2(items) patterns. Items are then
numbered within their length and looked up in the plan; no item list is ever gathered.

Defined results
* an item longer than the capacity is split into pieces of ``capacity`` tokens and a rest (``piece`` 0, 1, ...,
  ``token_from``/``token_to`` in its tokens); no other item is split;
* an item exactly as long as the capacity fills a container alone;
* an item without tokens (null or empty text) needs no room: its ``container`` is null;
* repeated rows of an id are items of their own, told apart by ``copy`` (a number no two rows share); a null id is an id
  like any other;
* no items: no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovework.llm.tokens import TOKENIZER, with_token_counts
from grovework.runtime import cut, ship

ROWS_PER_BLOCK = 100_000


def best_fill(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The multiset of ``lengths`` (descending, ``counts`` of each) whose sum is the greatest up to ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for x in lengths[bisect.bisect_left(lengths, -room, key=lambda v: -v) :]:
        before, left, k = reach, min(counts[x], room // x), 1
        while left > 0:  # binary splitting: the counts 0..left in log2 shifts
            take = min(k, left)
            reach |= (reach << (x * take)) & mask
            left -= take
            k *= 2
        stages.append((x, before))
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for x, before in reversed(stages):
        while not before >> at & 1:
            at -= x
            chosen[x] = chosen.get(x, 0) + 1
    return chosen


def pack_counts(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of containers, {length: how many in each}) of every pattern of the plan."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = sorted(counts, reverse=True)
    plan = []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        pattern = best_fill(capacity - seed, lengths, counts)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[x] // n for x, n in pattern.items())
        plan.append((times, pattern))
        for x, n in pattern.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
                lengths.remove(x)
    return plan


def _lookup(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): length, first rank, first container, items of that length in each container."""
    rows, used, base = [], {}, 0
    for times, pattern in plan:
        for x, n in pattern.items():
            rows.append((x, used.get(x, 0), base, n))
            used[x] = used.get(x, 0) + n * times
        base += times
    rows.sort()
    return tuple(np.array(c, dtype="int64") for c in zip(*rows)) if rows else (np.zeros(0, "int64"),) * 4


def _numbered(pieces: DataFrame, keys: list[str], largest: int) -> DataFrame:
    """``rank`` (from 0) within ``size``. A length shared by many items is numbered in hash blocks side by side."""
    blocks = math.ceil(largest / ROWS_PER_BLOCK)
    block = F.pmod(F.xxhash64(*keys), F.lit(max(blocks, 1)))
    blocked = pieces.withColumn("_block", block)
    own = F.row_number().over(Window.partitionBy("size", "_block").orderBy(*keys)) - 1
    ranked = blocked.withColumn("rank", own.cast("long"))
    if blocks <= 1:
        return ranked.drop("_block")
    ahead = Window.partitionBy("size").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy("size", "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("size", "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return ranked.join(offsets, ["size", "_block"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_block", "_before")


def pack(items: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """``key, copy, piece, n_pieces, token_from, token_to, size, container`` from ``key, n_tokens``."""
    ship(items.sparkSession)
    cap = F.lit(int(capacity)).cast("long")
    n_pieces = F.greatest(F.ceil(F.col("n_tokens") / cap), F.lit(1)).cast("int")
    cuts = (
        items.select(key, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        .withColumn("copy", F.monotonically_increasing_id())
        .withColumn("n_pieces", n_pieces)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("token_from", F.col("piece") * cap)
        .withColumn("token_to", F.least(F.col("token_from") + cap, F.col("n_tokens")))
    )
    pieces = cut(
        cuts.select(key, "copy", "piece", "n_pieces", "token_from", "token_to", (F.col("token_to") - F.col("token_from")).alias("size")), "pieces"
    )
    filled = pieces.where("size > 0")
    histogram = {r["size"]: r["n"] for r in filled.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    length, first, base, per = _lookup(pack_counts(histogram, int(capacity)))
    span = np.int64(1) << 44

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = length * span + first
        for pdf in batches:
            at = np.searchsorted(starts, pdf["size"].to_numpy() * span + pdf["rank"].to_numpy(), side="right") - 1
            yield pdf.drop(columns="rank").assign(container=base[at] + (pdf["rank"].to_numpy() - first[at]) // per[at])

    ranked = _numbered(filled, [key, "copy", "piece"], max(histogram.values(), default=0))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", container long"
    packed = ranked.select(*pieces.columns, "rank").mapInPandas(assign, schema)
    return packed.unionByName(pieces.where("size = 0").withColumn("container", F.lit(None).cast("long")))


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens``, counted once and kept in the shared folder."""
    return cut(with_token_counts(documents, ["doc_id"], path=path), "sizes")


def invariants(packed: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """One row: items, those without tokens, items split though they fit, containers over the capacity, items whose
    pieces do not cover their tokens once, and whether at most one container in a hundred more than needed is used."""
    item = packed.groupBy(key, "copy").agg(
        F.sum("size").alias("size"), F.max("token_to").alias("to"), F.min("token_from").alias("begin"), F.count(F.lit(1)).alias("rows"), F.max("n_pieces").alias("n_pieces"), F.countDistinct("piece").alias("pieces")
    )
    cap = F.lit(int(capacity))
    least = F.when(F.col("to") <= cap, 1).otherwise(F.ceil(F.col("to") / cap))
    count = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    whole = (F.col("begin") == 0) & (F.col("size") == F.col("to")) & (F.col("rows") == F.col("n_pieces")) & (F.col("pieces") == F.col("rows"))
    of_items = item.agg(
        F.count(F.lit(1)).alias("n_items"), count(F.col("size") == 0, "n_empty"), count(F.col("n_pieces") > least, "split_though_fitting"), count(~whole, "not_covered_once")
    )
    fill = packed.where("container is not null").groupBy("container").agg(F.sum("size").alias("size"))
    of_containers = fill.agg(count(F.col("size") > cap, "over_capacity"), (F.count(F.lit(1)) <= F.ceil(F.coalesce(F.sum("size"), F.lit(0)) / cap) * 1.01 + 1).alias("well_filled"))
    one = F.lit(1).alias("_one")
    return of_items.select("*", one).join(of_containers.select("*", one), "_one").drop("_one")  # one row each


def capacity_of(pack_sizes: DataFrame, container: str) -> int:
    row = pack_sizes.where(F.col("container") == container).agg(F.max("capacity_tokens").alias("c")).first()
    if row["c"] is None:
        raise ValueError(f"no container named {container}")
    return int(row["c"])


def found(documents: DataFrame, pack_sizes: DataFrame, container: str = "standard") -> DataFrame:
    """``doc_id`` of every document that the packing put into more than one container."""
    packed = pack(sized(documents), capacity_of(pack_sizes, container))
    spread = packed.groupBy("doc_id", "copy").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return spread.where(F.col("first") != F.col("last")).select("doc_id").distinct()


def report(documents: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """Of each container kind: containers used, tokens in them, the fewest any packing could use, share filled."""
    sizes, out = sized(documents), None
    for r in pack_sizes.where("capacity_tokens is not null").groupBy("container").agg(F.max("capacity_tokens").alias("cap")).collect():
        packed = pack(sizes, r["cap"]).where("container is not null")
        row = packed.agg(
            F.lit(r["container"]).alias("container_kind"),
            F.lit(r["cap"]).alias("capacity_tokens"),
            (F.coalesce(F.max("container") + 1, F.lit(0))).alias("containers"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"),
        )
        out = row if out is None else out.unionByName(row)
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return out.select("*", least.alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
