"""Problem 9: mixing sources to target weights by temperature mixing and budgeted block permutations.

Weights come from exponentiated shares, normalised, in one of three ways:
* ``budget=None``: every source gets its target share exactly; the budget is the greatest at which no source is needed
  more often than its limit. No single exponent of the token shares gives arbitrary targets, so there is none here.
* a budget in tokens: w_i ~ s_i (t_i / s_i)^a, the natural token shares s (a = 0) tempered towards the target shares t
  (a = 1); a is bisected to the greatest value at which the budget needs no source more often than its limit.
* an entropy: w_i ~ s_i^a, a bisected until the weights have that entropy.

The weights are realised per source as whole passes over the source and a part of one more: the source's records fall
into blocks by hash, the blocks are taken in the order of a permutation drawn anew for each pass while they fit the
budget, and only the block on the edge is taken record by record. So just block sums reach the driver, and no source,
however large, is sorted as a whole: blocks hold about ``BLOCK_ROWS`` records. Every record gets its ``position`` in the
permutation of its source as a share of what is drawn from it; sorted by position, any prefix of the mixture has the
weights of the whole.

Defined results
* a record without tokens (null or empty text) and one without a source is never drawn;
* a source without a target has target share 0: it is reported, not drawn; a target without any tokens cannot be met:
  its share is spread over the others in proportion to theirs, and the report has it with share 0;
* ``max_repeats`` n means a record is used at most n times in all; null means once; below 1 the source is left out;
* repeated rows of an id are records of their own; targets given twice for a source add up, with the smaller limit;
* the part of a pass ends before the record that would exceed the budget, so a source falls short of its share by less
  than one record; with no records or no targets nothing is drawn; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovework.llm.tokens import TOKENIZER, with_token_counts
from grovework.runtime import cut

BLOCK_ROWS = 20_000  # records of a source that form a block
MIN_BLOCKS, MAX_BLOCKS = 16, 65_536  # blocks of a source: their sums reach the driver


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else {}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def weights_at(natural: dict[str, float], target: dict[str, float], a: float) -> dict[str, float]:
    both = {k: natural[k] * (target[k] / natural[k]) ** a for k in target if natural.get(k, 0) > 0 and target[k] > 0}
    return normalised(both)


def exponent_of_entropy(natural: dict[str, float], wanted: float, steps: int = 60) -> float:
    """The exponent from 0 up at which natural^a has the entropy ``wanted`` (or comes as near to it as it can)."""
    shares = {k: v for k, v in normalised(natural).items() if v > 0}
    at = lambda a: entropy(normalised({k: (v / max(shares.values())) ** a for k, v in shares.items()}))
    low, high = 0.0, 1.0  # entropy falls as a grows
    while at(high) > wanted and high < 1024:
        high *= 2
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid) > wanted else (low, mid)
    return high


def weights_of_entropy(natural: dict[str, float], wanted: float) -> dict[str, float]:
    """natural^a, normalised, with a bisected so that the entropy is ``wanted``."""
    a = exponent_of_entropy(natural, wanted)
    shares = {k: v for k, v in normalised(natural).items() if v > 0}
    return normalised({k: (v / max(shares.values())) ** a for k, v in shares.items()})


def solve(
    tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None, wanted_entropy: float | None = None, steps: int = 60
) -> tuple[dict[str, float], float, float]:
    """(weights, budget, exponent) for sources of ``tokens`` and ``targets`` of (share, most uses of a record).

    With ``wanted_entropy`` the target shares only say which sources take part; without a budget that is as in ``mix``.
    """
    able = {k: t for k, t in targets.items() if tokens.get(k, 0) > 0 and t[0] > 0 and t[1] >= 1}
    if not able:
        return {}, 0.0, 1.0
    natural = normalised({k: float(tokens[k]) for k in able})
    target = normalised({k: t[0] for k, t in able.items()})
    most = {k: tokens[k] * t[1] for k, t in able.items()}
    feasible = lambda w, b: all(w[k] * b <= most[k] * (1 + 1e-12) for k in w)
    if wanted_entropy is not None:
        w, a = weights_of_entropy(natural, wanted_entropy), exponent_of_entropy(natural, wanted_entropy)
        most_of_all = min(most[k] / w[k] for k in w if w[k] > 0)
        return w, most_of_all if budget is None else min(budget, most_of_all), a
    if budget is None:
        return target, min(most[k] / target[k] for k in able), 1.0
    if feasible(target, budget):
        return target, budget, 1.0
    if not feasible(natural, budget):
        # even the natural shares repeat some source too often: fill what is short from the sources with room
        got, open_, left = {}, dict(target), float(min(budget, sum(most.values())))
        whole = left
        while open_:
            share = normalised(open_)
            full = [k for k in open_ if share[k] * left > most[k]]
            if not full:
                got |= {k: share[k] * left for k in open_}
                break
            for k in full:
                got[k] = float(most[k])
                del open_[k]
            left = whole - sum(got.values())
        return {k: v / whole for k, v in got.items()}, whole, 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if feasible(weights_at(natural, target, mid), budget) else (low, mid)
    return weights_at(natural, target, low), budget, low


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    return cut(with_token_counts(documents, ["doc_id", "source"], path=path), "mix-sizes")


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """One row per target source, a table of fixed size."""
    rows = (
        mix_targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("t"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("m"))
        .collect()
    )
    return {r["source"]: (r["t"], r["m"]) for r in rows}


def whole_budget(sizes: DataFrame, mix_targets: DataFrame) -> int:
    """As many tokens as the sources that can be drawn hold, so that the exponent is bisected instead of the size."""
    able = [k for k, (share, most) in _targets(mix_targets).items() if share > 0 and most >= 1]
    there = sizes.where((F.col("n_tokens") > 0) & F.col("source").isin(able))
    return there.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]


def target_entropy(mix_targets: DataFrame) -> float:
    """The entropy of the target shares."""
    return entropy(normalised({k: share for k, (share, most) in _targets(mix_targets).items() if share > 0 and most >= 1}))


def mix(
    sizes: DataFrame, mix_targets: DataFrame, budget: float | None = None, wanted_entropy: float | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``doc_id, source, n_tokens, use, position`` of every drawn record.

    A record used n times is n rows (``use`` 1 to n), each with its place in the pass it belongs to.
    """
    spark = sizes.sparkSession
    targets = _targets(mix_targets)
    wanted = sizes.select("doc_id", "source", "n_tokens").where((F.col("n_tokens") > 0) & F.col("source").isin(list(targets)))
    there = {r["source"]: (int(r["n"]), r["rows"]) for r in wanted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    total = {k: n for k, (n, _) in there.items()}
    weights, size, _ = solve(total, targets, budget, wanted_entropy)
    plan, part = [], {}
    for k, w in weights.items():
        whole, rest = divmod(w * size * (1 + 1e-12), total[k])
        passes = int(min(whole, targets[k][1]))
        part[k] = rest if passes < targets[k][1] else 0.0
        blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, math.ceil(there[k][1] / block_rows)))
        plan.append((k, passes, passes + (part[k] > 0), blocks, w * size))
    plan = spark.createDataFrame(plan, "source string, passes int, last int, blocks int, wanted double")
    planned = wanted.join(F.broadcast(plan), "source")  # one row per target
    # the permutation of a pass is the order of its hash blocks, and within a block that of another hash
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed), "use"), "blocks").cast("int").alias("block")
    every = planned.where("last > 0").select("doc_id", "source", "n_tokens", "passes", "last", "blocks", "wanted", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("use"))
    passes = cut(every.select("doc_id", "source", "n_tokens", "use", (F.col("use") > F.col("passes")).alias("partly"), "wanted", block), "mix-blocks")
    sums = passes.groupBy("source", "use", "partly", "block").agg(F.sum("n_tokens").alias("n"))
    of_part: dict[str, dict[int, int]] = {}
    for r in sums.where("partly").collect():  # at most MAX_BLOCKS for each target
        of_part.setdefault(r["source"], {})[r["block"]] = int(r["n"])
    edges = []
    for k, parts in of_part.items():
        left, edge = part[k], MAX_BLOCKS
        for b in sorted(parts):
            if parts[b] > left:
                edge = b
                break
            left -= parts[b]
        edges.append((k, edge, float(left)))
    edge = spark.createDataFrame(edges, "source string, _edge int, _left double")
    taken = passes.join(F.broadcast(edge), "source", "left").where(~F.col("partly") | (F.col("block") <= F.col("_edge")))
    in_block = Window.partitionBy("source", "use", "block").orderBy(F.xxhash64("doc_id", F.lit(seed), F.lit("place"), "use"), "doc_id", "n_tokens")
    running = F.sum("n_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    fits = ~F.col("partly") | (F.col("block") < F.col("_edge")) | (F.col("_sum") <= F.col("_left"))
    earlier = Window.partitionBy("source").orderBy("use", "block").rowsBetween(Window.unboundedPreceding, -1)  # block sums of one source
    offsets = sums.select("source", "use", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    placed = taken.withColumn("_sum", running).where(fits).join(offsets, ["source", "use", "block"])
    position = (F.col("_before") + F.col("_sum") - F.col("n_tokens")) / F.col("wanted")
    return placed.select("doc_id", "source", "n_tokens", "use", position.alias("position"))


def invariants(sizes: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Of each target source that has tokens: whether its share, its repetitions and its positions are as they should be.

    Shares are normalised over those sources and may be off by the longest record over all that is drawn.
    """
    targets = mix_targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("t"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("m"))
    there = sizes.where("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("longest"))
    uses = mix(sizes, mix_targets).groupBy("source", "doc_id").agg(
        F.count(F.lit(1)).alias("uses"), F.countDistinct("use").alias("distinct_uses"), F.sum("n_tokens").alias("n"), F.min("position").alias("low"), F.max("position").alias("high")
    )
    drawn = uses.groupBy("source").agg(F.sum("n").alias("n"), F.max("uses").alias("uses"), F.min(F.col("uses") == F.col("distinct_uses")).alias("apart"), F.min("low").alias("low"), F.max("high").alias("high"))
    everything = Window.partitionBy()  # one row per target
    rows = targets.where("t > 0 and m >= 1").join(there, "source").join(drawn, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share, aim = F.col("n") / F.sum("n").over(everything), F.col("t") / F.sum("t").over(everything)
    return rows.select(
        "source",
        (F.abs(share - aim) <= (F.max("longest").over(everything) + 1) / F.sum("n").over(everything)).alias("share_met"),
        (F.col("uses") <= F.col("m")).alias("repeats_met"),
        (F.col("apart") & (F.col("low") >= 0) & (F.col("high") < 1)).alias("positions_met"),
    )


def report(sizes: DataFrame, mix_targets: DataFrame, budget: float | None = None, wanted_entropy: float | None = None) -> DataFrame:
    """Of each source and target: tokens there and drawn, target and actual share, most uses allowed and made."""
    drawn = mix(sizes, mix_targets, budget, wanted_entropy).groupBy("source").agg(
        F.sum("n_tokens").alias("drawn_tokens"), F.count(F.lit(1)).alias("drawn_rows"), F.max("use").alias("most_uses")
    )
    there = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    targets = mix_targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = there.join(targets, "source", "full").join(drawn, "source", "left").select(
        "source", *[zero(c) for c in ("tokens", "rows", "target_share", "max_repeats", "drawn_tokens", "drawn_rows", "most_uses")]
    )
    everything = Window.partitionBy()  # one row per source
    all_drawn = F.greatest(F.sum("drawn_tokens").over(everything), F.lit(1))
    return joined.withColumn("actual_share", F.round(F.col("drawn_tokens") / all_drawn, 6))
