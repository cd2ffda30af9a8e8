"""Keyword (BM25), vector and fused search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovework.functions.text import sanitize_query
from grovework.runtime import cut

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits (of any script) and underscore."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _equals(term: str):
    return lambda x: x == term


def query_terms(query: str) -> list[str]:
    return sorted(set(sanitize_query(query).lower().split()))


def counted(docs: DataFrame, query: str, text: str) -> DataFrame:
    """``docs`` without the text, with its length in words ``_dl`` and how often each query term occurs ``_f``.

    Numbers instead of texts: what comes after (deduplication, corpus figures, hits) shuffles no text.
    """
    found = F.array(*[F.size(F.filter("_t", _equals(t))) for t in query_terms(query)])
    rest = [c for c in docs.columns if c != text]
    words = docs.select(*rest, tokens(F.col(text)).alias("_t"))
    there = F.col("_t").isNotNull()
    return words.select(*rest, F.when(there, F.size("_t")).alias("_dl"), F.when(there, found).alias("_f"))


def score_counted(base: DataFrame, query: str, keys: list[str], scope: str = "project") -> DataFrame:
    """``keys, score`` of the counted documents that have a term of the query; statistics per ``scope`` column.

    Scores add up per term: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)).
    """
    n = len(query_terms(query))
    base = cut(base.where(F.col("_dl").isNotNull()).select(*keys, "_dl", "_f"), "counted")
    corpus = base.groupBy(scope).agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum(F.when(F.col("_f")[i] > 0, 1).otherwise(0)).alias(f"_df{i}") for i in range(n)])
    hit = base.where(F.exists("_f", lambda x: x > 0)).join(corpus, scope)
    score = F.lit(0.0)
    for i in range(n):
        df, tf = F.col(f"_df{i}"), F.col("_f")[i].cast("double")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))).otherwise(0.0)
    return hit.select(*keys, F.round(score, 6).alias("score"))


def bm25(docs: DataFrame, query: str, keys: list[str], text: str, scope: str = "project") -> DataFrame:
    """``keys, score`` of the documents that have a term of the query."""
    if not query_terms(query):
        return docs.limit(0).select(*keys, F.lit(0.0).alias("score"))
    return score_counted(counted(docs.select(*dict.fromkeys([*keys, scope]), text), query, text), query, keys, scope)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of a vector column with a literal query, accumulated in doubles; null for unusable vectors."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(vector) == len(query)) & (own > 0), dot / own)


def vector_search(rows: DataFrame, vector: str, query: list[float], k: int | None, *ties: str) -> DataFrame:
    """Rows with ``score``, the best k first. Filters placed before it narrow the search exactly."""
    scored = rows.withColumn("score", F.round(cosine(F.col(vector), query), 6)).where(F.col("score").isNotNull())
    return scored if k is None else scored.orderBy(F.desc("score"), *ties).limit(k)


def group_hits(rows: DataFrame, entity: list[str]) -> DataFrame:
    """Chunk hits per entity: greatest score and the matches, best first."""
    match = F.struct((-F.col("score")).alias("_k"), F.col("chunk_id"), F.col("score"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"))
    hits = rows.groupBy(*entity).agg(F.max("score").alias("score"), F.array_sort(F.collect_list(match)).alias("m"))
    return hits.withColumn("matches", F.transform("m", lambda x: x.dropFields("_k"))).drop("m")


def _with_matches(df: DataFrame) -> Column:
    return F.col("matches") if "matches" in df.columns else F.lit(None)


def fuse(lists: dict[str, DataFrame], entity: list[str], order: list[str]) -> DataFrame:
    """Union of scored lists by entity: greatest score; ``source_type`` is the list, or ``text`` when several have it.

    ``matches`` of a list that has them are kept.
    """
    whole, matched = None, any("matches" in df.columns for df in lists.values())
    kind = next((df.schema["matches"].dataType for df in lists.values() if "matches" in df.columns), None)
    for name in order:
        extra = [_with_matches(lists[name]).cast(kind).alias("matches")] if matched else []
        part = lists[name].select(*entity, "score", F.lit(name).alias("src"), *extra)
        whole = part if whole is None else whole.unionByName(part)
    more = [F.flatten(F.collect_list("matches")).alias("matches")] if matched else []
    fused = whole.groupBy(*entity).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("src")).alias("srcs"), *more)
    return fused.withColumn("source_type", F.when(F.size("srcs") > 1, "text").otherwise(F.get("srcs", F.lit(0)))).drop("srcs")


def hybrid(code: DataFrame, summary: DataFrame, entity: list[str], min_score: float = 0.0) -> DataFrame:
    """Code and summary hits fused by the greatest score; a hit with code is ``hybrid``, else ``summary``.

    ``matches`` of the code hits are kept if they have them.
    """
    extra = ["matches"] if "matches" in code.columns else []
    other = [F.lit(None).cast(code.schema["matches"].dataType).alias("matches")] if extra else []
    both = code.select(*entity, "score", F.lit(1).alias("c"), *extra).unionByName(summary.select(*entity, "score", F.lit(0).alias("c"), *other))
    both = both.where(F.coalesce("score", F.lit(0.0)) >= min_score)
    more = [F.flatten(F.collect_list("matches")).alias("matches")] if extra else []
    return both.groupBy(*entity).agg(F.max("score").alias("score"), F.when(F.max("c") == 1, "hybrid").otherwise("summary").alias("source_type"), *more)


def first_list_wins(lists: list[DataFrame], entity: list[str]) -> DataFrame:
    """Union in which an entity keeps its row from the first list that has it."""
    whole = None
    for i, df in enumerate(lists):
        part = df.withColumn("_src", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    w = Window.partitionBy(*entity).orderBy("_src", F.desc("score"))
    return whole.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_src")


def quick_search(names: DataFrame, symbols: DataFrame, summaries: DataFrame, semantic: DataFrame | None = None, entity: tuple = ("project", "id")) -> DataFrame:
    """Per project the 15 best name hits, then of symbol and of summary hits 10 each that the names do not have, then
    semantic hits the others do not have: ``entity, score (3 decimals), section, place``. Lists have ``score``.
    """
    key, whole = list(entity), None
    for k, (section, df, most) in enumerate((("name", names, 15), ("text", symbols, 10), ("text", summaries, 10), ("semantic", semantic, 15))):
        if df is None:
            continue
        w = Window.partitionBy("project").orderBy(F.desc("score"), "id")
        part = df.select(*key, "score").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
        part = part.withColumn("score", F.round("score", 3)).withColumn("section", F.lit(section)).withColumn("_src", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    first = whole.withColumn("_f", F.row_number().over(Window.partitionBy(*key).orderBy("_src", "_n"))).where("_f = 1")
    place = F.row_number().over(Window.partitionBy("project").orderBy("_src", "_n"))
    return first.select(*key, "score", "section", place.alias("place"))


def semantic_panel(summary: DataFrame, chunks: DataFrame, entity: tuple = ("project", "id"), most: int = 15) -> DataFrame:
    """The ten best summary and the ten best chunk hits of each project; an entity keeps its first row (not the greatest
    score); the best ``most`` by score, rounded to three decimals."""
    key = list(entity)
    ten = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "id"))).where("_n <= 10").select(*key, "score")
    one = first_list_wins([ten(summary), ten(chunks)], key).withColumn("score", F.round("score", 3))
    w = Window.partitionBy("project").orderBy(F.desc("score"), "id")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
