from datetime import datetime as D

from grovework.operators import references as R

EDGES = "project string, source string, edge_type string, target string, resolution string, callee_text string, indexed_at timestamp, id string"
NODES = "project string, id string, indexed_at timestamp, deleted_at timestamp, edge_at string"
EXT = "project string, id string, name string, root string, kind string, language string"
T1, T2, T3 = D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)


def run(spark, edges, nodes, ext=()):
    e = spark.createDataFrame([(*x, "clash") for x in edges], EDGES)
    n = spark.createDataFrame([(*x, "clash") for x in nodes], NODES)
    x = spark.createDataFrame(list(ext), EXT)
    return sorted((tuple(r) for r in R.orphan_references(e, n, x).collect()), key=repr)


def test_reasons(spark):
    nodes = [("p", "a", T1, None), ("p", "gone", T1, T2), ("p", "late", T3, None), ("p", "back", T1, T2), ("p", "back", T2, None)]
    edges = [("p", "a", "CALLS", t, None, None, T2) for t in ("a", "gone", "late", "back", "none", "", "ext:m", None)]
    got = run(spark, edges, nodes, [("p", "ext:m", "m", "m", "module", None)])
    assert got == [
        ("p", "a", "CALLS", "", "target", "missing"),
        ("p", "a", "CALLS", "gone", "target", "deleted"),
        ("p", "a", "CALLS", "late", "target", "later"),
        ("p", "a", "CALLS", "none", "target", "missing"),
    ]


def test_other_project_source_external_and_duplicates(spark):
    nodes = [("q", "b", T1, None), ("p", "a", None, None)]
    edges = [("p", "ext:m", "CALLS", "b", "x", None, T1)] * 3 + [("p", "ext:m", "CALLS", "b", None, "y", T1), (None, "a", "CALLS", "a", None, None, None)]
    got = run(spark, edges, nodes, [("p", "ext:m", None, None, None, None)])
    assert ("p", "ext:m", "CALLS", "b", "source", "missing") in got and ("p", "ext:m", "CALLS", "b", "target", "missing") in got
    assert len(got) == 4


def test_empty(spark):
    assert run(spark, [], []) == []
    assert len(run(spark, [("p", "a", "CALLS", "b", None, None, T1)], [])) == 2


def test_hot_key(spark):
    nodes = [("p", f"n{i}", T1, None) for i in range(200)]
    edges = [("p", f"n{i}", "IMPORTS", "hub", None, None, T2) for i in range(200)]
    assert len(run(spark, edges, nodes)) == 200


def test_a_third_of_all_references_to_one_key(spark):
    """A hot key is split over tasks by adaptive execution, with the same result."""
    from datetime import datetime as D

    from pyspark.sql import functions as F

    from grovework.operators import references as R

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.shuffle.partitions", "spark.sql.adaptive.forceOptimizeSkewedJoin")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the small test data would end in one task
    for k, v in zip(old, ("40KB", "20KB", "2", "16", "true")):
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        target = F.when(i % 3 == 0, "hot").when(i % 3 == 1, F.concat(F.lit("n"), i % 5000)).otherwise(F.concat(F.lit("gone"), i))
        edges = spark.range(60_000).select(F.lit("p").alias("project"), F.concat(F.lit("n"), i % 5000).alias("source"), F.concat(F.lit("T"), i).alias("edge_type"), target.alias("target"), F.lit(D(2024, 1, 2)).alias("indexed_at"))
        nodes = spark.range(5000).select(F.lit("p").alias("project"), F.concat(F.lit("n"), i).alias("id"), F.lit(D(2024, 1, 1)).alias("indexed_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
        none = spark.createDataFrame([], "project string, id string")
        df = R.orphan_references(edges, nodes, none)
        rows = df.groupBy("reason").count().collect()
        assert [(r["reason"], r["count"]) for r in rows] == [("missing", 40_000)]
        df.write.format("noop").mode("overwrite").save()
        got = R.orphan_references(edges, nodes, none)
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        for k, v in old.items():
            spark.conf.set(k, v)
