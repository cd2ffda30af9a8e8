import pytest

from grovework.llm import tokens as T

SCHEMA = "doc_id long, text string, n_tokens string"


def test_counts(spark):
    import os

    if not os.path.exists(T.TOKENIZER):
        pytest.skip("no tokenizer here")
    texts = ["hello world", "", None, "<|endoftext|>", "é" * 5000, "hello world"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["n_tokens"] for r in T.with_token_counts(df, ["doc_id"]).collect()}
    tok = T.tokenizer(T.TOKENIZER)
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    assert got[3] > 1 and got[1] == got[2] == 0
    assert T.with_token_counts(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0


def test_queries_against_sql(same):
    from grovework.llm.queries import QUERIES, SQL

    for name, sql in SQL.items():
        same(QUERIES[name], sql)


MAY_BE_EMPTY = {"p6_found", "p8_found", "p10_found", "p7_found", "p2_found", "p2_pairs", "p3_found", "p5_found"}  # at this small scale


def test_all_queries_run(spark, sf):
    from grovework.llm.queries import QUERIES

    for name in QUERIES:
        df = QUERIES[name](spark, sf)
        rows = df.collect()
        assert df.columns and (rows or name in MAY_BE_EMPTY), name
