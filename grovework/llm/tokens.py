"""Token counts by a public tokenizer, in Arrow batches (one native call per batch)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovework.runtime import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a ``tokenizers`` JSON file; special tokens in a text are ordinary text."""
    if path not in _loaded:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Token count of each text; repeated texts of a batch are encoded once."""
    distinct = list(dict.fromkeys(texts))
    encoded = tokenizer(path).encode_batch_fast(distinct, add_special_tokens=False)
    counts = {x: len(e) for x, e in zip(distinct, encoded)}
    return [counts[x] for x in texts]


def with_token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of the whole text (null or empty text: 0). The text itself is not kept."""
    ship(df.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = ["" if x is None else x for x in pdf[text]]
            counts: list[int] = []
            for i in range(0, len(texts), 256):
                counts += count_tokens(texts[i : i + 256], path)
            yield pdf[keep].assign(n_tokens=pd.Series(counts, index=pdf.index, dtype="int64"))

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())])
    return df.select(*keep, *([] if text in keep else [text])).mapInPandas(count, schema)
