"""Reader of code-index files in the public SCIP protobuf format: occurrences of symbols per document.

Only the fields needed are decoded: Index.documents = 2, Document.relative_path = 1, Document.occurrences = 2,
Occurrence.range = 1 (packed), Occurrence.symbol = 2, Occurrence.symbol_roles = 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from grovework.runtime import ship


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if i >= len(b):
            raise ValueError("truncated number")
        value |= (b[i] & 0x7F) << shift
        i += 1
        if not b[i - 1] & 0x80:
            return value, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, number or bytes) of a message; fixed-width fields are skipped, groups are an error."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, i = _varint(b, i)
            yield number, value
        elif wire == 2:
            n, i = _varint(b, i)
            if i + n > len(b):
                raise ValueError("truncated field")
            yield number, b[i : i + n]
            i += n
        elif wire in (1, 5):
            i += 8 if wire == 1 else 4
        else:
            raise ValueError(f"wire type {wire}")


def occurrences(index: bytes) -> Iterator[tuple[str, int, str, int]]:
    """(relative path, line from 0, symbol, roles)."""
    for number, doc in fields(index):
        if number != 2 or not isinstance(doc, bytes):
            continue
        path, occ = "", []
        for k, v in fields(doc):
            if k == 1 and isinstance(v, bytes):
                path = v.decode("utf-8", "replace")
            elif k == 2 and isinstance(v, bytes):
                occ.append(v)
        for o in occ:
            line, symbol, roles = None, "", 0
            for k, v in fields(o):
                if k == 1 and line is None:
                    line = _varint(v, 0)[0] if isinstance(v, bytes) and v else v if isinstance(v, int) else None
                elif k == 2 and isinstance(v, bytes):
                    symbol = v.decode("utf-8", "replace")
                elif k == 3 and isinstance(v, int):
                    roles = v
            if line is not None and symbol:
                yield path, int(line), symbol, roles


def read_index(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Occurrences of all index files at ``path``; a broken file gives none."""
    ship(spark)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    rows += [(project, *o) for o in occurrences(bytes(content))]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["project", "file_path", "line", "symbol", "roles"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "project string, file_path string, line int, symbol string, roles int")
