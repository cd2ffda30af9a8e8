"""Limits, pages and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAPH_LIMIT, SEARCH_LIMIT = 500, 100


def clamp(limit: int | None, most: int, default: int = 1) -> int:
    """A limit within [1, most]; none or zero means ``default``."""
    return max(1, min(int(limit or default), most))


def page(df: DataFrame, order: list, limit: int, offset: int = 0, most: int = GRAPH_LIMIT) -> DataFrame:
    """Rows [offset, offset + limit) in a total order (callers end ``order`` with a key)."""
    return df.orderBy(*order).offset(max(0, int(offset or 0))).limit(clamp(limit, most))


def envelope(df: DataFrame, order: list, limit: int, offset: int = 0, most: int = GRAPH_LIMIT) -> dict:
    """``items`` and ``page`` {limit, offset, next_offset, has_more, truncated}: one row more than asked tells whether more follow."""
    limit, offset = clamp(limit, most), max(0, int(offset or 0))
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).offset(offset).limit(limit + 1).collect()]
    more = len(rows) > limit
    items = [{k: v for k, v in r.items() if v is not None} for r in rows[:limit]]
    return {"items": items, "page": {"limit": limit, "offset": offset, "next_offset": offset + limit if more else None, "has_more": more, "truncated": False}}  # filters come before limits


def page_per_group(df: DataFrame, group: list[str], order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """The same page of every group; Spark prunes each group to its first rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).where((F.col("_place") > offset) & (F.col("_place") <= offset + limit)).drop("_place")


def top(df: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k rows of the greatest score, ties by the given keys."""
    return df.orderBy(F.desc(score), *ties).limit(k)
