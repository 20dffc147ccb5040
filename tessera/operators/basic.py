"""Projection, filter, limit, sort and top-n over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput

Key = str | Column | tuple


def project(df: DataFrame, *expressions: str | Column) -> DataFrame:
    """Columns and expressions; an expression without a name becomes ``expr{i}``."""
    out = []
    for i, e in enumerate(expressions):
        if isinstance(e, str):
            out.append(F.col(e) if e in df.columns else F.expr(e) if " as " in e.lower() else F.expr(e).alias(f"expr{i}"))
        else:
            out.append(e)
    return df.select(*out)


def filter_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows for which the predicate is true; null drops a row."""
    return df.filter(predicate)


def sort_key(key: Key) -> Column:
    """``name``, or (name or Column, "asc" or "desc"[, "first" or "last"]); nulls
    come last unless said otherwise, rising or falling."""
    column, order, nulls = ((*key, "last")[:3] if len(key) > 1 else (key[0], "asc", "last")) if isinstance(key, tuple) else (key, "asc", "last")
    c = F.col(column) if isinstance(column, str) else column
    if order not in ("asc", "desc") or nulls not in ("first", "last"):
        raise InvalidInput(f"sort key {key!r}")
    return getattr(c, f"{order}_nulls_{nulls}")()


def sort(df: DataFrame, *keys: Key) -> DataFrame:
    """A full sort: range partitioned, so that no task holds everything."""
    return df.orderBy(*map(sort_key, keys))


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """``n`` rows after ``offset``; which ones, only an order above decides."""
    if (n is not None and n < 0) or offset < 0:
        raise InvalidInput("limit and offset are not negative")
    if offset:
        df = df.offset(offset)
    return df if n is None else df.limit(n)


def top_n(df: DataFrame, keys: Sequence[Key], n: int, offset: int = 0) -> DataFrame:
    """The first ``n`` rows of a sort after ``offset``; each task keeps
    ``n + offset`` rows and only those meet."""
    return limit(sort(df, *keys), n, offset)


def constants(spark, rows: list[tuple], schema: str) -> DataFrame:
    """An inline table; without rows an empty one of that type."""
    return spark.createDataFrame(rows, schema)
