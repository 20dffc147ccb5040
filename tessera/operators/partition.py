"""How the rows of a result are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame


def gather(df: DataFrame) -> DataFrame:
    """Everything in one partition: only for small results, such as one CSV file."""
    return df.coalesce(1)


def hash_split(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` partitions by the hash of ``keys``; joins and groupings on these
    keys then need no further shuffle."""
    return df.repartition(n, *keys)
