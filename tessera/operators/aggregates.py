"""Grouped and global aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotSupported


@dataclass(frozen=True)
class Aggregate:
    """``function`` of ``argument`` (None for count_star), named ``name``."""

    function: str
    argument: str | Column | None = None
    distinct: bool = False
    name: str | None = None

    def column(self) -> Column:
        f, arg = self.function, self.argument
        c = F.expr(arg) if isinstance(arg, str) else arg
        if f == "count_star" or f == "count" and arg is None:
            out = F.count(F.lit(1))
        elif f == "count":
            out = F.count_distinct(c) if self.distinct else F.count(c)
        elif f in ("sum", "sum_no_overflow"):
            out = F.sum_distinct(c) if self.distinct else F.sum(c)
        elif f == "avg":  # always in floating point
            c = c.cast("double")
            out = F.sum_distinct(c) / F.nullif(F.count_distinct(c), F.lit(0)) if self.distinct else F.avg(c)
        elif f in ("min", "max", "first"):  # distinct changes nothing
            out = getattr(F, f)(c)
        else:
            raise NotSupported(f"aggregate {f}")
        return out.alias(self.name or f)


def aggregate(df: DataFrame, keys: Sequence[str | Column] = (), aggregates: Sequence[Aggregate] = (), having: str | Column | None = None) -> DataFrame:
    """One row per group (null is a group), or exactly one row without keys.
    Partial sums are made before the shuffle; without aggregates the distinct
    keys remain. A key that is an expression is named ``key{i}`` unless aliased."""
    named = []
    for i, k in enumerate(keys):
        if isinstance(k, str):
            named.append(F.col(k) if k in df.columns else F.expr(k).alias(f"key{i}"))
        else:
            named.append(k)
    if not aggregates:
        out = df.select(*named).distinct()
    else:
        out = df.groupBy(*named).agg(*[a.column() for a in aggregates])
    return out if having is None else out.filter(having)
