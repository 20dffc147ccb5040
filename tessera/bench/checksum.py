"""A checksum of a result that does not depend on the order of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row hashes modulo 2**64). Floating point numbers are rounded
    to six decimals first, so that the order of a sum does not matter."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)  # no negative zero
        cells.append(F.coalesce(c.cast("string"), F.lit("\0")))
    h = F.xxhash64(*cells) if cells else F.lit(0)
    n, total = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)"))).first()
    return n, int(total or 0) % (1 << 64)
