"""CSV, Parquet and text output."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..errors import InvalidInput

ROW_GROUP_ROWS = 122_880
MAX_RENDERED_ROWS = 100_000


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "errorifexists", one_file: bool = False) -> None:
    """CSV files, one per partition. Fields that hold the separator, a quote or a
    line break are quoted, quotes doubled; null is an empty field."""
    if one_file:
        df = df.coalesce(1)
    df.write.mode(mode).option("header", str(header).lower()).option("sep", sep).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "errorifexists", max_rows: int = 0) -> None:
    """Parquet files, Snappy or uncompressed; ``max_rows`` bounds the rows of a
    file (0: as many as the partition has)."""
    if compression not in ("snappy", "none", "uncompressed", "zstd"):
        raise InvalidInput(f"compression {compression}")
    df.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", max_rows).parquet(path)


def lines(df: DataFrame, limit: int | None = None) -> Iterator[str]:
    """Rows as text separated by tabs, the names once on top; null is NULL. The
    driver holds a partition at a time."""

    def cell(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    yield "\t".join(df.columns)
    for row in (df if limit is None else df.limit(limit)).toLocalIterator():
        yield "\t".join(map(cell, row))


def render(df: DataFrame, limit: int | None = None, most: int = MAX_RENDERED_ROWS) -> str:
    """The lines of a result as one string; one of over ``most`` rows is an error,
    as it belongs in files."""
    out = list(lines(df.limit(most + 1) if limit is None else df.limit(min(limit, most + 1))))
    if len(out) > most + 1:
        raise InvalidInput(f"a result of over {most} rows: write it to files, or read its lines one by one")
    return "\n".join(out)
