"""CSV sources: type sniffing and reading."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput

SAMPLE_ROWS = 100
_BIGINT = re.compile(r"[+-]?\d{1,19}")
_DOUBLE = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def sniff(values: Sequence[str | None]) -> str:
    """The type that all sampled values have: BIGINT, else DOUBLE, else BOOLEAN,
    else VARCHAR. Empty fields are null and fit every type."""
    some = [v.strip() for v in values if v is not None and v != ""]
    if not some:
        return "string"
    if all(_BIGINT.fullmatch(v) and -(1 << 63) <= int(v) < 1 << 63 for v in some):
        return "bigint"
    if all(_DOUBLE.fullmatch(v) for v in some):
        return "double"
    if all(v.lower() in ("true", "false") for v in some):
        return "boolean"
    return "string"


def read_csv(spark: SparkSession, paths: str | Sequence[str], sep: str | None = None, header: bool = True, quote: str = '"') -> DataFrame:
    """One or more CSV files of one layout. Types come from a sample of at most
    100 rows; a field that does not fit its column's type is null, and so are
    empty fields and those that a short row lacks. ``.tsv`` files are separated
    by tabs. Files without a header have columns ``col0``, ``col1``, ..."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise InvalidInput("no CSV file given")
    sep = sep or ("\t" if paths[0].lower().endswith(".tsv") else ",")
    reader = spark.read.option("sep", sep).option("header", str(header).lower()).option("quote", quote).option("escape", quote).option("mode", "PERMISSIVE").option("inferSchema", "false").option("enforceSchema", "true")
    raw = reader.csv(paths)
    if not header:
        raw = raw.toDF(*[f"col{i}" for i in range(len(raw.columns))])
    sample = raw.limit(SAMPLE_ROWS).collect()
    out = []
    for i, name in enumerate(raw.columns):
        kind = sniff([r[i] for r in sample])
        c = F.when(F.col(f"`{name}`") != "", F.col(f"`{name}`"))
        out.append((c if kind == "string" else F.trim(c).try_cast(kind)).alias(name))
    return raw.select(*out)
