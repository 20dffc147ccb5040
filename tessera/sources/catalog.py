"""Named sources over one or many files, and their statistics."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..errors import InvalidInput
from .csv import read_csv


@dataclass(frozen=True)
class ColumnStats:
    low: object
    high: object
    distinct: int
    nulls: int


@dataclass
class Source:
    name: str
    kind: str  # table, parquet or csv
    paths: tuple[str, ...]
    frame: DataFrame
    _stats: dict = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return self.frame.schema

    def rows(self) -> int:
        """Number of rows; Parquet answers from its footers."""
        if "rows" not in self._stats:
            self._stats["rows"] = self.frame.count()
        return self._stats["rows"]

    def stats(self, column: str) -> ColumnStats:
        """Bounds (numbers only), distinct values (estimated) and nulls."""
        if column not in self._stats:
            c = F.col(column)
            number = isinstance(self.frame.schema[column].dataType, NumericType)
            low, high = (F.min(c), F.max(c)) if number else (F.lit(None), F.lit(None))
            self._stats[column] = ColumnStats(*self.frame.agg(low, high, F.approx_count_distinct(c), F.count_if(c.isNull())).first())
        return self._stats[column]


def file_kind(path: str) -> str | None:
    ending = posixpath.splitext(path.split("?")[0].split("#")[0])[1].lower()
    return {".parquet": "parquet", ".csv": "csv", ".tsv": "csv"}.get(ending)


def stem(path: str) -> str:
    """A table name from a file name."""
    name = re.sub(r"\W", "_", posixpath.splitext(posixpath.basename(path.split("?")[0].rstrip("/")))[0]) or "source"
    return f"_{name}" if name[0].isdigit() else name


class Catalog:
    """Sources by name. Files are known by their whole list of paths, so equal
    stems of different files do not collide and the same files load once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.by_name: dict[str, Source] = {}
        self._by_paths: dict[tuple[str, ...], Source] = {}

    def __getitem__(self, name: str) -> Source:
        if name.lower() not in self.by_name:
            raise InvalidInput(f"no source named {name}")
        return self.by_name[name.lower()]

    def names(self) -> list[str]:
        return [s.name for s in self.by_name.values()]

    def add(self, name: str, frame: DataFrame, kind: str = "table", paths: tuple[str, ...] = ()) -> Source:
        source = Source(name, kind, paths, frame)
        frame.createOrReplaceTempView(f"`{name}`")
        self.by_name[name.lower()] = source
        if paths:
            self._by_paths[paths] = source
        return source

    def add_files(self, paths: str | list[str], name: str | None = None, **options) -> Source:
        """Registers Parquet or CSV files as one source; lists concatenate."""
        paths = (paths,) if isinstance(paths, str) else tuple(paths)
        if not paths:
            raise InvalidInput("an empty list of files")
        if paths in self._by_paths and name is None:
            return self._by_paths[paths]
        kinds = {file_kind(p) for p in paths}
        if len(kinds) != 1 or None in kinds:
            raise InvalidInput(f"not Parquet or CSV files of one kind: {', '.join(paths)}")
        kind = kinds.pop()
        located = [locate(p) for p in paths]
        frame = self.spark.read.parquet(*located) if kind == "parquet" else read_csv(self.spark, located, **options)
        if name is None:
            name, n = stem(paths[0]), 0
            while name.lower() in self.by_name:
                n += 1
                name = f"{stem(paths[0])}_{n}"
        return self.add(name, frame, kind, paths)


def locate(path: str) -> str:
    """A path as Spark opens it: ``~`` and relative paths become absolute, web
    addresses are refused (stage such files in a store that Spark reads)."""
    import os

    if path.lower().startswith(("http://", "https://")):
        raise InvalidInput(f"{path}: Spark has no file system for web addresses; copy the file to a store first")
    if "://" in path or path.startswith("file:"):
        return path
    return os.path.abspath(os.path.expanduser(path))
