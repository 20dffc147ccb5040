"""The engine: SQL text in, DataFrame out."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import session, theta
from .errors import InvalidInput, engine_errors
from .functions.dialect import to_spark
from .sources import scan, sinks
from .sources.catalog import Catalog, Source


class Engine:
    """Queries in the engine's dialect over registered tables and over files
    named in the query itself.

    >>> Engine(spark).sql("SELECT count(*) AS n FROM '/data/orders.parquet'")
    """

    def __init__(self, spark: SparkSession | None = None):
        self.spark = session.prepare(spark or session.build_session())
        self.catalog = Catalog(self.spark)

    def register(self, name: str, table: DataFrame | str | list[str], **options) -> Source:
        """A table, or Parquet or CSV files, under a name."""
        with engine_errors():
            if isinstance(table, DataFrame):
                return self.catalog.add(name, table)
            return self.catalog.add_files(table, name, **options)

    def translate(self, sql: str) -> str:
        """The query as Spark SQL; files it names are registered."""
        with engine_errors():
            if not sql.strip():
                raise InvalidInput("an empty query")
            return to_spark(scan.rewrite(sql, self.catalog))

    def sql(self, sql: str) -> DataFrame:
        """The query's result: planned by Catalyst, not yet run. Bounds and counts
        of a theta join are read first."""
        text = self.translate(sql)
        with engine_errors():
            return self.spark.sql(theta.rewrite(scan.rewrite(sql, self.catalog), self.catalog) or text)

    def explain(self, sql: str, mode: str = "formatted") -> str:
        """The plan, without running anything."""
        df = self.sql(sql)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def compile(self, sql: str) -> dict:
        """What a deployment of the query needs: its SQL, schema, sources and plan."""
        df = self.sql(sql)
        return {"sql": self.translate(sql), "schema": json.loads(df.schema.json()), "sources": {s.name: list(s.paths) for s in self.catalog.by_name.values()}, "plan": self.explain(sql)}

    def run(self, sql: str, limit: int | None = None) -> str:
        """The result as text, for results of up to 100,000 rows."""
        df = self.sql(sql)
        with engine_errors():
            return sinks.render(df, limit)

    def lines(self, sql: str, limit: int | None = None) -> Iterator[str]:
        """The result as lines of text, however many."""
        df = self.sql(sql)
        with engine_errors():
            yield from sinks.lines(df, limit)

    def write(self, sql: str, path: str, format: str = "parquet", **options) -> None:
        """Writes the result as Parquet or CSV files."""
        df = self.sql(sql)
        with engine_errors():
            if format == "parquet":
                sinks.write_parquet(df, path, **options)
            elif format == "csv":
                sinks.write_csv(df, path, **options)
            else:
                raise InvalidInput(f"format {format}")
