"""Runs named queries: alone, at a rate, or along a trace of arrivals.

``python -m tessera.bench config.json`` with::

    {"tables": {"lineitem": ["part-0.parquet", "part-1.parquet"]},
     "queries": {"q1": "SELECT ... FROM [lineitem] ..."},
     "mode": "single", "repetitions": 3, "timeout": 30,
     "checksums": {"q1": [6, 1234]}}

``mode`` is ``single``, ``throughput`` ("rates": requests a second, "seconds": how
long each) or ``trace`` ("trace": [[second, query], ...]). ``[name]`` in a query
stands for a table.
"""

from __future__ import annotations

import json
import re
import sys
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from .checksum import checksum


@dataclass
class Timing:
    query: str
    planning_s: float
    runs: list[float]
    checksum_ok: bool | None

    def line(self) -> str:
        r = self.runs or [float("nan")]
        return f"{self.query}\t{self.planning_s * 1000:.0f}\t{len(self.runs)}\t{min(r):.3f}\t{sum(r) / len(r):.3f}\t{max(r):.3f}\t{self.checksum_ok}"


def fill(sql: str, tables: Iterable[str]) -> str:
    """``[name]`` becomes the table's name."""
    known = set(tables)

    def put(m: re.Match) -> str:
        if m.group(1) not in known:
            raise KeyError(f"no table {m.group(1)}")
        return m.group(1)

    return re.sub(r"\[(\w+)\]", put, sql)


def drain(df: DataFrame) -> None:
    """Runs a query without keeping its rows."""
    df.write.format("noop").mode("overwrite").save()


def single(queries: dict[str, Callable[[], DataFrame]], repetitions: int = 3, checksums: dict | None = None) -> list[Timing]:
    out = []
    for name, make in queries.items():
        start = time.perf_counter()
        make()._jdf.queryExecution().executedPlan()
        planning, runs = time.perf_counter() - start, []
        for _ in range(repetitions):
            start = time.perf_counter()
            drain(make())
            runs.append(time.perf_counter() - start)
        ok = None
        if checksums and name in checksums:
            ok = tuple(checksums[name]) == checksum(make())
        out.append(Timing(name, planning, runs, ok))
    return out


def arrivals(schedule: Iterable[tuple[float, str]], queries: dict[str, Callable[[], DataFrame]], workers: int = 16) -> list[tuple[str, float, float]]:
    """Starts queries at their times whether or not earlier ones are done (open
    loop); returns (query, due, seconds until its end, waiting included)."""
    begun = time.perf_counter()

    def run(due: float, name: str) -> tuple[str, float, float]:
        drain(queries[name]())
        return name, due, time.perf_counter() - begun - due

    with ThreadPoolExecutor(workers) as pool:
        jobs = []
        for due, name in sorted(schedule):
            time.sleep(max(0.0, due - (time.perf_counter() - begun)))
            jobs.append(pool.submit(run, due, name))
        return [j.result() for j in jobs]


def throughput(queries: dict[str, Callable[[], DataFrame]], rates: Iterable[float], seconds: float, workers: int = 16) -> dict[float, float]:
    """Mean latency at each rate of requests a second, queries taken in turn."""
    names, out = list(queries), {}
    for rate in rates:
        schedule = [(i / rate, names[i % len(names)]) for i in range(max(1, int(rate * seconds)))]
        got = arrivals(schedule, queries, workers)
        out[rate] = sum(x for _, _, x in got) / len(got)
    return out


def main(argv: list[str]) -> int:
    for path in argv:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        engine = Engine(SparkSession.builder.config("spark.scheduler.mode", "FAIR").getOrCreate())
        for name, files in config["tables"].items():
            engine.register(name, files)
        queries = {k: (lambda q=fill(sql, config["tables"]): engine.sql(q)) for k, sql in config["queries"].items()}
        mode = config.get("mode", "single")
        if mode == "single":
            print("query\tplanning_ms\truns\tmin\tmean\tmax\tchecksum_ok")
            for t in single(queries, config.get("repetitions", 3), config.get("checksums")):
                print(t.line())
        elif mode == "throughput":
            for rate, mean in throughput(queries, config["rates"], config["seconds"]).items():
                print(f"{rate}\t{mean:.3f}")
        elif mode == "trace":
            for name, due, took in arrivals([(float(a), b) for a, b in config["trace"]], queries):
                print(f"{name}\t{due:.3f}\t{took:.3f}")
        else:
            raise ValueError(f"mode {mode}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
