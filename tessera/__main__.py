"""``python -m tessera "SELECT ..."``: runs a query from the arguments or from
standard input and prints its rows; ``--explain`` prints the plan instead."""

from __future__ import annotations

import argparse
import sys

from .engine import Engine
from .errors import EngineError


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description="Runs a query over files.")
    p.add_argument("sql", nargs="?", help="the query (default: standard input)")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--limit", type=int)
    p.add_argument("--output", help="write to this path instead of printing")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    args = p.parse_args(argv)
    sql = args.sql if args.sql is not None else sys.stdin.read()
    try:
        engine = Engine()
        engine.spark.sparkContext.setLogLevel("ERROR")
        if args.explain:
            print(engine.explain(sql))
        elif args.output:
            engine.write(sql, args.output, args.format)
        else:
            for line in engine.lines(sql, args.limit):
                print(line)
    except EngineError as e:
        print(f"{e.kind}: {e}", file=sys.stderr)
        return -e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
