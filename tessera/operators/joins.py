"""Equi, residual and theta joins of ten kinds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType

from ..errors import InvalidInput

KINDS = ("inner", "left", "right", "outer", "semi", "anti", "single", "mark", "right_semi", "right_anti")
_SPARK = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti"}


def condition(left: DataFrame, right: DataFrame, on: Sequence, residual: Column | None = None, null_safe: bool = False) -> Column:
    """``on``: pairs of names or Columns (a bare name means the same on both
    sides). ``residual``: a condition on both rows; it stays in the join, as
    outer, semi and anti joins need it there."""
    terms = []
    for pair in on:
        a, b = (pair, pair) if isinstance(pair, str) else pair
        a = left[a] if isinstance(a, str) else a
        b = right[b] if isinstance(b, str) else b
        terms.append(a.eqNullSafe(b) if null_safe else a == b)
    if residual is not None:
        terms.append(residual)
    return reduce(lambda x, y: x & y, terms) if terms else F.lit(True)


def join(left: DataFrame, right: DataFrame, on: Sequence = (), kind: str = "inner", residual: Column | None = None, null_safe: bool = False, marker: str = "mark") -> DataFrame:
    """Joins two frames; null keys match nothing unless ``null_safe``.

    Catalyst chooses the strategy from sizes and repartitions both sides by the
    keys; skewed partitions are split at run time. A theta join (no keys) is a
    nested loop over the smaller side; for one comparison see ``theta_join``."""
    if kind not in KINDS:
        raise InvalidInput(f"join kind {kind!r}")
    if kind in ("right_semi", "right_anti"):
        on = [p if isinstance(p, str) else (p[1], p[0]) for p in on]
        return join(right, left, on, kind.removeprefix("right_"), residual, null_safe)
    if kind == "mark":
        if len(on) != 1 or residual is not None:
            raise InvalidInput("a mark join has one key and no residual")
        pair = on[0]
        return mark_join(left, right, *((pair, pair) if isinstance(pair, str) else pair), marker)
    if kind == "single":
        return single_join(left, right, on, residual, null_safe)
    return left.join(right, condition(left, right, on, residual, null_safe), _SPARK[kind])


def mark_join(left: DataFrame, right: DataFrame, x: str, y: str, marker: str = "mark") -> DataFrame:
    """``left`` with a boolean: whether ``x`` is among the ``y``. Null where
    nothing matches but ``x`` is null or a ``y`` is; false among no rows."""
    keys = right.select(F.col(y).alias("__y"))
    facts = keys.agg(F.count("*").alias("__n"), F.count_if(F.col("__y").isNull()).alias("__nulls"))  # one row
    found = left.join(keys.filter("__y IS NOT NULL").distinct(), left[x] == F.col("__y"), "left").crossJoin(F.broadcast(facts))
    mark = F.when(F.col("__n") == 0, False).when(F.col("__y").isNotNull(), True).when(F.col(x).isNull() | (F.col("__nulls") > 0), F.lit(None).cast("boolean")).otherwise(False)
    return found.select(*[F.col(c) for c in left.columns], mark.alias(marker))


def single_join(left: DataFrame, right: DataFrame, on: Sequence, residual: Column | None = None, null_safe: bool = False) -> DataFrame:
    """A left join where more than one match is an error, as in a scalar
    subquery. Matches are counted per right key before the join."""
    if residual is not None or not on:
        raise InvalidInput("a single join has keys and no residual")
    keys = [b if isinstance(b, str) else None for b in (p if isinstance(p, str) else p[1] for p in on)]
    if None in keys:
        raise InvalidInput("a single join's right keys are names")
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in rest]).select(*right.columns, "__n")
    found = left.join(once, condition(left, once, on, None, null_safe), "left")
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row returned by a subquery used as an expression")).cast("boolean")).otherwise(True)
    return found.filter(checked).drop("__n")


#: Rows of a side in a block of ``theta_join``, pairs and rows that a task is dealt, cells for ranks and rows that make one.
BLOCK, TASK_PAIRS, TASK_ROWS, CELLS, CELL_ROWS = 1024, 10_000_000, 500_000, 64, 50_000
_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def comparable(a: DataType, b: DataType) -> DataType | None:
    """The type in which ``theta_join`` compares the two, or None if it does not."""
    if isinstance(a, (*_WHOLE, DoubleType)) and isinstance(b, (*_WHOLE, DoubleType)):
        return DoubleType() if DoubleType() in (a, b) else LongType()
    return a if a == b and isinstance(a, (FloatType, DecimalType, DateType)) else None


def theta_join(left: DataFrame, right: DataFrame, x: Column, op: str, y: Column, block: int = BLOCK) -> DataFrame:
    """The inner join on ``x op y``, where ``x`` is of the left and ``y`` of the
    right rows and ``op`` is one of < <= > >=; null matches nothing.

    Rows without a partner are dropped by the other side's bounds. The rest of both
    sides is ranked by value together, so that each row's partners are a range
    of ranks of the other side. Ranks are cut into blocks; a row goes to every pair
    of its block with one that holds partners, and block pairs are joined as keys.
    So the work grows with the rows and the pairs that are returned, no row is
    sent to all, and no task has more than its share of pairs."""
    if op not in ("<", "<=", ">", ">="):
        raise InvalidInput(f"comparison {op!r}")
    kind = comparable(left.select(x).schema[0].dataType, right.select(y).schema[0].dataType)
    if kind is None:
        raise InvalidInput("a theta join compares numbers or dates of one type")
    names, above = {"l": [f"__l{i}" for i in range(len(left.columns))], "r": [f"__r{i}" for i in range(len(right.columns))]}, op[0] == ">"
    l, r = (d.select("*", v.cast(kind).alias("__v")).toDF(*names[k], "__v").filter("__v IS NOT NULL") for k, d, v in (("l", left, x), ("r", right, y)))
    found = _above(l, r, kind, ">" + op[1:], block) if above else _above(r, l, kind, ">" + op[1:], block)
    return found.select(*names["l"], *names["r"]).toDF(*left.columns, *right.columns)


def _cell(v: Column, bounds: list[Column], at: int = 0) -> Column:
    """How many of the rising ``bounds`` are below ``v``, by halving."""
    if not bounds:
        return F.lit(at)
    half = len(bounds) // 2
    return F.when(v <= bounds[half], _cell(v, bounds[:half], at)).otherwise(_cell(v, bounds[half + 1 :], at + half + 1))


def _above(a: DataFrame, b: DataFrame, kind: DataType, op: str, block: int) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` with ``a.__v > b.__v`` (or ``>=``)."""
    of_a, of_b, v, strict = a.columns[:-1], b.columns[:-1], F.col("__v"), op == ">"
    value = lambda x: F.lit(x).cast(kind)
    facts = {row.side: row for row in a.select(F.lit(0).alias("side"), "__v").union(b.select(F.lit(1), "__v")).groupBy("side").agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")).collect()}
    none = a.select(*of_a).join(b.select(*of_b), F.lit(False))
    if len(facts) < 2:
        return none
    low, high = value(facts[1].low), value(facts[0].high)
    a, b = a.filter(v > low if strict else v >= low), b.filter(v < high if strict else v <= high)

    # ranks: within cells of neighbouring values, after the counts of the cells below
    cells = min(CELLS, (facts[0].n + facts[1].n) // CELL_ROWS + 1)
    bounds = a.select("__v").union(b.select("__v")).agg(F.percentile_approx("__v", [i / cells for i in range(1, cells + 1)], 10_000)).first()[0]
    if not bounds:
        return none
    cell = _cell(v, [value(x) for x in bounds])
    empty = lambda d, columns: [F.lit(None).cast(d.schema[c].dataType).alias(c) for c in columns]
    rows = a.select(F.lit(0).alias("__side"), "__v", *of_a, *empty(b, of_b)).union(b.select(F.lit(1), "__v", *empty(a, of_a), *of_b)).withColumn("__cell", cell)
    counts = [[0] * (len(bounds) + 1) for _ in "ab"]
    for row in rows.groupBy("__cell", "__side").count().collect():
        counts[row["__side"]][row["__cell"]] = row["count"]
    below = [[0, *accumulate(c)] for c in counts]
    n_a, pairs = below[0][-1], sum(n * top for n, top in zip(counts[0], below[1][1:]))
    tie = F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t and "variant" not in t])  # the same ranks if a task runs again
    before = Window.partitionBy("__cell").orderBy("__v", F.col("__side") if strict else F.col("__side").desc(), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = lambda side: (F.sum((F.col("__side") == side).cast("long")).over(before) + F.get(F.lit(below[side]).cast("array<bigint>"), F.col("__cell"))).alias(("__a", "__b")[side])
    ranked = rows.select("*", rank(0), rank(1))  # rows of a and of b up to this one

    blocks = lambda c: F.floor(c / block).cast("long")
    at_a, at_b, last = F.col("__a"), F.col("__b"), F.lit((n_a - 1) // block).cast("long")
    in_a = ranked.filter((F.col("__side") == 0) & (at_b > 0)).select(*of_a, "__v", blocks(at_a - 1).alias("__i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks(at_b - 1))).alias("__j"))
    in_b = ranked.filter((F.col("__side") == 1) & (at_a < n_a)).select(*of_b, v.alias("__w"), F.explode(F.sequence(blocks(at_a), last)).alias("__i"), blocks(at_b - 1).alias("__j"))
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, pairs // TASK_PAIRS, sum(below[0][-1:] + below[1][-1:]) // TASK_ROWS)
    in_a, in_b = (d.repartition(tasks, "__i", "__j") for d in (in_a, in_b))
    return in_a.join(in_b.hint("merge"), ["__i", "__j"]).filter(v > F.col("__w") if strict else v >= F.col("__w"))


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows; the columns of ``left`` come first."""
    return left.crossJoin(right)
