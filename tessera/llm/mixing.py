"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target from its weight; whole epochs are taken while they
fit, and a subset of the source's documents fills the rest of the budget. The
subset is chosen by length alone: documents are counted by exact length, each
length gives its share, and a bounded-knapsack dynamic program over what is
left makes the lengths add up to the budget. Which documents of a length are
taken is decided by a seeded hash, so reruns agree.

Defined results: a null text has size 0 and takes 0 words; a null source is a
source of its own, the last; repeated rows count as often as they occur; an
empty table gives an empty result. The driver holds one row per source.
"""

from __future__ import annotations

import math

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, share: float = 1.0) -> dict[str | None, float]:
    """Target of each source: ``share`` of all words, by weights that repeat
    over the sources in code point order (null last). No target is above
    ``cap`` times its source; what is above is shared again by weight."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, active = share * sum(sizes.values()), {}, list(order)
    while active:
        unit = left / sum(weight[s] for s in active)
        above = [s for s in active if unit * weight[s] > cap * sizes[s]]
        for s in above or active:
            out[s] = cap * sizes[s] if above else unit * weight[s]
        if not above:
            break
        left -= sum(out[s] for s in above)
        active = [s for s in active if s not in out]
    return out


def _exact(lengths: list[int], avail: dict[int, int], budget: int, room: int = 1 << 31) -> dict[int, int]:
    """Bounded knapsack: how many of each length add up to ``budget``, or to
    the largest smaller sum. Reachable sums are the bits of an integer; one in
    ``every`` of them is held, the rest are made again on the way back. Held are
    ``room`` bits at most: documents beyond that are not looked at."""
    mask, reach, steps, marks, every = (1 << budget + 1) - 1, 1, [], [], 16
    n, part = {size: m for size in lengths if (m := min(avail[size], budget // size))}, 1
    while n and not reach >> budget & 1 and (len(marks) + every + 1) * budget <= room:
        for size in list(n):  # one of each length, then two more of each, four, ...
            k = min(part, n[size])
            if len(steps) % every == 0:
                marks.append(reach)
            steps.append((size, k))
            reach |= reach << size * k & mask
            n[size] -= k
            if reach >> budget & 1 or (len(marks) + every + 1) * budget > room:
                break
        n, part = {size: m for size, m in n.items() if m}, part * 2
    value, take = reach.bit_length() - 1, {}
    for at in reversed(range(len(marks))):
        some, befores = steps[at * every : (at + 1) * every], [marks[at]]
        for size, k in some[:-1]:
            befores.append(befores[-1] | befores[-1] << size * k & mask)
        for (size, k), before in zip(reversed(some), reversed(befores)):
            if not before >> value & 1:
                value -= size * k
                take[size] = take.get(size, 0) + k
    return take


def fit(counts: dict[int, int], budget: int, exact_below: int = 1 << 15, seed: int = 17) -> dict[int, int]:
    """How many documents of each length to take so that their lengths add up
    to ``budget`` or as near below it as the counts allow: each length gives its
    proportional share, seeded draws by what the shares were rounded down by
    bring the rest below ``exact_below`` or 16 documents of mean length, and the
    dynamic program finds the rest. Where it finds no exact sum, the shares are
    of less and less of the budget, until the program has all of it or as much
    as its table has room for; the nearest sum counts."""
    counts = {k: n for k, n in counts.items() if k > 0 and n > 0}
    total = sum(k * n for k, n in counts.items())
    budget = max(0, min(budget, total))
    if budget == total:
        return counts
    unit = math.gcd(*counts)
    if unit > 1:
        return {k * unit: n for k, n in fit({k // unit: n for k, n in counts.items()}, budget // unit, exact_below, seed).items()}
    draw = {k: (xxhash.xxh64_intdigest(str(k), seed) + 1) / 2**64 for k in counts}
    below, kept, best, most = max(exact_below, 16 * total // sum(counts.values())), 0, {}, -1
    while True:
        share = max(0, budget - kept)
        take = {k: n * share // total for k, n in counts.items()}
        left = budget - sum(k * n for k, n in take.items())
        avail = {k: counts[k] - take[k] for k in counts}
        # Of a length with the rest r one document more is taken with a chance that grows with r.
        rest = {k: n * share % total or 1 for k, n in counts.items()}
        order = sorted((k for k in avail if avail[k]), key=lambda k: (draw[k] / rest[k], k))
        for k in order:
            if left <= kept + below:
                break
            m = min(1, max(0, left - kept - below // 2) // k)
            take[k] += m
            avail[k] -= m
            left -= m * k
        for k, m in _exact([k for k in order if avail[k]], avail, left).items():
            take[k] += m
            avail[k] -= m
            left -= m * k
        for k in order:  # where the table had no room for all
            m = min(avail[k], left // k)
            take[k] += m
            left -= m * k
        got = budget - left
        if got > most:
            best, most = take, got
        if most == budget or kept >= budget or 17 * (kept + below) > 1 << 31:
            return best
        kept = 16 * max(kept, below)


def _choose(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Epochs and partial take for the lengths of one source."""
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    epochs = int(target // size) if size else 0
    rest = round(target - epochs * size) if size else 0
    take = fit(dict(zip(pdf["size"].tolist(), pdf["n"].tolist())), rest, seed=seed)
    return pdf.assign(epochs=epochs, k=[take.get(s, 0) for s in pdf["size"].tolist()])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, share: float = 1.0, seed: int = 17, rid: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken, rid: how often the
    mix takes each document of ``docs`` (doc_id, source, text; ``rid`` names a
    column that tells rows apart, else rid is null)."""
    spark = docs.sparkSession
    rid = F.lit(None).cast("long").alias("rid") if rid is None else F.col(rid).alias("rid")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).alias("h"),
        rid,
    )
    rows = shared.stage(sized, "sized")
    lengths = shared.stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = {r[0]: r[1] for r in lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()}
    goal = targets(sizes, weights, cap, share)
    plan = spark.createDataFrame([(s, sizes[s], float(goal[s])) for s in sizes], "source string, source_size long, target double")
    chosen = lengths.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    chosen = chosen.groupBy("source").applyInPandas(lambda pdf: _choose(pdf, seed), "source string, size long, n long, source_size long, target double, epochs long, k long")
    chosen = shared.stage(chosen, "chosen").select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "epochs", "k", F.col("n").alias("of"))
    # The k smallest hashes of each (source, size): ranked within 4096 ranges of the
    # hash, whose counts add up before, so that a frequent length is no single task's.
    rows = rows.withColumn("b", F.shiftright("h", 52))
    ranges = rows.groupBy("source", "size", "b").agg(F.count("*").alias("m"))
    before = Window.partitionBy("source", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("b").alias("b2"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "b").orderBy("h", "doc_id")))
    ranked = ranked.join(ranges, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("b") == F.col("b2")))
    out = ranked.join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    repeats = F.col("epochs") + F.when(F.col("base") + F.col("nth") <= F.col("k"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"), "rid")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents")).drop("rid")
