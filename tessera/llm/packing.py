"""Best-fit packing by a configuration linear program.

Only the histogram of piece lengths matters for how well pieces pack, and it
has at most ``capacity`` bins however many documents there are. The driver
solves the configuration LP over that histogram: multiplicative weights hold a
price for each length, a knapsack dynamic program over the capacity prices the
best next pattern, and a length that has been served gets cheaper. The
fractional pattern counts are rounded down against what is left; what this
leaves is rounded by diving: the weights go on over the rest, the knapsack now
takes no length more often than it is left, and each pattern it prices is fixed
as often as the counts allow. Best fit places the last few sequences' worth.
The work depends on the histogram alone. Pieces then find their places by their
rank among the pieces of equal length; no group of equal lengths ever meets in
one task.

Defined results: a null text is empty and still has its end id; a null doc_id
passes through; repeated rows are packed as often as they occur; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder, resolve, slices

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity and the index of the item taken last (-1: none)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        best[c] = best[c - 1]
        if k:
            gain = best[c - lengths[:k]] + prices[:k]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], last[c] = gain[i], i
    return best, last


def _trace(lengths: np.ndarray, last: np.ndarray, c: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while c > 0:
        i = int(last[c])
        if i < 0:
            c -= 1
            continue
        out[i] = out.get(i, 0) + 1
        c -= int(lengths[i])
    return out


def _fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, eps: float, near: int, gap: float = 0.005, slack: float = 0.05) -> tuple[list[tuple[dict[int, int], float]], np.ndarray, np.ndarray, float]:
    """Multiplicative weights for the configuration LP: patterns with fractional
    multiplicities, how far they cover each length, the prices, and a lower bound of the LP
    (any prices over the value of their best pattern are a dual solution).

    A round prices once. Besides the best pattern it takes those that end at the
    ``near`` next smaller capacities, share no length with one taken before and
    are worth at least 1 - ``slack`` of the best; each is used as often as its scarcest
    length allows, and what it serves gets cheaper by that share. The search
    ends when the scaled solution is within ``gap`` of the bound."""
    prices, cover, lower = lengths / capacity, np.zeros(len(lengths)), 0.0
    dual = prices.copy()
    found: dict[tuple, float] = {}
    for _ in range(rounds):
        best, last = _knapsack(lengths, prices, capacity)
        if (bound := float((counts * prices).sum() / best[capacity])) > lower:
            lower, dual = bound, prices.copy()
        used: set[int] = set()
        for c in range(capacity, max(0, capacity - near), -1):
            if best[c] < (1 - slack) * best[capacity]:
                break
            p = _trace(lengths, last, c)
            if not p or used & p.keys():
                continue
            used |= p.keys()
            step = min(counts[i] / n for i, n in p.items())
            key = tuple(sorted(p.items()))
            found[key] = found.get(key, 0.0) + step
            for i, n in p.items():
                cover[i] += n * step / counts[i]
                prices[i] *= np.exp(-eps * n * step / counts[i])
        if (least := cover.min()) > 0 and sum(found.values()) / least <= (1 + gap) * lower:
            break
    return [(dict(k), x) for k, x in found.items()], cover, dual, lower


def _best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit of decreasing lengths, many equal pieces and equal bins at a time."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_at = np.zeros(capacity + 1, dtype=bool)

    def put(free: int, items: tuple[int, ...], n: int) -> None:
        bins.setdefault(free, []).append((items, n))
        open_at[free] = True

    for i in np.argsort(-lengths):
        size, n = int(lengths[i]), int(counts[i])
        while n:
            fits = np.flatnonzero(open_at[size:])
            if not len(fits):
                q = capacity // size
                if n >= q:
                    put(capacity - q * size, (size,) * q, n // q)
                if n % q:
                    put(capacity - n % q * size, (size,) * (n % q), 1)
                n = 0
                continue
            free = size + int(fits[0])
            items, k = bins[free].pop()
            if not bins[free]:
                open_at[free] = False
            q = min(free // size, n)  # best fit goes on with the bin it has just used
            if k * q <= n:
                m = k
            else:
                m = n // q
                put(free, items, k - m)
            put(free - q * size, items + (size,) * q, m)
            n -= m * q
    out: dict[Pattern, int] = {}
    for kinds in bins.values():
        for items, n in kinds:
            sizes, times = np.unique(items, return_counts=True)
            key = tuple(zip(sizes[::-1].tolist(), times[::-1].tolist()))
            out[key] = out.get(key, 0) + n
    return list(out.items())


def _bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parcels of equal pieces (length's index, how many), and for each parcel and
    capacity whether the best that fills it exactly, with the parcels so far and
    at most ``counts`` pieces of each length, ends with this one."""
    parcels = []
    for i, n in enumerate(np.minimum(counts, capacity // lengths).tolist()):
        k = 1
        while n:
            parcels.append((i, min(k, n)))
            n, k = n - min(k, n), 2 * k
    index, times = np.array(parcels, dtype=np.int64).T
    best = np.full(capacity + 1, -np.inf)
    best[0], used = 0.0, np.zeros((len(parcels), capacity + 1), dtype=bool)
    for row, w, value in zip(used, (times * lengths[index]).tolist(), (times * prices[index]).tolist()):
        new = best[: capacity + 1 - w] + value
        np.greater(new, best[w:], out=row[w:])
        np.maximum(best[w:], new, out=best[w:])
    return index, times, used


def _dive(lengths: np.ndarray, left: np.ndarray, prices: np.ndarray, capacity: int, eps: float, tail: int, slack: float = 0.004) -> list[tuple[dict[int, int], int]]:
    """Patterns for what rounding has left, each with a whole multiplicity, until
    about ``tail`` sequences are left. Each pricing gives, for every longest piece
    that a pattern may have, the best pattern that fills a sequence, and those
    worth nearly as much as the best of all are taken; where none is full any
    more, the next smaller sum is. Of patterns of one price those with the longer
    pieces come first: short ones are of more use later."""
    out: list[tuple[dict[int, int], int]] = []
    prices = prices / max(1e-300, float((prices / lengths).max())) * (1 + 0.02 * lengths / capacity)
    fill = capacity
    while fill and (lengths * left).sum() > tail * capacity:
        some = np.flatnonzero(left)
        index, times, used = _bounded_knapsack(lengths[some], left[some], prices[some], fill)
        weight, value, done, top = times * lengths[some][index], times * prices[some][index], 0, 0.0
        for end in np.flatnonzero(used[:, fill])[::-1].tolist():
            c, stop, p, worth = fill, end + 1, {}, 0.0
            while c:
                stop = int(np.flatnonzero(used[:stop, c])[-1])
                i = int(some[index[stop]])
                p[i] = p.get(i, 0) + int(times[stop])
                c -= int(weight[stop])
                worth += float(value[stop])
            top = max(top, worth)
            if worth < (1 - slack) * top:  # and so are all with a shorter longest piece
                break
            m = min(int(left[i]) // n for i, n in p.items())
            if not m:
                continue
            done += 1
            out.append((p, m))
            for i, n in p.items():
                prices[i] *= np.exp(-eps * n * m / left[i])
                left[i] -= m * n
        if not done:
            fill = int(np.flatnonzero(used[:, :fill].any(0)).max(initial=0))
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = 200, eps: float = 0.05, near: int = 64, tail: int = 12) -> tuple[list[tuple[Pattern, int]], list[tuple[Pattern, int]]]:
    """Patterns of the LP for pieces below ``capacity`` and how many sequences
    follow each, and those that best fit adds for the rest; together they use
    every piece once."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), dtype=np.int64)
    counts = np.array([histogram[k] for k in lengths.tolist()], dtype=np.int64)
    if not len(lengths):
        return [], []
    solution, cover, prices, _ = _fractional(lengths, counts, capacity, rounds, eps, near)
    left, found = counts.copy(), []
    scale = 1 / cover[cover > 0].min() if (cover > 0).all() else 1 / np.median(cover[cover > 0])
    for p, x in sorted(solution, key=lambda y: -y[1]):
        if (m := min(int(x * scale), *(int(left[i]) // n for i, n in p.items()))) > 0:
            for i, n in p.items():
                left[i] -= m * n
            found.append((p, m))
    found += _dive(lengths, left, prices, capacity, eps, tail)
    named = [(tuple(sorted(((int(lengths[i]), n) for i, n in p.items()), reverse=True)), m) for p, m in found]
    return named, _best_fit(lengths[left > 0], left[left > 0], capacity)


def plan(histogram: dict[int, int], capacity: int, **options) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences follow each; uses every piece once."""
    full: list[tuple[Pattern, int]] = [(((capacity, 1),), n)] if (n := histogram.get(capacity)) else []
    by_program, rest = solve(histogram, capacity, **options)
    return full + by_program + rest


def _places(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, offset), sorted."""
    rows, taken, sequence = [], {}, 0
    for p, m in patterns:
        offset = 0
        for size, n in p:
            first = taken.get(size, 0)
            rows.append((size, first, n, sequence, offset))
            taken[size] = first + n * m
            offset += size * n
        sequence += m
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("pid", pa.int64()), ("nth", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, pid long, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """The pieces of all documents, each with its task (pid) and its number
    among that task's pieces of the same length (nth)."""
    path = resolve(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, pid = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            docs_, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(texts):
                cols: list[list] = [[] for _ in _PIECES]
                for doc, ids in zip(docs_[i:j], enc.encode(texts[i:j])):
                    ids = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        raw, n = part.tobytes(), len(part)
                        for c, v in zip(cols, (doc, k, at, n, zlib.crc32(raw), raw if keep_ids else None, pid, int(seen[n]))):
                            c.append(v)
                        seen[n] += 1
                yield shared.batch(_PIECES, cols)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES_SQL)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``capacity``
    tokens. One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with ``keep_ids`` the ids as little-endian uint32."""
    spark = docs.sparkSession
    pieces = shared.stage(cut_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    counts = shared.stage(pieces.groupBy("pid", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))  # grows with the histogram only
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, times, sequence, offset = places.value.T
        keys = size << 44 | first
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 6))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            k = rank - first[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(sequence[at] + k // times[at]), pa.array(offset[at] + k % times[at] * length)], names=[*b.schema.names[:6], "sequence_id", "offset"])

    out = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
    return out if keep_ids else out.drop("ids")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"))
