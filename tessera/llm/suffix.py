"""Suffix-array dedup: bytes covered by strings that occur more than once.

Every byte that lies in a ``width``-byte string which also starts anywhere else
is marked. No string crosses the end of a document. Strings may be of words
instead of bytes (``Unit``): then the symbols are word hashes.

1. Each string of ``width`` symbols belongs to the smallest hash among its
   windows of ``gram`` symbols, a quarter as long. A first pass over the texts only
   counts the hashes that are smallest somewhere: equal strings fall under equal
   hashes. Texts with a hash that occurs again are looked at once more, each
   distinct text once: runs of strings with such a hash form segments. Equal
   segments are one, with a count.
2. A segment whose hash occurs nowhere else, once, goes, and so does one that
   shares neither the bytes right of the gram nor those left of it with another
   of its hash: neither holds a repeated string. The remaining segments of some
   hashes are written one after another; their suffixes are sorted, and the
   Burrows-Wheeler transform is extended backward
   breadth first: intervals of strings of length 0, 1, 2, ... set the common
   prefixes in increasing order, each once, and the search stops at ``width``.
   Where no value was set between two suffixes, they share ``width`` symbols or
   more.
3. A hash with very many different segments is not one task's: its strings are
   counted by a 128-bit digest over all tasks (the exact way for the rest).

Defined results: a null text is empty; texts shorter than ``width`` bytes lose
nothing; copies of a text lose all of it if it is that long; repeated rows count
as copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse
_RUN = 4096  # strings in a segment at most
_PART = 1 << 18  # symbols of a text that are looked at together
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")  # what a word is, as in mixing
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []  # of the base and of its inverse, made when first needed


def _sums(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a * base ** i before each position, and the powers of the inverse."""
    if not _POWERS or len(_POWERS[0]) < len(a) + 1:
        size = max(len(a) + 1, _PART + 1024)
        _POWERS[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(a * _POWERS[0][: len(a)], out=total[1:])
    return total, _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ h >> np.uint64(29)


def gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` symbols from each position; their number costs nothing."""
    total, down = _sums(a)
    return _mixed((total[gram:] - total[:-gram]) * down[: len(a) - gram + 1])


def word_codes(raw: bytes) -> bytes:
    """The words of a text as 64-bit hashes."""
    out, at = [], 0
    while at < len(raw):
        end = at + _PART
        if end < len(raw):  # not within a word
            found = _SPACE.search(raw, end)
            end = found.start() if found else len(raw)
        a = np.frombuffer(raw, dtype=np.uint8)[at:end]
        inside = np.concatenate(([False], (a != 32) & ((a < 9) | (a > 13)), [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        total, down = _sums(a.astype(np.uint64) + np.uint64(1))
        out.append(_mixed((total[edges[1::2]] - total[edges[::2]]) * down[edges[::2]]))
        at = end
    return np.concatenate([*out, np.zeros(0, np.uint64)]).tobytes()


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    m, reach = h, 1
    while reach * 2 <= w:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    return np.minimum(m[: -(w - reach)], m[w - reach :]) if w > reach else m


@dataclass(frozen=True)
class Unit:
    """What strings are made of: symbols of ``size`` bytes (1 or 8), read from a
    text by ``read``."""

    width: int
    gram: int
    size: int
    read: Callable[[bytes], bytes]

    def parts(self, raw: bytes) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """(first symbol, symbols, hashes) of overlapping parts of a text's symbols."""
        for base in range(0, max(0, len(raw) // self.size - self.width + 1), _PART):
            part = raw[base * self.size : (base + _PART + self.width - 1) * self.size]
            yield base, part, gram_hashes(np.frombuffer(part, dtype=f"<u{self.size}").astype(np.uint64), self.gram)


def byte_strings(width: int = 400, gram: int | None = None) -> Unit:
    return Unit(width, gram or width // 4, 1, lambda raw: raw)


def word_strings(width: int = 51, gram: int | None = None) -> Unit:
    return Unit(width, gram or width // 4, 8, word_codes)


def least_hashes(raw: bytes, unit: Unit) -> np.ndarray:
    """The hashes that are the smallest of some string of symbols ``raw``, once
    for each place where they are."""
    out, w = [], unit.width - unit.gram + 1
    for _, _, h in unit.parts(raw):
        m = sliding_min(h, w)
        # The largest of the minima of all strings around a place is its own hash.
        edge = np.zeros(w - 1, dtype=np.uint64)
        most = ~sliding_min(~np.concatenate((edge, m, edge)), w)
        out.append(h[most == h])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def segments(raw: bytes, unit: Unit, wanted: set[int]) -> Iterator[tuple[int, int, int, int, int | None, int | None, bool]]:
    """(hash, start, length, digest, left, right, odd) for each run of strings
    of one smallest hash, if that is ``wanted``, in symbols ``raw``. left and right:
    digests of what every string shares which has the gram in its right or left
    half (None: no such string); odd: the gram occurs more than once, so that
    neither is known."""
    width, gram, z = unit.width, unit.gram, unit.size
    w, half = width - gram + 1, (width - gram) // 2
    for base, part, h in unit.parts(raw):
        m = sliding_min(h, w)
        change = np.flatnonzero(m[1:] != m[:-1]) + 1
        starts = np.concatenate(([0], change))
        for first, last, fp in zip(starts.tolist(), [*change.tolist(), len(m)], m[starts].tolist()):
            if fp not in wanted:
                continue
            for s in range(first, last, _RUN):
                e = min(s + _RUN, last)
                near = h[s : e + w - 1]
                at = np.flatnonzero(near == m[s])
                odd, q, left, right = len(at) > 1, s + int(at[0]), None, None
                if not odd:
                    if e - 1 >= q - half:
                        right = xxhash.xxh3_64_intdigest(part[q * z : (q + width - half) * z])
                    if s < q - half:
                        left = xxhash.xxh3_64_intdigest(part[(q - half) * z : (q + gram) * z])
                yield fp, base + s, e - s + width - 1, xxhash.xxh3_64_intdigest(part[s * z : (e + width - 1) * z]), left, right, odd


def sort_suffixes(sym: np.ndarray, width: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes: by a first key of at most ``width``
    symbols, then by the ranks of what follows, three times as far in each round.
    Symbol 0 separates and comes last; separators are smaller than all else and all different
    (in the order of their positions). Besides, what the first key of ``lead``
    symbols tells: lead, where a suffix differs from the one before within it,
    and which suffixes have a separator before its last symbol."""
    n = len(sym)
    bits = int(sym.max(initial=1)).bit_length()
    lead = min(63 // bits, width)
    padded = np.concatenate((sym, np.zeros(lead, dtype=sym.dtype)))
    key, ends = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for j in range(lead):
        early = ends.copy() if j == lead - 1 else None
        ends |= padded[j : j + n] == 0
        key <<= bits
        key |= np.where(ends, 0, padded[j : j + n])  # nothing behind a separator counts
    sa = np.argsort(key, kind="stable").astype(np.int32)
    key = key[sa]
    first = np.concatenate(([True], (key[1:] != key[:-1]) | ends[sa[1:]]))
    apart, cut = first.copy(), early[sa]
    del key, ends, early, padded
    rank = np.empty(n, dtype=np.int32)
    head = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0)).astype(np.int32)
    rank[sa] = head
    known = lead
    three = n < 1 << 21  # so small that three places fit into a number
    steps = (1, 2) if three else (1,)
    while True:
        alone = first & np.concatenate((first[1:], [True]))
        at = np.flatnonzero(~alone).astype(np.int32)
        if not len(at):
            break
        members = sa[at]
        pair = head[at].astype(np.int64)
        for k in steps:
            pair = pair * n + rank[np.minimum(members + k * known, n - 1)]
        order = np.argsort(pair)
        members, pair = members[order], pair[order]
        sa[at] = members
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        first[at] = new
        head[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[members] = head[at]
        known *= 1 + len(steps)
    return sa, lead, apart, cut


def long_prefixes(sym: np.ndarray, sa: np.ndarray, width: int, lead: int, apart: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """For each place p of ``sa`` (1 to n - 1; 0 and n: False) whether the
    suffixes at p - 1 and p share ``width`` symbols: what remains after the
    backward search has set all smaller common prefixes, those below ``lead``
    from the first key of the sort and the others by increasing value."""
    n = len(sym)
    isa = np.empty(n, dtype=np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    bwt = np.where(sa > 0, sym[sa - 1], 0)
    lf = np.where(sa > 0, isa[sa - 1], 0)
    del isa
    known = np.append(apart, True)
    # The intervals of all strings of lead symbols; a separator may be the last.
    lo = np.flatnonzero(apart).astype(np.int32)
    hi = np.append(lo[1:], np.int32(n))
    lo, hi = lo[~cut[lo]], hi[~cut[lo]]
    # Repetitive text has long runs in its transform: a run is extended as a whole.
    begins = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1]))).astype(np.int32)
    ends = np.append(begins[1:], np.int32(n))
    run = np.repeat(np.arange(len(begins), dtype=np.int32), ends - begins)
    for _ in range(lead, width):
        if not len(lo):
            break
        r, size = run[lo], run[hi - 1] - run[lo] + 1
        one = (size == 1) & (bwt[lo] != 0)
        los, his = [lf[lo[one]]], [lf[hi[one] - 1] + 1]
        many = np.flatnonzero(size > 1)
        if len(many):
            size = size[many]
            total = np.cumsum(size)
            which = np.repeat(many, size)
            at = np.arange(int(total[-1])) + np.repeat(r[many] - (total - size), size)
            c = bwt[begins[at]]
            live = c != 0
            at, which, c = at[live], which[live], c[live]
            if len(at):
                to, end = lf[np.maximum(begins[at], lo[which])], lf[np.minimum(ends[at], hi[which]) - 1] + 1
                order = np.argsort(which.astype(np.int64) * n + to)
                to, end, which, c = to[order], end[order], which[order], c[order]
                new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (c[1:] != c[:-1]))))
                los.append(to[new])
                his.append(end[np.concatenate((new[1:] - 1, [len(to) - 1]))])
        lo, hi = np.concatenate(los), np.concatenate(his)
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        known[hi] = True
    return ~known


def repeated_starts(parts: list[bytes], width: int, size: int = 1) -> list[np.ndarray]:
    """For each string of symbols of ``size`` bytes (1 or 8) the positions of the
    strings of ``width`` symbols that start at another place of the strings too."""
    sizes = np.array([len(p) // size + 1 for p in parts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    if size == 1:
        sym = np.zeros(int(sizes.sum()), dtype=np.int16)
        numbers = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int16) + 1
    else:
        sym = np.zeros(int(sizes.sum()), dtype=np.int32)
        numbers = np.unique(np.frombuffer(b"".join(parts), dtype="<u8"), return_inverse=True)[1].astype(np.int32) + 1
    inside = np.ones(len(sym), dtype=bool)
    inside[starts + sizes - 1] = False
    sym[inside] = numbers
    sa, *first = sort_suffixes(sym, width)
    long = long_prefixes(sym, sa, width, *first)
    at = np.sort(sa[long[:-1] | long[1:]])
    cut = np.searchsorted(at, np.append(starts, len(sym)))
    return [at[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], starts)]


def runs(at: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by strings at the sorted positions ``at``."""
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > width)
    return list(zip(at[np.concatenate(([0], gap + 1))].tolist(), (at[np.concatenate((gap, [len(at) - 1]))] + width).tolist()))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def word_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the text for ranges of its words."""
    at = [m.span() for m in _WORD.finditer(raw)] if spans else []
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


_LEAST = pa.schema([("key", pa.binary()), ("fps", pa.list_(pa.int64()))])
_SEGMENTS = pa.schema([("key", pa.binary()), ("times", pa.int64()), ("fp", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("dig", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("odd", pa.bool_())])
_TEXTS = pa.schema([("fp", pa.int64()), ("dig", pa.int64()), ("len", pa.int32()), ("body", pa.binary())])
_COVERS = pa.schema([("fp", pa.int64()), ("dig", pa.int64()), ("len", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
_STRINGS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fp", pa.int64()), ("dig", pa.int64()), ("len", pa.int32()), ("at", pa.int32())])


def _signed(x: int | None) -> int | None:
    return None if x is None else x - (x >> 63 << 64)


def _least(texts: DataFrame, unit: Unit) -> DataFrame:
    """(key, fps): the hashes that are smallest somewhere in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [least_hashes(unit.read(raw.as_py()), unit).view(np.int64) for raw in b.column(1)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))], schema=_LEAST)

    least = unit.width if unit.size == 1 else 2 * unit.width - 1  # words and what stands between them
    return texts.filter(F.length("raw") >= least).mapInArrow(run, "key binary, fps array<long>")


def _places(texts: DataFrame, hits: DataFrame, unit: Unit) -> DataFrame:
    """The segments of the texts of ``hits`` (key, times, fps) under their fps."""
    some = shared.sieve(texts, hits)[0].dropDuplicates(["key"]).join(hits, "key").select("key", "raw", "times", "fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, raw, times, fps in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
                wanted = set(fps.values.to_numpy().view(np.uint64).tolist())
                for fp, start, n, dig, left, right, odd in segments(unit.read(raw.as_py()), unit, wanted):
                    rows.append((key, times, _signed(fp), start, n, _signed(dig), _signed(left), _signed(right), odd))
                if len(rows) > 50_000:
                    yield shared.batch(_SEGMENTS, list(zip(*rows)))
                    rows = []
            if rows:
                yield shared.batch(_SEGMENTS, list(zip(*rows)))

    return some.mapInArrow(run, "key binary, times long, fp long, start int, len int, dig long, l long, r long, odd boolean")


def _bodies(texts: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """The symbols of the segments ``wanted`` (fp, dig, len, key, start). Only texts
    that pass a Bloom filter of the wanted keys are shuffled."""
    each = shared.stage(wanted.groupBy("key").agg(F.collect_list(F.struct("fp", "dig", "len", "start")).alias("parts")), "wanted")  # of one text
    some = shared.sieve(texts, each)[0].dropDuplicates(["key"]).join(each, "key").select("raw", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for raw, parts in zip(b.column(0), b.column(1)):
                raw = unit.read(raw.as_py())
                for p in parts.as_py():
                    body = raw[p["start"] * unit.size : (p["start"] + p["len"]) * unit.size]
                    rows.append((p["fp"], p["dig"], p["len"], body))
                    size += len(body)
                if size > 4 << 20:
                    yield shared.batch(_TEXTS, list(zip(*rows)))
                    rows, size = [], 0
            if rows:
                yield shared.batch(_TEXTS, list(zip(*rows)))

    return some.mapInArrow(run, "fp long, dig long, len int, body binary")


def _by_transform(bodies: DataFrame, unit: Unit, batch_bytes: int) -> DataFrame:
    """Covered ranges of segments, by the transform: all segments of a hash are
    in one batch."""

    def solve(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch | None:
        rows = [(fp, dig, n, a, b) for (fp, dig, n, _), at in zip(held, repeated_starts([x[3] for x in held], unit.width, unit.size)) for a, b in runs(at, unit.width)]
        return shared.batch(_COVERS, list(zip(*rows))) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != last and size > batch_bytes:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[3])
        if held and (out := solve(held)) is not None:
            yield out

    n = 2 * shared.spread(bodies.sparkSession, bodies, 8 << 20)
    return bodies.repartition(n, "fp").sortWithinPartitions("fp", "dig").mapInArrow(run, "fp long, dig long, len int, lo int, hi int")


def _by_digest(bodies: DataFrame, unit: Unit) -> DataFrame:
    """Covered ranges of the segments of very frequent hashes: every string of
    every segment, counted by digest. Segments are dealt evenly."""
    width, z = unit.width, unit.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp, dig, n, body in zip(*(c.to_pylist() for c in b.columns)):
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[i : i + width * z]) for i in range(0, (n - width + 1) * z, z)), dtype="<i8").reshape(-1, 2)
                m = len(h)
                yield shared.batch(_STRINGS, [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), [fp] * m, [dig] * m, [n] * m, pa.array(np.arange(m, dtype=np.int32))])

    n = 2 * shared.spread(bodies.sparkSession, bodies, 8 << 20)
    strings = bodies.repartition(n, "fp", "dig").mapInArrow(run, "a long, b long, fp long, dig long, len int, at int")
    strings = shared.stage(strings, "strings")
    again = shared.stage(strings.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    starts = strings.join(again, ["a", "b"], "left_semi").groupBy("fp", "dig", "len").agg(F.collect_list("at").alias("at"))  # of one segment

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(fp, dig, n, lo, hi) for fp, dig, n, at in zip(*(c.to_pylist() for c in b.columns)) for lo, hi in runs(np.sort(at), width)]
            yield shared.batch(_COVERS, list(zip(*rows)) or [[]] * len(_COVERS))

    return starts.mapInArrow(join_up, "fp long, dig long, len int, lo int, hi int")


def covered(texts: DataFrame, unit: Unit, batch_bytes: int = 1 << 19, hash_bytes: int = 3 << 20) -> DataFrame:
    """(key, spans) for those of ``texts`` (key, raw; equal keys, equal bytes) that
    hold strings of ``unit`` which start elsewhere too; spans count symbols and may
    overlap or touch."""
    rows = shared.stage(_least(texts, unit).groupBy("key").agg(F.first("fps").alias("fps"), F.count("*").alias("times")), "least")
    each = rows.select("key", "times", F.explode("fps").alias("fp"))
    often = shared.stage(each.groupBy("fp").agg(F.sum("times").alias("n")).filter("n > 1").select("fp"), "often")
    hits = shared.sieve(each, often, "fp")[0].join(often, "fp", "left_semi")
    hits = shared.stage(hits.groupBy("key").agg(F.collect_set("fp").alias("fps"), F.first("times").alias("times")), "hits")
    places = shared.stage(_places(texts, hits, unit), "places")
    kinds = places.groupBy("fp", "dig", "len").agg(F.sum("times").alias("n"), F.min(F.struct("key", "start")).alias("at"), F.first("l").alias("l"), F.first("r").alias("r"), F.max("odd").alias("odd"))
    kinds = shared.stage(kinds, "kinds")
    whole = kinds.filter("n > 1").select("fp", "dig", "len", F.lit(0).alias("lo"), F.col("len").alias("hi"))
    # Segments that may share a string with a different one. What a hash or a side
    # has is a table of its own, so that joins of frequent ones can be dealt out.
    hashes = shared.stage(kinds.groupBy("fp").agg(F.count("*").alias("kinds"), F.max("odd").alias("any_odd")).filter("kinds > 1 OR any_odd").drop("kinds"), "hashes")
    sides = F.when(F.col("any_odd"), F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("h")))).otherwise(F.filter(F.array(F.struct(F.lit(1).alias("side"), F.col("l").alias("h")), F.struct(F.lit(2).alias("side"), F.col("r").alias("h"))), lambda x: x["h"].isNotNull()))
    parted = shared.stage(kinds.join(hashes, "fp").select("fp", "dig", "len", "at", F.explode(sides).alias("s")).select("fp", "dig", "len", "at", "s.side", "s.h"), "sides")
    both = shared.stage(parted.groupBy("fp", "side", "h").agg(F.count("*").alias("m")).filter("m > 1 OR side = 0").drop("m"), "both")
    able = shared.stage(parted.join(both, ["fp", "side", "h"], "left_semi").groupBy("fp", "dig", "len").agg(F.first("at").alias("at")), "able")
    large = able.groupBy("fp").agg((F.sum("len") * unit.size > hash_bytes).alias("large"))
    bodies = shared.stage(_bodies(texts, able.select("fp", "dig", "len", "at.key", "at.start"), unit).join(large, "fp"), "bodies")
    part = ["fp", "dig", "len", "body"]
    covers = whole.union(_by_transform(bodies.filter("NOT large").select(part), unit, batch_bytes))
    if not bodies.filter("large").isEmpty():
        covers = covers.union(_by_digest(bodies.filter("large").select(part), unit))
    covers = shared.stage(covers, "covers")
    spans = places.select("fp", "dig", "len", "key", "start").join(covers, ["fp", "dig", "len"])
    spans = spans.groupBy("key").agg(F.collect_list(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))
    spans = shared.stage(spans, "spans")
    shared.release(rows, often, hits, places, kinds, hashes, parted, both, able, bodies, covers)
    return spans


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, shared.text_key().alias("key"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("raw"))


def marked(docs: DataFrame, strings: Unit, words: Unit, **options) -> DataFrame:
    """(key, spans, passages) for texts of ``docs`` with repeated strings: of bytes,
    and of words."""
    texts = keyed(docs).select("key", "raw")
    spans, passages = covered(texts, strings, **options), covered(texts, words, **options)
    both = shared.stage(spans.join(passages.withColumnRenamed("spans", "passages"), "key", "full"), "marked")
    shared.release(spans, passages)
    return both


def ranges(found: list[dict] | None) -> list[tuple[int, int]]:
    return merge([(x["lo"], x["hi"]) for x in found or ()])


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("passage_words", pa.int64())])


def report(docs: DataFrame, strings: Unit | None = None, words: Unit | None = None, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``docs`` (doc_id, text),
    and passage_words: how many words lie in passages of 51 words or more that
    occur elsewhere too, however few bytes these have (they are not removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _REPORT]
            for doc, raw, found, passages in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                raw, found, passages = raw.as_py(), ranges(found.as_py()), ranges(passages.as_py())
                for c, v in zip(cols, (doc, len(raw), sum(y - x for x, y in found), len(found), hashlib.sha256(kept_bytes(raw, found)).hexdigest(), sum(y - x for x, y in passages))):
                    c.append(v)
            yield shared.batch(_REPORT, cols)

    found = marked(docs, strings or byte_strings(), words or word_strings(), **options)
    rows = keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    some, rest = shared.sieve(rows, found)
    none = F.lit(0).cast("long")
    rest = rest.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"), none.alias("passage_words"))
    return rest.union(some.join(found, "key", "left").select("doc_id", "raw", "spans", "passages").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH x AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
u AS (SELECT r, h, unnest(range(0, greatest(length(h) // 2 - 399, 0))) AS i FROM x),
w AS (SELECT r, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS m FROM u),
s AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
b AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM b),
p AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY r, k),
q AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM p),
f AS (SELECT q.r, count(*) AS n, sum(hi - lo) AS gone, max(hi) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)), '' ORDER BY lo) AS kept FROM q JOIN x ON x.r = q.r GROUP BY q.r),
pw AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w FROM x),
pu AS (SELECT r, w, unnest(range(0, greatest(len(w) - 50, 0))) AS i FROM pw),
pm AS (SELECT r, i, md5(array_to_string(w[i + 1:i + 51], ' ')) AS m FROM pu),
ps AS (SELECT r, i FROM pm WHERE m IN (SELECT m FROM pm GROUP BY m HAVING count(*) > 1)),
pc AS (SELECT r, sum(least(51, coalesce(i - before, 51))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM ps) GROUP BY r)
SELECT x.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(f.n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN f.r IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256,
       CAST(coalesce(pc.n, 0) AS BIGINT) AS passage_words
FROM x LEFT JOIN f ON f.r = x.r LEFT JOIN pc ON pc.r = x.r
"""
