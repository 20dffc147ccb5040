"""Predicate transfer: the keys of small inputs as filters on large scans.

A filter is built from a build side's join key (bounds, and the distinct keys
while they are few) and applied to a probe side before the join. It never
changes a join's result where rows without a partner are dropped. Few keys
become an IN list, which reaches the Parquet scan and its row-group and page
statistics; more keys become bounds and a Bloom filter of at most 4 MiB, which
Spark evaluates in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from ..errors import InvalidInput
from .joins import join

#: Defaults of the planner.
MAX_VALUES = 256
MAX_MATCH = 0.5
MAX_SELECTIVITY = 0.2
MAX_CHAIN = 2
MAX_PASS = 0.9  # a Bloom filter that lets more of a probe's first rows pass is not used
PROBE_ROWS = 10_000
BITS_PER_KEY = 10  # about 1 % false positives
MAX_BLOOM_BYTES = 4 << 20
FIRST_BITS = 1 << 23  # of a filter that is built before the number of keys is known

#: Kinds whose unmatched rows are dropped, by the side that may be filtered.
_FILTERS_LEFT = frozenset(("inner", "semi", "right_semi", "right"))
_FILTERS_RIGHT = frozenset(("inner", "semi", "right_semi", "left"))


def _hash(df: DataFrame, key: str) -> tuple[Column, str]:
    """A 64-bit hash of a key, the same for all integer types, and its kind."""
    kind = df.schema[key].dataType
    whole = isinstance(kind, IntegralType)
    return F.xxhash64(F.col(key).cast("long") if whole else F.col(key)), "whole" if whole else kind.simpleString()


@dataclass(frozen=True)
class BloomFilter:
    """A set of keys with false positives and no false negatives."""

    data: bytes
    bits: int
    kind: str

    @staticmethod
    def build(df: DataFrame, key: str, keys: int, bits_per_key: int = BITS_PER_KEY, max_bytes: int = MAX_BLOOM_BYTES) -> BloomFilter | None:
        """The filter of a key column with about ``keys`` distinct values, built
        by the executors; None when it would exceed ``max_bytes``. Nulls are no keys."""
        bits = max(64, keys * bits_per_key)
        if bits > 8 * max_bytes:
            return None
        h, kind = _hash(df, key)
        rows = df.filter(F.col(key).isNotNull()).select(h.alias("h"))
        return BloomFilter(_bytes(df.sparkSession, rows._jdf.stat().bloomFilter("h", max(1, keys), bits)), bits, kind)

    @staticmethod
    def column(df: DataFrame, key: str, bits: int) -> Column:
        """The same as an aggregate, for one pass with other aggregates; null
        without keys."""
        from pyspark.sql.classic.column import Column as Classic

        jvm = df.sparkSession._jvm
        bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
        h = F.when(F.col(key).isNotNull(), _hash(df, key)[0])
        parts = (h, F.lit(max(1, bits // BITS_PER_KEY)).cast("long"), F.lit(bits).cast("long"))
        bloom = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(*(bridge.expression(x._jc) for x in parts))
        return Classic(bridge.column(bloom.toAggregateExpression()))

    def merge(self, spark: SparkSession, other: BloomFilter) -> BloomFilter:
        """The union of two filters of one size and kind."""
        if (self.bits, self.kind) != (other.bits, other.kind):
            raise InvalidInput("Bloom filters of different sizes or kinds do not merge")
        jvm = spark._jvm
        one, two = (jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(jvm.java.io.ByteArrayInputStream(bytearray(x.data))) for x in (self, other))
        return BloomFilter(_bytes(spark, one.mergeInPlace(two)), self.bits, self.kind)

    def might_contain(self, df: DataFrame, key: str) -> Column:
        """Whether a row's key may be in the set; null for null keys."""
        from pyspark.sql.classic.column import Column as Classic

        h, kind = _hash(df, key)
        if kind != self.kind:
            raise InvalidInput(f"a filter of {self.kind} keys on a key of {kind}")
        jvm = df.sparkSession._jvm
        bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
        probe = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(bridge.expression(F.lit(bytearray(self.data))._jc), bridge.expression(h._jc))
        return F.when(F.col(key).isNotNull(), Classic(bridge.column(probe)))


def _bytes(spark: SparkSession, bloom) -> bytes:
    out = spark._jvm.java.io.ByteArrayOutputStream()
    bloom.writeTo(out)
    return bytes(out.toByteArray())


@dataclass(frozen=True)
class DynamicFilter:
    """Bounds of a key and its values, or a Bloom filter when there are too many
    (None for both: bounds only). Without any key the filter lets nothing pass."""

    low: object
    high: object
    values: tuple | None
    distinct: int
    bloom: BloomFilter | None = None
    kind: str | None = None

    def merge(self, other: DynamicFilter, max_values: int = MAX_VALUES) -> DynamicFilter:
        """The filter for the union of two build sides; Bloom filters of one size
        unite, and values join the other side's."""
        if not self.distinct or not other.distinct:
            return other if not self.distinct else self
        values = None
        if self.values is not None and other.values is not None:
            values = tuple(sorted(set(self.values) | set(other.values)))
        low, high = min(self.low, other.low), max(self.high, other.high)
        if values is not None and len(values) <= max_values:
            return DynamicFilter(low, high, values, len(values), None, self.kind)
        return DynamicFilter(low, high, None, self.distinct + other.distinct, self._union(other), self.kind)

    def _union(self, other: DynamicFilter) -> BloomFilter | None:
        spark = SparkSession.getActiveSession()
        bits = next((x.bloom.bits for x in (self, other) if x.bloom is not None), FIRST_BITS)
        blooms = []
        for x in (self, other):
            if x.bloom is None and x.values is not None and x.kind is not None and spark is not None:
                keys = spark.createDataFrame([(v,) for v in x.values], f"k {x.kind}")
                blooms.append(BloomFilter(bytes(keys.agg(BloomFilter.column(keys, "k", bits)).first()[0]), bits, _hash(keys, "k")[1]))
            else:
                blooms.append(x.bloom)
        if None in blooms or (blooms[0].bits, blooms[0].kind) != (blooms[1].bits, blooms[1].kind):
            return None
        return blooms[0].merge(spark, blooms[1])

    def condition(self, probe: DataFrame, key: str) -> Column:
        """Whether a row of ``probe`` may have a partner; null keys have none."""
        if not self.distinct:
            return F.lit(False)
        if self.values is not None:
            return F.col(key).isin(list(self.values))
        out = F.col(key).between(self.low, self.high)
        if self.bloom is not None and _hash(probe, key)[1] == self.bloom.kind:
            out = out & self.bloom.might_contain(probe, key)
        return out

    def apply(self, probe: DataFrame, key: str) -> DataFrame:
        """Rows of ``probe`` that may have a partner."""
        return probe.filter(self.condition(probe, key))

    def share(self, probe: DataFrame, key: str, rows: int = PROBE_ROWS) -> float:
        """How much of the first ``rows`` rows of ``probe`` passes."""
        some = probe.select(key).limit(rows)
        n, passed = some.agg(F.count("*"), F.count_if(self.condition(some, key))).first()
        return passed / n if n else 0.0


def build(df: DataFrame, key: str, max_values: int = MAX_VALUES) -> DynamicFilter:
    """One pass over the key column: bounds, an estimate of the distinct keys and a
    Bloom filter. Few keys are then read in a second one as a list; so many that
    the filter is too small for them get a larger one, or none."""
    kind = df.schema[key].dataType
    floating = isinstance(kind, (DoubleType, FloatType))  # bounds only: equality of floats is no key
    bloom = F.lit(None) if floating else BloomFilter.column(df, key, FIRST_BITS)
    low, high, n, raw = df.agg(F.min(key), F.max(key), F.approx_count_distinct(key), bloom).first()
    name = kind.simpleString()
    if low is None:
        return DynamicFilter(None, None, (), 0, None, name)
    if floating:
        return DynamicFilter(low, high, None, n, None, name)
    if n <= 2 * max_values:
        values = [r[0] for r in df.select(key).filter(F.col(key).isNotNull()).distinct().limit(max_values + 1).collect()]
        if len(values) <= max_values:
            return DynamicFilter(low, high, tuple(sorted(values)), len(values), None, name)
    if n * BITS_PER_KEY > FIRST_BITS:
        return DynamicFilter(low, high, None, n, BloomFilter.build(df, key, n), name)
    return DynamicFilter(low, high, None, n, BloomFilter(bytes(raw), FIRST_BITS, _hash(df, key)[1]), name)


def transfer(build_side: DataFrame, build_key: str, probe: DataFrame, probe_key: str, semi: bool = False, domain: int | None = None, probe_rows: int | None = None, max_values: int = MAX_VALUES) -> DataFrame:
    """``probe`` without rows that cannot match. With the number of distinct
    keys in the whole domain, or of probe rows, a filter that would let too much
    pass is not applied, nor is a Bloom filter that over ``MAX_PASS`` of the
    probe's first rows pass. ``semi`` makes a filter without all values exact by a
    semi join on the distinct keys, broadcast only if Spark finds them small."""
    f = build(build_side, build_key, max_values)
    if domain is not None and f.distinct > MAX_MATCH * domain:
        return probe
    if domain is None and probe_rows is not None and f.distinct > MAX_SELECTIVITY * probe_rows:
        return probe
    if f.bloom is not None and f.share(probe, probe_key) > MAX_PASS:
        return probe
    out = f.apply(probe, probe_key)
    if f.values is None and semi:
        keys = build_side.select(F.col(build_key).alias("__k")).distinct()
        out = out.join(keys, out[probe_key] == keys["__k"], "left_semi")
    return out


def filtered_join(left: DataFrame, right: DataFrame, on: tuple[str, str], kind: str = "inner", small: str = "right", **options) -> DataFrame:
    """:func:`join` with a filter from the ``small`` side on the other, where
    the kind allows it."""
    a, b = on
    if small == "right" and kind in _FILTERS_LEFT:
        left = transfer(right, b, left, a, **options)
    elif small == "left" and kind in _FILTERS_RIGHT:
        right = transfer(left, a, right, b, **options)
    return join(left, right, [on], kind)


def chain(relations: Sequence[tuple[DataFrame, str | None, str | None]], depth: int = MAX_CHAIN) -> list[DataFrame]:
    """Filters along a path of inner joins. ``relations``: (frame, key shared
    with the one before, key shared with the next), smallest first; a filter
    travels at most ``depth`` relations far."""
    out = [relations[0][0]]
    for i in range(1, len(relations)):
        frame, key, _ = relations[i]
        out.append(transfer(out[i - 1], relations[i - 1][2], frame, key) if i <= depth else frame)
    return out


def runtime_bloom(spark: SparkSession, scan_bytes: str = "0", build_bytes: str = "10MB") -> None:
    """Lets Catalyst add Bloom filters of the small sides to scans of at least
    ``scan_bytes`` (by default only scans of 10 GB get them)."""
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", scan_bytes)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", build_bytes)
