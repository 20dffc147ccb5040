"""Shared storage, staging and Arrow helpers of the training-data operators.

Executors and driver have no local folder in common. Everything that one task
writes and another reads lies in the folder that ``spark.checkpoint.dir``
names; files there are opened through ``pyarrow.fs``, which speaks ``file:``,
``hdfs:``, ``s3:`` and ``gs:``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..operators.transfer import BITS_PER_KEY, BloomFilter


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only if unset, and
    then only in local mode, where all tasks share the driver's disk."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not spark.sparkContext.master.startswith("local-cluster") and spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise InvalidInput("set spark.checkpoint.dir to a folder that all executors share")
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one, not yet created. It goes when
    the driver ends, if nobody deletes it earlier."""
    path = f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if not _folders:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # still there when the session has ended
        atexit.register(lambda: _delete(jvm, conf, list(_folders)))
    _folders.add(path)
    return path


_folders: set[str] = set()


def _delete(jvm, conf, paths: list[str]) -> None:
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _folders.discard(path)


def release(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration(), [t._staged_at])


#: Small batches: at 10,000 rows each, as is the default, a batch of long texts
#: takes more memory than a task has.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, unless its bounds are lower. They
    stay, as results are computed when the caller asks for them."""
    for k, v in _BATCHES.items():
        if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(k)) <= v:
            spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends
    here, so a lost executor costs no more than the step it worked on."""
    bound_batches(df.sparkSession)
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def sieve(rows: DataFrame, wanted: DataFrame, key: str = "key", max_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have their ``key`` in ``wanted`` and those that have not,
    told apart in generated code by a Bloom filter of at most ``max_bytes``; with
    more keys it only lets more pass."""
    n = min(wanted.count(), 8 * max_bytes // BITS_PER_KEY)
    if not n:
        return rows.filter(F.lit(False)), rows
    bloom = BloomFilter.build(wanted, key, n, BITS_PER_KEY, max_bytes)
    may = F.coalesce(bloom.might_contain(rows, key), F.lit(False))
    return rows.filter(may), rows.filter(~may)


def helper(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(x for i in range(len(taken) + 1) if (x := f"{name}_{i}").lower() not in taken)


def open_fs(uri: str):
    """(filesystem, path) of a URI, on any machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_kept: list = [None, None]


def keep(name, make: Callable):
    """What a Python worker remembers between tasks: one thing at a time, so that
    the memories of operators that follow one another do not add up."""
    if _kept[0] != name:
        _kept[:] = [None, None]
        _kept[:] = [name, make()]
    return _kept[1]


class WordHashes(dict):
    """64-bit hashes of words; the first 400,000 are remembered."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def spread(spark: SparkSession, df: DataFrame | None = None, bytes_each: int = 64 << 20) -> int:
    """How many partitions a shuffle is to have: the session's number, or as many
    as keep those of ``df`` near ``bytes_each`` of its files, where it reads a
    single table and so knows its size."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if df is not None:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        if leaves.size() == 1:
            size = int(str(leaves.head().stats().sizeInBytes()))
            if size < 1 << 60:  # else not known
                n = max(n, size // bytes_each)
    return n


def text_key(text="text"):
    """16 bytes that stand for a text: equal texts, equal keys (null: empty)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 32))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_bitmap(keys: DataFrame, bits: int = 26):
    """A bitmap over the leading bits of 16-byte ``key`` values, of 2 ** bits bits
    however many keys there are. It only spares work: what passes it is still
    compared with the keys themselves."""
    import numpy as np

    at = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set"))
    out = np.zeros(1 << bits - 6, dtype=np.uint64)
    got = words.toArrow()  # at most 2 ** (bits - 6) rows
    out[got["word"].to_numpy()] = got["set"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap, keys: list[bytes]):
    """Which 16-byte keys may be in a bitmap."""
    import numpy as np

    at = np.frombuffer(b"".join(k[:4] for k in keys), dtype=">u4").astype(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
