"""Token-ID / binary output: length-delimited records with an offset index.

A shard is a run of frames, laid out like those of a TFRecord file, but with the
CRC-32 of ``zlib`` as checksum::

    uint64 length | uint32 masked crc32(length) | data | uint32 masked crc32(data)

``data`` is one serialized sequence: flags (1 byte; bit 0: doc_id is null, bit 1:
ids take 4 bytes instead of 2), doc_id as int64, then the ids, all little-endian.
Beside each shard lies an index of its own: the little-endian uint64 offset of
every frame and, last, the length of the shard, so that any record can be read
alone, in any order.

Defined results: a null or empty text is a record of the end id alone; a null
doc_id is stored as such and comes last; rows that share a doc_id, or repeat
whole, have a record each, in the order of their texts' hashes; an empty table
gives no shard and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder, resolve, slices

#: Fixed value: what a masked checksum is shifted by.
_MASK_DELTA = 0xA282EAD8

_HEAD = struct.Struct("<BQ")
_LENGTH = struct.Struct("<QI")


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that checksums of data that hold
    checksums stay useful."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A payload within its lengths and checksums."""
    n = len(payload)
    return b"".join((_LENGTH.pack(n, masked(n.to_bytes(8, "little"))), payload, masked(payload).to_bytes(4, "little")))


def unframe(raw: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next begins; raises
    ValueError where a checksum or a length is wrong."""
    if len(raw) < at + 16:
        raise ValueError("a frame is cut off")
    n, check = _LENGTH.unpack_from(raw, at)
    if masked(raw[at : at + 8]) != check or len(raw) < at + 16 + n:
        raise ValueError("a frame's length fails its checksum")
    payload, end = raw[at + 12 : at + 12 + n], at + 16 + n
    if masked(payload) != int.from_bytes(raw[end - 4 : end], "little"):
        raise ValueError("a frame fails its checksum")
    return payload, end


def unframe_all(raw: bytes, offsets: list[int]) -> Iterator[bytes]:
    """The payloads of frames at ``offsets``; the last entry ends the last frame."""
    for a, b in zip(offsets, offsets[1:]):
        payload, end = unframe(raw, a)
        if end != b:
            raise ValueError("a frame does not agree with the index")
        yield payload


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = ids.dtype.itemsize == 4
    return _HEAD.pack((doc_id is None) | wide << 1, (doc_id or 0) & 0xFFFFFFFFFFFFFFFF) + ids.tobytes()


def deserialize(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc = _HEAD.unpack_from(data)
    ids = np.frombuffer(data, dtype="<u4" if flags & 2 else "<u2", offset=_HEAD.size)
    return None if flags & 1 else doc - (doc >> 63 << 64), ids


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_SHARDS = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


def write_records(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes them in ascending doc_id order
    (null last, ties by text) as record shards in the shared folder; ``end_id``
    ends each document, and ids take two bytes when all fit, else four. Returns
    the manifest: shard, path, n_docs, n_tokens, n_bytes. Shards are numbered in
    order of doc_id; an attempt that was lost leaves a file which no manifest
    row names. Null texts are empty, an empty table gives an empty manifest."""
    spark = docs.sparkSession
    path, folder = resolve(tokenizer), shared.fresh_folder(spark, "records")
    n = shards or shared.spread(spark, docs)
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        enc, fs, root = encoder(path), *shared.open_fs(folder)
        end = np.array([end_id], dtype=enc.dtype)
        shard, out, name = TaskContext.get().partitionId(), None, ""
        at, n_docs, n_tokens, offsets = 0, 0, 0, []
        for b in batches:
            doc, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(texts):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.rec"
                    out = fs.open_output_stream(f"{root}/{name}")
                some = [np.append(x, end) for x in enc.encode(texts[i:j])]
                for d, x in zip(doc[i:j], some):
                    offsets.append(at)
                    at += out.write(frame(serialize(d, x)))
                n_docs += len(some)
                n_tokens += sum(map(len, some))
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as idx:
                idx.write(np.array([*offsets, at], dtype="<u8").tobytes())
            yield shared.batch(_SHARDS, [[shard], [f"{folder}/{name}"], [n_docs], [n_tokens], [at]])

    return shared.stage(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long, n_bytes long"), "manifest")


def read_one(path: str, record: int) -> tuple[int | None, np.ndarray]:
    """A single record, found through the offset index: what a shuffled reader calls."""
    fs, p = shared.open_fs(path)
    with fs.open_input_file(f"{p}.idx") as idx:
        idx.seek(8 * record)
        a, b = np.frombuffer(idx.read(16), dtype="<u8").tolist()
    with fs.open_input_file(p) as f:
        f.seek(a)
        return deserialize(unframe(f.read(b - a))[0])


def read_records(manifest: DataFrame, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Reads all shards back, checks every frame, and returns per document
    doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard
    and offset. The manifest has a row per shard; its running sum is small."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, p = shared.open_fs(path)
                with fs.open_input_file(f"{p}.idx") as f:
                    offsets = np.frombuffer(f.read(), dtype="<u8").astype(np.int64)
                with fs.open_input_file(p) as f:
                    i = start = 0
                    while i < len(offsets) - 1:
                        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, side="right")) - 1)
                        some = [deserialize(x) for x in unframe_all(f.read(int(offsets[j] - offsets[i])), (offsets[i : j + 1] - offsets[i]).tolist())]
                        sizes = np.array([len(x) for _, x in some], dtype=np.int64)
                        starts = start + np.cumsum(sizes) - sizes
                        yield shared.batch(_READ, [[d for d, _ in some], [shard] * len(some), pa.array(starts), pa.array(sizes), [ids_crc32(x) for _, x in some], pa.array(offsets[i:j])])
                        start += int(sizes.sum())
                        i = j

    sums, before = [], 0
    for r in sorted(manifest.select("shard", "n_tokens").collect()):  # a row per shard
        sums.append((r[0], before))
        before += r[1]
    bases = spark.createDataFrame(sums, "shard long, base long")
    files = manifest.select("shard", "path").repartition(max(1, len(sums)), "shard")
    rows = files.mapInArrow(read, "doc_id long, shard long, local_start long, n_tokens long, ids_crc32 long, offset long")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset")


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return read_records(write_records(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")
