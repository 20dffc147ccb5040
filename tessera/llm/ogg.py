"""Media columns: Ogg streams.

:func:`mux` stores a payload as 8-bit unsigned PCM samples in an Ogg file with
two logical streams: stream 1 holds an OggPCM header packet, a comment packet
and packets of samples, whose granule position counts samples; stream 2 is a
Skeleton-like track with one header packet and an end packet. Their pages
alternate. :func:`demux` verifies every page's checksum and sequence number,
reassembles packets from lacing values (across pages), separates the logical
streams and derives timestamps from granule positions.

The checksum is the container's own: polynomial 0x04C11DB7, most significant
bit first, register from zero, no final inversion. As bits mirrored it is the
same as the checksum in ``zlib``, which therefore does the work.

Defined results: a null or empty text is 64 zero bytes; a null doc_id passes
through; equal texts give equal files, and repeated rows a row each; texts of any
length keep all their bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

RATE = 8000
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_PAGE = struct.Struct("<4sBBqIIIB")
PCM, TRACK = 1, 2


def checksum(data: bytes) -> int:
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


class _Track:
    """Pages of one logical stream. A packet continues on the next page when
    its lacing values do not fit; a page ends after 255 of them."""

    def __init__(self, serial: int):
        self.serial, self.number, self.pages = serial, 0, []

    def add(self, packets: list[bytes], granules: list[int], first: bool = False, last: bool = False) -> None:
        """Lays the packets out over as few pages as they need."""
        lacing, body, granule, continued = bytearray(), bytearray(), -1, False
        for i, (p, g) in enumerate(zip(packets, granules)):
            values = [255] * (len(p) // 255) + [len(p) % 255]
            at = 0
            for j, v in enumerate(values):
                if len(lacing) == 255:
                    self._put(lacing, body, granule, continued, first, False)
                    lacing, body, granule, continued, first = bytearray(), bytearray(), -1, j > 0, False
                lacing.append(v)
                body += p[at : at + v]
                at += v
            granule = g
        self._put(lacing, body, granule, continued, first, last)

    def _put(self, lacing, body, granule, continued, first, last) -> None:
        self.pages.append(page(continued | first << 1 | last << 2, granule, self.serial, self.number, bytes(lacing), bytes(body)))
        self.number += 1


def mux(payload: bytes, rate: int = RATE, packet_bytes: int = 4096) -> bytes:
    """An Ogg file whose PCM stream carries ``payload``; the same for the same bytes."""
    pcm, track = _Track(PCM), _Track(TRACK)
    # Fixed layout of the OggPCM header: version 0.0, unsigned 8 bit, rate, 8 significant bits, 1 channel.
    pcm.add([b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, 0xFFFF, 0)], [0], first=True)
    track.add([b"fishead\0" + struct.pack("<HHqqqq", 3, 0, 0, rate, 0, rate)], [0], first=True)
    pcm.add([struct.pack("<I", 7) + b"tessera" + struct.pack("<I", 0)], [0])
    parts = [payload[i : i + packet_bytes] for i in range(0, len(payload), packet_bytes)] or [b""]
    ends = np.minimum(np.arange(1, len(parts) + 1) * packet_bytes, len(payload)).tolist()
    pcm.add(parts, ends, last=True)
    track.add([struct.pack("<q", len(payload))], [len(payload)], last=True)
    heads = [pcm.pages[0], track.pages[0]]
    return b"".join([*heads, pcm.pages[1], *pcm.pages[2:3], track.pages[1], *pcm.pages[3:]])


def demux(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets of each logical stream as (bytes, granule position of the page
    on which the packet ends; -1 if none). Raises ValueError where a checksum,
    a sequence number or the structure is wrong."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    rest: dict[int, bytes | None] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("a page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError("no page where one is due")
        lacing = data[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError("a page is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError("a page fails its checksum")
        if flags & 2:
            if serial in streams:
                raise ValueError("a logical stream begins twice")
            streams[serial], rest[serial], expected[serial] = [], None, 0
        if serial not in streams or serial in ended or number != expected[serial]:
            raise ValueError("a page is out of sequence")
        if bool(flags & 1) != (rest[serial] is not None):
            raise ValueError("a continued packet lacks a part")
        expected[serial] += 1
        part, done = rest[serial] or b"", rest[serial] is None
        rest[serial] = None
        pieces = [part] if not done else []
        for v in lacing:
            pieces.append(data[body_at : body_at + v])
            body_at += v
            if v < 255:
                streams[serial].append((b"".join(pieces), granule))
                pieces = []
        if pieces:
            rest[serial] = b"".join(pieces)
        if flags & 4:
            ended.add(serial)
        at = end
    if any(x is not None for x in rest.values()) or ended != streams.keys():
        raise ValueError("a logical stream does not end")
    return streams


def samples(data: bytes) -> tuple[bytes, int, dict[int, list[tuple[bytes, int]]]]:
    """(payload, rate, streams) of a file by :func:`mux`."""
    streams = demux(data)
    packets = streams.get(PCM) or [(b"", 0)]
    if packets[0][0][:8] != b"PCM     ":
        raise ValueError("no PCM header")
    rate = struct.unpack_from(">I", packets[0][0], 16)[0]
    payload = b"".join(p for p, _ in packets[2:])
    if packets[-1][1] != len(payload):
        raise ValueError("the last granule position is not the number of samples")
    return payload, rate, streams


def describe(payload: bytes, rate: int, streams: dict[int, list[tuple[bytes, int]]]) -> str:
    """Integer features of the samples and the container."""
    x = np.frombuffer(payload, dtype=np.uint8)
    s = x.astype(np.int32) - 128
    stamps = sorted({g for _, g in streams[PCM][2:] if g >= 0})
    crossings = int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
    energy = int(np.dot(s.astype(np.int64), s)) if len(s) else 0
    return f"streams={len(streams)};packets={sum(map(len, streams.values()))};ms={len(x) * 1000 // rate};first_ms={stamps[0] * 1000 // rate};peak={int(np.abs(s).max(initial=0))};sum={int(s.sum(dtype=np.int64))};energy={energy};crossings={crossings}"


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit or (unit if not raw else 0))


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _in_parts(b: pa.RecordBatch, sizes: list[int], limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text (null: empty) as UTF-8, padded with
    zero bytes to a positive multiple of 64, in an Ogg file of its own, kept in
    a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, raw = b.column(0).to_pylist(), [x or b"" for x in b.column(1).to_pylist()]
            for i, j in _in_parts(b, list(map(len, raw))):
                yield shared.batch(_MEDIA, [doc[i:j], list(map(len, raw[i:j])), [mux(padded(x)) for x in raw[i:j]]])

    raw = docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))
    return shared.stage(raw.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def features(media: DataFrame) -> DataFrame:
    """Reads the stored files and describes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _FEATURES]
            for doc, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (x.as_py() for x in b.column(2))):
                payload, rate, streams = samples(data)
                for c, v in zip(cols, (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), describe(payload, rate, streams))):
                    c.append(v)
            yield shared.batch(_FEATURES, cols)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(shared.table(spark, sf_dir, "documents")))
