"""WARC archives: writing captures, reading them back, transaction assembly.

A page becomes a transaction of three records: a request, a response (or a
revisit of an earlier, equal payload) and a metadata record. Request and
metadata name the response in ``WARC-Concurrent-To``; :func:`assemble` joins
the three kinds through that identifier and gives one nested row per capture.

Defined results: a null html is an empty payload, a null url an empty target;
a null page_id passes through (it never is the page that others refer to,
unless all pages of that payload lack one: then all are responses). Rows that
repeat the smallest page_id of a payload are responses, each with a record of
its own. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
_RECORDS = pa.schema(
    [("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("http_head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))]
)
_RECORDS_SQL = "record_id string, kind string, concurrent_to string, target_uri string, date string, payload_digest string, http_head string, payload binary, payload_bytes long, fields map<string,string>"


def digest32(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def render(kind: str, record_id: str, block: bytes, date: str, headers: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def transaction(seed: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> list[bytes]:
    """The records of one capture."""

    def name(kind: str) -> str:
        h = hashlib.md5(f"{seed}/{kind}".encode()).hexdigest()
        return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"

    target, digest, main = one_line(url), f"sha1:{digest32(payload)}", name("response")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    linked = [("WARC-Target-URI", target), ("WARC-Concurrent-To", f"<{main}>")]
    own = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    fields = [f"payload-bytes: {len(payload)}"]
    if page_id is not None:
        fields.append(f"page-id: {page_id}")
    if revisit:
        own.append(("WARC-Profile", _PROFILE))
        if refers_to is not None:
            fields.append(f"refers-to-page: {refers_to}")
    return [
        render("request", name("request"), f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode(), date, [*linked, ("Content-Type", "application/http; msgtype=request")]),
        render("revisit" if revisit else "response", main, head if revisit else head + payload, date, own),
        render("metadata", name("metadata"), "".join(f"{f}\r\n" for f in fields).encode(), date, [*linked, ("Content-Type", "application/warc-fields")]),
    ]


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, first_id, revisit: payloads of at least
    ``min_bytes`` that occur more than once keep one response, the page with
    the smallest page_id. Copies are counted by digest before the join, whose
    large side may be split where one payload is very frequent."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    again = rows.filter(F.length("payload") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = shared.stage(again, "copies")  # its size is then known: small ones need no shuffle of the pages
    return rows.join(again, "key", "left").select("page_id", "url", "payload", "first_id", (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"))


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as ``.warc.gz`` files, one gzip
    member per record, in the shared folder. Returns the manifest; files of
    attempts that were lost are in no manifest row."""
    folder = shared.fresh_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        out, path, n, size, seed = None, "", 0, 0, uuid.uuid4().hex
        serial = 0
        fs, root = shared.open_fs(folder)
        for b in batches:
            for page_id, url, payload, first, revisit in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path = f"part-{seed}-{serial:06d}.warc.gz"
                    out, n, size = fs.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                for record in transaction(f"{seed}/{serial}/{n}", page_id, url, payload, first, revisit, date):
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = z.compress(record) + z.flush()
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
                if size >= roll_bytes:
                    out.close()
                    yield shared.batch(_MANIFEST, [[f"{folder}/{path}"], [n], [size]])
                    out, serial = None, serial + 1
        if out is not None:
            out.close()
            yield shared.batch(_MANIFEST, [[f"{folder}/{path}"], [n], [size]])

    rows = mark_revisits(pages, min_bytes)
    return shared.stage(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed
    stream; checks block digests."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.decode().partition(":")
            headers[k.lower()] = v.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record ends early")
        if (d := headers.get("warc-block-digest")) and d != f"sha1:{digest32(block)}":
            raise ValueError("a block does not have its digest")
        yield headers, block


def read_archives(manifest: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives that the manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = shared.open_fs(uri)
                rows, size = [], 0
                with fs.open_input_file(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, block in parse(stream):
                        kind, head, payload, fields = h["warc-type"], None, None, None
                        if kind in ("response", "revisit", "request"):
                            text, _, payload = block.partition(b"\r\n\r\n")
                            head = text.decode()
                            if kind == "response" and h.get("warc-payload-digest") != f"sha1:{digest32(payload)}":
                                raise ValueError("a payload does not have its digest")
                            if kind != "response":
                                payload = None
                        else:
                            fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if ": " in x]
                        rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-date"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, head, payload, None if payload is None else len(payload), fields))
                        size += len(block) + 500
                        if size > batch_bytes:
                            yield shared.batch(_RECORDS, list(zip(*rows)))
                            rows, size = [], 0
                if rows:
                    yield shared.batch(_RECORDS, list(zip(*rows)))

    n = max(1, manifest.count())  # a row per archive file
    return manifest.select("path").repartition(min(n, 4 * shared.spread(manifest.sparkSession))).mapInArrow(read, _RECORDS_SQL)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: request, response and metadata records that
    belong together through their concurrent-to identifiers. A capture whose
    request or metadata is missing keeps nulls there. Without ``payload`` the
    bodies stay out of the join; their sizes and digests are there all the same."""

    def kind(names: list[str], key: str, alias: str, *columns: str) -> DataFrame:
        return records.filter(F.col("kind").isin(names)).select(F.col(key).alias("capture"), F.struct("record_id", *columns).alias(alias))

    response = kind(["response", "revisit"], "record_id", "response", "kind", "target_uri", "date", "payload_digest", "http_head", "payload_bytes", *["payload"] * payload)
    request = kind(["request"], "concurrent_to", "request", "http_head")
    metadata = kind(["metadata"], "concurrent_to", "metadata", "fields")
    return response.join(request, "capture", "left").join(metadata, "capture", "left").select("capture", "request", "response", "metadata")


def captures(pages: DataFrame, min_bytes: int = 0, payload: bool = True) -> DataFrame:
    """Writes, reads back and assembles. The records are staged once, so that
    the three sides of the join do not read the archives three times."""
    return assemble(shared.stage(read_archives(write_archives(pages, min_bytes)), "warc-records"), payload)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captures(shared.table(spark, sf_dir, "pages"), payload=False)
    fields = F.col("metadata.fields")
    revisit = F.col("response.kind") == "revisit"
    return c.select(
        fields["page-id"].cast("long").alias("page_id"),
        F.when(revisit, fields["payload-bytes"].cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(revisit, fields["refers-to-page"].cast("long")).alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body),
h AS (SELECT p.page_id, f.first_id, strlen(p.body) AS n, sha1(p.body) AS hex
      FROM p JOIN f ON p.body = f.body)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM h
"""
