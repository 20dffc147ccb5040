import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import covertree, ogg, shared, warc

# Ogg


@pytest.mark.parametrize("n", [0, 1, 64, 254, 255, 256, 4096, 4097, 65025, 300_000])
def test_mux_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = ogg.mux(payload)
    got, rate, streams = ogg.samples(data)
    assert got == payload and rate == ogg.RATE and set(streams) == {ogg.PCM, ogg.TRACK}
    assert streams[ogg.PCM][-1][1] == n


def test_long_packets_cross_pages():
    t = ogg._Track(7)
    packets = [b"a" * 70_000, b"", b"b" * 255, b"c" * 200_000]
    t.add(packets, [1, 2, 3, 4], first=True, last=True)
    assert len(t.pages) > 4
    assert [p for p, _ in ogg.demux(b"".join(t.pages))[7]] == packets


def test_damage_is_found():
    data = ogg.mux(b"hello" * 100)
    for at in range(0, len(data), 37):
        with pytest.raises(ValueError):
            ogg.demux(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :])
    for cut in (10, 60, len(data) - 1):
        with pytest.raises(ValueError):
            ogg.demux(data[:cut])
    pages = [m.start() for m in re.finditer(b"OggS", data)] + [len(data)]
    swapped = data[: pages[2]] + data[pages[3] : pages[4]] + data[pages[2] : pages[3]] + data[pages[4] :]
    with pytest.raises(ValueError):
        ogg.demux(swapped)


def test_checksum_against_the_definition():
    def slow(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    for data in (b"", b"\0", b"OggS" * 5, bytes(range(256))):
        assert ogg.checksum(data) == slow(data)


def test_features(odd, odd_rows, nothing):
    got = sorted((tuple(r) for r in ogg.features(ogg.store(odd)).collect()), key=repr)
    by_text = {}
    want = []
    for d, t, *_ in odd_rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert by_text.setdefault(r[3], r[5:]) == r[5:]
    assert ogg.features(ogg.store(nothing)).count() == 0


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/", "<p>x</p>"), (1, "http://b/", "<p>x</p>"), (7, None, None), (8, "http://c/\r\nX: y", ""), (9, "http://d/é", "日本" * 500), (2, "u", "<p>x</p>"), (None, "n", "<p>x</p>"), (1, "http://b/", "<p>x</p>"), (20, "e", "WARC/1.1\r\n\r\n\r\n\r\nOggS"), (None, None, "lone"), (None, None, "lone")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, key string"), rows


def test_captures(pages, nothing):
    df, rows = pages
    got = warc.captures(df).collect()
    assert len(got) == len(rows) and len({r.capture for r in got}) == len(rows)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and p != f
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", f if again else None))
    seen = []
    for r in got:
        fields = r.metadata.fields
        page = int(fields["page-id"]) if "page-id" in fields else None
        refers = int(fields["refers-to-page"]) if "refers-to-page" in fields else None
        seen.append((page, int(fields["payload-bytes"]), r.response.payload_digest, r.response.kind, refers))
        assert r.request is not None and r.request.http_head.startswith("GET ")
        if r.response.kind == "response":
            assert len(r.response.payload) == int(fields["payload-bytes"])
        else:
            assert r.response.payload is None
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    empty = nothing.selectExpr("doc_id AS page_id", "text AS url", "text AS html")
    assert warc.captures(empty).count() == 0


def test_small_payloads_are_not_revisits(pages):
    df, _ = pages
    kinds = [r.response.kind for r in warc.captures(df, min_bytes=100).collect()]
    assert set(kinds) == {"response"}


def test_archives_are_whole(spark, pages):
    df, rows = pages
    manifest = warc.write_archives(df, roll_bytes=400).collect()
    assert sum(m.n_records for m in manifest) == 3 * len(rows) and len(manifest) > 1
    for m in manifest:
        fs, path = shared.open_fs(m.path)
        with fs.open_input_file(path) as f:
            raw = f.read()
        records = list(warc.parse(gzip.GzipFile(fileobj=__import__("io").BytesIO(raw))))
        assert len(records) == m.n_records and len(raw) == m.n_bytes
        ids = {h["warc-record-id"] for h, _ in records if h["warc-type"] in ("response", "revisit")}
        assert all(h["warc-concurrent-to"] in ids for h, _ in records if h["warc-type"] in ("request", "metadata"))
    with pytest.raises(ValueError):
        list(warc.parse(__import__("io").BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")))


# cover trees


def brute(vectors, queries, k):
    out = {}
    for q, (qid, v) in enumerate(queries):
        if v is None:
            continue
        s = sorted(((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in vectors if i != qid and w is not None and len(w) == len(v)))[:k]
        out[q, qid] = [(-a, i) for a, i in s]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_dual_tree(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(700, 6)) * [5, 5, 5, 50, 5, 5] * 20)
    x[100:160] = x[100]
    ids = rng.permutation(5000)[:700].astype(np.int64)
    q, qids = x[::9], ids[::9]
    order = np.argsort(ids)
    s = covertree.Search(q, qids, x[order], ids[order], 10)
    s.run(covertree.build(q, leaf=4), covertree.build(x[order], leaf=8))
    want = brute(list(zip(ids.tolist(), x)), list(zip(qids.tolist(), q)), 10)
    for i, qid in enumerate(qids.tolist()):
        assert [(int(a), int(b)) for a, b in zip(s.scores[i], s.found[i])] == want[i, qid]


def test_tree_covers():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 4)) * 100)

    def points(n):
        return n.points if n.children is None else np.concatenate([points(c) for c in n.children])

    def check(n):
        p = points(n)
        assert np.sqrt(((x[p] - n.center) ** 2).sum(1)).max() <= n.radius + 1e-9
        reach = n.radius / 1.5
        for i, c in enumerate(n.children or ()):
            assert c.radius <= reach + 1e-9
            assert all(np.sqrt(((c.center - d.center) ** 2).sum()) > reach for d in n.children[:i])
            check(c)

    for x in (x, np.repeat(rng.normal(size=(25, 40)) * 1000, 20, axis=0) + rng.normal(size=(500, 40)), rng.normal(size=(500, 64))):
        root = covertree.build(x, leaf=16)
        assert sorted(points(root).tolist()) == list(range(500))
        check(root)


def test_pairs_of_nodes_are_dropped():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16)) * 900
    x = np.floor(np.repeat(centers, 200, axis=0) + rng.normal(size=(8000, 16)))
    q = np.floor(np.repeat(centers[:8], 10, axis=0) + rng.normal(size=(80, 16)))
    s = covertree.Search(q, np.arange(80) + 10_000, x, np.arange(8000), 10)
    looked, leaf = [], s._leaf
    s._leaf = lambda a, b: (looked.append(len(a) * len(b)), leaf(a, b))
    s.run(covertree.build(q, leaf=16), covertree.build(x))
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :10]
    assert (s.scores == want).all() and sum(looked) < 0.2 * 80 * 8000


def test_cells_are_dropped_before_the_shuffle(spark):
    rng = np.random.default_rng(5)
    centers = np.eye(8) * 4
    rows = [(i, (centers[i % 8] + rng.normal(size=8) / 50).tolist()) for i in range(16_400)]
    v = covertree.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in covertree.top_k(v.filter("vec_id % 400 = 0"), v, sample_rows=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    x = np.floor(np.array([e for _, e in rows]) * 1024)
    for qid, best in got.items():
        scores = x @ x[qid]
        scores[qid] = -np.inf
        want = np.lexsort((np.arange(len(x)), -scores))[:10]
        assert sorted(best) == [(n + 1, scores[i], i) for n, i in enumerate(want.tolist())]
    assert len(got) == 41


def test_whole_numbers_beyond_doubles():
    x = np.array([[2.0**60, 1.0], [2.0**60, 2.0], [3.0, 2.0**60]])
    s = covertree.Search(np.array([[1.0, 1.0]]), np.array([99]), x, np.array([1, 2, 3]), 2)
    s.run(covertree.build(np.array([[1.0, 1.0]])), covertree.build(x))
    assert s.found[0].tolist() == [3, 2] and int(s.scores[0][0]) == 2**60 + 3


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(400)]
    rows += [(400, None), (500, [1.0, None, 1.0, 1.0, 1.0]), (600, [float("nan")] * 5), (700, [float("inf")] * 5), (None, [1.0] * 5), (800, [1.0, 2.0]), (801, [0.5, 0.5]), (900, []), (901, []), (5, rows[6][1]), (300, rows[300][1])]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<float>, label int, qb string")
    v = covertree.vectors(df)
    got = {}
    for r in covertree.top_k(v.filter("vec_id % 100 = 0"), v, block_rows=64, query_rows=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    f = lambda e: None if e is None or any(c is None or not np.isfinite(c) for c in e) else [int(np.floor(1024 * float(np.float32(c)))) for c in e]
    vectors = [(i, f(e)) for i, e in rows if i is not None]
    want = {}
    for (_, qid), best in brute(vectors, [x for x in vectors if x[0] % 100 == 0], 10).items():
        want.setdefault(qid, []).extend((n + 1, s, i) for n, (s, i) in enumerate(best))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items() if x}
    assert covertree.top_k(v.limit(0), v).count() == 0 and covertree.top_k(v, v.limit(0)).count() == 0
