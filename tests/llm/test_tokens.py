import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, records, tokens

ODD = ["", " ", "  ", "a  b", "a   b\n", " \n x", "x \n", "\n\n a", "A.\nBcd, x", "a\nb\nc d", "foo***\nBar### z", "Éa!\n\nb", "ΑΣ Σ", "a\x1cb c", "it's 's 't", "\xa0x \xa0y", "日本 語 123 45", "\t\tx", "x\x00y \x00 z", "ﬁ ǅ İstanbul K Å", "<|endoftext|> x", "a<|startoftext|>b  <|endoftext|>\nc <|endoftext|", "<|ENDOFTEXT|> <|endoftext |>", "é ́x", "　a b c d"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_ids_as_the_library(name, odd_rows):
    e = tokens.ChunkEncoder(name, limit=500)
    plain = Tokenizer.from_file(tokens.resolve(name))
    texts = ODD + [t for _, t, *_ in odd_rows if t]
    for _ in range(2):  # again, from memory
        for a, b in tokens.slices(texts, 4000):
            for text, ids in zip(texts[a:b], e.encode(texts[a:b])):
                assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:40]


def test_frames():
    for p in (b"", b"x", bytes(range(256)) * 9):
        f = records.frame(p)
        assert records.unframe(f) == (p, len(f)) and len(f) == len(p) + 16
        for at in (0, 9, len(f) - 1):
            with pytest.raises(ValueError):
                records.unframe(f[:at] + bytes([f[at] ^ 1]) + f[at + 1 :])
        with pytest.raises(ValueError):
            records.unframe(f[:-1])
    for doc in (None, 0, -7, 1 << 62):
        for kind in ("<u2", "<u4"):
            got, ids = records.deserialize(records.serialize(doc, np.arange(5, dtype=kind)))
            assert got == doc and ids.tolist() == list(range(5))


def test_records(odd, odd_rows, nothing):
    plain = Tokenizer.from_file(tokens.resolve("byte_bpe_50k.json"))
    manifest = records.write_records(odd, shards=3)
    got = sorted(map(tuple, records.read_records(manifest).collect()), key=lambda r: r[1])
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, (_, t, *_) in enumerate(odd_rows)}
    assert [r[0] for r in got] == sorted((r[0] for r in odd_rows), key=lambda d: (d is None, d or 0))
    start = 0
    for r in got:
        assert r[1] == start
        start += r[2]
    want = sorted((len(ids[i]), zlib.crc32(np.array(ids[i], dtype="<u4").tobytes())) for i in ids)
    assert sorted((r[2], r[3]) for r in got) == want
    first = manifest.orderBy("shard").first()
    doc, some = records.read_one(first.path, first.n_docs - 1)
    assert any(r[0] == doc and r[2] == len(some) for r in got)
    assert records.read_records(records.write_records(nothing)).count() == 0


def test_packing(odd, odd_rows, nothing):
    plain = Tokenizer.from_file(tokens.resolve("word_bpe_49k.json"))
    got = packing.pack(odd, capacity=128, keep_ids=True).collect()
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
    for rows in held.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    total = sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in odd_rows)
    assert sum(r.length for r in got) == total
    assert len(held) <= -(-total // 128) + 1
    long = sorted((r for r in got if r.doc_id == 13), key=lambda r: r.piece)
    want = np.array(plain.encode(odd_rows[13][1], add_special_tokens=False).ids + [0], dtype="<u4").tobytes()
    assert b"".join(r.ids for r in long) == want and [r.start for r in long] == list(range(0, len(want) // 4, 128))
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    h = {int(k): int(n) for k, n in zip(rng.integers(1, 101, 60), rng.integers(1, 3000, 60))}
    p = packing.plan(h, 100)
    used = {}
    for pattern, m in p:
        assert sum(size * n for size, n in pattern) <= 100 and m > 0
        for size, n in pattern:
            used[size] = used.get(size, 0) + n * m
    assert used == h
    lengths = np.array(sorted(k for k in h if k < 100))
    counts = np.array([h[k] for k in lengths.tolist()])
    _, _, _, lower = packing._fractional(lengths, counts, 100, 2000, 0.02, 64, slack=0.002)
    made = sum(m for _, m in p) - h.get(100, 0)
    assert lower <= made <= 1.025 * lower + 1


def test_the_program_makes_the_sequences():
    rng = np.random.default_rng(2)
    sizes, counts = np.unique(np.minimum(2048, rng.lognormal(6, 1, 12_000).astype(int) + 1), return_counts=True)
    h = dict(zip(sizes.tolist(), counts.tolist()))
    by_program, rest = packing.solve(h, 2048)
    made, added = sum(m for _, m in by_program), sum(m for _, m in rest)
    volume = -(-sum(k * n for k, n in h.items()) // 2048)
    assert made >= 0.9 * (made + added) and h.get(2048, 0) + made + added <= volume + 2
    assert packing.plan({}, 2048) == [] and packing.plan({2048: 3}, 2048) == [(((2048, 1),), 3)]
    assert sum(m for _, m in packing.plan({1500: 50, 700: 3}, 2048)) == 52


def test_bounded_knapsack_is_optimal():
    lengths, counts, prices = np.array([3, 5, 7, 11]), np.array([2, 5, 1, 3]), np.array([0.2, 0.35, 0.5, 0.72])
    index, times, used = packing._bounded_knapsack(lengths, counts, prices, 40)
    for c in range(1, 41):
        want = max((np.dot(n, prices) for n in np.ndindex(3, 6, 2, 4) if np.dot(n, lengths) == c), default=None)
        ends, at, got = np.flatnonzero(used[:, c]), c, 0.0
        assert (want is None) == (not len(ends))
        stop = len(used)
        while want is not None and at:
            stop = int(np.flatnonzero(used[:stop, at])[-1])
            got += float(times[stop] * prices[index[stop]])
            at -= int(times[stop] * lengths[index[stop]])
        assert want is None or abs(got - want) < 1e-9


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 5, 7, 11])
    prices = rng.random(4)
    best, last = packing._knapsack(lengths, prices, 40)
    brute = max(sum(n * p for n, p in zip(c, prices)) for c in np.ndindex(14, 9, 6, 4) if np.dot(c, lengths) <= 40)
    assert abs(best[40] - brute) < 1e-9
    taken = packing._trace(lengths, last, 40)
    assert abs(sum(prices[i] * n for i, n in taken.items()) - best[40]) < 1e-9
