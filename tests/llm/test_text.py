import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import graph, jaccard, langid, mixing, suffix, toxicity

# suffix-array dedup


def brute_spans(raws, width):
    seen = Counter(b[i : i + width] for b in raws for i in range(len(b) - width + 1))
    out = []
    for b in raws:
        cover = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                cover[i : i + width] = b"\1" * width
        kept = bytes(x for x, c in zip(b, cover) if not c)
        starts = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        out.append((len(b), sum(cover), starts, hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(raws, n):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", b) for b in raws]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    return [len({j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}) for w in words]


@pytest.mark.parametrize("seed", range(30))
def test_transform(seed):
    rng = random.Random(seed)
    width, letters = rng.choice([8, 12, 40]), rng.choice([b"ab", b"abcdefgh", b"\x00a\xff"])
    base = bytes(rng.choice(letters) for _ in range(90))
    parts = []
    for _ in range(rng.randint(1, 9)):
        a = rng.randint(0, 60)
        parts.append(bytes(rng.choice(letters) for _ in range(rng.randint(0, 50))) + base[a : a + rng.randint(0, 90)])
    seen = Counter(p[i : i + width] for p in parts for i in range(len(p) - width + 1))
    want = [[i for i in range(len(p) - width + 1) if seen[p[i : i + width]] > 1] for p in parts]
    assert [x.tolist() for x in suffix.repeated_starts(parts, width)] == want
    wide = [np.frombuffer(p, dtype=np.uint8).astype("<u8").tobytes() for p in parts]
    assert [x.tolist() for x in suffix.repeated_starts(wide, width, 8)] == want


@pytest.mark.parametrize("part", [1 << 18, 16])
def test_word_codes(part, monkeypatch):
    monkeypatch.setattr(suffix, "_PART", part)
    rng = random.Random(1)
    stock = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 7))) for _ in range(60)] + [b"a", b"a\x00", b"\x00a", b"w" * 50]
    words = [rng.choice(stock) for _ in range(500)]
    raw = b"".join(w + bytes(rng.choice(b" \t\n\x0b\x0c\r") for _ in range(rng.randint(1, 3))) for w in words)
    for text in (raw, b" " + raw.strip(), b"", b" \n", b"one"):
        codes = np.frombuffer(suffix.word_codes(text), dtype="<u8").tolist()
        assert len(codes) == len(text.split()) and len(set(zip(codes, text.split()))) == len(set(codes)) == len(set(text.split()))


@pytest.mark.parametrize("seed", range(6))
def test_least_hashes(seed):
    rng = random.Random(seed)
    raw = bytes(rng.choice(b"abc") for _ in range(rng.randint(30, 200)))
    unit = suffix.byte_strings(24, 8)
    h = [zlib.crc32(raw[i : i + 8]) for i in range(len(raw) - 7)]
    got = suffix.gram_hashes(np.frombuffer(raw, dtype=np.uint8).astype(np.uint64), 8).tolist()
    assert len(set(zip(h, got))) == len(set(h)) == len(set(got))
    least = [min(got[i : i + 17]) for i in range(len(raw) - 23)]
    places = {j for i, m in enumerate(least) for j in range(i, i + 17) if got[j] == m}
    assert sorted(suffix.least_hashes(raw, unit).tolist()) == sorted(got[j] for j in places)
    covered = [(fp, s, n) for fp, s, n, *_ in suffix.segments(raw, unit, set(least))]
    assert [m for m in least] == [fp for fp, s, n in covered for _ in range(n - 23)] and [s for _, s, _ in covered] == sorted({s for _, s, _ in covered})
    some = set(least[:1])
    assert [x for x in suffix.segments(raw, unit, some)] == [x for x in suffix.segments(raw, unit, set(least)) if x[0] in some]


@pytest.mark.parametrize("hash_bytes", [3 << 20, 300])
def test_dedup(odd, odd_rows, hash_bytes):
    some = odd.filter("doc_id IS NULL OR doc_id <> 13")
    got = [tuple(r) for r in suffix.report(some, hash_bytes=hash_bytes).collect()]
    rows = [r for r in odd_rows if r[0] != 13]
    raws = [(r[1] or "").encode() for r in rows]
    want = [(r[0], *b, n) for r, b, n in zip(rows, brute_spans(raws, 400), brute_passages(raws, 51))]
    assert any(r[5] for r in want)
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_dedup_small_width(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé") for _ in range(400))
    texts = []
    for _ in range(40):
        a = rng.randint(0, 350)
        words = " ".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))
        texts.append(words + "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 60))) + base[a : a + rng.randint(0, 200)] + rng.choice(["", "abc" * 30]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix.report(df, suffix.byte_strings(24, 8), suffix.word_strings(6, 2), batch_bytes=500, hash_bytes=rng.choice([1 << 20, 200])).collect())
    raws = [t.encode() for t in texts]
    assert got == [(i, *b, n) for i, (b, n) in enumerate(zip(brute_spans(raws, 24), brute_passages(raws, 6)))]
    assert any(r[5] for r in got)


def test_dedup_of_nothing(nothing):
    assert suffix.report(nothing).count() == 0


# n-gram Jaccard join


def brute_links(texts, threshold=0.8):
    def grams(t):
        w = (t or "").lower().split()
        n = min(5, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()

    sets = {t: grams(t) for t in {t or "" for t in texts}}
    links = defaultdict(set)
    all_ = sorted(sets)
    for i, a in enumerate(all_):
        for b in all_[:i]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) / len(x | y) >= threshold:
                links[a].add(b)
                links[b].add(a)
    return links


def brute_classes(rows):
    links = brute_links([t for _, t in rows])
    ids = defaultdict(list)
    for d, t in rows:
        ids[t or ""].append(d)
    low = lambda ds: min((d for d in ds if d is not None), default=None)
    out = []
    for d, t in rows:
        seen, todo = {t or ""}, [t or ""]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out.append((d, low([i for s in seen for i in ids[s]]), low(ids[t or ""]), len(links[t or ""])))
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_classes(spark, odd_rows, block):
    rng = random.Random(8)
    stock = ["w%d" % i for i in range(500)]
    rows = [(r[0], r[1]) for r in odd_rows if r[0] != 13]
    for f in range(6):
        family = [rng.choice(stock) for _ in range(120)]
        for i in range(14):
            w = list(family)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(stock)
            rows.append((1000 + 20 * f + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.class_id, r.copy_of, r.n_links) for r in jaccard.classes(df, block=block).collect()]
    assert sorted(got, key=repr) == sorted(brute_classes(rows), key=repr)


def test_one_row_stands_for_each_class(odd):
    got = jaccard.classes(odd).collect()
    heads = Counter((r.class_id, r.copy_of) for r in got if r.first)
    assert len(got) == 22 and all(n == 1 for n in heads.values())


def test_classes_of_nothing(nothing):
    assert jaccard.classes(nothing).count() == 0


def test_similar_both_ways():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(30)]
    pairs = np.stack(np.triu_indices(30, 1), 1)
    want = [len(np.intersect1d(sets[a], sets[b])) / max(1, len(np.union1d(sets[a], sets[b]))) for a, b in pairs]
    want = [w if w >= 0.5 else 0 for w in want]
    near = lambda x: [v if v >= 0.5 else 0 for v in x]
    assert near(jaccard.similarity(sets, pairs, 0.5).tolist()) == want
    assert near(float(jaccard.similarity(sets, p[None], 0.5)[0]) for p in pairs) == want


def test_depth():
    assert jaccard.forest_depth(20, 0.8, 0.9995) == 5
    assert jaccard.forest_depth(1, 0.8, 0.9999) == 1
    a = np.array([0x0102030405060708, 0x0102030405060708, -1], dtype=np.int64)
    b = np.array([0x0102030405060708, 0x0102030405FF0708, 1], dtype=np.int64)
    assert jaccard.shared_depth(a, b).tolist() == [8, 5, 0]


def test_labels_share_values_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    forest, common = jaccard.Forest(200), rng.integers(0, 1 << 62, 160).astype(np.uint64)
    a, b = (np.append(common, rng.integers(0, 1 << 62, 20).astype(np.uint64)) for _ in range(2))  # similarity 0.8
    depth = jaccard.shared_depth(forest.labels(a), forest.labels(b))
    assert abs((depth >= 1).mean() - 0.8) < 0.1 and abs((depth >= 4).mean() - 0.8**4) < 0.12


def test_tries_know_their_neighbours(spark):
    rng = random.Random(5)
    rows = [(bytes([i // 256, i % 256]), 9, [rng.choice([1, 2]) << 56 | rng.choice([1, 2]) << 48 | rng.randrange(1 << 20) for _ in range(3)]) for i in range(600)]
    got = jaccard.sorted_tries(spark.createDataFrame(rows, "key binary, size int, labels array<long>")).collect()
    assert len(got) == 1800
    for tree in range(3):
        labels = np.sort(np.array([r[2][tree] for r in rows], dtype=np.int64))
        want = [0, *jaccard.shared_depth(labels[1:], labels[:-1]).tolist(), 0]
        want = {x: max(want[i], want[i + 1]) for i, x in enumerate(labels.tolist())}
        held = [r for r in got if r.tree == tree]
        assert all(r.depth >= want[r.label] for r in held) and sum(r.depth > want[r.label] for r in held) <= 16


def test_descent_ends_when_recall_is_reached(spark):
    rng, rows = random.Random(6), []
    for family, changes in ((range(0, 30), 0), (range(30, 60), 5)):
        stock = ["v%d" % i for i in range(4000)]
        for f in family:
            base = [rng.choice(stock) for _ in range(240)]
            for i in range(2):
                w = base + ["end%d" % i] if not changes else list(base)
                for k in range(changes * i):
                    w[k * 48 + rng.randrange(20)] = "x%d" % k  # five shingles each: 211 of 261
                rows.append((f"{f}-{i}".encode(), " ".join(w), changes))
    df = spark.createDataFrame(rows, "key binary, text string, changes int")
    easy, steps = jaccard.text_links(df.filter("changes = 0"))
    assert [d for d, _ in steps] == [8, 7] and steps[-1][1] >= 0.9995 and easy.filter("b IS NOT NULL").count() == 30
    hard, steps = jaccard.text_links(df.filter("changes > 0"), threshold=0.8)
    assert [d for d, _ in steps][-1] < 7 and [r for _, r in steps] == sorted(r for _, r in steps)
    found = hard.filter("b IS NOT NULL").count()
    exact = sum(len(x) for x in brute_links([t for _, t, c in rows if c]).values()) // 2
    assert exact == 30 and found >= 0.9 * exact
    few, _ = jaccard.text_links(df, target=0.5, least=0.0)
    assert few.filter("b IS NOT NULL").count() <= 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# mixing


def test_targets():
    t = mixing.targets({"b": 100, "a": 10, None: 1, "c": 100})
    assert t["a"] == 30 and t[None] <= 3 and abs(sum(t.values()) - 211) < 1e-9
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0}


@pytest.mark.parametrize("seed", range(20))
def test_fit(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 60): rng.randint(1, 5) for _ in range(8)}
    total = sum(k * n for k, n in counts.items())
    budget = rng.randint(0, total)
    take = mixing.fit(counts, budget, exact_below=1 << 14)
    assert all(0 <= take.get(k, 0) <= n for k, n in counts.items())
    got = sum(k * n for k, n in take.items())
    assert got <= budget and budget - got <= 60


def test_knapsack_reaches_what_can_be_reached():
    take = mixing._exact([50, 30, 7], {50: 2, 30: 3, 7: 1}, 117)
    sums = {50 * a + 30 * b + 7 * c for a in range(3) for b in range(4) for c in range(2)}
    assert sum(k * n for k, n in take.items()) == max(s for s in sums if s <= 117)


@pytest.mark.parametrize("counts, budget", [({50_000: 1, 60_000: 1, 70_000: 1}, 110_000), ({100: 10_000, 150_001: 1}, 750_001), ({100_000: 2, 70_001: 3, 6: 1}, 310_009)])
def test_fit_of_long_documents(counts, budget):
    take = mixing.fit(counts, budget)
    assert all(take.get(k, 0) <= n for k, n in counts.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    assert sum(k * n for k, n in take.items()) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("seed", range(20))
def test_fit_of_few_long_documents_is_the_best(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(30_000, 90_000) for _ in range(9)]
    counts = Counter(lengths)
    sums = {0}
    for k in lengths:
        sums |= {s + k for s in sums}
    budget = rng.randint(0, sum(lengths))
    assert sum(k * n for k, n in mixing.fit(counts, budget).items()) == max(s for s in sums if s <= budget)


def test_fit_takes_lengths_alike():
    counts = {k: 1 for k in range(1000, 3000)}
    budget = sum(counts) // 3
    taken = [[k for k, n in mixing.fit(counts, budget, seed=s).items() if n] for s in (1, 2)]
    assert taken[0] != taken[1]
    for t in taken:
        assert sum(t) == budget and 1900 < sum(t) / len(t) < 2100


def plain_targets(sizes):
    """Shares by weight; one source above three times its size at a time, the one
    most above first, is held there and what it gives up is shared again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, left = {}, sum(sizes.values())
    while len(held) < len(order):
        free = [s for s in order if s not in held]
        unit = left / sum(weight[s] for s in free)
        worst = max(free, key=lambda s: unit * weight[s] - 3 * sizes[s])
        if unit * weight[worst] <= 3 * sizes[worst]:
            return held | {s: unit * weight[s] for s in free}
        held[worst] = 3 * sizes[worst]
        left -= held[worst]
    return held


def test_mix_of_long_documents(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abcd"), " ".join(["w"] * rng.choice([3, 40, 41_000, 60_000, 45_007]))) for i in range(44)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in "abcd":
        of = [r for r in got if r.source == s]
        size, target = of[0].source_size, of[0].target
        sums = {0}
        for r in of:
            sums |= {x + r.size for x in sums}
        rest = round(target - int(target // size) * size)
        assert sum(r.taken for r in of) - int(target // size) * size == max(x for x in sums if x <= rest)
        assert all(r.repeats in (int(target // size), int(target // size) + 1) for r in of)


@pytest.mark.parametrize("counts, budget, want", [({60000: 3, 41000: 3}, 123000, 123000), ({400: 5, 45000: 2, 50000: 1}, 90000, 90000)])
def test_fit_meets_these_budgets(counts, budget, want):
    assert sum(k * n for k, n in mixing.fit(counts, budget).items()) == want


def test_mix(odd, odd_rows, nothing):
    got = mixing.mix(odd).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(odd).collect()))
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    sizes, taken, goal = Counter(), Counter(), {}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.repeats * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = (r.source_size, r.target)
    want = Counter()
    for r in odd_rows:
        want[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert sizes == want
    want = plain_targets(sizes)
    for s, (size, target) in goal.items():
        assert size == sizes[s] and taken[s] <= 3 * size and abs(target - want[s]) < 1e-6
        epochs = int(target // size) if size else 0
        lengths = [r.size for r in got if r.source == s and r.size]
        sums = {0}
        for x in lengths:
            sums |= {y + x for y in sums}
        assert taken[s] - epochs * size == max(x for x in sums if x <= round(target - epochs * size))
    assert mixing.mix(nothing).count() == 0


# language


def plain_code_length(learned, text, order=4):
    """Escape method C straight from the definition, over lists of symbols."""
    after = defaultdict(Counter)
    for raw in learned:
        for i in range(len(raw)):
            for k in range(min(i, order) + 1):
                after[raw[i - k : i]][raw[i]] += 1
    total = 0.0
    for i in range(len(text)):
        for k in range(min(i, order), -1, -1):
            seen = after.get(text[i - k : i])
            if seen is None:
                continue
            if seen[text[i]]:
                total -= np.log2(seen[text[i]] / (sum(seen.values()) + len(seen)))
                break
            total -= np.log2(sum(1 for v in seen.values() if v) / (sum(seen.values()) + len(seen)))
        else:
            total += 8
    return total


@pytest.mark.parametrize("part", [1 << 18, 7])
def test_code_lengths(part):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    learned = [[" ".join(word(letters) for _ in range(30)).encode() for _ in range(6)] for letters in ("abcdé", "cdefü")]
    trees = []
    for raws in learned:
        trees.append(langid.ContextTree())
        trees[-1].learn(raws)
    texts = [b"", b"a", b"abc cab", "éüé 12\x00 \x00".encode(), " ".join(word("abcdefé") for _ in range(40)).encode(), b"zzzzzzzz", b"abc cab"]
    s = langid.Scorer(["x", "y"], trees, limit=20)
    for _ in range(2):
        for text, got in zip(texts, s.lengths(texts, part).tolist()):
            want = [plain_code_length(raws, text) for raws in learned]
            assert all(abs(g / 1024 - w) < 0.001 * len(text) + 1e-9 for g, w in zip(got, want)), text


def test_slots_that_clash(monkeypatch):
    tree = langid.ContextTree()
    tree.learn([b"the quick brown fox jumps over the lazy dog " * 3])
    wide = langid.Scorer(["x"], [tree])
    monkeypatch.setattr(langid, "_SLOTS", 3)
    narrow = langid.Scorer(["x"], [tree])
    texts = [b"the lazy fox", b"over and over the dog", b"quick quick quick jumps"]
    monkeypatch.setattr(langid, "_SLOTS", 21)
    want = wide.lengths(texts).tolist()
    monkeypatch.setattr(langid, "_SLOTS", 3)
    assert [narrow.lengths(texts).tolist() for _ in range(3)] == [want] * 3


def test_long_documents_are_learned_from(spark):
    rows = [(i, "lorem ipsum dolor " * 20_000 if i % 2 else "quick brown foxes " * 3, "la" if i % 2 else "en") for i in range(60)]
    langs, trees = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=50_000)
    assert langs == ["en", "la"] and trees[0].counts[b"quick"] == 90 and 500 < trees[1].counts[b"lorem"] < 8000


def test_languages(spark, sf_dir):
    got = {r.doc_id: r for r in langid.op10_ppm_language(spark, sf_dir).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sorted(d for d in got if got[d].held_out) == sorted(held)
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_languages(odd, odd_rows, nothing):
    from pyspark.sql import functions as F

    langs, trees = langid.train(odd.filter("doc_id > 3"))
    got = langid.predict(odd.withColumn("held_out", F.lit(False)), langs, trees).collect()
    assert len(got) == len(odd_rows) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    for r in got:
        if r.doc_id in (0, 1, 2, 3, 16):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.train(nothing) == ([], [])
    assert {r.lang_pred for r in langid.predict(odd.withColumn("held_out", F.lit(False)), [], []).collect()} == {"und"}


# toxicity


def plain_ftrl(rows, alpha, beta, l1, l2):
    """The published per-coordinate algorithm, one number at a time; coordinate
    None is the bias, which has no L1 or L2."""
    z, n, scores = defaultdict(float), defaultdict(float), []

    def weight(i):
        a, b = (0.0, 0.0) if i is None else (l1, l2)
        if abs(z[i]) <= a:
            return 0.0
        return -(z[i] - np.sign(z[i]) * a) / ((beta + n[i] ** 0.5) / alpha + b)

    for y, found in rows:
        w = {i: weight(i) for i in (None, *found)}
        p = 1 / (1 + np.exp(-sum(w.values())))
        for i in w:
            g = p - y
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
            n[i] += g * g
        scores.append(p)
    return scores, {i: weight(i) for i in list(z)}


@pytest.mark.parametrize("l1, l2", [(0.5, 0.0), (1.0, 0.1)])
def test_ftrl_is_the_published_one(l1, l2):
    rng = np.random.default_rng(7)
    rows = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 40, 6))) for _ in range(300)]
    rows = [(y, np.unique(np.append(b, 41) if y and rng.random() < 0.8 else b)) for y, b in rows]
    learner = toxicity.Ftrl(6, alpha=0.7, beta=1.0, l1=l1, l2=l2)
    got = [learner.update(b, y) for y, b in rows]
    scores, weights = plain_ftrl([(y, b.tolist()) for y, b in rows], 0.7, 1.0, l1, l2)
    _, bias, at, w = learner.model()
    assert np.allclose(got, scores) and np.isclose(bias, weights.pop(None))
    assert np.allclose(w, [weights[i] for i in at.tolist()]) and len(at) == sum(x != 0 for x in weights.values())


def test_features_are_grams_and_skip_grams():
    one = lambda *w: set(toxicity.features(" ".join(w), 20).tolist())
    assert len(toxicity.features("a b c d e", 20)) == 5 + 4 + 3 + 2 and not len(toxicity.features(None, 20))
    assert one("a", "x", "b") & one("a", "y", "b") == one("a") | one("b") | (one("a", "x", "b") & one("a", "z", "b"))
    assert len(one("a", "x", "b") & one("a", "y", "b")) == 3 and len(one("a", "b") & one("b", "a")) == 2
    assert one("A", "b") == one("a", "B")


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    learner = toxicity.Ftrl(12, l1=2.0)
    rows = []
    for _ in range(2000):
        y = int(rng.random() < 0.2)
        rows.append((y, np.unique(np.append(rng.integers(0, 4000, 30), [4090, 4091] if y else [4092]))))
    for _ in range(3):
        for y, b in rows:
            learner.update(b, y)
    bits, bias, at, w = learner.model()
    s = toxicity.Scorer(bits, bias, at, w)
    assert len(at) < 1500 and s.weights[4090] > 0.5 and s.weights[4092] < 0


def test_toxicity(spark, sf_dir, odd, nothing):
    rows = [(i, f"word{i % 40} other{i % 7} thing " * 6 + ("vile scum" if i % 3 == 0 else "good day")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.labelled_sample(docs, labels, 1000))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].predicted == (i % 3 == 0) == (got[i].score >= 0.5) for i in got)
    some = toxicity.score(odd, model).collect()
    assert len(some) == odd.count() and all(0 <= r.score <= 1 for r in some)
    empty = toxicity.train(toxicity.labelled_sample(docs, nothing.selectExpr("doc_id", "1 AS toxic"), 10))
    assert all(r.predicted == 0 for r in toxicity.score(docs.limit(3), empty).collect())
    assert toxicity.score(nothing, model).count() == 0
