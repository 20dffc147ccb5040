"""N-gram Jaccard join through a MinHash LSH forest.

A text is the set of its shingles (five words; a shorter text is one shingle).
Each of ``trees`` prefix tries holds the texts' labels, ``DEPTH`` MinHash values
of a byte each, as one sorted run: the longest prefix that a label shares with
its neighbours says in which nodes of the trie it is not alone. The join begins
with whole labels and shortens the matched prefixes by one value at a time. All
pairs that meet for the first time, in the first trie that has them, are
verified on the exact shingle sets. After each step the recall is measured: a
pair of similarity s had met by depth d with probability p = 1 - (1 - s^d)^trees,
so the links found so far stand for the sum of their 1 / p. The descent ends
when the found ones are the target share of that sum, but not before a pair
right at the threshold has a chance of ``least``; and where p itself is as high
as the target for every pair above the threshold.

Equal texts count as one. A large trie node is cut into blocks by hash, and
each pair of blocks is a task of its own that returns link counts and spanning
links, never the pairs, so no task holds a whole group.

Defined results: null and empty texts have no shingles and link to nothing; all
of them are copies of one text. A null doc_id sorts last as a representative.
Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, shared

WORDS = 5
DEPTH = 8  # values of a label
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words (lower case, cut at
    white space)."""
    words = (text or "").lower().split()
    known = shared.keep("word hashes", shared.WordHashes)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out ^= h[j : j + m] * _STEPS[j % len(_STEPS)]
        out = (out << np.uint64(27) | out >> np.uint64(37)) * _MIX
    out ^= out >> np.uint64(31)
    return np.unique(out * _STEPS[0])


def met_chance(similarity: float, depth: int, trees: int) -> float:
    """The chance that a pair shares ``depth`` values or more in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def forest_depth(trees: int, threshold: float, target: float) -> int:
    """The longest prefix at which a pair at ``threshold`` meets in some trie
    with probability ``target`` (1 where even that is too long)."""
    return next((d for d in range(DEPTH, 1, -1) if met_chance(threshold, d, trees) >= target), 1)


class Forest:
    """The labels of a text: ``DEPTH`` MinHash values for each trie, the first in
    the highest byte."""

    def __init__(self, trees: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = trees
        self.a = rng.integers(0, 1 << 63, trees * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, trees * DEPTH, dtype=np.uint64)

    def labels(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), ~np.uint64(0), dtype=np.uint64)
        for i in range(0, len(s), 256):
            np.minimum(least, ((s[i : i + 256, None] ^ self.b) * self.a).min(0), out=least)
        values = ((least ^ least >> np.uint64(32)) * _MIX >> np.uint64(56)).reshape(self.trees, DEPTH)
        return (values << np.arange(8 * (DEPTH - 1), -1, -8, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def shared_depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading values two labels share."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    return sum(((x >> np.uint64(8 * k)) == 0).astype(np.int8) for k in range(DEPTH))


_SIGNED = pa.schema([("key", pa.binary()), ("size", pa.int32()), ("labels", pa.list_(pa.int64()))])
_TRIES = pa.schema([("tree", pa.int32()), ("label", pa.int64()), ("key", pa.binary()), ("size", pa.int32()), ("depth", pa.int8())])
_SETS = pa.schema([("key", pa.binary()), ("shingles", pa.binary())])


def signatures(texts: DataFrame, forest: Forest) -> DataFrame:
    """(key, size, labels) of ``texts`` (key, text); a task skips keys it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keys, sizes, out = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if key in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(key)
                s = shingles(text.as_py())
                if len(s):
                    keys.append(key)
                    sizes.append(len(s))
                    out.append(forest.labels(s))
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * forest.trees)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, flat)], schema=_SIGNED)

    return texts.select("key", "text").mapInArrow(run, "key binary, size int, labels array<long>")


def sorted_tries(signed: DataFrame) -> DataFrame:
    """(tree, label, key, size, depth): every trie as a sorted run of labels, with
    the longest prefix that a label shares with a neighbour. At the ends of a
    partition, where a neighbour is unknown, the depth is the greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, np.full(1, DEPTH, dtype=np.int8)
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            tree, label = b.column(0).to_numpy(), b.column(1).to_numpy()
            common = np.where(tree[1:] == tree[:-1], shared_depth(label[1:], label[:-1]), 0).astype(np.int8)
            depth = np.maximum(np.concatenate((before, common[:-1])), common) if len(common) else common
            if len(common):
                yield pa.RecordBatch.from_arrays([*b.slice(0, b.num_rows - 1).columns, pa.array(depth)], schema=_TRIES)
                before = common[-1:]
            held = b.slice(b.num_rows - 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([DEPTH], pa.int8())], schema=_TRIES)

    rows = signed.select(F.posexplode("labels").alias("tree", "label"), "key", "size")
    n = shared.spread(signed.sparkSession, signed, 4 << 20)
    rows = rows.repartitionByRange(n, "tree", "label", "key").sortWithinPartitions("tree", "label", "key")
    return rows.mapInArrow(run, "tree int, label long, key binary, size int, depth byte")


def shingle_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, shingles) for the keys of ``wanted``. Only texts that pass a Bloom
    filter of these are looked at, and only sets are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keys, out, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if key in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(key)
                keys.append(key)
                out.append(shingles(text.as_py()).tobytes())
                size += len(out[-1])
                if size > 4 << 20:
                    yield shared.batch(_SETS, [keys, out])
                    keys, out, size = [], [], 0
            if keys:
                yield shared.batch(_SETS, [keys, out])

    sets = shared.sieve(texts.select("key", "text"), wanted)[0].mapInArrow(run, "key binary, shingles binary")
    return sets.join(wanted, "key", "left_semi").dropDuplicates(["key"])


def similarity(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Jaccard similarity of ``pairs`` (rows of two indices), exact, over the given
    sets of hashes; 0 where the sizes alone keep it below ``threshold``."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    a, b = pairs[:, 0], pairs[:, 1]
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    able = small >= threshold * large
    common = np.zeros(len(pairs), dtype=np.int64)
    if able.sum() <= 2 * len(sets):
        for i in np.flatnonzero(able):
            x, y = sets[a[i]], sets[b[i]]
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common[i] = int((y[at] == x).sum())
    else:
        # Shingles that several sets hold are columns of a 0/1 matrix, some thousand at a time.
        owner = np.repeat(np.arange(len(sets)), sizes)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.concatenate(([True], values[1:] != values[:-1]))
        column = np.cumsum(new) - 1
        times = np.bincount(column)
        shared_ = times[column] > 1
        owner, column = owner[shared_], np.cumsum(np.concatenate(([True], np.diff(column[shared_]) != 0)))[: shared_.sum()] - 1 if shared_.any() else column[shared_]
        total = np.zeros((len(sets), len(sets)), dtype=np.float64)
        width = max(1, (1 << 22) // len(sets))
        for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [at, at + width])
            m = np.zeros((len(sets), width), dtype=np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            total += m @ m.T
        common = np.rint(total[a, b]).astype(np.int64)
    return np.where(able, common / np.maximum(1, sizes[a] + sizes[b] - common), 0.0)


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()), ("bin", pa.int32())])
_BINS = 1000  # of similarity, for the measured recall


def _verify_group(keys: list[bytes], sets: list[np.ndarray], labels: np.ndarray, parts: np.ndarray, crossing: bool, tree: int, depth: int, threshold: float, out: list, bins: Counter) -> None:
    """Links of the texts that share ``depth`` values in ``tree`` and meet here for
    the first time: rows (a, b, null) that span each linked set, (a, null, n)
    with the number of links first met here, and their similarities by bin."""
    i, j = np.triu_indices(len(keys), 1)
    if crossing:  # a pair of blocks: only what crosses
        cross = parts[i] != parts[j]
        i, j = i[cross], j[cross]
    for t in range(labels.shape[1]):
        most = depth if t >= tree else depth - 1  # values they may share here
        if most < DEPTH and len(i):
            prefix = labels[:, t] >> 8 * (DEPTH - 1 - most)
            fresh = prefix[i] != prefix[j]
            i, j = i[fresh], j[fresh]
    if not len(i):
        return
    found = similarity(sets, np.stack([i, j], 1), threshold)
    ok = found >= threshold
    i, j = i[ok], j[ok]
    for at, n in zip(*(x.tolist() for x in np.unique((found[ok] * _BINS).astype(np.int64), return_counts=True))):
        bins[at] += n
    for at, n in zip(*(x.tolist() for x in np.unique(np.concatenate([i, j]), return_counts=True))):
        out.append((keys[at], None, n, None))
    root = list(range(len(keys)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        x, y = find(x), find(y)
        if x != y:
            x, y = sorted((x, y), key=keys.__getitem__)
            root[y] = x
    for x in range(len(keys)):
        if (r := find(x)) != x:
            out.append((keys[r], keys[x], None, None))


def _links_at(depth: int, tries: DataFrame, done: DataFrame | None, sets: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """The links (a, b, n, bin) of pairs that first meet at ``depth``, and the nodes
    that were looked at. ``done``: nodes of greater depth; one with the same
    members has nothing new."""
    spark = tries.sparkSession
    met = tries.filter(F.col("depth") >= depth).select("tree", F.shiftrightunsigned("label", 8 * (DEPTH - depth)).alias("prefix"), "key", "size")
    nodes = met.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("shingles"), F.bit_xor(F.xxhash64("key")).alias("members")).filter("n > 1")
    # Nodes with the same members in several tries are kept in the first.
    nodes = nodes.groupBy("n", "members", "shingles").agg(F.min(F.struct("tree", "prefix")).alias("at"))
    if done is not None:
        nodes = nodes.join(done.select("n", "members"), ["n", "members"], "left_anti")
    nodes = shared.stage(nodes.select("at.tree", "at.prefix", "n", "members", "shingles"), "nodes")
    # Blocks of a large node: up to 8, then as many as hold 1024 texts or 8 MB of sets each.
    blocks = F.ceil(F.greatest(F.col("n") / F.greatest(F.lit(block), F.least(F.lit(1024), F.ceil(F.col("n") / 8))), F.col("shingles") / (1 << 20))).cast("int")
    part = F.pmod(F.xxhash64("tree", "prefix", "key"), F.col("blocks")).cast("int")
    held = met.drop("size").join(nodes.select("tree", "prefix", blocks.alias("blocks")), ["tree", "prefix"])
    dealt = held.withColumn("part", part).select("key", "tree", "prefix", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = shared.stage(dealt.select("key", "tree", "prefix", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")), "dealt")
    n = shared.spread(spark, dealt, 256 << 10)
    rows = dealt.join(sets, "key").repartition(2 * n, "tree", "prefix", "p", "q").sortWithinPartitions("tree", "prefix", "p", "q").select("tree", "prefix", "p", "q", "part", "key", "shingles", "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out, bins = None, [], [], Counter()

        def finish() -> None:
            if len(group) > 1:
                _verify_group([r[1] for r in group], [r[2] for r in group], np.stack([r[3] for r in group]).view(np.uint64), np.array([r[0] for r in group]), now[2] != now[3], now[0], depth, threshold, out, bins)

        for b in batches:
            for tree, prefix, p, q, part, key, raw, labels in zip(*(c.to_pylist() for c in b.columns[:7]), b.column(7)):
                if (tree, prefix, p, q) != now:
                    finish()
                    now, group = (tree, prefix, p, q), []
                group.append((part, key, np.frombuffer(raw, dtype=np.uint64), labels.values.to_numpy()))
            if len(out) > 5000:
                yield shared.batch(_LINKS, list(zip(*out)))
                out.clear()
        finish()
        out += [(None, None, n, at) for at, n in bins.items()]
        if out:
            yield shared.batch(_LINKS, list(zip(*out)))

    links = shared.stage(rows.mapInArrow(run, "a binary, b binary, n long, bin int"), "links")
    shared.release(dealt)
    return links, nodes


def text_links(texts: DataFrame, threshold: float = 0.8, trees: int = 20, target: float = 0.9995, least: float = 0.99, block: int = 512) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Verified links between different texts of ``texts`` (key, text; equal
    keys, equal texts): rows (a, b, null) whose graph has the same components as
    all links, and rows (a, null, n) whose n add up to a's number of links.
    Besides, the depths of the descent and the recall measured at each."""
    signed = shared.stage(signatures(texts, Forest(trees)).dropDuplicates(["key"]), "signatures")
    tries = shared.stage(sorted_tries(signed), "tries")
    last = forest_depth(trees, threshold, target)
    wanted = shared.stage(tries.filter(F.col("depth") >= last).select("key").distinct(), "wanted")
    sets = shared.stage(shingle_sets(texts, wanted).join(signed.select("key", "labels"), "key"), "shingles")
    links, nodes, bins, steps = [], [], Counter(), []
    for depth in range(DEPTH, last - 1, -1):
        done = None
        for x in nodes:
            done = x if done is None else done.union(x)
        found, looked = _links_at(depth, tries, done, sets, threshold, block)
        links.append(found)
        nodes.append(looked)
        for at, n in found.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("n")).collect():  # at most _BINS rows
            bins[at] += n
        total = sum(n / met_chance(max(threshold, at / _BINS), depth, trees) for at, n in bins.items())
        steps.append((depth, sum(bins.values()) / total if total else 1.0))
        if steps[-1][1] >= target and met_chance(threshold, depth, trees) >= least:
            break
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    out = shared.stage(out.filter("bin IS NULL").drop("bin"), "links")
    shared.release(signed, tries, wanted, sets, *nodes, *links)
    return out, steps


def classes(docs: DataFrame, rid: str | None = None, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; ``rid`` names a column that tells
    rows apart): doc_id, rid,
    class_id (the smallest doc_id among the texts linked to it directly or
    through others), copy_of (the smallest doc_id with this very text), n_links
    (how many other texts are similar to it), first (whether this row stands
    for its class; ties by rid)."""
    rid = F.monotonically_increasing_id().alias("rid") if rid is None else F.col(rid).alias("rid")
    texts = docs.select(shared.text_key().alias("key"), F.col("text").cast("string").alias("text"))
    rows = shared.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid, shared.text_key().alias("key")), "rows")
    links, _ = text_links(texts, **options)
    counts = links.filter("n IS NOT NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    labels = graph.components(links.filter("b IS NOT NULL")).select(F.col("node").alias("key"), "label")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    copies = rows.groupBy("key").agg(first.alias("copy"))
    copies = copies.join(counts, "key", "left").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    copies = shared.stage(copies, "copies")
    whole = copies.groupBy("label").agg(F.min("copy").alias("head"))
    by_text = copies.join(whole, "label").select("key", "copy", "head", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = rows.join(by_text, "key")
    return out.select("doc_id", "rid", F.col("head.doc_id").alias("class_id"), F.col("copy.doc_id").alias("copy_of"), "n_links", (F.col("rid") == F.col("head.rid")).alias("first"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(shared.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of", "n_links")


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT t, min(doc_id) AS id FROM d GROUP BY t),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '') AS w FROM c),
i AS (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM i),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g AS a JOIN g AS b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b WHERE CAST(k AS DOUBLE) / (x.n + y.n - k) >= 0.8),
r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
e AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, m.class_id, c.id AS copy_of, CAST(coalesce(e.n_links, 0) AS BIGINT) AS n_links
FROM d JOIN c ON d.t = c.t JOIN m ON m.a = c.id LEFT JOIN e ON e.a = c.id
"""
