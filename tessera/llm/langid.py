"""Language ID by prediction by partial matching.

Each language has a variable-order byte context tree: how often each byte
followed each context of up to ``order`` bytes. A byte's code length is what an
escape-method-C coder would need with these statistics frozen: from the longest
known context down, an escape costs distinct / (total + distinct), a symbol
count / (total + distinct), and below order 0 every byte is equally likely. The
code length of a text is the sum over all its bytes, each after those before it;
the language with the shortest code wins.

Code lengths are kept in 1/1024 bit as integers: sums are exact and independent
of order. A byte with the bytes of its context is one number, whose code lengths
under all languages are looked up in a table. Training takes a bounded sample of
passages (``sample_bytes`` for each language, in expectation); every text is
scored whole.

Defined results: null texts and texts without a letter are ``und`` with score
0, and so is everything where nothing could be learned; ties go to the first
language in code point order; a null doc_id is never learned from and is not
held out. The driver holds a row and a tree per language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ORDER = 4
_UNIT = 1024
_BITS = 9  # of a symbol: 0 stands before the beginning of a text, a byte is its value + 1
_SLOTS = 21  # bits of a table's index
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(symbols: np.ndarray) -> np.ndarray:
    """For each symbol from the ``ORDER``-th on, it and the ones before as a number."""
    p = symbols.astype(np.uint64)
    out = p[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= p[ORDER - k : -k] << np.uint64(_BITS * k)
    return out


def _unpack(gram: int) -> bytes:
    """The bytes of a gram, without what stands before a text."""
    found = [gram >> _BITS * k & (1 << _BITS) - 1 for k in range(ORDER, -1, -1)]
    return bytes(x - 1 for x in found if x)


def _joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of texts, each after ``ORDER`` zeros; which are a text's; where
    each text begins."""
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    symbols = np.frombuffer(b"".join(bytes(ORDER) + r for r in raws), dtype=np.uint8).astype(np.uint16) + 1
    starts = np.cumsum(sizes + ORDER) - sizes
    inside = np.ones(len(symbols), dtype=bool)
    for k in range(1, ORDER + 1):
        inside[starts - k] = False
    symbols[~inside] = 0
    return symbols, inside, starts


class ContextTree:
    """How often each byte followed each context of at most ``ORDER`` bytes."""

    def __init__(self):
        self.counts: dict[bytes, int] = {}  # context and byte
        self.nodes: dict[bytes, list[int]] = {}  # context: all counts, distinct bytes

    def learn(self, raws: list[bytes]) -> None:
        symbols, inside, _ = _joined(raws)
        g, n = np.unique(grams(symbols)[inside[ORDER:]], return_counts=True)
        for gram, k in zip(g.tolist(), n.tolist()):
            b = _unpack(gram)
            for i in range(len(b)):
                node = self.nodes.setdefault(b[i:-1], [0, 0])
                node[0] += k
                if b[i:] not in self.counts:
                    node[1] += 1
                    self.counts[b[i:]] = 0
                self.counts[b[i:]] += k

    def bits(self, gram: bytes) -> float:
        """Code length of the last byte of ``gram`` after the bytes before it."""
        cost = 0.0
        for k in range(len(gram)):
            if (node := self.nodes.get(gram[k:-1])) is None:
                continue
            total, distinct = node
            if n := self.counts.get(gram[k:]):
                return cost - math.log2(n / (total + distinct))
            cost -= math.log2(distinct / (total + distinct))
        return cost + 8.0


class Scorer:
    """Code lengths of texts under all languages, in units of 1/1024 bit."""

    def __init__(self, langs: list[str], trees: list[ContextTree], limit: int = 500_000):
        self.langs, self.trees, self.limit = langs, trees, limit
        self.memo: dict[int, list[int]] = {}
        self.keys = np.zeros(1 << _SLOTS, dtype=np.uint64)
        self.costs = np.zeros((1 << _SLOTS, len(langs)), dtype=np.int32)

    def _gram(self, gram: int) -> list[int]:
        if (found := self.memo.get(gram)) is None:
            b = _unpack(gram)
            found = [round(t.bits(b) * _UNIT) for t in self.trees]
            if len(self.memo) >= self.limit:
                self.memo.clear()
            self.memo[gram] = found
        return found

    def _costs(self, g: np.ndarray) -> np.ndarray:
        """A row of code lengths for each gram (none is 0: it ends with a byte)."""
        slot = (g * _MIX >> np.uint64(64 - _SLOTS)).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != g)
        out = self.costs[slot]
        if len(missing):
            new, which = np.unique(g[missing], return_inverse=True)
            rows = np.array([self._gram(x) for x in new.tolist()], dtype=np.int32)
            out[missing] = rows[which]
            at = (new * _MIX >> np.uint64(64 - _SLOTS)).astype(np.int64)
            self.keys[at], self.costs[at] = new, rows
            clash = np.flatnonzero(self.keys[at] != new)  # several in one slot: whichever is held, the row is its own
            self.costs[at[clash]] = np.array([self._gram(x) for x in self.keys[at[clash]].tolist()], dtype=np.int32).reshape(-1, len(self.langs))
        return out

    def lengths(self, raws: list[bytes], part: int = 1 << 18) -> np.ndarray:
        """Code length of each text under each language."""
        total = np.zeros((len(raws), len(self.langs)), dtype=np.int64)
        at = 0
        while at < len(raws):
            end, size = at, 0
            while end < len(raws) and (end == at or size + len(raws[end]) <= part):
                size += len(raws[end])
                end += 1
            symbols, inside, starts = _joined(raws[at:end])
            for i in range(0, len(symbols) - ORDER, part):  # more than once for a long text only
                g = grams(symbols[i : i + part + ORDER])
                real = inside[i + ORDER : i + ORDER + len(g)]
                which = np.searchsorted(starts, np.flatnonzero(real) + i + ORDER, side="right") - 1
                rows = self._costs(g[real])
                if len(rows):
                    first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
                    total[at + which[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.int64)
            at = end
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        able = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        out = [("und", 0.0)] * len(texts)
        sizes = self.lengths([texts[i].encode() for i in able])
        for i, size in zip(able, sizes.tolist()):
            best = min(range(len(size)), key=size.__getitem__)
            out[i] = self.langs[best], 1.0 / sum(2.0 ** max(-1000.0, (size[best] - s) / _UNIT) for s in size)
        return out


def fold(doc_id: str, k: int):
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(doc_id).cast("string")) % k


_PASSAGES = pa.schema([("text", pa.string()), ("lang", pa.string())])


def train(labelled: DataFrame, sample_bytes: int = 300_000, passage: int = 1000, seed: int = 5) -> tuple[list[str], list[ContextTree]]:
    """Languages and their trees from ``labelled`` (doc_id, text, lang). Texts are
    cut into passages of ``passage`` characters; each language gives a hash sample
    of these of about ``sample_bytes`` bytes, or all where it has less."""
    rows = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text"))).collect()}  # a row per language
    rates = {k: int(min(1.0, sample_bytes / max(1, n)) * (1 << 64)) for k, n in sizes.items()}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc, text, lang in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = text.as_py()
                found += [(text[i : i + passage], lang) for i in range(0, len(text), passage) if xxhash.xxh64_intdigest(f"{doc} {i}", seed) < rates[lang]]
            yield shared.batch(_PASSAGES, list(zip(*found)) or [[], []])

    trees = {k: ContextTree() for k in sorted(sizes)}
    if trees:
        found: dict[str, list[bytes]] = {}
        for text, lang in rows.mapInArrow(draw, "text string, lang string").collect():  # a bounded sample
            found.setdefault(lang, []).append(text.encode())
        for lang, raws in found.items():
            trees[lang].learn(raws)
    return list(trees), list(trees.values())


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, langs: list[str], trees: list[ContextTree]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for ``docs`` (doc_id, held_out, text)."""
    model = docs.sparkSession.sparkContext.broadcast((langs, trees))  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = model.value
        _, scorer = shared.keep(("scorer", id(trained)), lambda: (trained, Scorer(*trained)))
        for b in batches:
            got = scorer.predict(b.column(2).to_pylist())
            yield shared.batch(_PREDICTED, [b.column(0), b.column(1), [x for x, _ in got], [y for _, y in got]])

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))
    langs, trees = train(docs.filter((fold("doc_id", 3) != 1)))
    return predict(docs, langs, trees)
