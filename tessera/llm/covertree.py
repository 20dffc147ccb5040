"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(scale * x). A bounded hash sample of the
candidates gives the pivots and, for each query, a lower bound of its k-th score.
Candidates go to the cell of their nearest pivot. A query q meets the cells
whose center c and radius r do not rule it out, q . c + |q| r against its bound;
this is decided from one row per cell, before anything is shuffled. Large cells
are cut by hash, so are the queries of a cell, and each pair of blocks meets
once: a cover tree over the candidates, one over the queries, and a descent of
both. With centers c and covering radii r no product of a pair of nodes exceeds

    cq . cr + rq |cr| + rr |cq| + rq rr

and the pair is dropped, at inner nodes as at leaves, when that is below the
worst k-th score in the query node. The best of all blocks are merged per query.

Vectors without structure (random directions) cannot be pruned by any bound of
this kind: all pairs of blocks then meet, as matrix products over large leaves.

Defined results: vectors that are null or hold null or non-finite components,
and rows without vec_id, take no part; vectors of different dimension do not
meet (empty ones meet with score 0); a query does not meet rows with its own
vec_id; repeated queries are answered each; fewer than k candidates give fewer
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

_SAFE = float(1 << 53)
_NONE = np.iinfo(np.int64).max


class Node:
    """A node of a cover tree: its points lie within ``radius`` of ``center``."""

    __slots__ = ("center", "norm", "radius", "children", "points", "worst")

    def __init__(self, center, radius, children, points):
        self.center, self.radius, self.children, self.points = center, radius, children, points
        self.norm, self.worst = float(np.sqrt(center @ center)), None


def build(x: np.ndarray, at: np.ndarray | None = None, base: float = 1.5, leaf: int = 64, gain: int = 4) -> Node:
    """A cover tree. Covering: a node's points lie within its radius of its center,
    and a child's within radius / base of the child's. Separation: the centers
    of a node's children are further than radius / base apart. A node for which
    such centers would not take ``gain`` points each on average stays a leaf,
    however large: nothing is near anything there."""
    at = np.arange(len(x)) if at is None else at
    center = x[at[0]]
    far = np.sqrt(((x[at] - center) ** 2).sum(1))
    radius = float(far.max())
    if len(at) <= leaf or radius == 0:
        return Node(center, radius, None, at)
    reach, groups, rest, near = radius / base, [], at, far
    while len(rest):
        inside = near <= reach
        groups.append(rest[inside])
        rest = rest[~inside]
        if len(groups) >= 16 and len(at) - len(rest) < gain * len(groups):
            return Node(center, radius, None, at)
        if len(rest):
            near = np.sqrt(((x[rest] - x[rest[0]]) ** 2).sum(1))
    return Node(center, radius, [build(x, g, base, leaf, gain) for g in groups], None)


class Search:
    """The k best candidates of each query, ties to the smaller id. ``floor``: scores
    below it cannot be among a query's k best overall and are not looked for."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q, self.qids, self.x, self.ids, self.k = queries, query_ids, x, ids, k
        big = max(np.abs(queries).max(initial=0), np.abs(x).max(initial=0)) ** 2 * max(1, x.shape[1])
        self.exact = big < _SAFE
        self.least = -np.inf if self.exact else -(1 << 200)  # beyond 2 ** 53: whole numbers of any size
        kind = np.float64 if self.exact else object
        self.scores = np.full((len(queries), k), self.least, dtype=kind)
        self.found = np.full((len(queries), k), _NONE)
        self.worst = np.full(len(queries), self.least, dtype=kind)  # what a score must reach
        if self.exact and floor is not None:
            self.worst[:] = floor

    def _products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.exact:
            return self.q[a] @ self.x[b].T
        whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object)
        return whole(self.q[a]) @ whole(self.x[b]).T

    def _leaf(self, a: np.ndarray, points: np.ndarray) -> None:
        for i in range(0, len(points), 4096):
            b = points[i : i + 4096]
            s = self._products(a, b)
            able = (s >= self.worst[a][:, None]).astype(bool) & (self.qids[a][:, None] != self.ids[b][None, :])
            for row in np.flatnonzero(able.any(1)).tolist():
                at, n = np.flatnonzero(able[row]), int(a[row])
                scores = np.concatenate((self.scores[n], s[row, at]))
                ids = np.concatenate((self.found[n], self.ids[b[at]]))
                best = np.lexsort((ids, -scores))[: self.k]
                self.scores[n], self.found[n] = scores[best], ids[best]
                if self.found[n, -1] != _NONE:
                    self.worst[n] = max(self.worst[n], self.scores[n, -1])

    def _worst(self, node: Node) -> float:
        if node.worst is None:
            node.worst = float(self.worst[node.points].min()) if node.children is None else min(map(self._worst, node.children))
        return node.worst

    def run(self, qnode: Node, rnode: Node) -> None:
        """Visits pairs of nodes, the most promising first, and drops those that
        cannot hold a better score for any query of the node."""
        if qnode.children is None and rnode.children is None:
            self._leaf(qnode.points, rnode.points)
            qnode.worst = None
            return
        qs, rs = qnode.children or [qnode], rnode.children or [rnode]
        norms, radii = np.array([c.norm for c in rs]), np.array([c.radius for c in rs])
        centers = np.stack([c.center for c in rs])
        for q in qs:
            bound = centers @ q.center + q.radius * norms + radii * q.norm + q.radius * radii
            bound = bound + np.abs(bound) * 1e-9 + 1
            for i in np.argsort(-bound):
                if bound[i] < self._worst(q):
                    break
                self.run(q, rs[i])
        qnode.worst = None


def _pair(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    right = right.sort_values("vec_id")
    if not len(left) or not len(right):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "qrow", "vec_id", "score")})
    q, x = _matrix(left["v"], left["dim"].iloc[0]), _matrix(right["v"], left["dim"].iloc[0])
    s = Search(q, left["vec_id"].to_numpy(), x, right["vec_id"].to_numpy(), k, left["floor"].to_numpy())
    s.run(build(q), build(x))
    real = s.found != _NONE
    rows = np.nonzero(real)[0]
    return pd.DataFrame({"query_id": left["vec_id"].to_numpy()[rows], "qrow": left["qrow"].to_numpy()[rows], "vec_id": s.found[real], "score": s.scores[real].astype(np.int64)})


def _matrix(vectors, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64).reshape(len(vectors), dim)


def vectors(embeddings: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, dim, v): whole vectors as integers."""
    e = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter("vec_id IS NOT NULL AND e IS NOT NULL")
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~odd).select("vec_id", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


class Pivots:
    """A bounded sample of the candidates by dimension; the first ones are pivots."""

    def __init__(self, rows: list, pivots: int):
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.centers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {r["dim"] for r in rows}:
            some = [r for r in rows if r["dim"] == dim]
            self.rows[dim] = np.array([r["vec_id"] for r in some]), _matrix([r["v"] for r in some], dim)
            cells = [i for i, r in enumerate(rows[:pivots]) if r["dim"] == dim]
            if cells:
                self.centers[dim] = np.array(cells), _matrix([rows[i]["v"] for i in cells], dim)

    def cells(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and centers; a dimension without a pivot has one cell around 0."""
        return self.centers.get(dim) or (np.array([-1]), np.zeros((1, dim)))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers, centers = self.cells(v.shape[1])
        apart = np.maximum((v * v).sum(1)[:, None] - 2 * v @ centers.T + (centers * centers).sum(1), 0)
        best = apart.argmin(1)
        return numbers[best], np.sqrt(((v - centers[best]) ** 2).sum(1))

    def floor(self, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that its k-th best is not below."""
        own, x = self.rows.get(v.shape[1], (np.zeros(0, np.int64), np.zeros((0, v.shape[1]))))
        if len(own) < k + 1 or max(np.abs(v).max(initial=0), np.abs(x).max(initial=0)) ** 2 * max(1, v.shape[1]) >= _SAFE:
            return np.full(len(ids), -np.inf)
        s = v @ x.T
        s[ids[:, None] == own[None, :]] = -np.inf
        return np.partition(s, len(own) - k, axis=1)[:, len(own) - k]


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of one dimension each; columns dim and v come last."""
    dims = b.column(b.num_columns - 2).to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield at, _matrix(b.column(b.num_columns - 1).take(pa.array(at)).to_pylist(), dim)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block_rows: int = 65536, query_rows: int = 4096, pivots: int = 256, sample_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for tables by :func:`vectors`. ``sample_rows``
    candidates are broadcast; at most ``pivots`` of them, one for 2048 candidates,
    are centers of cells."""
    spark = candidates.sparkSession
    queries = shared.stage(queries.withColumn("qrow", F.monotonically_increasing_id()).select("vec_id", "qrow", "dim", "v"), "queries")
    sample = candidates.select("vec_id", "dim", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_rows).collect()  # bounded
    frame = spark.sparkContext.broadcast(Pivots(sample, min(pivots, max(1, candidates.count() // 2048))))  # sample_rows vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in _by_dim(b):
                cells, apart = frame.value.nearest(v)
                rows = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells.astype(np.int32)), pa.array(apart)], names=["vec_id", "dim", "v", "cell", "apart"])

    placed = shared.stage(candidates.select("vec_id", "dim", "v").mapInArrow(place, "vec_id long, dim int, v array<long>, cell int, apart double"), "placed")
    found = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()  # a row per cell
    radius = spark.sparkContext.broadcast({(r.dim, r.cell): r.radius for r in found})

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in _by_dim(b):
                rows = b.take(pa.array(at))
                floor = frame.value.floor(rows.column(0).to_numpy(), v, k)
                cells, centers = frame.value.cells(v.shape[1])
                r = np.array([radius.value.get((v.shape[1], c), -1.0) for c in cells.tolist()])
                bound = v @ centers.T + np.sqrt((v * v).sum(1))[:, None] * r
                q, c = np.nonzero((bound + np.abs(bound) * 1e-9 + 1 >= floor[:, None]) & (r >= 0))
                some = rows.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cells[c].astype(np.int32)), pa.array(floor[q])], names=["vec_id", "qrow", "dim", "v", "cell", "floor"])

    aimed = shared.stage(queries.mapInArrow(aim, "vec_id long, qrow long, dim int, v array<long>, cell int, floor double"), "aimed")
    asked = {(r.dim, r.cell): r["count"] for r in aimed.groupBy("dim", "cell").count().collect()}
    # As many blocks as tasks can use, of at least 2048 rows and at most block_rows.
    most = 4 * shared.spread(spark)
    plan = [(r.dim, r.cell, max(1, -(-r.n // block_rows), min(-(-r.n // 2048), -(-most // len(found)))), -(-asked[r.dim, r.cell] // query_rows)) for r in found if asked.get((r.dim, r.cell))]
    plan = F.broadcast(spark.createDataFrame(plan, "dim int, cell int, blocks int, chunks int"))  # a row per cell
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    deal = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int").alias(n[:-1])
    left = aimed.join(plan, ["dim", "cell"]).select("vec_id", "qrow", "dim", "v", "cell", "floor", deal("chunks", "qrow"), each("blocks", "block"))
    right = placed.join(plan, ["dim", "cell"]).select("vec_id", "dim", "v", "cell", deal("blocks", "vec_id", "v"), each("chunks", "chunk"))
    by = ("dim", "cell", "block", "chunk")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda a, b: _pair(a, b, k), "query_id long, qrow long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "qrow").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(shared.table(spark, sf_dir, "embeddings"))
    return top_k(v.filter("vec_id % 100 = 0"), v)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
