"""Nearest neighbours by a similarity (larger is nearer): exact in blocks, and by walking a neighbour graph."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgraph.errors import TooLarge
from tabgraph.runtime import written

BLOCK = 256  # queries a task, at least, before there is another task
HELD = 200_000  # queries that a task holds
GRAPH_ROWS = 2_000_000  # edges and vectors that a walk holds in memory


def similarities(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    if kind == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return unit(a) @ unit(b).T
    if kind == "inner":
        return a @ b.T
    return -np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(2), 0))


def exact(points: DataFrame, k: int, kind: str = "euclid", queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(src, dst, similarity, rank): each query's k nearest other points of (id, v); ties to the smaller id.

    Each task holds its share of the queries, and all points stream past, a batch at a time, so points are shuffled once a
    task however many blocks of queries it has. A product of matrices tells which pairs may be nearer than a query's k-th
    so far; only these are compared row by row, in double precision.
    """
    q = points if queries is None else queries
    m = q.count()
    parts = max(1, min(q.sparkSession.sparkContext.defaultParallelism, -(-m // block)), -(-m // HELD))
    left = q.select(F.lit(True).alias("ask"), "id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    right = points.select(F.lit(False).alias("ask"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = left.union(right).repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("ask").desc()).select("ask", "id", F.col("v").cast("array<double>").alias("v"))

    def fn(batches):
        asked, best = [], None
        for b in batches:
            n = b.column(0).true_count or 0
            if n:
                asked.append((b.column(1).slice(0, n).to_numpy(), _matrix(b.column(2).slice(0, n))))
            if n == b.num_rows or not asked:
                continue
            best = best or Best(np.concatenate([a for a, _ in asked]), np.concatenate([v for _, v in asked]), k, kind)
            best.meet(b.column(1).slice(n).to_numpy(), _matrix(b.column(2).slice(n)))
        if best:
            for i in range(0, len(best.ids), 8192):
                yield best.rows(slice(i, i + 8192))

    return rows.mapInArrow(fn, "src long, dst long, similarity double, rank int")


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


class Best:
    """The k nearest so far of each query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, kind: str):
        self.ids, self.k, self.kind = ids, k, kind
        self.vectors = self._own(vectors)
        self.norm2 = (self.vectors**2).sum(1)
        self.fast = self.vectors.astype(np.float32) if kind == "cosine" else self.vectors
        self.near, self.sim = np.full((len(ids), k), -1), np.full((len(ids), k), -np.inf)

    def _own(self, v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if self.kind == "cosine" else v

    def _exactly(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row by row, so that equal rows get equal similarities wherever they stand."""
        return -np.sqrt(((a - b) ** 2).sum(1)) if self.kind == "euclid" else (a * b).sum(1)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        vectors = self._own(vectors)
        norm2 = (vectors**2).sum(1)
        fast = vectors.astype(np.float32) if self.kind == "cosine" else vectors
        unit = np.finfo(fast.dtype).eps * (vectors.shape[1] + 8)
        for p in range(0, len(ids), 1024):
            other, longest = slice(p, p + 1024), norm2[p : p + 1024].max()
            for at in range(0, len(self.ids), 512):
                own = slice(at, at + 512)
                rough = self.fast[own] @ fast[other].T
                worst, n2 = self.sim[own, -1], self.norm2[own]
                if self.kind == "euclid":  # rough: twice the product less the point's square, which grows as the distance falls
                    rough = 2 * rough - norm2[other]
                    worst = n2 - worst**2
                slack = unit * (4 * longest + 4 * n2 if self.kind == "euclid" else np.sqrt(n2 * longest))
                if not np.isfinite(worst).all() and rough.shape[1] > self.k:  # as near as k of this block, not counting the query itself
                    kth = np.partition(rough, -self.k - 1, axis=1)[:, -self.k - 1].astype(float) - slack
                    worst = np.where(np.isfinite(worst), worst, kth)
                least = np.nextafter((worst - slack).astype(rough.dtype), rough.dtype.type(-np.inf))
                i, j = np.divmod(np.flatnonzero(~(rough < least[:, None])), rough.shape[1])
                keep = self.ids[at + i] != ids[p + j]
                self._take(at + i[keep], ids[p + j[keep]], vectors, p + j[keep])

    def _take(self, i: np.ndarray, found: np.ndarray, vectors: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        sim = np.concatenate([self._exactly(self.vectors[i[x : x + 65_536]], vectors[j[x : x + 65_536]]) for x in range(0, len(i), 65_536)])
        rows = np.unique(i)
        i = np.concatenate([np.repeat(rows, self.k), i])
        sim, found = np.concatenate([self.sim[rows].ravel(), sim]), np.concatenate([self.near[rows].ravel(), found])
        order = np.lexsort((found, -sim, i))
        i, sim, found = i[order], sim[order], found[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < self.k
        self.sim[i[top], place[top]], self.near[i[top], place[top]] = sim[top], found[top]

    def rows(self, some: slice) -> pa.RecordBatch:
        sim, near = self.sim[some], self.near[some]
        i, rank = np.nonzero(sim > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[some][i]), pa.array(near[i, rank]), pa.array(sim[i, rank]), pa.array((rank + 1).astype(np.int32))], ["src", "dst", "similarity", "rank"])


def climb(query: np.ndarray, k: int, seeds: list[int], near: dict[int, list[int]], vectors: dict[int, np.ndarray], kind: str = "euclid") -> list[tuple[int, float]]:
    """Best-first hill climbing: the best open vertex is expanded to its unseen neighbours and closed; a closed one on top
    goes to the result, until k are there."""
    sim = lambda i: float(similarities(query[None], vectors[i][None], kind)[0, 0])
    seen, closed, heap, out = set(seeds), set(), [], []
    for s in dict.fromkeys(seeds):
        heapq.heappush(heap, (-sim(s), s))
    while heap and len(out) < k:
        s, v = heap[0]
        if v in closed:
            heapq.heappop(heap)
            out.append((v, -s))
            continue
        closed.add(v)
        for n in near.get(v, ()):
            if n not in seen:
                seen.add(n)
                heapq.heappush(heap, (-sim(n), n))
    return out


def _memory(points: DataFrame, edges: DataFrame) -> tuple[dict, dict]:
    if points.count() + edges.count() > GRAPH_ROWS:
        raise TooLarge(f"a walk holds at most {GRAPH_ROWS} vertices and edges; use exact() beyond")
    near: dict[int, list[int]] = {}
    e, p = edges.select("src", "dst").toArrow(), points.select("id", F.col("v").cast("array<double>").alias("v")).toArrow()
    for a, b in zip(e.column("src").to_pylist(), e.column("dst").to_pylist()):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return near, {i: v for i, v in zip(p.column("id").to_pylist(), p.column("v").to_numpy())}


def approximate(spark: SparkSession, points: DataFrame, edges: DataFrame, queries: DataFrame, k: int, seeds: int = 3, kind: str = "euclid", seed: int = 1) -> DataFrame:
    """(src, dst, similarity) of queries (id, v) by hill climbing from random seeds; the graph is sent to the tasks behind
    a check of its size, the queries are not gathered."""
    near, vectors = _memory(points, edges)
    shared, ids = spark.sparkContext.broadcast((near, vectors)), sorted(vectors)

    def fn(batches):
        g, v = shared.value
        for pdf in batches:
            rows = []
            for i, q in zip(pdf["id"], pdf["v"]):
                first = random.Random(seed * 1_000_003 + int(i)).sample(ids, min(seeds, len(ids)))
                rows += [(i, a, s) for a, s in climb(np.asarray(q, float), k + 1, first, g, v, kind) if a != i][:k]
            yield pd.DataFrame(rows, columns=["src", "dst", "similarity"]).astype({"src": "int64", "dst": "int64", "similarity": "float64"})

    return queries.select("id", "v").mapInPandas(fn, "src long, dst long, similarity double")


def nearest(spark: SparkSession, points: DataFrame, edges: DataFrame, queries: DataFrame, k: int, kind: str = "euclid", most: int = GRAPH_ROWS) -> DataFrame:
    """(src, dst, similarity): approximate() where a walk can hold the graph, exact neighbours beyond."""
    if points.count() + edges.count() > most:
        return exact(points, k, kind, queries).select("src", "dst", "similarity")
    return approximate(spark, points, edges, queries, k, kind=kind)


def walked(spark: SparkSession, points: DataFrame, queries: DataFrame, k: int, near: int, kind: str = "euclid", most: int = GRAPH_ROWS) -> DataFrame:
    """nearest() over the graph of the `near` exact neighbours of each point, which is made only where a walk can hold it."""
    n = points.count()
    if n + n * min(near, n - 1) > most:
        return exact(points, k, kind, queries).select("src", "dst", "similarity")
    return approximate(spark, points, written(spark, exact(points, near, kind), "near"), queries, k, kind=kind)


def inserted(spark: SparkSession, points: DataFrame, k: int, kind: str = "euclid", seed: int = 1) -> DataFrame:
    """(src, dst, similarity) of a neighbour graph built by inserting points in order of their ids: each is linked to the k
    nearest that a climb from k random earlier points finds, never to itself. Sequential, so bounded like a walk."""
    _, vectors = _memory(points, spark.createDataFrame([], "src long, dst long"))
    rng, near, done, rows = random.Random(seed), {}, [], []
    for i in sorted(vectors):
        for a, s in climb(vectors[i], k, rng.sample(done, min(k, len(done))), near, vectors, kind) if done else []:
            near.setdefault(i, []).append(a)
            near.setdefault(a, []).append(i)
            rows.append((i, a, s))
        done.append(i)
    return spark.createDataFrame(rows, "src long, dst long, similarity double")
