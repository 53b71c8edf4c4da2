"""Operator 6: approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, load, written

BITS, PARTS = 256, 16  # of a code, in substrings of 16 bits each
#: Rows of an index block: a 64th of the table, but at least LEAST and at most what CELLS components are.
LEAST, CELLS, BLOCKS = 8192, 1 << 23, 64
#: Distances of a batch of queries to a block that are held at once.
PAIRS = 1 << 22


def usable(v: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


class Codes:
    """BITS-bit codes: vectors of length up to `norm` are lifted to unit length by one more component, so that inner
    products order as cosines, laid on their principal axes, turned by rotations learned by iterative quantisation from
    different starts (as many as it takes to give BITS components), and cut at 0."""

    def __init__(self, sample: np.ndarray, norm: float, rounds: int = 15, seed: int = 5):
        self.norm = norm or 1.0
        x, rng = self.lifted(sample), np.random.default_rng(seed)
        self.mean = x.mean(0)
        c = x - self.mean
        axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :BITS]
        y, turned, n = c @ axes, [], axes.shape[1]
        for _ in range(-(-BITS // n)):
            r = np.linalg.qr(rng.standard_normal((n, n)))[0]
            for _ in range(rounds if n >= 16 else 0):  # fewer axes would all come to rest in the same place
                u, _, w = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
                r = (u @ w).T
            turned.append(r)
        self.project = axes @ np.concatenate(turned, axis=1)[:, :BITS]

    def lifted(self, v: np.ndarray) -> np.ndarray:
        v = v / self.norm
        return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1, keepdims=True)))], axis=1)

    def stored(self, v: np.ndarray) -> np.ndarray:
        return self._cut(self.lifted(v.astype(float)))

    def asked(self, q: np.ndarray) -> np.ndarray:
        """A query's length does not matter to it, and its added component is 0."""
        q = q.astype(float)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return self._cut(np.concatenate([q, np.zeros((len(q), 1))], axis=1))

    def _cut(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.project >= 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def ball(reach: int) -> np.ndarray:
    """The 16-bit values with at most `reach` ones."""
    return np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) <= reach)


class Index:
    """A block's codes, with a table for each substring: rows in order of their value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes.T)
        self.parts = np.ascontiguousarray(codes).view("<u2")
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []

    def probing(self, radius: int) -> bool:
        """Whether probing looks at fewer values than the block has rows: beyond that, comparing all codes is the shorter way
        to the same rows."""
        return PARTS * sum(math.comb(16, i) for i in range(min(16, radius // PARTS) + 1)) < self.words.shape[1]

    def within(self, asked: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """For each code asked for, every row whose code differs in at most `radius` bits."""
        if self.probing(radius):
            values = ball(radius // PARTS)
            for code in asked:
                yield self._probed(code, values, radius)
            return
        step = max(1, PAIRS // max(1, self.words.shape[1]))
        for at in range(0, len(asked), step):
            part = asked[at : at + step]
            far = np.zeros((len(part), self.words.shape[1]), np.uint16)
            for w, own in enumerate(self.words):
                far += np.bitwise_count(part[:, w, None] ^ own)
            for row in far <= radius:
                yield np.flatnonzero(row)

    def _probed(self, code: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
        """By the pigeonhole, a code within the radius differs in at most radius // PARTS bits in one of its substrings, so
        the rows under those values are all that need to be looked at."""
        if not self.tables:
            for own in self.parts.T:
                self.tables.append((np.argsort(own, kind="stable"), np.concatenate([[0], np.bincount(own, minlength=1 << 16).cumsum()])))
        found = []
        for own, (rows, begins) in zip(code.view("<u2").astype(np.int64), self.tables):
            a = begins[values ^ own]
            n = begins[(values ^ own) + 1] - a
            a, n = a[n > 0], n[n > 0]
            if len(n):
                found.append(rows[np.repeat(a - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())])
        near = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return near[np.bitwise_count(self.words[:, near] ^ code[:, None]).sum(0, dtype=np.int64) <= radius]


def calibrated_radius(codes: Codes, sample: np.ndarray, k: int, rows: int, share: float = 0.97, asked: int = 512) -> int:
    """The radius that holds `share` of the neighbours of the sample's first rows that lie as near as the k nearest of the
    whole table of `rows` do: of a sample, that is its k * len(sample) / rows nearest."""
    q = sample[:asked]
    ip = q @ sample.T
    ip[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = min(max(1, -(-k * len(sample) // rows)), ip.shape[1] - 1)
    top = np.argpartition(-ip, near - 1, axis=1)[:, :near]
    far = np.bitwise_count(codes.stored(sample)[top] ^ codes.asked(q)[:, None]).sum(2, dtype=np.int64)
    return int(np.quantile(far, share))


class Block:
    """Rows of an index block: distinct vectors, each with its least ids and how often they stand with it."""

    def __init__(self, v: np.ndarray, begins: np.ndarray, ids: np.ndarray, counts: np.ndarray, codes: Codes):
        self.v, self.begins, self.ids, self.counts = v, begins, ids, counts
        self.index = Index(codes.stored(v))
        last = begins[:-1] + 1 == begins[1:]
        self.first, self.alone = ids[begins[:-1]], last
        self.second = np.where(last, self.first, ids[np.minimum(begins[:-1] + 1, len(ids) - 1)])

    def search(self, query_ids: np.ndarray, q: np.ndarray, codes: Codes, radius: int, k: int) -> tuple[list, list, list]:
        """Columns query_id, vec_id, score: each query's k nearest of the rows within the radius, by float products. The k
        vectors with the best products (ties to the smallest id but the query's own) hold them."""
        asked, out = codes.asked(q), ([], [], [])
        for qid, vec, near in zip(query_ids, q.astype(float), self.index.within(asked, radius)):
            near = near[~(self.alone[near] & (self.first[near] == qid))]
            score = (self.v[near].astype(float) * vec).sum(1)
            least = np.where(self.first[near] == qid, self.second[near], self.first[near])
            best = np.lexsort((least, -score))[:k]
            ids, scores = self._rows(near[best], score[best], qid)
            ids, scores = ids[:k], scores[:k]
            out[0].append(np.full(len(ids), qid))
            out[1].append(ids)
            out[2].append(scores)
        return out

    def _rows(self, at: np.ndarray, score: np.ndarray, qid: int) -> tuple[np.ndarray, np.ndarray]:
        """Every row of these vectors but the query's own, in order."""
        size = self.begins[at + 1] - self.begins[at]
        flat = np.repeat(self.begins[at] - np.concatenate([[0], size.cumsum()[:-1]]), size) + np.arange(size.sum()) if len(at) else np.empty(0, np.int64)
        score = np.repeat(np.repeat(score, size), self.counts[flat])
        ids = np.repeat(self.ids[flat], self.counts[flat])
        score, ids = score[ids != qid], ids[ids != qid]
        order = np.lexsort((ids, -score))
        return ids[order], score[order]


FOUND = "query_id long, vec_id long, score double"


def _searcher(models: dict[int, tuple[Codes, int]], k: int, radius: int | None):
    """For mapInArrow over rows sorted by (dims, block, ask): a block's vectors are kept, its queries stream past."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            marks = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dims", "block", "ask")])
            cuts = [0, *(np.flatnonzero((np.diff(marks) != 0).any(0)) + 1).tolist(), b.num_rows]
            for a, e in zip(cuts, cuts[1:]):
                dims, at, ask = marks[:, a].tolist()
                own = b.slice(a, e - a)
                v = own.column("v").flatten().to_numpy().reshape(-1, dims)
                if (dims, at) != key:
                    key, parts, block = (dims, at), [], None
                if not ask:
                    ids = own.column("ids")
                    parts.append((v, np.diff(ids.offsets.to_numpy()), ids.flatten().field("vec_id").to_numpy(), ids.flatten().field("n").to_numpy()))
                    continue
                if block is None:
                    if not parts:  # a block that no vector was dealt to
                        continue
                    v_, size, ids, n = (np.concatenate(x) for x in zip(*parts))
                    block, parts = Block(v_, np.concatenate([[0], size.cumsum()]), ids, n, models[dims][0]), []
                found = block.search(own.column("vec_id").to_numpy(), v, models[dims][0], models[dims][1] if radius is None else radius, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(found, schema)], schema=schema)

    return run


def nearest(spark: SparkSession, vectors: DataFrame, k: int = 20, every: int = 20, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with vec_id divisible by `every` against all rows but those with the
    query's own id, from (vec_id, embedding).

    Vectors that are null, empty, zero or have null or non-finite components, and rows with a null id, take no part; a
    query meets only vectors of its own number of components (the driver keeps a model for each number there is). Of
    several vectors of a query's id the least is asked for. Repeated rows are found as often as they stand there, up to k
    times; ties go to the smaller vec_id. Rotations and radius are fitted for each number of components on at most
    2 * `sample` vectors drawn by a hash; every vector is in the index.

    Equal vectors become one with their k + 1 least ids, which hold all that can be among any query's k, so that no vector
    is hot. They are dealt into blocks of bounded size by their hash; each query is sent to every block, is probed there
    within the radius, and hands on k rows; the best k of those are ranked. Queries for which the radius holds fewer than k are
    asked anew without a radius.
    """
    id_, v = F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")
    good = vectors.where(F.col("vec_id").isNotNull() & usable(v)).select(id_, v.alias("v"))
    ids = good.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    index = ids.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids")).withColumn("dims", F.size("v"))
    index = written(spark, index, "vectors")
    models, blocks = {}, {}
    for r in index.groupBy("dims").agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm"), F.count(F.lit(1)).alias("n")).collect():
        own = bounded_sample(index.where(F.col("dims") == r.dims).select("v"), [F.col("v")], sample, r.n).toArrow()["v"].combine_chunks()
        fit = own.flatten().to_numpy().reshape(-1, r.dims).astype(float)
        fit = fit[np.random.default_rng(7).permutation(len(fit))] if len(fit) else np.eye(r.dims)[:1]
        codes = Codes(fit, float(np.sqrt(r.norm)) * (1 + 1e-12))
        models[r.dims] = codes, calibrated_radius(codes, fit, k, r.n) if len(fit) > 1 else BITS
        most = max(1024, CELLS // r.dims)
        blocks[r.dims] = -(-r.n // max(min(LEAST, most), min(most, -(-r.n // BLOCKS))))
    if not models:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of = F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv))[F.col("dims")]
    dealt = index.select("dims", F.pmod(F.xxhash64("v"), of).cast("int").alias("block"), F.lit(False).alias("ask"), F.lit(0).cast("long").alias("vec_id"), "v", "ids")
    queries = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("dims"), "v")).alias("q")).select("vec_id", "q.*")
    queries = written(spark, queries, "queries")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))

    def searched(some: DataFrame, radius: int | None) -> DataFrame:
        ask = some.select("dims", F.explode(F.sequence(F.lit(0), (of - 1).cast("int"))).alias("block"), F.lit(True).alias("ask"), "vec_id", "v", F.lit(None).cast(dealt.schema["ids"].dataType).alias("ids"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = dealt.union(ask).repartition(n, "dims", "block").sortWithinPartitions("dims", "block", "ask")
        found = met.mapInArrow(_searcher(models, k, radius), FOUND).withColumn("rank", place).where(F.col("rank") <= k)
        return written(spark, found.select("query_id", "rank", "vec_id", "score"), "found")

    found = searched(queries, None)
    whole = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    rest = written(spark, queries.join(whole, "vec_id", "left_anti"), "unmet")
    if not rest.limit(1).count():
        return found
    return found.join(rest.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(found.columns).union(searched(rest, BITS))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, load(spark, sf_dir, "embeddings"))
