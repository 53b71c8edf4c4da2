"""Operator 9: SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, load, row_pass, written
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: The 64 bits in three blocks; two fingerprints at most 3 bits apart differ in at most 2 bits outside one of them.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Members of a variant's group that are compared pairwise; larger groups are linked by whole balls instead.
CROWD = 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit k is 1 if it is set in over half of the shingles' XXH64 values, repeats included; no word: 0."""
    words = text.encode().lower().split()  # on bytes: A-Z alone, and \x20 and \x09 to \x0D alone
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    begins = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(begins[:n], begins[min(shingle, len(words)) :])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def signed(x: int) -> int:
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def fingerprints(docs: DataFrame, name: str = "fp", drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs with each whole text's fingerprint as a bigint."""
    return row_pass(docs, lambda texts: {name: [signed(fingerprint(x)) for x in texts]}, T.StructType().add(name, "long"), drop=drop)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


EDGES = T.StructType().add("a", "long").add("b", "long")


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x in batches:
        if x.num_rows:
            yield x.column(0).to_numpy(), x.column(1).to_numpy()


def _table(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key: links within each key's group; members of crowds as (fp, fp)."""
    keys, fps, crowd = np.empty(0, np.int64), np.empty(0, np.int64), None

    def links(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        cut = np.flatnonzero(np.diff(k)) + 1
        size = np.diff(np.concatenate([[0], cut, [len(k)]]))
        size = np.repeat(size, size)
        full = f[size > CROWD]
        if len(full):
            full = np.unique(full)
            yield _table(full, full)
        few = (size > 1) & (size <= CROWD)
        k, f, most = k[few], f[few], int(size[few].max(initial=1))
        found = []
        for step in range(1, most):
            same = k[step:] == k[:-step]
            x, y = f[:-step][same], f[step:][same]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS
            near &= x != y
            found.append(np.stack([np.minimum(x[near], y[near]), np.maximum(x[near], y[near])]))
        if found and (e := np.concatenate(found, axis=1)).shape[1]:
            e = np.unique(e, axis=1)
            yield _table(e[0], e[1])

    for k, f in _batches(batches):
        if crowd is not None:  # the group that was a crowd already goes on
            n = int(np.searchsorted(k, crowd, "right"))
            if n:
                yield _table(u := np.unique(f[:n]), u)
                k, f = k[n:], f[n:]
            if not len(k):
                continue
            crowd = None
        keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
        open_ = int(np.searchsorted(keys, keys[-1], "left"))
        yield from links(keys[:open_], fps[:open_])
        keys, fps = keys[open_:], fps[open_:]
        if len(keys) > CROWD:
            crowd = keys[0]
            yield from links(keys, fps)
            keys, fps = keys[:0], fps[:0]
    yield from links(keys, fps)


def _hubs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (variant, fp) sorted by variant, then odd fingerprints first: each group's star around its first member."""
    variant, hub, linked = None, None, False
    for v, f in _batches(batches):
        cut = np.flatnonzero(np.diff(v)) + 1
        first = np.concatenate([[0], cut])
        head = np.repeat(f[first], np.diff(np.concatenate([first, [len(v)]])))
        if v[0] == variant:
            head[: cut[0] if len(cut) else len(v)] = hub
        # an odd variant's members are all within 1 bit of it; an even one's even members need an odd one in the group
        odd = lambda x: (np.bitwise_count(x.view(np.uint64)) & 1).astype(bool)
        good = (odd(v) | odd(head)) & (head != f)
        variant, hub = v[-1], head[-1]
        if good.any():
            e = np.unique(np.stack([np.minimum(head[good], f[good]), np.maximum(head[good], f[good])]), axis=1)
            yield _table(e[0], e[1])


def _keyed(fps: DataFrame, key: Column, *order: str) -> DataFrame:
    k = fps.select(key.alias("key"), "fp")
    return k.repartition(int(k.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", *order)


def links(spark: SparkSession, fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that join exactly those reachable through steps of at most RADIUS bits.

    Outside one of three blocks, two fingerprints at most 3 bits apart differ in at most 2 of the other 42 or 43 bits.
    So each emits, for each block left out, the rest and all its variants within half of 2, 1 bit: 131 keys in all. The
    pair meets in the middle at a common key. Groups of up to CROWD members are compared pair by pair, the distance of
    colliding pairs is verified. Members of larger groups go on to whole balls, whose number of rows stays in proportion to
    theirs: an odd fingerprint emits its variants within 1 bit, an even one itself, its variants within 1 bit, and those of 2
    bits in the same half (of 3 differing bits, 2 are in the same half). All who meet at an odd variant are
    within 2 bits of each other; all who meet at an even variant with an odd one among them within 3 bits of that; so
    each such group is a star, without pairs, and no link's ends are left apart.
    """
    flips = [(~(((1 << b) - 1) ^ ((1 << a) - 1)) & (2**64 - 1), f) for a, b in BLOCKS for f in [0, *(1 << k for k in range(64) if not a <= k < b)]]
    keys = F.array(*(F.struct(F.lit(signed(m)).alias("mask"), F.lit(signed(f)).alias("flip")) for m, f in flips))
    near = fps.select("fp", F.explode(keys).alias("v"))
    found = written(spark, _keyed(near, F.col("fp").bitwiseAND(F.col("v.mask")).bitwiseXOR(F.col("v.flip"))).mapInArrow(_pairs, EDGES).distinct(), "pairs")
    crowd = found.where("a = b").select(F.col("a").alias("fp"))
    one = [signed(1 << k) for k in range(64)]
    two = [signed(1 << i | 1 << j) for h in (0, 32) for i, j in itertools.combinations(range(h, h + 32), 2)]
    lits = lambda xs: F.array(*(F.lit(x) for x in xs))
    odd = F.bit_count("fp") % 2
    balls = crowd.select("fp", odd.alias("odd"), F.explode(F.when(odd == 1, lits(one)).otherwise(lits([0, *one, *two]))).alias("flip"))
    balls = balls.select("odd", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stars = balls.repartition(n, "key").sortWithinPartitions("key", F.col("odd").desc(), "fp").select("key", "fp").mapInArrow(_hubs, EDGES)
    return found.where("a <> b").union(stars)


def linked(spark: SparkSession, docs: DataFrame, name: str = "component_id", drop: tuple[str, ...] = ("text",), fp: str = "fp") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): docs with their fingerprint `fp`, as a table; and (fp, `name`): the smallest doc_id of its class.

    Null texts have no words and so fingerprint 0, which links like any other; rows with the same id or text each keep
    their row; null ids belong to classes but never name one, unless it has no other.
    """
    rows = written(spark, fingerprints(docs, fp, drop), "fps")
    ids = written(spark, rows.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(spark, links(spark, ids.select("fp")))
    of = written(spark, ids.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    named = written(spark, of.groupBy("root").agg(F.min("least").alias(name)), "named")  # so that a large class's join can be split
    return rows, of.join(named.hint("merge"), "root").select("fp", name)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; see `linked`."""
    rows, classes = linked(spark, docs.select("doc_id", "text"))
    c = classes.select(F.col("fp").alias("of"), "component_id").hint("merge")
    return rows.join(c, F.col("fp") == F.col("of")).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that with the smallest doc_id (null last; among rows with that id, the first in its table)."""
    fp, row, key, cls = (free(docs, x) for x in ("__fp", "__row", "__key", "__class"))
    rows, classes = linked(spark, docs.withColumn(row, F.monotonically_increasing_id()), "component_id", (), fp)
    c = classes.select(F.col("fp").alias(key), F.col("component_id").alias(cls)).hint("merge")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    first = rows.select(fp, "doc_id", row).join(c, F.col(fp) == F.col(key)).groupBy(cls).agg(F.min(rank).alias("first"))
    first = written(spark, first.select(F.col("first.row").alias(key)), "kept")
    return rows.join(first.hint("merge"), F.col(row) == F.col(key), "left_semi").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, load(spark, sf_dir, "documents"))
