"""Graphs as flat arrays of edges: numbers for them, and measures for which each task gets the whole graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgraph.runtime import written

EDGES = 100_000_000  # what each task may get
ROOMY = 1 << 22  # words or numbers that a step gathers at once


def numbers(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of `wanted` in the sorted ids."""
    at = np.searchsorted(ids, wanted)
    if len(wanted) and (at.max() == len(ids) or (ids[at] != wanted).any()):
        raise KeyError("an edge or a root names a vertex that is not there")
    return at


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after the other."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive items whose sizes add up to at most `most`, or single items."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def spread(spark: SparkSession, edges: DataFrame, vertices: DataFrame, tasks: int, fn: Callable, schema: str) -> DataFrame:
    """The columns that fn(ids, starts, ends, to, asked, task, tasks) yields in each of so many tasks, each of which gets the
    whole graph: the out-edges of the vertex with the id ids[v], in order of ids, are to[starts[v]:ends[v]]. Of `vertices`
    (id, asked) `asked` is handed on; edges (src, dst) may name others, which are not asked."""
    none = F.lit(None).cast("long")
    rows = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(False).alias("asked"))
    rows = rows.union(edges.select("dst").distinct().select("dst", none, F.lit(False))).union(vertices.select("id", none, "asked"))
    lists = written(spark, rows.groupBy("id").agg(F.collect_list("to").alias("to"), F.max("asked").alias("asked")), "lists")
    rows = lists.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("task"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, to, asked, task = [], [], [], [], None
        for b in batches:
            if b.num_rows:
                ids.append(b.column("id").to_numpy())
                lengths.append(b.column("to").value_lengths().to_numpy())
                to.append(b.column("to").flatten().to_numpy())
                asked.append(b.column("asked").to_numpy(zero_copy_only=False))
                task = b.column("task")[0].as_py()
        if task is None:
            return
        all_, length = np.concatenate(ids), np.concatenate(lengths).astype(np.int64)
        order = np.argsort(all_)
        all_, ends = all_[order], np.cumsum(length)
        for i in range(len(to)):
            to[i] = numbers(all_, to[i]).astype(np.int32)
        for columns in fn(all_, (ends - length)[order], ends[order], np.concatenate(to), np.concatenate(asked)[order], task, tasks):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows.mapInArrow(run, schema)


def reversed_(starts: np.ndarray, ends: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and edges of the graph with all edges turned round."""
    degree = np.zeros(len(starts), np.int64)
    for at in range(0, len(to), ROOMY):
        degree += np.bincount(to[at : at + ROOMY], minlength=len(starts))
    last = np.cumsum(degree)
    back, free = np.empty(len(to), np.int32), last - degree
    for some in pieces(ends - starts, ROOMY):
        t = to[ranges(starts[some], ends[some])]
        order = np.argsort(t, kind="stable")
        t, n = np.unique(t, return_counts=True)
        back[ranges(free[t], free[t] + n)] = np.repeat(np.arange(len(starts), dtype=np.int32)[some], (ends - starts)[some])[order]
        free[t] += n
    return last - degree, last, back


def distances(ids, starts, ends, to, asked, task, tasks) -> Iterator[list[np.ndarray]]:
    """(id, eccentricity, total, reached) of every `tasks`-th block of the asked vertices, of edges without parallels: searches by layers from all
    vertices of a block at once, with a bit for each. A round looks at the successors of what the last one found, and of
    these only at vertices that some search has not found yet."""
    roots, n = np.flatnonzero(asked), len(ids)
    words = int(max(1, min(16, -(-len(roots) // (128 * tasks)), (8 << 20) // max(n, 1))))
    back_starts, back_ends, back = reversed_(starts, ends, to)
    size, front, seen = 64 * words, np.zeros((n, words), np.uint64), np.empty((n, words), np.uint64)
    for at in range(task * size, len(roots), tasks * size):
        own = roots[at : at + size]
        far, total, reached = (np.zeros(size, np.int64) for _ in range(3))
        bit = np.arange(len(own))
        front[own, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        full = np.bitwise_or.reduce(front[own], axis=0)
        seen[:] = front
        done = (seen == full).all(1)
        active, depth = own, 0
        while len(active):
            depth += 1
            next_ = np.zeros(n, bool)
            for some in pieces(ends[active] - starts[active], ROOMY):
                next_[to[ranges(starts[active[some]], ends[active[some]])]] = True
            next_ = np.flatnonzero(next_ & ~done)
            found, bits = [], []
            for some in pieces(back_ends[next_] - back_starts[next_], ROOMY // words):
                v = next_[some]
                k = back_ends[v] - back_starts[v]
                new = np.bitwise_or.reduceat(front[back[ranges(back_starts[v], back_ends[v])]], np.cumsum(k) - k, axis=0) & ~seen[v]
                some = new.any(1)
                found.append(v[some])
                bits.append(new[some])
            front[active] = 0
            active = np.concatenate(found) if found else next_
            if not len(active):
                break
            new = np.concatenate(bits)
            front[active] = new
            seen[active] |= new
            done[active] = (seen[active] == full).all(1)
            count = np.zeros(size, np.int64)
            for i in range(0, len(new), 255):  # sums of single bytes
                count += np.unpackbits(new[i : i + 255].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
            far[count > 0] = depth
            total += depth * count
            reached += count
        k = len(own)
        yield [ids[own], far[:k], total[:k], reached[:k]]


def inside(ids, starts, ends, to, asked, task, tasks) -> Iterator[list[np.ndarray]]:
    """(id, neighbours, inside) of every `tasks`-th asked vertex: its successors other than itself, and the edges from one
    of these to another, parallel ones each."""
    mark = np.zeros(len(ids), np.int64)
    own = np.flatnonzero(asked)[task::tasks]
    for at in range(0, len(own), 65_536):
        rows = own[at : at + 65_536]
        near, found = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for i, v in enumerate(rows):
            a = np.unique(to[starts[v] : ends[v]])
            a = a[a != v]
            mark[a] = 1
            near[i] = len(a)
            if len(a) > 1:
                for some in pieces(ends[a] - starts[a], ROOMY):
                    found[i] += mark[to[ranges(starts[a[some]], ends[a[some]])]].sum()
            mark[a] = 0
        yield [ids[rows], near, found]
