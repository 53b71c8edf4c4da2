"""What depends on a depth-first order, exactly in one bounded task, and scalable forms with the same answers up to order."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgraph.errors import CycleDetected, TooLarge
from tabgraph.runtime import Grown, ranked, written

from .flat import numbers, pieces, ranges
from .graph import Graph

BOUND = 150_000_000  # vertices and edges together that a sequential algorithm takes, at 4 bytes an edge (12 with weights)
CHUNK = 65_536  # rows that a task hands on at once


class Flat:
    """A graph in flat arrays: ids[v] is the id of vertex v, its out-edges are to[first[v]:last[v]], in order of edges."""

    def __init__(self, ids: np.ndarray, degree: np.ndarray, to: np.ndarray, weight: np.ndarray | None):
        self.ids, self.count, self.targets = ids, len(ids), to
        self.ends = np.cumsum(degree)
        self.starts = self.ends - degree
        self.first, self.last, self.to = memoryview(self.starts), memoryview(self.ends), memoryview(to)  # plain numbers, one at a time
        self.weight = None if weight is None else memoryview(weight)

    def number(self, ids) -> np.ndarray:
        return numbers(self.ids, np.asarray(ids, np.int64))


def _flat(batches: Iterator[pa.RecordBatch], edges: int, weighted: bool) -> Flat:
    """Of batches (edge, id, to, w), the vertices before the edges and these sorted by source."""
    found, ids, degree, at = [], None, None, 0
    to, weight = np.empty(edges, np.int32), np.empty(edges) if weighted else None
    for b in batches:
        n = b.num_rows - (b.column(0).true_count or 0)
        if n:
            found.append(b.column(1).slice(0, n).to_numpy())
        if n == b.num_rows:
            continue
        if ids is None:
            ids = np.unique(np.concatenate(found))
            degree = np.zeros(len(ids), np.int64)
        source, k = np.unique(numbers(ids, b.column(1).slice(n).to_numpy()), return_counts=True)
        degree[source] += k
        end = at + b.num_rows - n
        to[at:end] = numbers(ids, b.column(2).slice(n).to_numpy())
        if weighted:
            weight[at:end] = b.column(3).slice(n).to_numpy()
        at = end
    if ids is None:
        ids = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        degree = np.zeros(len(ids), np.int64)
    return Flat(ids, degree, to[:at], weight)


def _single(graph: Graph, fn, schema: str, bound: int, weight: str | Column | None = None) -> DataFrame:
    """The columns that fn(flat graph) yields, chunk by chunk, in one task behind a check of the size. Spark sorts the edges,
    and neither they nor the results are ever Python objects as a whole."""
    v, e = graph.vertices.select("id"), graph.both_ways()
    edges = e.count()
    if v.count() + edges > bound:
        raise TooLarge(f"more than {bound} vertices and edges; use the scalable form")
    order = F.col("eid") if "eid" in e.columns else F.monotonically_increasing_id()
    weighted = weight is not None
    rows = v.select(F.lit(False).alias("edge"), F.col("id").cast("long"), F.lit(0).cast("long").alias("to"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("at"))
    own = F.lit(0.0) if not weighted else F.col(weight).cast("double") if isinstance(weight, str) else weight
    rows = rows.union(e.select(F.lit(True), F.col("src").cast("long"), F.col("dst").cast("long"), own, order.cast("long")))
    rows = rows.repartition(1).sortWithinPartitions("edge", "id", "at").select("edge", "id", "to", *(["w"] if weighted else []))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for columns in fn(_flat(batches, edges, weighted)):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return rows.mapInArrow(run, schema)


def _sliced(*columns: np.ndarray):
    for at in range(0, len(columns[0]), CHUNK):
        yield [c[at : at + CHUNK] for c in columns]


def _events(flat: Flat, events: Iterator[tuple]):
    """Columns (step, kind, vertex, target) of events (kind, vertex, target or -1), by chunks."""
    step = 0
    while chunk := list(islice(events, CHUNK)):
        kind, vertex, target = zip(*chunk)
        target = np.array(target)
        yield np.arange(step, step + len(chunk)), pa.array(kind, pa.string()), flat.ids[np.array(vertex)], pa.array(flat.ids[target], mask=target < 0)
        step += len(chunk)


def _walk(flat: Flat, roots: Iterable[int] | None = None):
    """Depth-first events (kind, vertex, target or -1) with an explicit stack."""
    colour, at, last, to = bytearray(flat.count), array("q", flat.first), flat.last, flat.to
    for root in range(flat.count) if roots is None else roots:
        if colour[root]:
            continue
        yield "start", root, -1
        colour[root] = 1
        yield "discover", root, -1
        stack = [root]
        while stack:
            v = stack[-1]
            for i in range(at[v], last[v]):
                t = to[i]
                yield "examine", v, t
                if not colour[t]:
                    yield "tree", v, t
                    colour[t] = 1
                    yield "discover", t, -1
                    at[v] = i + 1
                    stack.append(t)
                    break
                yield ("back" if colour[t] == 1 else "forward_or_cross"), v, t
            else:
                colour[v] = 2
                yield "finish", v, -1
                stack.pop()


def depth_first(graph: Graph, roots: list[int] | None = None, bound: int = BOUND) -> DataFrame:
    """(step, kind, vertex, target) of a traversal from the roots, or from all vertices in order of their ids."""

    def fn(flat):
        return _events(flat, _walk(flat, None if roots is None else flat.number(roots).tolist()))

    return _single(graph, fn, "step long, kind string, vertex long, target long", bound)


def _searched(flat: Flat, starts: list[int], end: int | None, nearest: bool):
    """Events (kind, vertex, target or -1) of a search by layers or, with `nearest`, by distance, until `end` is examined."""
    first, last, to, weight = flat.first, flat.last, flat.to, flat.weight
    colour, far, queue, n = bytearray(flat.count), array("d", bytes(8 * flat.count)), [], 0
    for s in dict.fromkeys(starts):
        yield "start", s, -1
        yield "discover", s, -1
        colour[s] = 1
        heapq.heappush(queue, (0.0, n, s))
        n += 1
    while queue:
        d, _, v = heapq.heappop(queue)
        if colour[v] == 2:  # a nearer way to it was found meanwhile
            continue
        yield "examine", v, -1
        if v == end:
            return
        for i in range(first[v], last[v]):
            t = to[i]
            yield "examine_edge", v, t
            new = d + (weight[i] if nearest else 1)
            if not colour[t]:
                yield "tree", v, t
                yield "discover", t, -1
                colour[t] = 1
            elif nearest and colour[t] == 1 and new < far[t]:
                yield "relaxed", v, t
            else:
                yield ("not_relaxed" if nearest else "gray_target" if colour[t] == 1 else "black_target"), v, t
                continue
            far[t] = new
            heapq.heappush(queue, (new, n, t))
            n += 1
        colour[v] = 2
        yield "finish", v, -1


def search_events(graph: Graph, starts: list[int], end: int | None = None, weight: str | None = None, bound: int = BOUND) -> DataFrame:
    """(step, kind, vertex, target): what a visitor of a breadth-first search sees, or with `weight` (not negative) of one by
    distance; it stops when it examines `end`. One bounded task: supersteps has the results themselves at any size."""
    if not starts:
        raise ValueError("no start vertex")

    nearest = weight is not None

    def fn(flat):
        stop = None if end is None else int(np.searchsorted(flat.ids, end)) if end in flat.ids else None
        return _events(flat, _searched(flat, flat.number(starts).tolist(), stop, nearest))

    return _single(graph, fn, "step long, kind string, vertex long, target long", bound, weight)


def topological(graph: Graph, bound: int = BOUND) -> DataFrame:
    """(place, id) in reverse order of finishing; a cycle is an error when the result is asked for."""

    def fn(flat):
        done = array("q")
        for kind, v, _ in _walk(flat):
            if kind == "back":
                raise CycleDetected("cycle")
            if kind == "finish":
                done.append(v)
        return _sliced(np.arange(len(done)), flat.ids[np.array(done, np.int64)[::-1]])

    return _single(graph, fn, "place long, id long", bound)


def topological_layers(spark: SparkSession, graph: Graph) -> DataFrame:
    """(id, layer): the longest path that ends there. Each round takes the vertices without in-edges from the rest."""
    left, edges, layers, k = graph.vertices.select("id"), written(spark, graph.both_ways().select("src", "dst").distinct(), "edges"), Grown(spark, "layers"), 0
    left = written(spark, left, "left")
    while left.limit(1).count():
        free = layers.add(left.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("layer", F.lit(k)))
        if not free.limit(1).count():
            raise CycleDetected("cycle")
        left = written(spark, left.join(free, "id", "left_anti"), "left")
        edges = written(spark, edges.join(free.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"), "edges")
        k += 1
    return layers.all() if k else graph.vertices.select("id", F.lit(0).alias("layer"))


def fits(graph: Graph, bound: int = BOUND) -> bool:
    return graph.vertices.count() + graph.both_ways().count() <= bound


def layers_any(spark: SparkSession, graph: Graph, bound: int = BOUND) -> DataFrame:
    """topological_layers(), in one task within the bound: its rounds, one a layer, are for what no task can hold."""
    if not fits(graph, bound):
        return topological_layers(spark, graph)

    def fn(flat):
        waits, layer = np.zeros(flat.count, np.int64), np.zeros(flat.count, np.int32)
        for at in range(0, len(flat.targets), 1 << 22):
            t, k = np.unique(flat.targets[at : at + (1 << 22)], return_counts=True)
            waits[t] += k
        free, done, k = np.flatnonzero(waits == 0), 0, 0
        while len(free):
            layer[free], done, k, freed = k, done + len(free), k + 1, []
            for some in pieces(flat.ends[free] - flat.starts[free], 1 << 22):
                t, n = np.unique(flat.targets[ranges(flat.starts[free[some]], flat.ends[free[some]])], return_counts=True)
                waits[t] -= n
                freed.append(t[waits[t] == 0])
            free = np.concatenate(freed)
        if done < flat.count:
            raise CycleDetected("cycle")
        return _sliced(flat.ids, layer)

    return _single(graph, fn, "id long, layer int", bound)


def topological_any(spark: SparkSession, graph: Graph, bound: int = BOUND) -> DataFrame:
    """(place, id) of topological() within the bound; beyond it all vertices by layer and id, which is as valid an order."""
    if fits(graph, bound):
        return topological(graph, bound)
    return ranked(spark, topological_layers(spark, graph), [F.col("layer"), F.col("id")], "place").select("place", "id")


def strong_components(graph: Graph, bound: int = BOUND) -> DataFrame:
    """(id, component) numbered as their roots finish in a depth-first traversal by ids."""

    def fn(flat):
        found, low, comp = array("q", bytes(8 * flat.count)), array("q", bytes(8 * flat.count)), np.full(flat.count, -1)
        number, at, stack, n = memoryview(comp), 0, [], 0
        for kind, v, t in _walk(flat):
            if kind == "discover":
                found[v] = low[v] = at
                at += 1
                stack.append(v)
            elif kind in ("back", "forward_or_cross") and number[t] < 0:
                low[v] = min(low[v], found[t])
            elif kind == "finish":
                for w in flat.to[flat.first[v] : flat.last[v]]:
                    if number[w] < 0:
                        low[v] = min(low[v], low[w])
                if low[v] == found[v]:
                    while True:
                        w = stack.pop()
                        number[w] = n
                        if w == v:
                            break
                    n += 1
        return _sliced(flat.ids, comp)

    return _single(graph, fn, "id long, component long", bound)


def strong_labels(spark: SparkSession, graph: Graph) -> DataFrame:
    """(id, label): the same components by their smallest id, at any size. Each round spreads the least id forward and,
    within what has the same one, back from its owner; who is met both ways forms that owner's component and leaves."""
    edges = written(spark, graph.both_ways().select("src", "dst").where("src <> dst").distinct(), "edges")
    left, done = written(spark, graph.vertices.select("id"), "left"), None
    while left.limit(1).count():
        colour = written(spark, left.withColumn("c", F.col("id")), "colour")
        while True:
            got = colour.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = written(spark, colour.join(got, "id", "left").select("id", F.least("c", "m").alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("changed")), "colour")
            colour = new.select("id", "c")
            if not new.where("changed").limit(1).count():
                break
        inner = edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        inner = written(spark, inner, "inner")
        member = written(spark, colour.where("id = c").select("id", "c"), "member")
        front = member
        while True:
            back = front.join(inner, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "c").distinct().join(member.select("id"), "id", "left_anti")
            front = written(spark, back, "front")
            if not front.limit(1).count():
                break
            member = written(spark, member.union(front), "member")
        named = member.select("id", F.col("c").alias("label"))
        done = named if done is None else done.union(named)
        left = written(spark, left.join(member, "id", "left_anti"), "left")
        edges = written(spark, inner.join(member.select(F.col("id").alias("src")), "src", "left_anti").join(member.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
    return done if done is not None else graph.vertices.select("id", F.col("id").alias("label"))


def strong_summary(spark: SparkSession, graph: Graph) -> DataFrame:
    """One row: the number of strong components, the size of the largest, and whether the graph is strongly connected (which
    one without vertices is)."""
    sizes = strong_labels(spark, graph).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), (F.count(F.lit(1)) <= 1).alias("strongly_connected"))


def strong_components_any(spark: SparkSession, graph: Graph, bound: int = BOUND) -> DataFrame:
    """(id, component) of strong_components() within the bound; beyond it the same components numbered from the last layer
    of the condensation to the first and by their smallest ids, so that edges lead to smaller numbers in both forms."""
    if fits(graph, bound):
        return strong_components(graph, bound)
    labels = written(spark, strong_labels(spark, graph), "labels")
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    between = graph.both_ways().select("src", "dst").join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    layers = topological_layers(spark, Graph(labels.select(F.col("label").alias("id")).distinct(), between))
    numbered = ranked(spark, layers, [F.col("layer").desc(), F.col("id")], "component").select(F.col("id").alias("label"), "component")
    return labels.join(numbered, "label").select("id", "component")
