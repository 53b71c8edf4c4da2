"""Vertex programs in super-steps: each is one join of messages with a partial aggregation by receiver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgraph.runtime import Grown, ranked, written

from .graph import Graph


@dataclass
class Result:
    state: DataFrame
    steps: int


def deliver(state: DataFrame, edges: DataFrame, sending: Column, message: Column, merge: Column) -> DataFrame:
    """Inboxes (id, inbox): every vertex for which `sending` holds sends `message` (of its state's and the edge's columns)
    along its out-edges; `merge` aggregates the column `message` of each receiver."""
    sent = state.where(sending).join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), message.alias("message"))
    return sent.groupBy("id").agg(merge.alias("inbox"))


def run(spark: SparkSession, graph: Graph, state: DataFrame, sending: Column, message: Column, merge: Column, update: dict[str, Column], most: int | None = None, shared: dict[str, Column] | None = None) -> Result:
    """The general loop. `state` (id, ..., active) holds after step 0, which counts as the first; each delivery of at least one
    message is a step. `update` gives the new columns from the old ones and `inbox` (null without messages). `shared` names
    aggregates over all vertices' states: each step's updates see those of the step before as further columns."""
    edges = written(spark, graph.both_ways(), "edges")
    state, steps = written(spark, state, "state"), 1
    while most is None or steps < most:
        inbox = written(spark, deliver(state, edges, sending, message, merge), "inbox")
        if not inbox.limit(1).count():
            break
        joined = state.join(inbox, "id", "left")
        if shared:
            joined = joined.crossJoin(F.broadcast(state.agg(*(c.alias(k) for k, c in shared.items()))))  # one row
        state = written(spark, joined.select("id", *(update.get(c, F.col(c)).alias(c) for c in state.columns if c != "id")), "state")
        steps += 1
    return Result(state.drop("active"), steps)


def closure(spark: SparkSession, graph: Graph, seeds: list[int], most: int | None = None) -> Result:
    """(id, reachable) from the seeds, which are reachable themselves."""
    start = F.col("id").isin(seeds)
    state = graph.vertices.select("id", start.alias("reachable"), start.alias("active"))
    new = F.col("inbox").isNotNull() & ~F.col("reachable")
    return run(spark, graph, state, F.col("active"), F.lit(True), F.max("message"), {"reachable": F.col("reachable") | F.col("inbox").isNotNull(), "active": new}, most)


def reached(spark: SparkSession, graph: Graph, start: int) -> Result:
    """(id, distance, pred): 0 for what start reaches, else infinity; start precedes itself; the least sender of the first wave."""
    is_start = F.col("id") == start
    state = graph.vertices.select("id", F.when(is_start, 0.0).otherwise(float("inf")).alias("distance"), F.when(is_start, F.col("id")).alias("pred"), is_start.alias("active"))
    better = F.col("inbox").isNotNull() & (F.col("distance") > 0)
    return run(spark, graph, state, F.col("active"), F.col("id"), F.min("message"), {"distance": F.when(better, 0.0).otherwise(F.col("distance")), "pred": F.when(better, F.col("inbox")).otherwise(F.col("pred")), "active": better})


def shortest_paths(spark: SparkSession, graph: Graph, start: int, weight: str | None = None, stop: int | None = None, most: int | None = None) -> Result:
    """(id, distance, pred) by relaxation in waves; the smaller distance wins, among equals the smaller sender.

    With `stop`, a wave after the one in which that vertex got a distance sends only from vertices not beyond it; the run
    ends in the second wave in which it got one and nobody below it went on. `most` bounds the number of steps.
    """
    e = graph.both_ways().select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    e = written(spark, e, "edges")
    is_start = F.col("id") == start
    state = written(spark, graph.vertices.select("id", F.when(is_start, 0.0).otherwise(float("inf")).alias("distance"), F.when(is_start, F.col("id")).alias("pred"), is_start.alias("active")), "state")
    steps, end, ends = 1, None, 0
    while most is None or steps < most:
        inbox = written(spark, deliver(state, e, F.col("active"), F.struct((F.col("distance") + F.col("w")).alias("d"), F.col("id").alias("s")), F.min("message")), "inbox")
        if not inbox.limit(1).count():
            break
        better = F.coalesce(F.col("inbox.d") < F.col("distance"), F.lit(False))
        new = state.join(inbox, "id", "left").select("id", F.when(better, F.col("inbox.d")).otherwise(F.col("distance")).alias("distance"), F.when(better, F.col("inbox.s")).otherwise(F.col("pred")).alias("pred"), better.alias("acts"))
        within = F.col("acts") if end is None else F.col("acts") & (F.col("distance") <= end)
        state = written(spark, new.withColumn("active", within), "state")
        steps += 1
        if stop is not None:
            r = state.agg(F.max(F.when(F.col("acts") & (F.col("id") == stop), F.col("distance"))).alias("end"), F.count_if(F.col("active") & (F.col("id") != stop)).alias("below")).first()
            still = end is not None and r.below > 0
            end = r.end
            ends += end is not None and not still
            if ends == 2:
                break
        state = state.select("id", "distance", "pred", "active")
    return Result(state.select("id", "distance", "pred"), steps)


def breadth_first(spark: SparkSession, graph: Graph, starts: list[int], end: int | None = None) -> DataFrame:
    """(id, depth, pred) of what is reached: a vertex's predecessor is the earliest discovered one that points to it, the
    order of discovery being (depth, predecessor's place, edge's target); stops after the layer that holds `end`.

    Each round joins the last layer with the edges and, once, with all that was seen; layers are numbered densely.
    """
    if not starts:
        raise ValueError("no start vertex")
    e = written(spark, graph.both_ways().select("src", "dst").distinct(), "edges")
    seen, depth = Grown(spark, "layers"), 0
    layer = seen.add(spark.createDataFrame([(v, 0, None, i) for i, v in enumerate(dict.fromkeys(starts))], "id long, depth int, pred long, place long"))
    while True:
        depth += 1
        next_ = layer.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("place", F.col("id").alias("by"))).alias("m"))
        new = next_.join(seen.all().select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), F.col("m.by").alias("pred"), F.col("m.place").alias("from"))
        layer = seen.add(ranked(spark, new, [F.col("from"), F.col("id")], "place").select("id", "depth", "pred", "place"))
        if not layer.limit(1).count() or end is not None and layer.where(F.col("id") == end).limit(1).count():
            return seen.all().select("id", "depth", "pred")


def path_to(state: DataFrame, start: int, goal: int) -> list[tuple[int, float]]:
    """The vertices from start to goal with their distances; empty if goal was not reached. Pointers are doubled: in round k
    each vertex knows the one 2**k predecessors before it, and those on the path so far find as many again in one join, so
    a path of n vertices takes log2(n) rounds. The path itself, the result, is collected."""
    spark = state.sparkSession
    known = written(spark, state.where(F.col("distance") < float("inf")).select("id", "distance", F.col("pred").alias("jump")), "pointers")
    jump = known.select("id", F.when(F.col("id") != start, F.col("jump")).alias("jump"))
    path = written(spark, known.where(F.col("id") == goal).select("id", F.lit(0).cast("long").alias("back")), "path")
    for k in range(64):
        far = path.join(jump, "id").where("jump is not null").select(F.col("jump").alias("id"), (F.col("back") + 2**k).alias("back"))
        more = written(spark, path.union(far).groupBy("id").agg(F.min("back").alias("back")), "path")
        if more.where(F.col("id") == start).limit(1).count() or not path.limit(1).count():
            path = more
            break
        path = more
        jump = written(spark, jump.join(jump.select(F.col("id").alias("jump"), F.col("jump").alias("then")), "jump", "left").select("id", F.col("then").alias("jump")), "jump")
    return [(r.id, r.distance) for r in path.join(known, "id").orderBy(F.col("back").desc()).select("id", "distance").collect()]


def incoming_weights(graph: Graph, weight: str = "w") -> DataFrame:
    """(id, total): sum of each vertex's in-edges' weights, 0 without any."""
    s = graph.both_ways().groupBy(F.col("dst").alias("id")).agg(F.sum(weight).alias("total"))
    return graph.vertices.select("id").join(s, "id", "left").select("id", F.coalesce("total", F.lit(0.0)).alias("total"))


def label_propagation(spark: SparkSession, graph: Graph, seeds: DataFrame, priors: DataFrame, steps: int, m1: float = 1.0, m2: float = 0.01, m3: float = 0.01, weight: str = "w") -> DataFrame:
    """(id, label, score) after `steps` steps, of which the first only sends.

    seeds and priors are (id, label, score). In each step, for a vertex with neighbours' labels,
    (m1 seed + m2 sum of w * neighbour + m3 prior) / (m1 if it has this seed + m2 W + m3), W being its in-edges' weights;
    a vertex that gets nothing keeps its labels; a label in none of the three stays absent.
    """
    e = written(spark, graph.both_ways().select("src", "dst", F.col(weight).cast("double").alias("w")), "edges")
    w = written(spark, e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("total")), "weights")
    fixed = seeds.select("id", "label", F.col("score").alias("seed")).join(priors.select("id", "label", F.col("score").alias("prior")), ["id", "label"], "full")
    fixed = written(spark, fixed, "fixed")
    labels = written(spark, seeds.select("id", "label", F.col("score").cast("double").alias("score")), "labels")
    for _ in range(steps - 1):
        sent = labels.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id"), "label").agg(F.sum(F.col("w") * F.col("score")).alias("got"))
        sent = written(spark, sent, "sent")
        heard = sent.select("id").distinct()
        parts = sent.join(fixed.join(heard, "id", "left_semi"), ["id", "label"], "full").join(w, "id")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        top = m1 * zero(F.col("seed")) + m2 * zero(F.col("got")) + m3 * zero(F.col("prior"))
        new = parts.select("id", "label", (top / (F.when(F.col("seed").isNotNull(), m1).otherwise(0.0) + m2 * F.col("total") + m3)).alias("score"))
        labels = written(spark, new.union(labels.join(heard, "id", "left_anti").select("id", "label", "score")), "labels")
    return labels
