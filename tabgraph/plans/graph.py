"""Property graphs: a table of vertices (id, ...) and one of edges (src, dst, ...), with generators and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgraph.runtime import Grown, written

from .flat import EDGES, distances, inside, spread


class Graph:
    """Ids stay what they are: removing a vertex removes its edges and renumbers nothing. Parallel edges and loops are
    kept. `undirected` graphs store an edge once; `both_ways` is what traversals use."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, undirected: bool = False):
        self.vertices, self.edges, self.undirected = vertices, edges, undirected

    @classmethod
    def from_edges(cls, edges: DataFrame, undirected: bool = False) -> Graph:
        v = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        return cls(v, edges, undirected)

    def _with(self, edges: DataFrame) -> Graph:
        return Graph(self.vertices, edges, self.undirected)

    def both_ways(self) -> DataFrame:
        if not self.undirected:
            return self.edges
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        back = self.edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
        return self.edges.select("src", "dst", *rest).union(back)

    # changes

    def add_vertices(self, more: DataFrame) -> Graph:
        return Graph(self.vertices.unionByName(more, allowMissingColumns=True), self.edges, self.undirected)

    def add_edges(self, more: DataFrame) -> Graph:
        return self._with(self.edges.unionByName(more, allowMissingColumns=True))

    def remove_edges(self, predicate: Column) -> Graph:
        return self._with(self.edges.where(~F.coalesce(predicate, F.lit(False))))

    def remove_edge(self, u: int, v: int) -> Graph:
        """All parallels of (u, v), in an undirected graph whichever end is stored first."""
        own = (F.col("src") == u) & (F.col("dst") == v)
        return self.remove_edges(own | (F.col("src") == v) & (F.col("dst") == u) if self.undirected else own)

    def clear(self, vertex: int) -> Graph:
        """Without its out-edges (in an undirected graph, without its edges)."""
        own = F.col("src") == vertex
        return self.remove_edges(own | (F.col("dst") == vertex) if self.undirected else own)

    def remove(self, vertex: int) -> Graph:
        g = self.remove_edges((F.col("src") == vertex) | (F.col("dst") == vertex))
        return Graph(self.vertices.where(F.col("id") != vertex), g.edges, self.undirected)

    def filter_edges(self, predicate: Column) -> Graph:
        return self._with(self.edges.where(predicate))

    def without_loops(self) -> Graph:
        return self.filter_edges(F.col("src") != F.col("dst"))

    def unique_undirected(self) -> Graph:
        return self.filter_edges(F.col("src") <= F.col("dst"))

    def transposed(self) -> Graph:
        return self._with(self.edges.select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in self.edges.columns)))

    def mapped(self, mapping: DataFrame) -> Graph:
        """A copy under other ids: mapping (id, new)."""
        m = lambda c: mapping.select(F.col("id").alias(c), F.col("new").alias(f"__{c}"))
        v = self.vertices.join(m("id"), "id").withColumn("id", F.col("__id")).drop("__id")
        e = self.edges.join(m("src"), "src").join(m("dst"), "dst").withColumn("src", F.col("__src")).withColumn("dst", F.col("__dst")).drop("__src", "__dst")
        return Graph(v.select(*self.vertices.columns), e.select(*self.edges.columns), self.undirected)

    def with_property(self, values: DataFrame, name: str, default: object = None) -> Graph:
        """A vertex property from a table (id, name), with a default for the others."""
        v = self.vertices.drop(name).join(values.select("id", name), "id", "left")
        return Graph(v.withColumn(name, F.coalesce(name, F.lit(default))) if default is not None else v, self.edges, self.undirected)

    # measures

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree, degree) of every vertex; a loop counts in both."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        counts = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return self.vertices.select("id").join(counts, "id", "left").select("id", zero(F.col("o")).alias("out_degree"), zero(F.col("i")).alias("in_degree"), (zero(F.col("o")) + zero(F.col("i"))).alias("degree"))

    def distribution(self, kind: str = "degree", dense: bool = False) -> DataFrame:
        """(degree, frequency, share); dense: with the degrees up to the largest that no vertex has."""
        d = self.degrees().groupBy(F.col(kind).alias("degree")).agg(F.count(F.lit(1)).alias("frequency"))
        if dense:
            all_ = d.agg(F.max("degree").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("degree"))
            d = all_.join(d, "degree", "left").select("degree", F.coalesce("frequency", F.lit(0)).alias("frequency"))
        total = F.broadcast(d.agg(F.sum("frequency").alias("t")))  # one row
        return d.crossJoin(total).select("degree", "frequency", (F.col("frequency") / F.col("t")).alias("share"))

    def degree_summary(self, kind: str = "degree") -> DataFrame:
        """One row: mode (the most frequent degree, the smallest of equals), maximum and average; null without vertices."""
        d = self.degrees().groupBy(F.col(kind).alias("degree")).agg(F.count(F.lit(1)).alias("n"))
        return d.agg(F.min_by("degree", F.struct(-F.col("n"), "degree")).alias("mode"), F.max("degree").alias("maximum"), (F.sum(F.col("degree") * F.col("n")) / F.sum("n")).alias("average"))

    def by_frequency(self, kind: str = "degree") -> DataFrame:
        """The distribution, the most frequent degree first, of equals the smaller."""
        return self.distribution(kind).orderBy(F.col("frequency").desc(), "degree")

    def has_parallel_edges(self) -> DataFrame:
        e = self.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")) if self.undirected else self.edges
        return e.groupBy("src", "dst").count().agg(F.coalesce(F.max(F.col("count") > 1), F.lit(False)).alias("found"))

    def has_loops(self) -> DataFrame:
        return self.edges.agg(F.coalesce(F.max(F.col("src") == F.col("dst")), F.lit(False)).alias("found"))

    def neighbourhoods(self, directed: bool = False) -> DataFrame:
        """(id, nb), distinct and without the vertex itself: out-neighbours, or with `directed` those of both directions."""
        e = self.both_ways().select(F.col("src").alias("id"), F.col("dst").alias("nb"))
        if directed:
            e = e.union(self.edges.select(F.col("dst").alias("id"), F.col("src").alias("nb")))
        return e.where("id <> nb").distinct()

    def clustering(self, directed: bool = False, most: int = EDGES) -> DataFrame:
        """(id, neighbours, inside, coefficient): edges among the neighbours over k (k - 1), 0 for k below 2. Up to `most` edges
        each task gets them all and counts for its vertices; beyond, and with `directed`, wedges are formed at an edge's ends
        only: each edge meets the neighbourhoods that hold its source, then its target."""
        spark = self.vertices.sparkSession
        if not directed and (e := self.both_ways().where("src <> dst").select("src", "dst")).count() <= most:
            tasks = spark.sparkContext.defaultParallelism
            got = spread(spark, e, self.vertices.select("id", F.lit(True).alias("asked")), tasks, inside, "id long, neighbours long, inside long")
            return got.withColumn("coefficient", F.when(F.col("neighbours") > 1, F.col("inside") / (F.col("neighbours") * (F.col("neighbours") - 1))).otherwise(0.0))
        n = self.neighbourhoods(directed)
        e = self.both_ways().where("src <> dst").select("src", "dst")
        half = e.join(n.select(F.col("nb").alias("src"), "id"), "src")
        among = half.join(n.select("id", F.col("nb").alias("dst")), ["id", "dst"]).groupBy("id").agg(F.count(F.lit(1)).alias("inside"))
        k = n.groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"))
        got = self.vertices.select("id").join(k, "id", "left").join(among, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("neighbours", "inside")))
        return got.withColumn("coefficient", F.when(F.col("neighbours") > 1, F.col("inside") / (F.col("neighbours") * (F.col("neighbours") - 1))).otherwise(0.0))

    def depths(self, spark: SparkSession, roots: DataFrame, rounds: int = 10_000) -> DataFrame:
        """(root, id, depth) for all that each root reaches, a row for each pair: breadth-first rounds keyed by (root, id), each
        with one join of the last layer with the edges and one with all pairs seen. Ask for as many roots as rows can be held."""
        e = written(spark, self.both_ways().select("src", "dst").distinct(), "adjacency")
        seen = Grown(spark, "depths")
        front = seen.add(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")))
        for depth in range(1, rounds):
            step = front.join(e, front["id"] == e["src"]).select("root", F.col("dst").alias("id")).distinct()
            step = step.join(seen.all().select("root", "id"), ["root", "id"], "left_anti")
            front = seen.add(step.withColumn("depth", F.lit(depth)))
            if not front.limit(1).count():
                break
        return seen.all()

    def path_lengths(self, spark: SparkSession, roots: DataFrame, most: int = EDGES) -> DataFrame:
        """(id, eccentricity, total, reached, average) of each root; one that reaches nothing has average NaN. Up to `most`
        different edges each task gets them all and searches from its roots, so no row is made for a pair."""
        e = written(spark, self.both_ways().select("src", "dst").distinct(), "adjacency")
        if e.count() <= most:
            n = roots.count()
            tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n // 64)))
            asked = self.vertices.select("id", F.lit(False).alias("asked")).union(roots.select("id", F.lit(True)))
            got = spread(spark, e, asked, tasks, distances, "id long, eccentricity long, total long, reached long")
        else:
            got = self.depths(spark, roots).groupBy(F.col("root").alias("id")).agg(F.max("depth").cast("long").alias("eccentricity"), F.sum("depth").cast("long").alias("total"), (F.count(F.lit(1)) - 1).alias("reached"))
        return got.withColumn("average", F.when(F.col("reached") > 0, F.col("total") / F.col("reached")).otherwise(F.lit(float("nan"))))

    def distance_metrics(self, spark: SparkSession) -> DataFrame:
        """One row: average_path_length, diameter, radius and the numbers of peripheral and central vertices. Vertices that
        reach a quarter of all (rounded down) or fewer are left out, unless it is the first."""
        p = written(spark, self.path_lengths(spark, self.vertices), "paths")
        n, first = self.vertices.agg(F.count(F.lit(1)), F.min("id")).first()
        p = p.where((F.col("reached") > n // 4) | (F.col("id") == first))
        ends = p.agg(F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"), F.sum("total").alias("t"), F.sum("reached").alias("r"))
        both = p.crossJoin(F.broadcast(ends))  # one row
        return both.agg((F.first("t") / F.first("r")).alias("average_path_length"), F.first("diameter").alias("diameter"), F.first("radius").alias("radius"), F.count_if(F.col("eccentricity") == F.col("diameter")).alias("peripheral"), F.count_if(F.col("eccentricity") == F.col("radius")).alias("central"), F.min(F.when(F.col("eccentricity") == F.col("radius"), F.col("id"))).alias("central_vertex"), F.min(F.when(F.col("eccentricity") == F.col("diameter"), F.col("id"))).alias("peripheral_vertex"))


# generators


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id")


def _graph(spark: SparkSession, n: int, edges: DataFrame, undirected: bool = False) -> Graph:
    return Graph(_ids(spark, n), edges.select(F.col("src").cast("long"), F.col("dst").cast("long")), undirected)


def star(spark: SparkSession, n: int, undirected: bool = False) -> Graph:
    """Every vertex points to 0; directed, 0 itself too."""
    return _graph(spark, n, spark.range(1 if undirected else 0, n).select(F.col("id").alias("src"), F.lit(0).alias("dst")), undirected)


def complete(spark: SparkSession, n: int, loops: bool = True) -> Graph:
    e = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"))
    return _graph(spark, n, e if loops else e.where("src <> dst"))


def circle(spark: SparkSession, n: int, k: int) -> Graph:
    """Each vertex points to the next k."""
    return _graph(spark, n, spark.range(n * k).select(F.floor(F.col("id") / k).alias("src"), ((F.floor(F.col("id") / k) + F.col("id") % k + 1) % n).alias("dst")))


def lollipop(spark: SparkSession, m: int, n: int) -> Graph:
    """A complete graph of m without loops, joined at its last vertex with a path of n, edges both ways."""
    head = spark.range(m * m).select(F.floor(F.col("id") / m).alias("src"), (F.col("id") % m).alias("dst")).where("src <> dst")
    tail = spark.range(m - 1, m + n - 1).select(F.explode(F.array(F.struct(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), F.struct((F.col("id") + 1).alias("src"), F.col("id").alias("dst")))).alias("e")).select("e.*")
    return _graph(spark, m + n, head.union(tail))


STEPS4 = ((0, 1), (1, 0), (0, -1), (-1, 0))
STEPS8 = STEPS4 + ((1, 1), (1, -1), (-1, -1), (-1, 1))


def grid(spark: SparkSession, width: int, height: int, steps: tuple = STEPS4, keep: Column | None = None) -> DataFrame:
    """Edges (sx, sy, dx, dy) of a bounded grid with 4 (Manhattan) or 8 neighbours; `keep` filters them further."""
    p = spark.range(width * height).select((F.col("id") % width).alias("sx"), F.floor(F.col("id") / width).cast("long").alias("sy"))
    e = p.select("sx", "sy", F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps))).alias("s"))
    e = e.select("sx", "sy", (F.col("sx") + F.col("s.x")).alias("dx"), (F.col("sy") + F.col("s.y")).alias("dy")).where((F.col("dx") >= 0) & (F.col("dx") < width) & (F.col("dy") >= 0) & (F.col("dy") < height))
    return e if keep is None else e.where(keep)


def grid_graph(spark: SparkSession, width: int, height: int, steps: tuple = STEPS4) -> Graph:
    e = grid(spark, width, height, steps)
    return _graph(spark, width * height, e.select((F.col("sy") * width + F.col("sx")).alias("src"), (F.col("dy") * width + F.col("dx")).alias("dst")))


def grid_ball(spark: SparkSession, x: int, y: int, radius: int, steps: tuple = STEPS4) -> DataFrame:
    """Of the unbounded grid, the points (x, y, depth) within `radius` steps of one."""
    side = 2 * radius + 1
    p = spark.range(side * side).select((F.col("id") % side - radius).alias("a"), (F.floor(F.col("id") / side) - radius).alias("b"))
    depth = F.abs("a") + F.abs("b") if len(steps) == 4 else F.greatest(F.abs("a"), F.abs("b"))
    return p.withColumn("depth", depth).where(F.col("depth") <= radius).select((F.col("a") + x).alias("x"), (F.col("b") + y).alias("y"), "depth")
