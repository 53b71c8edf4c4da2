"""Graphs beyond the former bound of 1,000,000 vertices and edges, walked whole."""

import pytest
from pyspark.sql import functions as F

from tabgraph.plans import graph, ordering


@pytest.fixture(scope="module")
def large(spark):
    n = 1_050_000
    e = spark.range(n).select(F.col("id").alias("eid"), (F.col("id") % 1000).alias("src"), ((F.col("id") * 7 + 1) % 1000).alias("dst"), F.lit(1.0).alias("w"))
    return graph.Graph(spark.range(1000).select("id"), e), n


def kinds(df):
    return {r.kind: r["count"] for r in df.groupBy("kind").count().collect()}


def test_breadth_first_events_of_a_large_graph(large):
    g, n = large
    got = kinds(ordering.search_events(g, [0]))
    reached = got["finish"]
    assert got["examine_edge"] == reached * n // 1000 and got["tree"] == reached - 1


def test_depth_first_events_of_a_large_graph(large):
    g, n = large
    got = kinds(ordering.depth_first(g))
    assert got["examine"] == n and got["finish"] == 1000 and got["tree"] + got["start"] == 1000


def test_distance_search_events_of_a_large_graph(large):
    g, n = large
    got = kinds(ordering.search_events(g, [0], weight="w"))
    reached = got["finish"]
    assert got["examine_edge"] == reached * n // 1000 and got["tree"] == reached - 1


def test_path_lengths_make_no_row_a_pair(spark, monkeypatch):
    """Of 300 vertices, in chains with cycles, loops and parallels, in searches of several blocks; some roots, one outside."""
    import random

    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 280)] + [(rng.randrange(280), rng.randrange(280)) for _ in range(60)] + [(5, 5), (7, 8), (500, 3)]
    g = graph.Graph(spark.range(300).select("id"), spark.createDataFrame(pairs, "src long, dst long"))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    want = {}
    for root in [*range(0, 300, 3), 900]:
        far, layer = {root: 0}, [root]
        while layer:
            layer = list({t for v in layer for t in near.get(v, ()) if t not in far})
            far |= dict.fromkeys(layer, far[root] + 1 + max(far.values()))
        want[root] = (max(far.values()), sum(far.values()), len(far) - 1)
    monkeypatch.setattr(graph.Graph, "depths", lambda *a: pytest.fail("a row for each pair"))
    roots = spark.createDataFrame([(r,) for r in want], "id long")
    got = g.path_lengths(spark, roots).collect()
    assert {r.id: (r.eccentricity, r.total, r.reached) for r in got} == want and len(got) == len(want)


def test_layers_of_a_large_graph_take_no_rounds(spark, large, monkeypatch):
    g, n = large
    monkeypatch.setattr(ordering, "topological_layers", lambda *a: pytest.fail("a round for each layer"))
    got = ordering.layers_any(spark, g.filter_edges(F.col("dst") == F.col("src") + 1))
    assert got.count() == 1000
    e = g.edges.withColumn("dst", F.col("src") + 1 + F.col("eid") % 3)
    rising = ordering.layers_any(spark, graph.Graph(spark.range(1003).select("id"), e))
    assert {r.id: r.layer for r in rising.collect()}[999] <= 999 and rising.count() == 1003


def test_order_of_a_large_graph_takes_no_rounds(spark, large, monkeypatch):
    g, n = large
    monkeypatch.setattr(ordering, "topological_layers", lambda *a: pytest.fail("a round for each layer"))
    e = g.edges.withColumn("dst", F.col("src") + 1 + F.col("eid") % 3)
    got = {r.id: r.place for r in ordering.topological_any(spark, graph.Graph(spark.range(1003).select("id"), e)).collect()}
    assert sorted(got.values()) == list(range(1003)) and all(got[i] < got[i + 1] for i in range(1000) if i % 3 == 0)


def test_interleaving_streams_its_schedule(spark, capsys):
    """Uneven and empty producers against a plain replay; lengths stream through, they are not gathered in a frame."""
    import random

    from tabgraph.streaming.pipeline import Pipeline

    rng = random.Random(9)
    lengths = [rng.choice([0, 0, 1, 2, 5, 40]) for _ in range(300)]
    for cycle, workers in ((1, None), (3, 4), (4, None), (400, None)):
        total, live, waiting, want = workers or 2 * cycle, [], [], []
        todo = [[(k, i) for i in range(n)] for k, n in enumerate(lengths)]
        live, waiting, rest = todo[:cycle], todo[cycle:total], todo[total:]
        while live:
            one = live.pop(0)
            if one:
                want.append(one.pop(0))
                live.append(one)
                continue
            if rest:
                waiting.append(rest.pop(0))
            if waiting:
                live.append(waiting.pop(0))
        p = Pipeline.items(spark, lengths, "int").enumerated("k")
        made = F.transform(F.sequence(F.lit(1), F.col("value")), lambda i: F.col("k") * 100 + i - 1)
        out = p.interleave(F.when(F.col("value") > 0, made), cycle, workers)
        assert out.collect() == [100 * k + i for k, i in want]
    out.frame.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out


def test_clustering_forms_no_wedges(spark, monkeypatch):
    import random

    rng = random.Random(6)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(300)] + [(40, 40), (41, 3), (3, 3)]
    g = graph.Graph(spark.range(50).select("id"), spark.createDataFrame(pairs, "src long, dst long"))
    wedges = {tuple(r) for r in g.clustering(most=0).collect()}
    monkeypatch.setattr(graph.Graph, "neighbourhoods", lambda *a: pytest.fail("a row for each wedge"))
    got = g.clustering().collect()
    assert {tuple(r) for r in got} == wedges and len(got) == 50
    near = {v: {b for a, b in pairs if a == v != b} for v in range(50)}
    assert {r.id: r.inside for r in got} == {v: sum(a != b and a in near[v] and b in near[v] for a, b in pairs) for v in range(50)}


def test_exact_neighbours_keep_ties_and_points_pass_once_a_task(spark, capsys):
    from tabgraph.plans import knn

    points = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(140)]
    df = spark.createDataFrame(points, "id long, v array<double>").repartition(3)
    got = knn.exact(df, 4, "euclid", df.where("id % 3 = 0"), block=10)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    want = {(i, r + 1): j for i, v in points if i % 3 == 0 for r, (_, j) in enumerate(sorted((far(v, w), j) for j, w in points if j != i)[:4])}
    assert {(r.src, r["rank"]): r.dst for r in got.collect()} == want
    got.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out


def test_no_neighbour_graph_where_none_can_be_walked(spark, monkeypatch):
    from tabgraph.plans import knn

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id long, v array<double>")
    monkeypatch.setattr(knn, "written", lambda *a: pytest.fail("a graph of all points"))
    got = knn.walked(spark, df, df.where("id < 3"), 2, 5, "euclid", most=100).collect()
    assert sorted((r.src, r.dst) for r in got) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (2, 3)]
