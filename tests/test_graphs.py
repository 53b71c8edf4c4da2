import math

import pytest
from pyspark.sql import functions as F

from tabgraph import errors
from tabgraph.plans import graph as G
from tabgraph.plans import knn, ordering
from tabgraph.plans import supersteps as P


def graph(spark, n, edges, undirected=False):
    e = spark.createDataFrame([(i, a, b, float(w[0]) if w else 1.0) for i, (a, b, *w) in enumerate(edges)], "eid long, src long, dst long, w double")
    return G.Graph(spark.range(n).select("id"), e, undirected)


@pytest.fixture(scope="module")
def dist7(spark):
    return graph(spark, 7, [(0, 1), (0, 3, 10), (1, 2), (2, 3), (3, 4, 5), (3, 5), (5, 0)])


def by_id(df, *cols):
    return [tuple(r)[0] if len(cols) == 1 else tuple(r) for r in df.orderBy("id").select(*cols).collect()]


INF = float("inf")


def test_shortest_paths_and_their_steps(spark, dist7):
    r = P.shortest_paths(spark, dist7, 0, "w")
    assert by_id(r.state, "distance") == [0, 1, 2, 3, 8, 4, INF] and r.steps == 6
    r3 = P.shortest_paths(spark, dist7, 0, "w", most=3)
    assert by_id(r3.state, "distance") == [0, 1, 2, 10, 15, 11, INF] and r3.steps == 3
    assert P.shortest_paths(spark, dist7, 0, "w", stop=3).steps == 4
    assert P.path_to(r.state, 0, 4) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 8)]
    assert P.path_to(r.state, 0, 6) == [] and P.path_to(r.state, 0, 0) == [(0, 0)]


def test_closure_and_search(spark, dist7):
    g = graph(spark, 5, [(0, 1), (0, 3), (1, 2), (3, 2)])
    r = P.closure(spark, g, [0])
    assert by_id(r.state, "reachable") == [True] * 4 + [False] and r.steps == 3
    r = P.reached(spark, dist7, 0)
    assert by_id(r.state, "distance") == [0] * 6 + [INF] and r.steps == 4
    tree = graph(spark, 6, [(0, 1, 2), (1, 2, 3), (1, 3, 4), (3, 4, 1), (0, 3, 10), (0, 4, 3)])
    assert by_id(P.shortest_paths(spark, tree, 0, "w").state, "distance", "pred") == [(0, 0), (2, 0), (5, 1), (6, 1), (3, 0), (INF, None)]
    assert by_id(P.breadth_first(spark, tree, [0]), "id", "depth", "pred") == [(0, 0, None), (1, 1, 0), (2, 2, 1), (3, 1, 0), (4, 1, 0)]
    with pytest.raises(ValueError):
        P.breadth_first(spark, tree, [])


def test_depth_first_orders(spark):
    tree = graph(spark, 5, [(0, 1), (1, 2), (1, 3), (3, 4)])
    assert [r.id for r in ordering.topological(tree).orderBy("place").collect()] == [0, 1, 3, 4, 2]
    assert by_id(ordering.topological_layers(spark, tree), "layer") == [0, 1, 2, 2, 3] == by_id(ordering.layers_any(spark, tree), "layer")
    cyclic = graph(spark, 5, [(0, 1), (1, 2), (1, 3), (3, 4), (4, 3)])
    with pytest.raises(Exception, match="cycle"):
        ordering.topological(cyclic).collect()
    with pytest.raises(errors.CycleDetected):
        ordering.topological_layers(spark, cyclic)
    with pytest.raises(Exception, match="cycle"):
        ordering.layers_any(spark, cyclic).collect()
    with pytest.raises(errors.TooLarge):
        ordering.topological(tree, bound=3)
    scc = graph(spark, 4, [(0, 1), (1, 2), (2, 3), (3, 1)])
    assert by_id(ordering.strong_components(scc), "component") == [1, 0, 0, 0]
    assert by_id(ordering.strong_labels(spark, scc), "label") == [0, 1, 1, 1]
    kinds = [r.kind for r in ordering.depth_first(tree).orderBy("step").collect()]
    assert kinds.count("tree") == 4 and kinds[-1] == "finish"


def test_label_propagation(spark):
    g = graph(spark, 3, [(0, 1, 0.5), (2, 1, 0.5), (1, 0, 0.1), (1, 2, 0.1)])
    seeds = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.0), (0, "c", -1.0), (2, "a", -1.0), (2, "b", 1.0), (2, "c", 0.0)], "id long, label string, score double")
    out = {r.label: r.score for r in P.label_propagation(spark, g, seeds, seeds.where("false"), 10).where("id = 1").collect()}
    assert out["a"] == pytest.approx(0, abs=0.01) and out["b"] == pytest.approx(0.25, abs=0.01) and out["c"] == pytest.approx(-0.25, abs=0.01)


def test_generators_and_measures(spark):
    lolly = G.lollipop(spark, 100, 50)
    assert lolly.edges.count() == 10_000
    assert {r.degree: r.frequency for r in lolly.distribution("out_degree").collect()} == {1: 1, 2: 49, 99: 99, 100: 1}
    assert G.circle(spark, 10, 4).clustering().agg(F.avg("coefficient")).first()[0] == pytest.approx(0.5)
    m = G.circle(spark, 10, 3).distance_metrics(spark).first()
    assert m.diameter == 3 and m.average_path_length == pytest.approx(2)
    assert G.complete(spark, 10, loops=False).distance_metrics(spark).first().average_path_length == 1
    grid = G.grid_graph(spark, 4, 4, G.STEPS8)
    m = grid.distance_metrics(spark).first()
    assert m.diameter == 3 and m.radius == 2 and grid.clustering().agg(F.avg("coefficient")).first()[0] == pytest.approx(0.657142857142857)
    assert G.star(spark, 5).has_loops().first()[0] and not G.star(spark, 5, True).has_loops().first()[0]
    assert G.grid_ball(spark, 2, 3, 2).count() == 13 and G.grid_ball(spark, 0, 0, 1, G.STEPS8).count() == 9
    assert G.Graph(spark.range(3), lolly.edges.limit(0)).path_lengths(spark, spark.range(1)).first().average != 0
    assert math.isnan(G.Graph(spark.range(3), lolly.edges.limit(0)).path_lengths(spark, spark.range(1)).first().average)


def test_changes(spark):
    g = graph(spark, 3, [(0, 1), (0, 1), (1, 2), (2, 2)])
    assert g.has_parallel_edges().first()[0] and g.remove_edge(0, 1).edges.count() == 2 and g.clear(0).edges.count() == 2
    assert g.remove(1).edges.count() == 1 and g.remove(1).vertices.count() == 2
    assert by_id(g.degrees(), "out_degree", "in_degree", "degree") == [(2, 0, 2), (1, 2, 3), (1, 2, 3)]
    u = graph(spark, 3, [(0, 1), (1, 0), (1, 2)], True)
    assert u.remove_edge(1, 0).edges.count() == 1 and g.degree_summary().first() == (3, 3, 8 / 3) and g.by_frequency().first().degree == 3
    assert ordering.strong_summary(spark, g).first() == (3, 1, False)
    moved = g.mapped(spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "id long, new long"))
    assert sorted(r.src for r in moved.edges.collect()) == [10, 10, 11, 12]
    assert by_id(g.with_property(spark.createDataFrame([(1, "x")], "id long, p string"), "p", "none").vertices, "p") == ["none", "x", "none"]


def test_nearest_neighbours(spark):
    pts = spark.createDataFrame([(6 * i + j, [2.0 * i, 2.0 * j]) for i in range(6) for j in range(6)], "id long, v array<double>")
    assert {r.dst for r in knn.exact(pts, 4, block=10).where("src = 14").collect()} == {8, 20, 13, 15}
    edges = knn.exact(pts, 8).select("src", "dst")
    q = spark.createDataFrame([(99, [1.0, 1.0])], "id long, v array<double>")
    assert {r.dst for r in knn.approximate(spark, pts, edges, q, 4).collect()} == {0, 1, 6, 7}
    made = knn.inserted(spark, pts, 4)
    assert made.where("src = dst").count() == 0 and made.count() > 100
