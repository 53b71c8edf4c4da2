"""Registered queries over the whole of a small table, against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from tabgraph import catalogue
from tabgraph.plans import graph, knn, ordering


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    rng = random.Random(5)
    users = [rng.randrange(12) for _ in range(30)] + [100, 101, 102, 100, 200, 201, 202]
    rows = [(i, u, "abc"[u % 3]) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{d}/events.parquet")
    return d, [(i, users[i], users[i + 1]) for i in range(len(users) - 1)]


def rows(spark, name, d, *cols):
    return {r[0]: r[1] if len(cols) == 2 else r[1:] for r in catalogue.QUERIES[name](spark, d).select(*cols).collect()}


def distances(edges, start, weight):
    far = {start: 0}
    for _ in edges:
        for i, a, b in edges:
            if a in far and far[a] + weight(i) < far.get(b, float("inf")):
                far[b] = far[a] + weight(i)
    return far


def test_graph_queries_take(spark, events):
    d, edges = events
    ids = {v for _, a, b in edges for v in (a, b)}
    start = min(a for _, a, _ in edges)
    hops, far = distances(edges, start, lambda i: 1), distances(edges, start, lambda i: i % 5 + 1.0)
    assert len(hops) > 12
    assert rows(spark, "bfs_depths", d, "id", "depth") == hops
    assert rows(spark, "transitive_closure", d, "id", "reachable") == {v: v in hops for v in ids}
    assert rows(spark, "shortest_paths", d, "id", "distance") == {v: far.get(v, float("inf")) for v in ids}
    assert rows(spark, "wave_reachability", d, "id", "distance") == {v: 0.0 if v in hops else float("inf") for v in ids}
    total = Counter()
    for i, _, b in edges:
        total[b] += i % 5 + 1.0
    assert rows(spark, "incoming_weight_sum", d, "id", "total") == {v: total[v] for v in ids}


def test_clustering_takes(spark, events):
    d, edges = events
    near = defaultdict(set)
    for _, a, b in edges:
        if a != b:
            near[a].add(b)
    inside = lambda v: sum(a != b and a in near[v] and b in near[v] for _, a, b in edges)
    want = {v: (len(near[v]), inside(v)) for v in {x for _, a, b in edges for x in (a, b)}}
    assert rows(spark, "clustering_coefficient", d, "id", "neighbours", "inside") == want


def test_depth_first_examines(spark, events):
    d, edges = events
    got = catalogue.QUERIES["depth_first_events"](spark, d).where("kind = 'examine'").collect()
    assert Counter((r.vertex, r.target) for r in got) == Counter((a, b) for _, a, b in edges)


def tarjan(ids, edges):
    """Components as (number by finishing root, least id)."""
    out = defaultdict(list)
    for _, a, b in sorted(edges):
        out[a].append(b)
    found, low, stack, number, least = {}, {}, [], {}, {}

    def visit(v):
        found[v] = low[v] = len(found)
        stack.append(v)
        for w in out[v]:
            if w not in found:
                visit(w)
            if w not in number:
                low[v] = min(low[v], low[w])
        if low[v] == found[v]:
            own = stack[stack.index(v) :]
            del stack[stack.index(v) :]
            n = len(set(number.values()))
            for w in own:
                number[w], least[w] = n, min(own)

    for v in sorted(ids):
        if v not in found:
            visit(v)
    return number, least


def test_strong_components_take(spark, events):
    d, edges = events
    number, least = tarjan({v for _, a, b in edges for v in (a, b)}, edges)
    assert len(set(number.values())) > 2 and max(Counter(number.values()).values()) > 5
    assert rows(spark, "scc_labels_min_id", d, "id", "label") == least
    assert rows(spark, "strong_components_numbered", d, "id", "component") == number


def test_grouped_lists_read_all_events(spark, tmp_path):
    d = str(tmp_path)
    events = [(i, "late" if i >= 100_000 else "early") for i in range(99_970, 100_030)]
    spark.createDataFrame(events, "event_id long, event_type string").write.parquet(f"{d}/events.parquet")
    want = {k: [i for i, t in events if t == k] for k in ("early", "late")}
    assert rows(spark, "grouped_lists", d, "event_type", "ids") == {k: str(v) for k, v in want.items()}


def small(spark, edges):
    return graph.Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))


def test_beyond_the_bound_the_order_is_whole(spark):
    edges = [(0, 1), (0, 2), (1, 3), (3, 4), (5, 2), (4, 6)]
    got = {r.id: r.place for r in ordering.topological_any(spark, small(spark, edges), 3).collect()}
    assert sorted(got.values()) == list(range(7)) and all(got[a] < got[b] for a, b in edges)


def test_beyond_the_bound_components_are_numbered(spark):
    edges = [(7, 8), (8, 7), (8, 1), (1, 2), (2, 1), (2, 5), (9, 5), (5, 5)]
    got = {r.id: r.component for r in ordering.strong_components_any(spark, small(spark, edges), 3).collect()}
    _, least = tarjan({1, 2, 5, 7, 8, 9}, [(i, *e) for i, e in enumerate(edges)])
    assert {a for a in got for b in got if (got[a] == got[b]) != (least[a] == least[b])} == set()
    assert set(got) == set(least) and sorted(set(got.values())) == [0, 1, 2, 3] and all(got[a] >= got[b] for a, b in edges)


def test_beyond_the_bound_neighbours_are_exact(spark):
    points = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(20)], "id long, v array<double>")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    got = knn.nearest(spark, points, edges, points.where("id < 4"), 3, most=20).collect()
    assert {(r.src, r.dst) for r in got} == {(r.src, r.dst) for r in knn.exact(points, 3).collect() if r.src < 4} and len(got) == 12


def test_layers_take_all_rising_moves(spark, events):
    d, edges = events
    up = [(a, b) for _, a, b in edges if a < b]
    want = {v: 0 for e in up for v in e}
    for a, b in sorted(up, key=lambda e: e[1]):  # by target: a source's layer is final before it is used
        want[b] = max([want[b]] + [want[x] + 1 for x, y in up if y == b])
    assert max(want.values()) > 3
    assert rows(spark, "topological_layers", d, "id", "layer") == want


def test_distance_metrics_take(spark, events):
    d, edges = events
    ids = {v for _, a, b in edges for v in (a, b)}
    far = {v: distances(edges, v, lambda i: 1) for v in ids}
    far = {v: f for v, f in far.items() if len(f) - 1 > len(ids) // 4 or v == min(ids)}
    ends = {v: max(f.values()) for v, f in far.items()}
    r = catalogue.QUERIES["distance_metrics"](spark, d).first()
    assert (r.diameter, r.radius) == (max(ends.values()), min(ends.values()))
    assert r.average_path_length == pytest.approx(sum(map(lambda f: sum(f.values()), far.values())) / sum(len(f) - 1 for f in far.values()))


def test_search_events(spark, events):
    """Each event once in the order of a plain search; both searches stop where they are told."""
    d, edges = events
    out = defaultdict(list)
    for i, a, b in sorted(edges):
        out[a].append(b)
    start = min(a for _, a, _ in edges)
    want, seen, queue = [], {start}, [start]
    for v in queue:
        for t in out[v]:
            if t not in seen:
                seen.add(t)
                queue.append(t)
                want.append((v, t))
    got = catalogue.QUERIES["breadth_first_events"](spark, d).orderBy("step").collect()
    assert [(r.vertex, r.target) for r in got if r.kind == "tree"] == want and [r.vertex for r in got if r.kind == "finish"] == queue
    assert Counter((r.vertex, r.target) for r in got if r.kind == "examine_edge") == Counter((v, t) for v in queue for t in out[v])
    far = distances(edges, start, lambda i: i % 5 + 1.0)
    got = catalogue.QUERIES["distance_search_events"](spark, d).orderBy("step").collect()
    order = [r.vertex for r in got if r.kind == "finish"]
    assert sorted(order) == sorted(far) and [far[v] for v in order] == sorted(far.values())
    g = catalogue.users(spark, d)
    some = ordering.search_events(g, [start], end=order[3], weight="w").orderBy("step").collect()
    assert (some[-1].kind, some[-1].vertex) == ("examine", order[3]) and len([r for r in some if r.kind == "finish"]) == 3


def test_topological_order_of_all_rising_moves(spark, events):
    d, edges = events
    place = rows(spark, "topological_order", d, "id", "place")
    up = [(a, b) for _, a, b in edges if a < b]
    assert set(place) == {v for e in up for v in e} and sorted(place.values()) == list(range(len(place)))
    assert all(place[a] < place[b] for a, b in up)


def test_label_propagation_step_by_step(spark):
    from tabgraph.plans import supersteps

    rng = random.Random(8)
    edges = [(rng.randrange(12), rng.randrange(12), rng.random()) for _ in range(40)]
    seeds, priors = [(0, "a", 1.0), (1, "b", 1.0), (2, "a", 0.5)], [(5, "b", 0.3)]
    labels, total = {(i, k): x for i, k, x in seeds}, Counter()
    for _, b, w in edges:
        total[b] += w
    for _ in range(9):
        got = defaultdict(float)
        for a, b, w in edges:
            for (i, k), x in labels.items():
                if i == a:
                    got[b, k] += w * x
        heard = {b for b, _ in got}
        new = {key: x for key, x in labels.items() if key[0] not in heard}
        for key in {*got, *((i, k) for i, k, _ in seeds + priors if i in heard)}:
            seed, prior = {(i, k): x for i, k, x in seeds}.get(key), {(i, k): x for i, k, x in priors}.get(key, 0)
            new[key] = ((seed or 0) + 0.01 * got.get(key, 0) + 0.01 * prior) / ((seed is not None) + 0.01 * total[key[0]] + 0.01)
        labels = new
    df = lambda r: spark.createDataFrame(r, "id long, label string, score double")
    g = graph.Graph(spark.range(12).select("id"), spark.createDataFrame(edges, "src long, dst long, w double"))
    out = {(r.id, r.label): r.score for r in supersteps.label_propagation(spark, g, df(seeds), df(priors), 10).collect()}
    assert out == {k: pytest.approx(x, rel=1e-9) for k, x in labels.items()}


def test_recall_of_the_neighbour_walk(spark):
    d = "/root/testdata/sf0.01"
    near = {(r.src, r.dst) for r in catalogue.QUERIES["exact_knn"](spark, d).collect()}
    got = {(r.src, r.dst) for r in catalogue.QUERIES["approx_knn"](spark, d).collect()}
    assert len({a for a, _ in got}) == len({a for a, _ in near}) and len(near & got) / len(near) > 0.8


def test_samples_and_shuffles_follow_their_seed(spark):
    from tabgraph.functions import scalars
    from tabgraph.streaming.pipeline import Pipeline

    df = spark.range(1000)
    one = [{r.id for r in scalars.sample_rows(df, 100, seed).collect()} for seed in (3, 3, 4)]
    assert len(one[0]) == 100 and one[0] == one[1] != one[2] and one[0] <= set(range(1000))
    assert 350 < sum(one[0]) / 100 < 650
    two = [Pipeline.range(spark, 0, 199).shuffled(seed).collect() for seed in (7, 7, 8)]
    assert sorted(two[0]) == list(range(200)) and two[0] == two[1] != two[2] != list(range(200))
    moved = sum(abs(a - i) for i, a in enumerate(two[0])) / 200
    assert 40 < moved < 95


def test_states_shared_by_all_vertices(spark):
    """Each step adds the sum of all states of the step before to those that hear anything."""
    from pyspark.sql import functions as F

    from tabgraph.plans import supersteps

    g = graph.Graph(spark.range(4).select("id"), spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long"))
    state = g.vertices.select("id", F.lit(1).cast("long").alias("x"), (F.col("id") == 0).alias("active"))
    heard = F.col("inbox").isNotNull()
    got = supersteps.run(spark, g, state, F.col("active"), F.lit(1), F.sum("message"), {"x": F.when(heard, F.col("x") + F.col("all")).otherwise(F.col("x")), "active": heard}, shared={"all": F.sum("x")})
    assert {r.id: r.x for r in got.state.collect()} == {0: 1, 1: 5, 2: 9, 3: 17} and got.steps == 4


def test_paths_by_pointer_doubling(spark):
    from tabgraph.plans import supersteps

    n = 300
    state = spark.createDataFrame([(i, float(i), max(i - 1, 0)) for i in range(n)] + [(n, float("inf"), None)], "id long, distance double, pred long")
    assert supersteps.path_to(state, 0, n - 1) == [(i, float(i)) for i in range(n)] and supersteps.path_to(state, 0, n) == []
