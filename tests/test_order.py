"""What follows a sort keeps its order."""

import pytest
from pyspark.sql import functions as F

from tabgraph.errors import UnknownColumn
from tabgraph.operators import aggregate as A
from tabgraph.operators.frame import Table


@pytest.fixture
def t(spark):
    return Table.of(spark, [("a", [3, 1, 2, None, 1]), ("b", ["x", "y", "z", "w", "v"]), ("k", [1, 1, 2, 2, 1])], "a int, b string, k int")


def shown(t, *names):
    return [tuple(r) if len(names) != 1 else r[0] for r in (t.select(*names) if names else t).ordered().collect()]


def test_every_operator_hands_the_sort_on(spark, t):
    s = t.sort("a")
    assert shown(s, "b") == ["y", "v", "z", "x", "w"]
    assert shown(s.where(s["k"] == 1), "b") == ["y", "v", "x"]
    assert shown(s.drop("a"), "b") == ["y", "v", "z", "x", "w"] and shown(s.rename("a", "c"), "b") == ["y", "v", "z", "x", "w"]
    assert shown(s.assign(a=F.lit(0)), "b") == ["y", "v", "z", "x", "w"] and shown(s.named("q", "r"), "r") == ["y", "v", "z", "x", "w"]
    assert shown(s.drop_nils(), "b") == ["y", "v", "z", "x"] and shown(s.fill_nils(a=0), "a") == [1, 1, 2, 3, 0]
    assert [r.b for r in s.select("b").take(2).collect()] == ["y", "v"] and s.element("b", 3) == "x"
    assert shown(s.with_element("b", 1, "new"), "b") == ["y", "new", "z", "x", "w"]
    assert [r.row for r in s.numbered().sort("b").frame.orderBy("row").select("row").collect()] == [0, 1, 2, 3, 4]
    assert s.text(1).split("\n")[2] == "1\ty\t1"
    with pytest.raises(IndexError):
        s.element("b", 5)


def test_a_second_sort_is_stable_over_the_first(t):
    assert shown(t.sort(("a", False)).sort("k"), "b") == ["x", "y", "v", "w", "z"]
    assert shown(t.sort("b").sort("a").select("a", "b"), "b") == ["v", "y", "z", "x", "w"]


def test_groups_and_longest_follow_the_sort(t):
    g = t.sort(("k", False), "b").group("k", A.count, A.longest)
    assert shown(g, "k", "b_longest") == [(2, "w"), (1, "v")]
    assert t.sort(("b", False)).summarize().where("column = 'b'").first().longest == "z"
    assert t.sort("b")["b"].reduced("", lambda s, x: F.concat(s, x)) == "vwxyz"


def test_concat_keeps_both_orders(spark, t):
    assert shown(t.sort("a").concat(t.sort(("b", False))), "b") == ["y", "v", "z", "x", "w", "z", "y", "x", "w", "v"]
    w = Table(spark.range(12).select(F.col("id").alias("n")), ["n"])
    assert shown(w.concat(w).concat(w), "n") == [*range(12)] * 3 and shown(w.concat(w.concat(w)), "n") == [*range(12)] * 3
    nullable = Table(spark.createDataFrame([(i,) for i in (10, 2)], "n long"), ["n"])
    assert shown(w.concat(nullable).concat(w), "n") == [*range(12), 2, 10, *range(12)]


def test_joins_keep_the_left_order_and_put_the_rest_last(spark, t):
    r = Table.of(spark, [("k", [9, 2, 8]), ("c", ["i", "j", "l"])], "k int, c string")
    s = t.sort(("b", False))
    assert shown(s.join(r, "k"), "b", "c") == [("z", "j"), ("y", None), ("x", None), ("w", "j"), ("v", None)]
    assert shown(s.join(r, "k", "full"), "b", "c") == [("z", "j"), ("y", None), ("x", None), ("w", "j"), ("v", None), (None, "i"), (None, "l")]
    assert shown(s.join(r.sort(("c", False)), "k", "right"), "k", "b", "c") == [(2, "z", "j"), (2, "w", "j"), (8, None, "l"), (9, None, "i")]
    both = s.join(r, "k", "full").concat(t.assign(c=F.lit("t")))
    assert shown(both, "c")[5:] == ["i", "l", "t", "t", "t", "t", "t"]
    many = Table.of(spark, [("k", [1, 1]), ("c", ["p", "o"])], "k int, c string")
    assert shown(s.join(many.sort("c"), "k", "inner", False), "b", "c") == [("y", "o"), ("y", "p"), ("x", "o"), ("x", "p"), ("v", "o"), ("v", "p")]
    assert shown(s.join(r, "k", "left_semi"), "b") == ["z", "w"]


def test_gathering_marking_and_appending(spark, t):
    s = t.sort("a")
    assert shown(s.gather([4, 0, None, 0]), "b") == ["w", "y", None, "y"] and shown(s.gather([]), "b") == []
    with pytest.raises(Exception, match="no row 5"):
        s.gather([5]).ordered().collect()
    n, m = s.marked([1, 3, 7])
    assert shown(n.where(m), "b") == ["v", "x"] and shown(n.where(~m), "b") == ["y", "z", "w"]
    assert sorted(r.row for r in s.rows_of(s["k"] == 2).collect()) == [2, 4]
    e, m = s.extended_mask(s["k"] == 1, 2, True)
    assert shown(e.where(m), "b") == ["y", "v", "z", "x", "w"]
    e, m = s.extended_mask(s["k"] == 1, 2, False)
    assert shown(e.where(m), "b") == ["y", "v"]
    more = s.append({"b": "end"}, {"a": 9, "k": 9})
    assert shown(more, "a", "b", "k")[4:] == [(None, "w", 2), (None, "end", None), (9, None, 9)]
    with pytest.raises(UnknownColumn):
        s.append({"nope": 1})
    assert t.frame.agg((t["a"] > 5).is_empty().alias("e"), (t["a"] > 2).is_empty().alias("f")).first() == (True, False)


def test_updating_aggregates_merge_states(spark, t):
    join = dict(zero=F.lit(""), update=lambda s, x: F.concat(s, x), merge=lambda s, x: F.concat(s, x), finish=F.upper)
    for chunk in (1, 2, 100):
        assert shown(t.sort(("b", False)).group_updating("k", "b", "all", chunk=chunk, **join)) == [(2, "ZW"), (1, "YXV")]
    n = Table(spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("v")), ["v"])
    assert shown(n.group_updating("k", "v", "s", F.lit(0).cast("long"), lambda s, x: s + x, lambda s, x: s + x, chunk=64)) == [(1, 49_995_000)]
