import math

import pytest
from pyspark.sql import functions as F

from tabgraph import errors
from tabgraph.functions import scalars as S
from tabgraph.operators import aggregate as A
from tabgraph.operators.column import Mask
from tabgraph.operators.frame import Table
from tabgraph.operators.typed import Schema, TypedTable


@pytest.fixture(scope="module")
def keyed(spark):
    return Table.of(spark, [("c1", [1, 2, 3, 4, 5]), ("c2", [30.0, 10.0, 30.0, None, None]), ("c3", ["200", "200", "100", None, "0"])], "c1 long, c2 double, c3 string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_sorting_is_stable_and_nulls_flip(keyed):
    assert [r[0] for r in rows(keyed.sort("c2", "c3").ordered())] == [2, 3, 1, 5, 4]
    assert [r[0] for r in rows(keyed.sort(("c2", False)).ordered())] == [4, 5, 1, 3, 2]
    assert [r[0] for r in rows(keyed.sort(("c2", False)).settled().ordered())] == [4, 5, 1, 3, 2]


def test_summary(keyed):
    got = {r.column: r for r in keyed.summarize().collect()}
    assert [got[c].missing_count for c in ("c1", "c2", "c3")] == [0, 2, 1]
    assert got["c1"].mean == 3 and got["c2"].mean == pytest.approx(70 / 3) and got["c3"].min_string == "0" and got["c3"].longest == "200"
    assert got["c1"].stddev == pytest.approx(math.sqrt(2)) and got["c1"].root_sum_sq_dev == pytest.approx(math.sqrt(10))


def test_groups_in_order_of_appearance(spark):
    t = Table.of(spark, [("c1", [1, 2, None, 1, 2, 1]), ("c2", [10, 20, 30, 10, 20, 10]), ("c3", ["a", "bbb", "c", "dd", "e", "ff"])], "c1 long, c2 long, c3 string")
    g = t.group("c1", A.count, A.sum, A.longest, A.count_nils)
    assert g.names == ["c1", "count", "c2_sum", "c2_nils_count", "c3_longest", "c3_nils_count"]
    assert rows(g.ordered()) == [(1, 3, 30, 0, "dd", 0), (2, 2, 40, 0, "bbb", 0), (None, 1, 30, 0, "c", 0)]
    assert rows(t.select("c1").group("c1", A.count).ordered()) == [(1, 3), (2, 2), (None, 1)]


def test_all_null_groups(spark):
    t = Table.of(spark, [("k", [1, 1]), ("v", [None, None])], "k long, v double")
    (r,) = rows(t.group("k", A.sum, A.mean).df)
    assert r[1] == 0 and math.isnan(r[2])


def test_joins(spark):
    a = Table.of(spark, [("id", [1, 2, None, 1, 4]), ("c2", [10, 20, 30, 40, 50])], "id long, c2 long")
    b = Table.of(spark, [("id", [1, 2, None]), ("name", ["A", "B", "N"])], "id long, name string")
    assert rows(a.join(b, "id").ordered()) == [(1, 10, "A"), (2, 20, "B"), (None, 30, None), (1, 40, "A"), (4, 50, None)]
    with pytest.raises(errors.DuplicateKeys):
        a.join(a.rename("c2", "c9"), "id")
    with pytest.raises(errors.TypeMismatch):
        a.join(Table.of(spark, [("id", ["1"])], "id string"), "id")
    with pytest.raises(errors.DuplicateColumn):
        a.join(b.rename("name", "c2"), "id")


def test_masks_are_two_valued(spark):
    t = Table.of(spark, [("v", [None, 1, None, 3, 1])], "v long")
    v = t["v"]
    as_list = lambda m: [r[0] for r in t.frame.orderBy("__pos").select(m.expr).collect()]
    assert as_list(v == 1) == [False, True, False, False, True]
    assert as_list(v != 1) == [False, False, False, True, False]
    assert as_list(~(v == 1)) == [True, False, True, True, False]
    assert as_list((v > 2) | Mask.of(F.lit(None).cast("boolean"))) == [False, False, False, True, False]
    assert v.has_nils() and v.avg() == 1 and v.mean() == pytest.approx(5 / 3)
    assert v.reduced(0, lambda a, x: (a + x).cast("int")) == 5


def test_nan_compares_as_a_number_that_equals_nothing(spark):
    t = Table.of(spark, [("v", [float("nan"), 1.0])], "v double")
    v = t["v"]
    one = lambda m: t.where(m).count()
    assert (one(v == float("nan")), one(v != 1.0), one(v > 0.0), one(v < 5.0)) == (0, 1, 1, 1)
    assert v.max() == 1.0


def test_columns(keyed):
    assert keyed.named("a", "b").names == ["a", "b"]
    assert keyed.get("zz") is None
    for fails in (lambda: keyed["zz"], lambda: keyed.drop("zz"), lambda: keyed.rename("zz", "a")):
        with pytest.raises(errors.UnknownColumn):
            fails()
    with pytest.raises(errors.DuplicateColumn):
        keyed.rename("c1", "c2")
    assert keyed.element("c1", 3) == 4 and keyed.with_element("c1", 3, 9).element("c1", 3) == 9
    assert "<nil>" in keyed.text()
    assert keyed.drop_nils().count() == 3 and keyed.drop_nils("c3").count() == 4
    assert keyed.concat(keyed).count() == 10 and [r[0] for r in rows(keyed.concat(keyed).ordered())] == [1, 2, 3, 4, 5] * 2
    assert rows(keyed.assign_from("x", keyed.sort(("c1", False)).settled(), "c1").select("c1", "x").ordered()) == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]


def test_typed_tables(keyed):
    assert TypedTable(Schema({"c1": "bigint"}), keyed).c1 is not None
    with pytest.raises(errors.SchemaProblems) as e:
        TypedTable(Schema({"c1": "string", "zz": "bigint"}), keyed)
    assert len(e.value.problems) == 2


def test_arrays_and_maps(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], {"a": 1, "b": 2})], "a array<int>, m map<string,int>")
    a, m = F.col("a"), F.col("m")
    got = df.select(S.first_index(a, lambda x: x > 2).alias("i"), S.update_while(a, lambda x: x < 3, lambda x: x * 10).alias("u"), S.half_stable_partition(a, lambda x: x % 2 == 0).alias("h"), S.insert_at(a, 1, F.lit(9)).alias("n"), S.remove_at(a, 0).alias("r"), S.write_prefix(a, F.array(F.lit(7))).alias("w"), S.update_value(m, F.lit("a"), F.lit(5)).alias("m"), S.merge_maps(m, F.create_map(F.lit("a"), F.lit(9)), lambda x, y: x + y).alias("g")).first()
    assert (got.i, got.u, got.h, got.n, got.r, got.w) == (2, [10, 20, 3, 4], [1, 3, 2, 4], [1, 9, 2, 3, 4], [2, 3, 4], [7, 2, 3, 4])
    assert got.m == {"b": 2, "a": 5} and got.g == {"a": 10, "b": 2}
