import pandas as pd
from pyspark.sql import functions as F

from tabgraph.streaming import events as E
from tabgraph.streaming.pipeline import Pipeline


def test_interleaving(spark):
    p = Pipeline.range(spark, 0, 3)
    v = F.col("value")
    assert p.interleave(F.transform(F.sequence(v * 0, F.lit(1).cast("long")), lambda k: 10 * v + k), 2).collect() == [0, 10, 1, 11, 20, 30, 21, 31]
    want = [0, 10, 11, 20, 21, 22, 30, 31, 32, 33]
    assert sorted(p.interleave(F.transform(F.sequence(F.lit(0).cast("long"), v), lambda k: 10 * v + k), 2).collect()) == want
    assert p.interleave(F.transform(F.sequence(F.lit(0).cast("long"), v), lambda k: 10 * v + k), 2).collect() == [0, 10, 11, 20, 21, 30, 22, 31, 32, 33]


def test_windows_and_zips(spark):
    p = Pipeline.range(spark, 0, 10)
    assert p.reduce_window(3, F.sum("value").alias("s")).collect() == [3, 12, 21, 19]
    assert Pipeline.range(spark, 0, 5).reduce_window(3, F.sum("value").alias("s")).collect() == [3, 12]
    assert p.take(3).collect() == [0, 1, 2] and Pipeline.range(spark, 0, 5).drop(2).collect() == [2, 3, 4, 5]
    assert Pipeline.range(spark, 1, 6, 2).collect() == [1, 3, 5]
    z = Pipeline.range(spark, 0, 4).zip(Pipeline.range(spark, 1, 9))
    assert z.map((F.col("left.value") + F.col("right.value")).alias("s")).collect() == [1, 3, 5, 7, 9]
    assert p.batch(4).collect() == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]
    assert Pipeline.items(spark, [5, 6], "int").enumerated().collect() == [(5, 0), (6, 1)]
    assert sorted(p.shuffled(3).collect()) == list(range(11))
    assert p.filter(F.col("value") > 8).enumerated().collect() == [(9, 0), (10, 1)]


def test_a_generator_goes_on_after_an_error(spark):
    todo = [1, ValueError("no"), 3, None]

    def fn():
        x = todo.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert Pipeline.generated(spark, fn, "int").collect() == [(1, None), (None, "no"), (3, None)]


def test_streams_give_what_tables_give(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400)
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    got = E.drained(E.windowed(E.event_stream(spark, str(tmp_path / "in"), table), "1 hour"), "hours", "complete")
    key = lambda df: sorted(map(tuple, df.select(F.col("window_start").cast("string"), "n").collect()))
    assert key(got) == key(E.windowed(table, "1 hour"))
    n = E.drained(E.running_counts(E.event_stream(spark, str(tmp_path / "in"), table)), "counts", "update")
    want = table.groupBy("user_id").count().toPandas()
    pd.testing.assert_frame_equal(n.toPandas().sort_values("user_id", ignore_index=True), want.rename(columns={"count": "n"}).sort_values("user_id", ignore_index=True))
