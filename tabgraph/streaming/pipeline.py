"""Ordered pipelines: sequences of rows with map, filter, interleave, zip and count windows, as lazy plans."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgraph.runtime import ranked, written

AT = "__at"


class Pipeline:
    """Rows in the order of a hidden column. Places are numbered densely (see runtime.ranked) only where an operator counts."""

    def __init__(self, df: DataFrame, dense: bool = False):
        self.frame, self.dense = df, dense

    # sources

    @classmethod
    def of(cls, df: DataFrame, *order: str) -> Pipeline:
        return cls(df.withColumn(AT, F.struct(*order)))

    @classmethod
    def range(cls, spark: SparkSession, first: int, last: int, step: int = 1) -> Pipeline:
        """Integers from first to last, both included. An endless one is a stream: see `endless`."""
        df = spark.range(first, last + (1 if step > 0 else -1), step).select(F.col("id").alias("value"), ((F.col("id") - first) / step).cast("long").alias(AT))
        return cls(df, True)

    @staticmethod
    def endless(spark: SparkSession, per_second: int = 1000) -> DataFrame:
        return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value"))

    @classmethod
    def items(cls, spark: SparkSession, values: Iterable, kind: str) -> Pipeline:
        return cls(spark.createDataFrame([(v, i) for i, v in enumerate(values)], T.StructType().add("value", T._parse_datatype_string(kind)).add(AT, "long")), True)

    @classmethod
    def generated(cls, spark: SparkSession, fn: Callable[[], object], kind: str) -> Pipeline:
        """What fn returns until it returns None, on the driver; where it raises, `error` has the text and it goes on."""
        rows = []
        while True:
            try:
                if (v := fn()) is None:
                    break
                rows.append((v, None, len(rows)))
            except Exception as e:  # noqa: BLE001  the pipeline's rule: an error is an element
                rows.append((None, str(e), len(rows)))
        return cls(spark.createDataFrame(rows, T.StructType().add("value", T._parse_datatype_string(kind)).add("error", "string").add(AT, "long")), True)

    def shuffled(self, seed: int) -> Pipeline:
        return Pipeline(self.numbered().frame.withColumn(AT, F.struct(F.xxhash64(AT, F.lit(seed)), F.col(AT))))

    # operators

    def numbered(self) -> Pipeline:
        if self.dense:
            return self
        return Pipeline(ranked(self.frame.sparkSession, self.frame, [F.col(AT)], "__n", 0).drop(AT).withColumnRenamed("__n", AT), True)

    def map(self, *columns: Column) -> Pipeline:
        return Pipeline(self.frame.select(*columns, AT), self.dense)

    def filter(self, predicate: Column) -> Pipeline:
        return Pipeline(self.frame.where(predicate))

    def compact_map(self, column: Column, name: str = "value") -> Pipeline:
        return Pipeline(self.frame.select(column.alias(name), AT).where(F.col(name).isNotNull()))

    def enumerated(self, name: str = "index") -> Pipeline:
        return Pipeline(self.numbered().frame.withColumn(name, F.col(AT)), True)

    def take(self, n: int) -> Pipeline:
        return Pipeline(self.numbered().frame.where(F.col(AT) < n), True)

    def drop(self, n: int) -> Pipeline:
        return Pipeline(self.numbered().frame.where(F.col(AT) >= n).withColumn(AT, F.col(AT) - n), True)

    def zip(self, other: Pipeline, left: str = "left", right: str = "right") -> Pipeline:
        """Rows at the same places, as two structs, up to the end of the shorter."""
        pack = lambda p, n: p.numbered().frame.select(AT, F.struct(*(c for c in p.frame.columns if c != AT)).alias(n))
        return Pipeline(pack(self, left).join(pack(other, right), AT).select(left, right, AT), True)

    def reduce_window(self, size: int, *aggs: Column) -> Pipeline:
        """Aggregates of consecutive windows of `size` rows, the last one maybe shorter."""
        at = F.floor(F.col(AT) / size)
        return Pipeline(self.numbered().frame.groupBy(at.alias("__w")).agg(*aggs).withColumnRenamed("__w", AT), True)

    def batch(self, size: int, name: str = "value") -> Pipeline:
        rows = F.transform(F.sort_array(F.collect_list(F.struct(AT, name))), lambda r: r[name])
        return self.reduce_window(size, rows.alias(name))

    def interleave(self, produced: Column, cycle: int, workers: int | None = None, name: str = "value") -> Pipeline:
        """Each row's array `produced`, interleaved in rounds over `cycle` live producers, of `workers` that are started.

        The order follows from the producers' lengths alone: a schedule is replayed over these, which stream through one task
        that holds the places of the started producers' elements only; a producer's elements and places meet in a join.
        """
        base = self.numbered().frame.select(AT, produced.alias("__made"))
        workers = max(workers or 2 * cycle, cycle)
        lengths = base.select(AT, F.coalesce(F.size("__made"), F.lit(0)).alias("n"))

        def replay(batches):
            todo = chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
            start = lambda n: deque((at, n, []) for at, n in islice(todo, n))
            live, waiting, done, place = start(cycle), start(workers - cycle), [], 0
            while live:
                at, n, places = one = live.popleft()
                if len(places) < n:
                    places.append(place)
                    place += 1
                    live.append(one)
                    continue
                if places:
                    done.append((at, places))
                waiting += start(1)
                if waiting:
                    live.append(waiting.popleft())
                if len(done) == 8192 or done and len(places) > 8192:
                    yield _places(done)
                    done = []
            if done:
                yield _places(done)

        order = lengths.repartition(1).sortWithinPartitions(AT).mapInArrow(replay, "__who long, __places array<long>")
        made = base.select(F.col(AT).alias("__who"), "__made").join(order, "__who")
        each = made.select(F.explode(F.arrays_zip("__made", "__places")).alias("__e"))
        return Pipeline(each.select(F.col("__e.__made").alias(name), F.col("__e.__places").alias(AT)), True)

    def prefetch(self, n: int = 10) -> Pipeline:
        """Nothing to do: stages run ahead of their consumers anyway."""
        return self

    def cached(self) -> Pipeline:
        return Pipeline(written(self.frame.sparkSession, self.frame, "pipeline"), self.dense)

    # results

    def df(self) -> DataFrame:
        return self.frame.drop(AT)

    def collect(self) -> list:
        return [tuple(r) if len(r) > 1 else r[0] for r in self.frame.orderBy(AT).drop(AT).collect()]


def _places(done: list[tuple[int, list[int]]]) -> pa.RecordBatch:
    who, places = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["__who", "__places"])


def attempt(value: Column, fallback: str = "failed") -> Column:
    """struct<value, error>: for expressions by try_* functions, whose null stands for an error."""
    return F.struct(value.alias("value"), F.when(value.isNull(), F.lit(fallback)).alias("error"))
