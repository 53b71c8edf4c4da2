"""Time windows over event streams: the same plans serve a table and a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame, files: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(like.schema).option("pathGlobFilter", files).parquet(folder)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, *by: str) -> DataFrame:
    """Number and sum of values in tumbling (or, with slide, sliding) windows of event time."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if late else ts
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = ts.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, by: str = "user_id") -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ts = ts.withWatermark("ts", late) if late else ts
    got = ts.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select(by, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def running_counts(stream: DataFrame, by: str = "user_id") -> DataFrame:
    """Keyed state: after each micro-batch, the number of events of each key in it so far."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        yield pd.DataFrame({by: [key[0]], "n": [n]})

    return stream.groupBy(by).applyInPandasWithState(update, f"{by} long, n long", "n long", "update", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available and gives its memory table: for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
