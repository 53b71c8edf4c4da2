"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it reaches.

    A large-star round links each node's larger neighbours to the smallest of itself and its neighbours, a small-star
    round its smaller ones; the number of rounds grows with the logarithm of the longest chain. A node's neighbours are
    never gathered: their minimum is a partial aggregation, written before it is handed back, so that both sides of that
    sort-merge join are dealt anew and adaptive execution splits the partition of a node with very many neighbours. Each round is written to the shared folder, so no lineage builds up. Loops (a = b) and
    repeated edges do no harm; no edges give no rows.
    """
    e = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(spark, both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(spark, large, "large")
        least = written(spark, large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "least")
        small = large.join(least.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("k", "m")).distinct()
        e = written(spark, small, "small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")
