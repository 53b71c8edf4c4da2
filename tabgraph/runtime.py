"""Scratch tables in the shared folder, and positions without a single sorting task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tabgraph.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tabgraph-")
        spark.conf.set("tabgraph.scratch", root)
    return root


def written(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and its files outlive lost executors."""
    path = f"{scratch_root(spark)}/tabgraph/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Grown:
    """A table that only grows, part by part, each written once: one scan reads them all, however many rounds wrote them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.parts, self.schema = spark, f"{scratch_root(spark)}/tabgraph/{name}-{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes df as the next part and gives it as read back."""
        self.schema, path = self.schema or df.schema, f"{self.path}/{self.parts}"
        df.write.option("compression", "zstd").parquet(path)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/*")


def cleared(spark: SparkSession) -> None:
    """Deletes all scratch tables of this library in the shared folder; nothing lazy that reads them may be asked for afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/tabgraph")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its columns are called (names clash regardless of case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def ranked(spark: SparkSession, df: DataFrame, order: Sequence[Column], by: str, start: int = 0) -> DataFrame:
    """df with its dense place, from `start`, in the given order. Ranges are sorted apart; the driver gets one count for
    each range, of which there are as many as shuffle partitions."""
    part = free(df, "__range")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = written(spark, df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()), "ranked")
    base, bases = start - 1, {}
    for r in cut.groupBy(part).count().orderBy(part).collect():
        bases[r[part]], base = base, base + r["count"]
    if not bases:
        return cut.select(*df.columns, F.lit(start).cast("long").alias(by))
    first = F.create_map(*(F.lit(x) for kv in bases.items() for x in kv))[F.col(part)]
    return cut.select(*df.columns, (F.row_number().over(Window.partitionBy(part).orderBy(*order)) + first).cast("long").alias(by))
