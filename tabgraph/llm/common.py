"""What the operators of this package share: inputs, scratch tables, label folds and row-wise Arrow passes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgraph.runtime import free, scratch_root, written

__all__ = ["bounded_sample", "fold", "fold_py", "free", "load", "row_pass", "scratch_root", "written"]

#: Rows that a Python pass turns into Python objects at once; bounds its memory, not its input.
SLICE = 256


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts. A null id counts as the empty text, so as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts


def fold_py(doc_id: int | None, parts: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def bounded_sample(df: DataFrame, keys: Sequence[Column], rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by a hash of `keys`, never more than twice as many: those with the least hashes,
    so that the same rows are chosen again in another run. Rows with equal keys stand or fall by all their columns."""
    if total <= rows:
        return df
    share, drawn = max(1, round(2**31 * rows / total)), F.pmod(F.xxhash64(*keys), F.lit(2**31))
    return df.where(drawn < share).orderBy(drawn, F.xxhash64(*df.columns)).limit(2 * rows)


def row_pass(df: DataFrame, fn: Callable[[list[str]], dict[str, list]], add: T.StructType, text: str = "text", drop: Sequence[str] = (), keep: Callable[[dict[str, list]], list[bool]] | None = None) -> DataFrame:
    """df with the columns that fn computes from each slice of its texts (null: empty), in one narrow stage.

    fn is called with at most SLICE whole texts. `drop` names columns left out of the result; `keep`, if given,
    turns what fn returned into a row filter, and then nothing is added.
    """
    names = [c for c in df.columns if c not in drop]
    added = [f.name for f in add.fields]
    out = T.StructType([df.schema[c] for c in names] + ([] if keep else add.fields))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64())}
    kinds = [arrow[f.dataType.simpleString()] for f in add.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                got = fn([x or "" for x in part.column(text).to_pylist()])
                if keep:
                    part = part.filter(pa.array(keep(got), pa.bool_()))
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in names], names)
                else:
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(got[a], k) for a, k in zip(added, kinds))], names + added)

    return df.mapInArrow(run, out)
