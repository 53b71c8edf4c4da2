"""Parsing, arrays, maps and grid geometry as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_int(s: Column) -> Column:
    return F.trim(s).try_cast("bigint")


def parse_double(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def parse_bool(s: Column) -> Column:
    low = F.lower(F.trim(s))
    return F.when(low.isin("true", "t", "1"), True).when(low.isin("false", "f", "0"), False)


def bool_to_int(b: Column) -> Column:
    return b.cast("int")


# arrays


def map_flatten(a: Column, fn: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(a, fn))


def compact_map(a: Column, fn: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(a, fn), lambda x: x.isNotNull())


def first_index(a: Column, fn: Callable[[Column], Column]) -> Column:
    """Index from 0 of the first element for which fn holds, else null."""
    at = F.array_position(F.transform(a, lambda x: F.coalesce(fn(x), F.lit(False))), True)
    return F.when(at > 0, at - 1)


def update_while(a: Column, goes_on: Callable[[Column], Column], fn: Callable[[Column], Column]) -> Column:
    """fn of the elements before the first for which goes_on fails, the rest as they are."""
    end = F.coalesce(first_index(a, lambda x: ~goes_on(x)), F.size(a))
    return F.transform(a, lambda x, i: F.when(i < end, fn(x)).otherwise(x))


def write_prefix(a: Column, values: Column) -> Column:
    n = F.least(F.size(a), F.size(values))
    return F.concat(F.slice(values, F.lit(1), n), F.slice(a, n + 1, F.size(a)))


def insert_at(a: Column, index: int, value: Column) -> Column:
    return F.concat(F.slice(a, 1, index), F.array(value), F.slice(a, F.lit(index + 1), F.size(a)))


def remove_at(a: Column, index: int) -> Column:
    return F.filter(a, lambda x, i: i != index)


def half_stable_partition(a: Column, selected: Callable[[Column], Column]) -> Column:
    """Elements that are not selected in their order, then the selected ones."""
    return F.concat(F.filter(a, lambda x: ~selected(x)), F.filter(a, selected))


# maps


def compact_map_values(m: Column, fn: Callable[[Column], Column]) -> Column:
    return F.map_filter(F.transform_values(m, lambda k, v: fn(v)), lambda k, v: v.isNotNull())


def merge_maps(a: Column, b: Column, unite: Callable[[Column, Column], Column]) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(unite(x, y)))


def update_value(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, value))


def remove_value(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def grouped_lists(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The values of each key, in order: a result that holds a key's values in one row, as asked for."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(rows, lambda r: r["v"]).alias(value))


def folded(df: DataFrame, key: str, value: str, order: str, zero: Column, fn: Callable[[Column, Column], Column]) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.aggregate(rows, zero, lambda acc, r: fn(acc, r["v"])).alias(value))


def sample_rows(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """k rows without replacement, the same for the same seed: the least hashes, by a top-k in every task."""
    return df.orderBy(F.xxhash64(*(keys or df.columns), F.lit(seed)), *(keys or df.columns)).limit(k)


# grid points (x, y)


def add_points(a: Column, b: Column) -> Column:
    return F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))


def negated(p: Column) -> Column:
    return F.struct((-p["x"]).alias("x"), (-p["y"]).alias("y"))


def magnitude(p: Column) -> Column:
    return F.sqrt((p["x"] * p["x"] + p["y"] * p["y"]).cast("double"))


def manhattan(a: Column, b: Column) -> Column:
    return F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])
