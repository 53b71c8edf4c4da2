"""Aggregations that fan out over all columns they apply to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgraph.types import is_numeric, is_string

from .column import mean_of, sum_of


@dataclass(frozen=True)
class Agg:
    """`build` makes the aggregate of (column, its type, position); a global one ignores them and is named by itself."""

    name: str
    build: Callable[[Column, T.DataType, Column], Column]
    applies: Callable[[T.DataType], bool] = lambda t: True
    is_global: bool = False


def longest_of(c: Column, position: Column) -> Column:
    """The longest string (by code points), the first of equals; null without any."""
    return F.min_by(c, F.when(c.isNotNull(), F.struct((-F.char_length(c)).alias("n"), position.alias("p"))))


count = Agg("count", lambda c, t, p: F.count(F.lit(1)), is_global=True)
sum = Agg("sum", lambda c, t, p: sum_of(c, t), is_numeric)
mean = Agg("mean", lambda c, t, p: mean_of(c), is_numeric)
count_nils = Agg("nils_count", lambda c, t, p: F.count_if(c.isNull()))
count_non_nils = Agg("non_nils_count", lambda c, t, p: F.count(c))
longest = Agg("longest", lambda c, t, p: longest_of(c, p), is_string)


def custom(name: str, build: Callable[[Column], Column], applies: Callable[[T.DataType], bool] = lambda t: True) -> Agg:
    """A user's aggregate: `build` of built-in functions, or of a grouped-aggregate pandas UDF."""
    return Agg(name, lambda c, t, p: build(c), applies)
