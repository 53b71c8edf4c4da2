"""Columns and masks. A mask is a boolean column without nulls: a null value fails every predicate, so not(p) holds for it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgraph.errors import TypeMismatch, UnknownColumn
from tabgraph.types import is_bool, is_fraction, is_numeric, is_string

if TYPE_CHECKING:
    from .frame import Table


class Mask:
    """`plain` is the predicate before nulls were made false: where() uses it, since only that reaches the Parquet scan."""

    def __init__(self, expr: Column, plain: Column | None = None):
        self.expr, self.plain = expr, expr if plain is None else plain

    @classmethod
    def of(cls, predicate: Column) -> Mask:
        return cls(F.coalesce(predicate, F.lit(False)), predicate)

    @classmethod
    def all(cls, value: bool) -> Mask:
        return cls(F.lit(value))

    def __and__(self, other: Mask) -> Mask:
        return Mask(self.expr & other.expr, self.plain & other.plain)

    def __or__(self, other: Mask) -> Mask:
        return Mask(self.expr | other.expr, self.plain | other.plain)

    def __invert__(self) -> Mask:
        return Mask(~self.expr)

    def count(self) -> Column:
        """The number of rows it holds for, as an aggregate."""
        return F.count_if(self.expr)

    def is_empty(self) -> Column:
        """Whether it holds for no row, as an aggregate."""
        return ~F.coalesce(F.bool_or(self.expr), F.lit(False))


#: Named properties of values that can be used as masks; more can be registered.
PROPERTIES: dict[str, Callable[[Column], Column]] = {
    "is_nan": F.isnan,
    "is_zero": lambda c: c == 0,
    "is_infinite": lambda c: F.abs(c) == float("inf"),
    "is_finite": lambda c: ~F.isnan(c) & (F.abs(c) != float("inf")),
    "is_empty": lambda c: F.length(c) == 0,
    "is_ascii": lambda c: ~c.rlike(r"[^\x00-\x7F]"),
}


class Col:
    """A named column of a table: comparisons give masks, reductions give values, the rest gives expressions."""

    def __init__(self, table: Table, name: str):
        self.table, self.name = table, name
        self.expr, self.dtype = table.frame[name], table.frame.schema[name].dataType

    def typed(self, dtype: str) -> Col:
        """The column itself, if it has exactly this type; nothing is converted."""
        if self.dtype.simpleString() != dtype:
            raise TypeMismatch(f"{self.name} is {self.dtype.simpleString()}, not {dtype}")
        return self

    def _compare(self, op: Callable[[Column, Column], Column], value: Any, of_nan: bool = False) -> Mask:
        v = value.expr if isinstance(value, Col) else value if isinstance(value, Column) else F.lit(value)
        if not is_fraction(self.dtype):
            return Mask.of(op(self.expr, v))
        nan = F.isnan(self.expr) | F.isnan(v.cast("double"))  # NaN compares as in IEEE: only "not equal" holds
        return Mask.of(op(self.expr, v) | nan if of_nan else op(self.expr, v) & ~nan)

    def __eq__(self, value: Any) -> Mask:  # type: ignore[override]
        return self._compare(lambda a, b: a == b, value)

    def __ne__(self, value: Any) -> Mask:  # type: ignore[override]
        return self._compare(lambda a, b: a != b, value, True)

    def __lt__(self, value: Any) -> Mask:
        return self._compare(lambda a, b: a < b, value)

    def __le__(self, value: Any) -> Mask:
        return self._compare(lambda a, b: a <= b, value)

    def __gt__(self, value: Any) -> Mask:
        return self._compare(lambda a, b: a > b, value)

    def __ge__(self, value: Any) -> Mask:
        return self._compare(lambda a, b: a >= b, value)

    __hash__ = None  # type: ignore[assignment]

    def matching(self, predicate: Callable[[Column], Column]) -> Mask:
        return Mask.of(predicate(self.expr))

    def having(self, name: str) -> Mask:
        """The mask of a named property."""
        if name not in PROPERTIES:
            raise UnknownColumn(f"no property {name}")
        return Mask.of(PROPERTIES[name](self.expr))

    def nils(self) -> Mask:
        return Mask(self.expr.isNull())

    def non_nils(self) -> Mask:
        return Mask(self.expr.isNotNull())

    def has_nils(self) -> bool:
        return bool(self.table.frame.where(self.expr.isNull()).limit(1).count())

    def filled(self, value: Any) -> Column:
        kinds = {bool: is_bool, int: is_numeric, float: is_numeric, str: is_string}
        if type(value) in kinds and not kinds[type(value)](self.dtype):
            raise TypeMismatch(f"{self.name} is {self.dtype.simpleString()}, not that of {value!r}")
        return F.coalesce(self.expr, F.lit(value).cast(self.dtype))

    def mapped(self, fn: Callable[[Column], Column]) -> Column:
        """fn of the values; null stays null, whatever fn makes of it."""
        return F.when(self.expr.isNotNull(), fn(self.expr))

    def _reduced(self, agg: Column) -> Any:
        return self.table.frame.agg(agg.alias("x")).first()[0]

    def sum(self) -> Any:
        return self._reduced(sum_of(self.expr, self.dtype))

    def min(self) -> Any:
        return self._reduced(F.min(not_nan(self.expr, self.dtype)))

    def max(self) -> Any:
        return self._reduced(F.max(not_nan(self.expr, self.dtype)))

    def mean(self) -> float:
        return self._reduced(mean_of(self.expr))

    def avg(self) -> float:
        """The sum over the number of all rows, nulls included (mean leaves them out)."""
        return self._reduced(avg_with_nils(self.expr))

    def reduced(self, zero: Any, fn: Callable[[Column, Column], Column]) -> Any:
        """An ordered fold over the values that are not null, of one group in one task: for columns of bounded length."""
        t = self.table.settled()
        c = t.frame[self.name]
        rows = F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(t.position.alias("p"), c.alias("v")))))
        return t.frame.agg(F.aggregate(rows, F.lit(zero), lambda acc, x: fn(acc, x["v"])).alias("x")).first()[0]


def not_nan(c: Column, t: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if is_fraction(t) else c


def sum_of(c: Column, t: T.DataType) -> Column:
    """A sum that is 0 without values; integers overflow with an error."""
    return F.coalesce(F.sum(c), F.lit(0).cast("double" if is_fraction(t) else "long" if isinstance(t, T.IntegralType) else t))


def mean_of(c: Column) -> Column:
    return F.coalesce(F.avg(c.cast("double")), F.lit(float("nan")))


def avg_with_nils(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0)) / F.count(F.lit(1))


def multi_map(cols: list[Column], fn: Callable[..., Column]) -> Column:
    """fn of several columns, null if any of them is null."""
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in cols)), fn(*cols))
