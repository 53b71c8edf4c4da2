"""Classes of data types: which aggregations and summaries apply to a column."""

from pyspark.sql import types as T


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_fraction(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_bool(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)
