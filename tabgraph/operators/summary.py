"""Column profiles: one pass over the table, one row a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgraph.types import is_bool, is_fraction, is_numeric, is_string

NUMBER = ("min", "max", "sum", "mean", "stddev", "root_sum_sq_dev")
COUNTS = ("zero_count", "negative_count", "positive_count", "nan_count", "inf_count")
STRING = ("min_string", "max_string", "longest", "shortest")


def summarized(df: DataFrame, position: Column, frame: DataFrame) -> DataFrame:
    """column, kind, row_count, missing_count and what its kind has; fields of other kinds, and of columns without
    values, are null. NaN takes no part in min, max, sum and mean; infinities are counted apart and by their sign.
    stddev is the population's."""
    rows = []
    for f in df.schema:
        c, t = frame[f.name], f.dataType
        got: dict[str, Column] = {}
        if is_numeric(t):
            kind, x = "numeric", c.cast("double")
            v = F.when(~F.isnan(x), x) if is_fraction(t) else x
            got = {"min": F.min(v), "max": F.max(v), "sum": F.sum(v), "mean": F.avg(v), "stddev": F.stddev_pop(v), "root_sum_sq_dev": F.stddev_pop(v) * F.sqrt(F.count(v))}
            got |= {"zero_count": F.count_if(x == 0), "negative_count": F.count_if(x < 0), "positive_count": F.count_if((x > 0) & ~F.isnan(x)), "nan_count": F.count_if(F.isnan(x)), "inf_count": F.count_if(F.abs(x) == float("inf"))}
        elif is_string(t):
            kind, n = "string", F.char_length(c)
            by = lambda k: F.min_by(c, F.when(c.isNotNull(), F.struct(k.alias("k"), position.alias("p"))))
            got = {"min_string": F.min(c), "max_string": F.max(c), "longest": by(-n), "shortest": by(n), "average_length": F.avg(n), "ascii_count": F.count_if(~c.rlike(r"[^\x00-\x7F]"))}
        elif is_bool(t):
            kind, got = "bool", {"true_count": F.count_if(c), "false_count": F.count_if(~c)}
        else:
            kind = "other"
        some = F.count(c) > 0
        types = {k: "double" for k in (*NUMBER, "average_length")} | {k: "long" for k in (*COUNTS, "ascii_count", "true_count", "false_count")} | {k: "string" for k in STRING}
        fields = [F.when(some, got[k]).cast(t_).alias(k) if k in got else F.lit(None).cast(t_).alias(k) for k, t_ in types.items()]
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("row_count"), F.count_if(c.isNull()).alias("missing_count"), *fields))
    return frame.agg(F.array(*rows).alias("a")).select(F.inline("a"))
