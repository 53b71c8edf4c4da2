"""Tables: a DataFrame whose rows have an order, kept as a hidden column that every operator hands on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabgraph.errors import DuplicateColumn, DuplicateKeys, TypeMismatch, UnknownColumn
from tabgraph.runtime import ranked, written

from .aggregate import Agg
from .column import Col, Mask, multi_map
from .summary import summarized

POS, KEY = "__pos", "__key"


class Table:
    """Lazy, like the DataFrame in it; only what returns plain values runs a job.

    The order is that of `order` columns if given, else that of reading, which holds as long as the files are split alike
    (see `pinned`). It is hidden columns, not a sort: it costs nothing until rows are shown, taken or numbered. `keys`
    are those of sort(): names of hidden columns, which go before the position, and whether each ascends.
    """

    def __init__(self, df: DataFrame, order: Sequence[str | Column] = (), keys: Sequence[tuple[str, bool]] = ()):
        if len({c.lower() for c in df.columns}) < len(df.columns):
            raise DuplicateColumn(", ".join(df.columns))
        if POS not in df.columns:
            df = df.withColumn(POS, F.struct(*order) if order else F.monotonically_increasing_id())
        self.frame, self.keys = df, list(keys)

    # sources

    @classmethod
    def parquet(cls, spark: SparkSession, path: str, order: Sequence[str] = ()) -> Table:
        return cls(spark.read.parquet(path), order)

    @classmethod
    def of(cls, spark: SparkSession, columns: Mapping[str, Sequence] | Sequence[tuple[str, Sequence]], schema: str) -> Table:
        """From columns of equal lengths; those of a mapping are put in order of their names."""
        pairs = [(k, columns[k]) for k in sorted(columns)] if isinstance(columns, Mapping) else list(columns)
        if len({len(v) for _, v in pairs}) > 1:
            raise TypeMismatch("columns of different lengths")
        kinds = {f.name: f for f in T._parse_datatype_string(schema)}
        rows = [(*r, i) for i, r in enumerate(zip(*(v for _, v in pairs)))]
        return cls(spark.createDataFrame(rows, T.StructType([kinds[k] for k, _ in pairs]).add(POS, "long")))

    # shape

    @property
    def hidden(self) -> list[str]:
        return [*(k for k, _ in self.keys), POS]

    @property
    def names(self) -> list[str]:
        return [c for c in self.frame.columns if c not in self.hidden]

    @property
    def position(self) -> Column:
        """One column that orders the rows; a sorted table has none before it is settled."""
        if self.keys:
            raise TypeMismatch("a sorted table has no single position; use settled()")
        return self.frame[POS]

    @property
    def order(self) -> list[Column]:
        """Nulls come last ascending and first descending; rows that all keys hold equal stay in the order before."""
        return [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_first() for k, up in self.keys] + [F.col(POS).asc_nulls_last()]

    @property
    def df(self) -> DataFrame:
        """Without the order."""
        return self.frame.drop(*self.hidden)

    def ordered(self) -> DataFrame:
        return self.frame.orderBy(*self.order).drop(*self.hidden)

    def settled(self) -> Table:
        """The same rows in the same order, with their dense numbers as the position; a table without sort keys as it is."""
        return self.dense() if self.keys else self

    def dense(self) -> Table:
        got = ranked(self.frame.sparkSession, self.frame, self.order, "__n")
        return Table(got.drop(*self.hidden).withColumnRenamed("__n", POS))

    def pinned(self) -> Table:
        """Written once, with its order as it is now."""
        return Table(written(self.frame.sparkSession, self.frame, "table"), keys=self.keys)

    def count(self) -> int | None:
        return self.frame.count() if self.names else None

    def _know(self, *names: str) -> None:
        if unknown := [n for n in names if n not in self.names]:
            raise UnknownColumn(", ".join(unknown))

    def _with(self, df: DataFrame) -> Table:
        return Table(df, keys=self.keys)

    def get(self, name: str) -> Col | None:
        return Col(self, name) if name in self.names else None

    def __getitem__(self, name: str) -> Col:
        self._know(name)
        return Col(self, name)

    # columns

    def select(self, *names: str) -> Table:
        self._know(*names)
        if len(set(names)) < len(names):
            raise DuplicateColumn(", ".join(names))
        return self._with(self.frame.select(*names, *self.hidden))

    def assign(self, **columns: Column) -> Table:
        return self._with(self.frame.withColumns(columns))

    def assign_from(self, name: str, other: Table, column: str) -> Table:
        """A column of another table, row by row in order; both must have as many rows."""
        spark = self.frame.sparkSession
        a, b = ranked(spark, self.frame, self.order, "__n"), ranked(spark, other.select(column).frame, other.order, "__n")
        if a.count() != b.count():
            raise TypeMismatch("columns of different lengths")
        return self._with(a.drop(name).join(b.select("__n", F.col(column).alias(name)), "__n").drop("__n"))

    def rename(self, old: str, new: str) -> Table:
        self._know(old)
        if new in self.names:
            raise DuplicateColumn(new)
        return self._with(self.frame.withColumnRenamed(old, new))

    def named(self, *names: str) -> Table:
        """The first columns under new names, in order; the others are dropped."""
        if len(set(names)) < len(names):
            raise DuplicateColumn(", ".join(names))
        return self._with(self.frame.select(*(F.col(a).alias(b) for a, b in zip(self.names, names)), *self.hidden))

    def drop(self, *names: str, strict: bool = True) -> Table:
        if strict:
            self._know(*names)
        return self._with(self.frame.drop(*names))

    def tmap(self, names: Sequence[str], fn: Callable[..., Column]) -> Column:
        self._know(*names)
        return multi_map([self.frame[n] for n in names], fn)

    # rows

    def where(self, mask: Mask) -> Table:
        return self._with(self.frame.where(mask.plain))

    def drop_nils(self, *names: str) -> Table:
        self._know(*names)
        return self._with(self.frame.dropna("any", subset=list(names or self.names)))

    def fill_nils(self, **values: Any) -> Table:
        return self.assign(**{k: self[k].filled(v) for k, v in values.items()})

    def numbered(self, name: str = "row") -> Table:
        """With the row's number from 0; needed for access by position only."""
        return self._with(ranked(self.frame.sparkSession, self.frame, self.order, name))

    def element(self, name: str, row: int) -> Any:
        self._know(name)
        got = self.frame.orderBy(*self.order).offset(row).limit(1).select(name).collect() if row >= 0 else []
        if not got:
            raise IndexError(row)
        return got[0][0]

    def with_element(self, name: str, row: int, value: Any) -> Table:
        t = self.numbered("__n").frame
        return self._with(t.withColumn(name, F.when(F.col("__n") == row, F.lit(value).cast(t.schema[name].dataType)).otherwise(F.col(name))).drop("__n"))

    def sort(self, *keys: str | tuple[str, bool]) -> Table:
        """Stable, by (name, ascending) keys: nulls come last ascending and first descending. The sort is the new order, which
        every operator hands on; nothing is moved before rows are shown or taken."""
        pairs = [(k, True) if isinstance(k, str) else k for k in keys]
        self._know(*(k for k, _ in pairs))
        new = [(f"{KEY}{len(self.keys) + i}", name, up) for i, (name, up) in enumerate(pairs)]
        return Table(self.frame.withColumns({k: F.col(name) for k, name, _ in new}), keys=[*((k, up) for k, _, up in new), *self.keys])

    def take(self, n: int) -> DataFrame:
        return self.frame.orderBy(*self.order).limit(n).drop(*self.hidden)

    def gather(self, rows: Sequence[int | None]) -> Table:
        """The rows at these numbers, in the order asked for and as often; a null number gives a row of nulls. A number that the
        table doesn't have is an error when rows are asked for."""
        spark = self.frame.sparkSession
        ask = spark.createDataFrame([(i, n) for i, n in enumerate(rows)], f"{POS} long, __ask long")
        n = self.numbered("__n").frame.drop(*self.hidden)
        got = ask.join(n.where(F.col("__n").isin([r for r in rows if r is not None])), F.col("__ask") == F.col("__n"), "left")
        bad = F.raise_error(F.concat(F.lit("no row "), F.col("__ask").cast("string")))
        return Table(got.select(*self.names, F.when(F.col("__ask").isNotNull() & F.col("__n").isNull(), bad.cast("long")).otherwise(F.col(POS)).alias(POS)))

    def marked(self, rows: Sequence[int]) -> tuple[Table, Mask]:
        """The table with its rows numbered (in the hidden position), and the mask of those with these numbers."""
        t = self.dense()
        return t, Mask(t.frame[POS].isin([int(r) for r in rows]))

    def rows_of(self, mask: Mask) -> DataFrame:
        """(row) numbers for which a mask of this table holds."""
        flagged = self.frame.withColumn("__m", mask.expr)
        return ranked(self.frame.sparkSession, flagged, self.order, "row").where("__m").select("row")

    def extended_mask(self, mask: Mask, size: int, value: bool) -> tuple[Table, Mask]:
        """The table with its rows numbered, and a mask made for its first `size` rows, with `value` for the rows beyond."""
        t = Table(self.frame.withColumn("__m", mask.expr), keys=self.keys).dense()
        m = F.when(F.col(POS) < size, F.col("__m")).otherwise(F.lit(value))
        return Table(t.frame.withColumn("__m", m)), Mask(F.col("__m"))

    def append(self, *rows: Mapping[str, Any]) -> Table:
        """With these rows at the end; a name that a row leaves out is null in it, one that the table doesn't have an error."""
        for r in rows:
            self._know(*r)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in self.df.schema]).add(POS, "long")
        more = self.frame.sparkSession.createDataFrame([(*(r.get(c) for c in self.names), i) for i, r in enumerate(rows)], schema)
        return self.concat(Table(more))

    # several tables

    def join(self, other: Table, on: str, how: str = "left", validate: bool = True) -> Table:
        """Equi-join on one column of the same name and type; null matches nothing. Left joins keep the left order.

        With `validate` the right key must be unique, a second null included, which one aggregation checks now.
        """
        self._know(on)
        other._know(on)
        a, b = self.frame.schema[on].dataType, other.frame.schema[on].dataType
        if a != b:
            raise TypeMismatch(f"{on}: {a.simpleString()} and {b.simpleString()}")
        if clash := set(self.names) & set(other.names) - {on}:
            raise DuplicateColumn(", ".join(sorted(clash)))
        if validate and other.frame.groupBy(on).count().where("count > 1").limit(1).count():
            raise DuplicateKeys(on)
        if how in ("left_semi", "left_anti"):
            return self._with(self.frame.join(other.df, on, how).select(*self.frame.columns))
        if how in ("right", "full", "outer"):  # unmatched right rows come last, in the right order
            left, right = self.settled(), other.settled()
            where = F.struct(F.isnull(POS).cast("int").alias("t"), F.col(POS).alias("l"), F.col("__right").alias("r"))
        elif not validate:  # several matches stand in the right order
            left, right = self, other.settled()
            where = F.struct(F.col(POS).alias("l"), F.col("__right").alias("r"))
        else:
            left, right, where = self, other, None
        more = right.frame.select(*other.names, right.frame[POS].alias("__right")) if where is not None else right.df
        joined = left.frame.join(more, on, how)
        if where is not None:
            joined = joined.withColumn(POS, where)
        return left._with(joined.select(*self.names, *(c for c in other.names if c != on), *left.hidden))

    def group(self, by: str | Sequence[str], *aggs: Agg) -> Table:
        """Keys, then global aggregates, then for each other column the aggregates that apply to it, as column_name.
        Null is a key; groups stand in the order in which they first appear."""
        keys = [by] if isinstance(by, str) else list(by)
        self._know(*keys)
        t_ = self.settled()
        frame, p = t_.frame, t_.position
        out = [a.build(F.lit(1), T.IntegerType(), p).alias(a.name) for a in aggs if a.is_global]
        for c in self.names:
            if c not in keys:
                t = frame.schema[c].dataType
                out += [a.build(frame[c], t, p).alias(f"{c}_{a.name}") for a in aggs if not a.is_global and a.applies(t)]
        return Table(frame.groupBy(*keys).agg(*out, F.min(POS).alias(POS)))

    def group_updating(self, by: str | Sequence[str], column: str, name: str, zero: Column, update: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda s: s, chunk: int = 4096) -> Table:
        """Keys and a user's aggregate of a column, in the table's order: states start at `zero`, take in a value that is not
        null by `update`, are merged in pairs and finished. A state holds at most `chunk` rows of a key, and only states are
        merged, so a key with very many rows is spread over many tasks."""
        keys = [by] if isinstance(by, str) else list(by)
        self._know(*keys, column)
        t = self.dense().frame.withColumn("__part", F.floor(F.col(POS) / chunk))
        rows = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col(POS).alias("p"), F.col(column).alias("v")))))
        part = t.groupBy(*keys, "__part").agg(F.aggregate(rows, zero, lambda s, x: update(s, x["v"])).alias("__s"), F.min(POS).alias(POS))
        states = F.sort_array(F.collect_list(F.struct(F.col("__part").alias("p"), F.col("__s").alias("s"))))
        return Table(part.groupBy(*keys).agg(finish(F.aggregate(states, zero, lambda s, x: merge(s, x["s"]))).alias(name), F.min(POS).alias(POS)))

    def concat(self, other: Table) -> Table:
        """other's rows after these, by name. Positions of two types, or of a sorted table, are made dense first."""
        a, b = self, other
        if a.keys or b.keys or _plain(a.frame.schema[POS].dataType) != _plain(b.frame.schema[POS].dataType):
            a, b = a.dense(), b.dense()
        side = lambda t, k: t.frame.withColumn(POS, F.struct(F.lit(k).alias("t"), F.col(POS).alias("s")))
        return Table(side(a, 0).unionByName(side(b, 1)))

    def equals(self, other: Table, ordered: bool = False) -> bool:
        """The same names in order, and the same rows; with `ordered`, at the same places."""
        if self.names != other.names or [f.dataType for f in self.df.schema] != [f.dataType for f in other.df.schema]:
            return False
        a, b = (self.numbered("__n").df, other.numbered("__n").df) if ordered else (self.df, other.df)
        return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()

    # looking

    def summarize(self) -> DataFrame:
        t = self.settled()
        return summarized(t.df, t.position, t.frame)

    def text(self, rows: int = 10) -> str:
        """Names, types and the first rows as text; nulls as <nil>."""
        lines = [self.names, [self.frame.schema[c].dataType.simpleString() for c in self.names]]
        lines += [["<nil>" if v is None else str(v) for v in r] for r in self.take(rows).collect()]
        return "\n".join("\t".join(x) for x in lines)

    __str__ = text


def _plain(t: T.DataType) -> str:
    """A type without nullability."""
    return t.simpleString()
