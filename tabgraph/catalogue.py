"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabgraph.functions import scalars as S
from tabgraph.operators import aggregate as A
from tabgraph.operators.column import Mask
from tabgraph.operators.frame import Table
from tabgraph.plans import graph as G
from tabgraph.plans import knn, ordering, supersteps
from tabgraph.runtime import ranked, scratch_root, written
from tabgraph.sources.csv import read_csv
from tabgraph.streaming import events as E
from tabgraph.streaming.pipeline import Pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


KEYS = {"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",), "customer": ("c_custkey",), "documents": ("doc_id",), "events": ("event_id",), "part": ("p_partkey",)}


def table(s: SparkSession, d: str, name: str) -> Table:
    return Table.parquet(s, f"{d}/{name}.parquet", KEYS.get(name, ()))


def raw(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def rounded(c: Column, n: int = 2) -> Column:
    return F.round(c, n)


# projections and columns


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def project_columns(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").df


@query("SELECT o_orderkey AS key, o_custkey AS customer, o_orderstatus AS state FROM orders")
def rename_columns(s, d):
    return table(s, d, "orders").named("key", "customer", "o_orderstatus").rename("o_orderstatus", "state").df


@query("SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS twice FROM orders")
def assign_column(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").assign(twice=F.col("o_totalprice") * 2).df


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(s, d):
    return table(s, d, "orders").drop("o_orderdate", "o_orderpriority").drop("absent", strict=False).df


def _compare(name: str, op: Callable, sql: str) -> None:
    def fn(s, d):
        t = table(s, d, "lineitem")
        return t.where(op(t["l_quantity"], 24.0)).select("l_orderkey", "l_linenumber", "l_quantity").df

    fn.__name__ = f"filter_scalar_{name}"
    query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {sql} 24")(fn)


for _name, _op, _sql in (("eq", lambda a, b: a == b, "="), ("ne", lambda a, b: a != b, "<>"), ("lt", lambda a, b: a < b, "<"), ("le", lambda a, b: a <= b, "<="), ("gt", lambda a, b: a > b, ">"), ("ge", lambda a, b: a >= b, ">=")):
    _compare(_name, _op, _sql)


def _holed(s, d) -> Table:
    """Orders with nulls in two columns."""
    return table(s, d, "orders").assign(o_orderstatus=F.nullif(F.col("o_orderstatus"), F.lit("F")), o_custkey=F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")))


HOLED = "(SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders)"


@query(f"SELECT o_orderkey, o_orderstatus FROM {HOLED} WHERE NOT coalesce(o_orderstatus = 'O', false)")
def filter_not_includes_nulls(s, d):
    t = _holed(s, d)
    return t.where(~(t["o_orderstatus"] == "O")).select("o_orderkey", "o_orderstatus").df


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 OR l_discount = 0")
def mask_union(s, d):
    t = table(s, d, "lineitem")
    return t.where((t["l_quantity"] > 45) | (t["l_discount"] == 0.0)).select("l_orderkey", "l_linenumber").df


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount = 0")
def mask_intersect(s, d):
    t = table(s, d, "lineitem")
    return t.where((t["l_quantity"] > 45) & (t["l_discount"] == 0.0)).select("l_orderkey", "l_linenumber").df


@query("SELECT count(*) FILTER (l_quantity > 45) AS many, count(*) FILTER (NOT l_quantity > 45) AS few, count(*) AS n FROM lineitem")
def mask_counts(s, d):
    t = table(s, d, "lineitem")
    m = t["l_quantity"] > 45
    return t.frame.agg(m.count().alias("many"), (~m).count().alias("few"), Mask.all(True).count().alias("n"))


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM {HOLED} WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL")
def drop_nils_any(s, d):
    return _holed(s, d).select("o_orderkey", "o_custkey", "o_orderstatus").drop_nils().df


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM {HOLED} WHERE o_custkey IS NOT NULL")
def drop_nils_subset(s, d):
    return _holed(s, d).select("o_orderkey", "o_custkey", "o_orderstatus").drop_nils("o_custkey").df


@query(f"SELECT o_orderkey, coalesce(o_custkey, -1) AS o_custkey, coalesce(o_orderstatus, '?') AS o_orderstatus FROM {HOLED}")
def fill_nils(s, d):
    return _holed(s, d).select("o_orderkey", "o_custkey", "o_orderstatus").fill_nils(o_custkey=-1, o_orderstatus="?").df


@query(f"SELECT count(*) FILTER (o_custkey IS NULL) AS nils, count(o_custkey) AS others FROM {HOLED}")
def nil_mask_counts(s, d):
    t = _holed(s, d)
    return t.frame.agg(t["o_custkey"].nils().count().alias("nils"), t["o_custkey"].non_nils().count().alias("others"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def tmap_revenue(s, d):
    t = table(s, d, "lineitem")
    return t.assign(revenue=t.tmap(["l_extendedprice", "l_discount"], lambda p, x: p * (1 - x))).select("l_orderkey", "l_linenumber", "revenue").df


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus IS NOT NULL THEN o_orderstatus || '!' END AS marked, CASE WHEN o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL THEN o_custkey + length(o_orderstatus) END AS both FROM {HOLED}")
def map_null_propagation(s, d):
    t = _holed(s, d)
    return t.assign(marked=t["o_orderstatus"].mapped(lambda c: F.concat(F.coalesce(c, F.lit("x")), F.lit("!"))), both=t.tmap(["o_custkey", "o_orderstatus"], lambda a, b: a + F.length(b))).select("o_orderkey", "marked", "both").df


@query("SELECT count(*) FILTER (v = 0) AS zero, count(*) FILTER (isinf(v)) AS infinite, count(*) FILTER (isfinite(v)) AS finite, count(*) FILTER (isnan(v)) AS nan FROM (SELECT CASE WHEN l_linenumber = 1 THEN 0::DOUBLE WHEN l_linenumber = 2 THEN 'inf'::DOUBLE WHEN l_linenumber = 3 THEN 'nan'::DOUBLE ELSE l_quantity END AS v FROM lineitem)")
def property_masks(s, d):
    n = F.col("l_linenumber")
    t = table(s, d, "lineitem").assign(v=F.when(n == 1, 0.0).when(n == 2, float("inf")).when(n == 3, float("nan")).otherwise(F.col("l_quantity")))
    return t.frame.agg(*(t["v"].having(f"is_{k}").count().alias(k) for k in ("zero", "infinite", "finite", "nan")))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n = 17")
def element_by_position(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").numbered("n").frame.where("n = 17").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) = 4 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def set_element(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus").with_element("o_orderstatus", 3, "Z").df


@query("SELECT NOT EXISTS (FROM customer EXCEPT ALL FROM customer) AS same, NOT EXISTS (FROM customer EXCEPT ALL SELECT * REPLACE (c_acctbal + 1 AS c_acctbal) FROM customer) AS other")
def table_equality(s, d):
    a = table(s, d, "customer")
    return s.createDataFrame([(a.equals(table(s, d, "customer"), ordered=True), a.equals(a.assign(c_acctbal=F.col("c_acctbal") + 1)))], "same boolean, other boolean")


# aggregation


@query("SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 2) AS l_quantity_mean, round(sum(l_extendedprice), 2) AS l_extendedprice_sum, round(avg(l_extendedprice), 2) AS l_extendedprice_mean FROM lineitem WHERE l_quantity > 24 GROUP BY l_returnflag ORDER BY l_returnflag")
def group_sum_mean_count(s, d):
    t = table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    g = t.where(t["l_quantity"] > 24).group("l_returnflag", A.count, A.sum, A.mean)
    g = g.assign(**{c: rounded(F.col(c)) for c in g.names[2:]})
    return g.sort("l_returnflag").ordered()


@query("SELECT l_returnflag, l_linestatus, count(*) AS count, sum(l_linenumber)::BIGINT AS l_linenumber_sum FROM lineitem GROUP BY ALL")
def group_multi_key(s, d):
    return table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").group(["l_returnflag", "l_linestatus"], A.count, A.sum).df


@query(f"SELECT o_orderstatus, count(*) AS count, sum(o_custkey)::BIGINT AS o_custkey_sum FROM {HOLED} GROUP BY 1")
def group_null_key(s, d):
    return _holed(s, d).select("o_orderstatus", "o_custkey").group("o_orderstatus", A.count, A.sum).df


@query(f"SELECT o_orderpriority, count(*) FILTER (o_custkey IS NULL) AS o_custkey_nils_count, count(o_custkey) AS o_custkey_non_nils_count, count(*) FILTER (o_orderstatus IS NULL) AS o_orderstatus_nils_count, count(o_orderstatus) AS o_orderstatus_non_nils_count FROM {HOLED} GROUP BY 1")
def group_nils_counts(s, d):
    return _holed(s, d).select("o_orderpriority", "o_custkey", "o_orderstatus").group("o_orderpriority", A.count_nils, A.count_non_nils).df


@query("SELECT lang, arg_min(text, (-length(text), doc_id)) AS text_longest FROM documents GROUP BY 1")
def group_longest(s, d):
    return table(s, d, "documents").select("lang", "text").group("lang", A.longest).df


@query("SELECT o_orderstatus, 0::BIGINT AS v_sum, 'nan'::DOUBLE AS v_mean FROM orders GROUP BY 1")
def group_all_null_sum_zero(s, d):
    return table(s, d, "orders").select("o_orderstatus").assign(v=F.lit(None).cast("long")).group("o_orderstatus", A.sum, A.mean).df


@query("SELECT lang, round(avg(length(text)), 4) AS text_average_length, round(avg(length(source)), 4) AS source_average_length FROM documents GROUP BY 1")
def group_custom_avg_length(s, d):
    average = A.custom("average_length", lambda c: F.round(F.avg(F.char_length(c)), 4), A.is_string)
    return table(s, d, "documents").select("lang", "text", "source").group("lang", average).df


@query("SELECT o_orderstatus, row_number() OVER (ORDER BY first) - 1 AS place FROM (SELECT o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY 1)")
def group_first_appearance(s, d):
    return table(s, d, "orders").select("o_orderstatus", "o_totalprice").group("o_orderstatus", A.count).select("o_orderstatus").numbered("place").df


@query("SELECT round(sum(o_totalprice), 2) AS sum, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 2) AS mean FROM orders")
def column_reductions(s, d):
    c = table(s, d, "orders")["o_totalprice"]
    return s.createDataFrame([(round(c.sum(), 2), c.min(), c.max(), round(c.mean(), 2))], "sum double, min double, max double, mean double")


@query(f"SELECT round(sum(o_custkey) / count(*), 4) AS avg, round(avg(o_custkey), 4) AS mean FROM {HOLED}")
def column_avg_including_nulls(s, d):
    c = _holed(s, d)["o_custkey"]
    return s.createDataFrame([(round(c.avg(), 4), round(c.mean(), 4))], "avg double, mean double")


def _summary(s, d, name: str, columns: list[str], fields: list[str]) -> DataFrame:
    t = table(s, d, name).select(*columns).summarize()
    return t.select("column", "row_count", "missing_count", *(F.round(f, 2).alias(f) if dict(t.dtypes)[f] == "double" else F.col(f) for f in fields))


def _numeric_sql(c: str, name: str) -> str:
    return f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS missing_count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(sum({c})::DOUBLE, 2) AS sum, round(avg({c}), 2) AS mean, round(stddev_pop({c}), 2) AS stddev, count(*) FILTER ({c} = 0) AS zero_count, count(*) FILTER ({c} > 0) AS positive_count FROM {name}"


@query(" UNION ALL ".join(_numeric_sql(c, "lineitem") for c in ("l_linenumber", "l_quantity", "l_discount")))
def summarize_numeric(s, d):
    return _summary(s, d, "lineitem", ["l_linenumber", "l_quantity", "l_discount"], ["min", "max", "sum", "mean", "stddev", "zero_count", "positive_count"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS missing_count, min({c}) AS min_string, max({c}) AS max_string, arg_min({c}, (-length({c}), c_custkey)) AS longest, arg_min({c}, (length({c}), c_custkey)) AS shortest, round(avg(length({c})), 2) AS average_length, count(*) FILTER (NOT regexp_matches({c}, '[^\\x00-\\x7F]')) AS ascii_count FROM customer" for c in ("c_name", "c_mktsegment")))
def summarize_string(s, d):
    return _summary(s, d, "customer", ["c_name", "c_mktsegment"], ["min_string", "max_string", "longest", "shortest", "average_length", "ascii_count"])


@query("SELECT 'rich' AS \"column\", count(*) AS row_count, 0::BIGINT AS missing_count, count(*) FILTER (c_acctbal > 0) AS true_count, count(*) FILTER (NOT c_acctbal > 0) AS false_count FROM customer")
def summarize_bool(s, d):
    t = table(s, d, "customer").assign(rich=F.col("c_acctbal") > 0).select("rich").summarize()
    return t.select("column", "row_count", "missing_count", "true_count", "false_count")


# joins


def _customers(s, d) -> Table:
    return table(s, d, "customer").rename("c_custkey", "o_custkey").select("o_custkey", "c_name", "c_nationkey")


@query("SELECT o_custkey, o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_join_unique(s, d):
    return table(s, d, "orders").select("o_custkey", "o_orderkey").join(_customers(s, d), "o_custkey").df


@query(f"SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM {HOLED} LEFT JOIN customer ON o_custkey = c_custkey")
def left_join_null_keys(s, d):
    return _holed(s, d).select("o_orderkey", "o_custkey").join(_customers(s, d), "o_custkey").df


@query("SELECT r_name, count(*) AS count, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join_chain(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_totalprice").join(_customers(s, d), "o_custkey").rename("c_nationkey", "n_nationkey")
    n = o.join(table(s, d, "nation"), "n_nationkey").rename("n_regionkey", "r_regionkey").join(table(s, d, "region"), "r_regionkey")
    g = n.select("r_name", "o_totalprice").group("r_name", A.count, A.sum)
    return g.assign(total=rounded(F.col("o_totalprice_sum"))).select("r_name", "count", "total").df


def _how(name: str, how: str, sql: str) -> None:
    """Orders with the suppliers of the same number, of which there are fewer."""

    def fn(s, d):
        other = table(s, d, "supplier").rename("s_suppkey", "o_custkey").select("o_custkey", "s_name")
        return table(s, d, "orders").select("o_custkey", "o_orderkey").join(other, "o_custkey", how).df

    fn.__name__ = name
    query(sql)(fn)


_OTHER = "(SELECT s_suppkey AS o_custkey, s_name FROM supplier)"
_how("inner_join", "inner", f"SELECT o_custkey, o_orderkey, s_name FROM orders JOIN {_OTHER} USING (o_custkey)")
_how("right_join", "right", f"SELECT o_custkey, o_orderkey, s_name FROM (SELECT o_custkey, o_orderkey FROM orders) RIGHT JOIN {_OTHER} USING (o_custkey)")
_how("full_join", "full", f"SELECT o_custkey, o_orderkey, s_name FROM (SELECT o_custkey, o_orderkey FROM orders) FULL JOIN {_OTHER} USING (o_custkey)")
_how("semi_join", "left_semi", f"SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM {_OTHER})")
_how("anti_join", "left_anti", f"SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM {_OTHER})")


@query("SELECT e.event_id, e.user_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id")
def asof_join(s, d):
    """Last purchase of the same user up to each event: a running maximum, without a range join."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return raw(s, d, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w).alias("last_purchase"))


# sorts


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def sort_one_key_topn(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").sort("o_totalprice").take(50)


@query(f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {HOLED} ORDER BY o_orderstatus DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey LIMIT 50")
def sort_two_keys_desc_nulls_first_topn(s, d):
    return _holed(s, d).select("o_orderkey", "o_orderstatus", "o_totalprice").sort(("o_orderstatus", False), ("o_totalprice", True)).take(50)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey DESC NULLS FIRST, o_orderkey) - 1 AS place FROM {HOLED}")
def sort_positions(s, d):
    return _holed(s, d).select("o_orderkey", "o_custkey").sort(("o_custkey", False)).numbered("place").select("o_orderkey", "place").df


def _placed(t: Table, *names: str) -> DataFrame:
    return t.numbered("place").select("place", *names).df


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus = 'O'")
def sort_then_filter(s, d):
    t = table(s, d, "orders").sort(("o_totalprice", False))
    return _placed(t.where(t["o_orderstatus"] == "O").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC NULLS FIRST, o_orderkey) - 1 AS place FROM orders")
def sort_twice(s, d):
    return _placed(table(s, d, "orders").sort(("o_totalprice", False)).sort("o_orderpriority"), "o_orderkey")


@query("SELECT o_custkey, n AS count, row_number() OVER (ORDER BY price DESC, key) - 1 AS place FROM (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS price, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS key FROM orders GROUP BY 1)")
def sort_then_group(s, d):
    t = table(s, d, "orders").sort(("o_totalprice", False)).select("o_custkey").group("o_custkey", A.count)
    return _placed(t, "o_custkey", "count")


@query("SELECT key, row_number() OVER (ORDER BY part, place, key) - 1 AS place FROM (SELECT 0 AS part, c_acctbal AS place, c_custkey AS key FROM customer UNION ALL SELECT 1, 0, o_orderkey FROM orders UNION ALL SELECT 2, -c_acctbal, c_custkey FROM customer)")
def concat_three(s, d):
    c = table(s, d, "customer")
    key = lambda t, k: t.select(k).named("key")
    return _placed(key(c.sort("c_acctbal"), "c_custkey").concat(key(table(s, d, "orders"), "o_orderkey")).concat(key(c.sort(("c_acctbal", False)), "c_custkey")), "key")


@query("SELECT k.i AS place, o_orderkey, o_totalprice FROM (VALUES (0, 5), (1, 0), (2, NULL), (3, 5), (4, 99)) k(i, n) LEFT JOIN (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS n FROM orders) o ON o.n = k.n")
def gather_rows(s, d):
    return _placed(table(s, d, "orders").sort("o_totalprice").gather([5, 0, None, 5, 99]).select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS n FROM orders) WHERE n NOT IN (0, 3, 4)")
def mask_from_positions(s, d):
    t, m = table(s, d, "orders").sort("o_totalprice").marked([0, 3, 4])
    return t.where(~m).select("o_orderkey").df


@query("SELECT n AS row FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE o_orderstatus = 'F'")
def mask_positions(s, d):
    t = table(s, d, "orders")
    return t.rows_of(t["o_orderstatus"] == "F")


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n >= 1000 OR o_orderstatus = 'F'")
def mask_extension(s, d):
    t = table(s, d, "orders")
    e, m = t.extended_mask(t["o_orderstatus"] == "F", 1000, True)
    return e.where(m).select("o_orderkey").df


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY part, c_custkey) - 1 AS place FROM (SELECT 0 AS part, c_custkey, c_name FROM customer UNION ALL SELECT 1, NULL, 'last')")
def append_rows(s, d):
    return _placed(table(s, d, "customer").select("c_custkey", "c_name").append({"c_name": "last"}), "c_custkey", "c_name")


@query("SELECT o_custkey, max(o_orderkey) - min(o_orderkey) AS span FROM orders GROUP BY 1")
def group_updating_span(s, d):
    """A user's aggregate by updates and merges of states (least, greatest)."""
    none = F.lit(None).cast("long")
    of = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    both = lambda x, y: of(F.least(x["lo"], y["lo"]), F.greatest(x["hi"], y["hi"]))
    return table(s, d, "orders").group_updating("o_custkey", "o_orderkey", "span", of(none, none), lambda x, v: both(x, of(v, v)), both, lambda x: x["hi"] - x["lo"]).df


# pipelines over events in order of event_id


def _events(s, d) -> Pipeline:
    return Pipeline.of(raw(s, d, "events").select("event_id", "user_id", "value"), "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS index FROM events")
def enumerated(s, d):
    return _events(s, d).map(F.col("event_id")).enumerated().df()


@query("SELECT a.event_id AS first, b.event_id AS second FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) a JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE user_id % 2 = 0) b USING (n)")
def zip_pipelines(s, d):
    p = _events(s, d)
    return p.zip(p.filter(F.col("user_id") % 2 == 0)).map(F.col("left.event_id").alias("first"), F.col("right.event_id").alias("second")).df()


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def take_first(s, d):
    return _events(s, d).map(F.col("event_id")).take(100).df()


@query("SELECT event_id FROM events ORDER BY event_id OFFSET 100")
def drop_first(s, d):
    return _events(s, d).map(F.col("event_id")).drop(100).df()


@query("SELECT min(event_id) AS first, count(*) AS n, sum(user_id)::BIGINT AS users FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) GROUP BY n // 64")
def reduce_window_sum(s, d):
    return _events(s, d).reduce_window(64, F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users")).df()


@query("SELECT list(event_id ORDER BY event_id)::VARCHAR AS ids FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events) GROUP BY n // 16")
def batch_arrays(s, d):
    b = _events(s, d).map(F.col("event_id")).batch(16, "event_id").df()
    return b.select(F.concat(F.lit("["), F.array_join(F.col("event_id").cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query("SELECT event_id + k AS value FROM events, range(3) t(k)")
def interleave_rows(s, d):
    e = F.col("event_id")
    return _events(s, d).interleave(F.array(e, e + 1, e + 2), 4).df()


@query("SELECT event_id, value * 2 AS twice FROM events WHERE value > 0")
def pipeline_map_filter(s, d):
    return _events(s, d).filter(F.col("value") > 0).map(F.col("event_id"), (F.col("value") * 2).alias("twice")).df()


@query("SELECT event_id AS value FROM events WHERE user_id % 5 = 0")
def compact_map(s, d):
    return _events(s, d).compact_map(F.when(F.col("user_id") % 5 == 0, F.col("event_id"))).df()


@query("SELECT 1 + 2 * i AS value FROM range(1000) t(i)")
def range_step(s, d):
    return Pipeline.range(s, 1, 2000, 2).df()


@query("SELECT event_id FROM events")
def shuffled_pipeline(s, d):
    return _events(s, d).map(F.col("event_id")).shuffled(7).df()


@query("SELECT event_type, list(event_id ORDER BY event_id)::VARCHAR AS ids FROM events GROUP BY 1")
def grouped_lists(s, d):
    g = S.grouped_lists(raw(s, d, "events"), "event_type", "event_id", "event_id")
    return g.select("event_type", F.concat(F.lit("["), F.array_join(F.col("event_id").cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query("SELECT o_orderkey, try_cast(trim(' ' || o_custkey || ' ') AS BIGINT) AS whole, CASE WHEN o_custkey % 3 = 0 THEN true WHEN o_custkey % 3 = 1 THEN false END AS flag FROM orders")
def parse_text(s, d):
    k = F.col("o_custkey")
    text = F.when(k % 3 == 0, " TRUE").when(k % 3 == 1, "f ").otherwise("yes")
    return raw(s, d, "orders").select("o_orderkey", S.parse_int(F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).alias("whole"), S.parse_bool(text).alias("flag"))


@query()
def sample_without_replacement(s, d):
    return S.sample_rows(raw(s, d, "orders").select("o_orderkey"), 100, 3)


# graphs


def supply(s, d) -> G.Graph:
    """Suppliers (negative ids) and parts, an edge for each line item."""
    return G.Graph.from_edges(raw(s, d, "lineitem").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")))


SUPPLY = "(SELECT -l_suppkey AS src, l_partkey AS dst FROM lineitem)"


def moves(s, d) -> DataFrame:
    """An edge from each event's user to the next event's."""
    e = ranked(s, raw(s, d, "events").select("event_id", "user_id"), [F.col("event_id")], "n")
    after = e.select((F.col("n") - 1).alias("n"), F.col("user_id").alias("dst"))
    return e.join(after, "n").select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), "dst")


MOVES = "(SELECT * FROM (SELECT event_id AS eid, user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


def users(s, d) -> G.Graph:
    """All moves are edges; users are the vertices."""
    e = written(s, moves(s, d), "moves").withColumn("w", (F.col("eid") % 5 + 1).cast("double"))
    return G.Graph(raw(s, d, "events").select(F.col("user_id").alias("id")).distinct(), e)


USERS = f"(SELECT *, (eid % 5 + 1)::DOUBLE AS w FROM {MOVES})"
VERTICES = "(SELECT DISTINCT user_id AS id FROM events)"


@query(f"SELECT degree, count(*) AS frequency FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {SUPPLY} UNION ALL SELECT dst FROM {SUPPLY}) GROUP BY id) GROUP BY degree")
def degree_distribution(s, d):
    return supply(s, d).distribution().select("degree", "frequency")


@query(f"SELECT degree, count(*) AS frequency FROM (SELECT v.id, count(e.dst) AS degree FROM (SELECT src AS id FROM {SUPPLY} UNION SELECT dst FROM {SUPPLY}) v LEFT JOIN {SUPPLY} e ON e.dst = v.id GROUP BY v.id) GROUP BY degree")
def in_degree_distribution(s, d):
    return supply(s, d).distribution("in_degree").select("degree", "frequency")


@query(f"SELECT coalesce(max(n) > 1, false) AS found FROM (SELECT count(*) AS n FROM {SUPPLY} GROUP BY src, dst)")
def has_parallel_edges(s, d):
    return supply(s, d).has_parallel_edges()


@query(f"SELECT coalesce(bool_or(src = dst), false) AS found FROM {MOVES}")
def self_edges(s, d):
    return G.Graph.from_edges(moves(s, d)).has_loops()


@query(f"SELECT eid, dst AS src, src AS dst FROM {MOVES}")
def transpose_edges(s, d):
    return G.Graph.from_edges(moves(s, d)).transposed().edges


@query(f"SELECT eid, src, dst FROM {MOVES} WHERE src <> dst")
def exclude_self_loops(s, d):
    return G.Graph.from_edges(moves(s, d)).without_loops().edges


@query(f"SELECT eid, src, dst FROM {MOVES} WHERE src <= dst")
def unique_undirected(s, d):
    return G.Graph.from_edges(moves(s, d)).unique_undirected().edges


@query(f"SELECT eid, src, dst FROM {MOVES} WHERE NOT (src % 10 = 0 OR dst % 10 = 0)")
def remove_edges_by_predicate(s, d):
    return G.Graph.from_edges(moves(s, d)).remove_edges((F.col("src") % 10 == 0) | (F.col("dst") % 10 == 0)).edges


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM {USERS} WHERE src <> dst), l AS (SELECT src, dst FROM {USERS} WHERE src <> dst), k AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT a.src AS id, count(*) AS m FROM e a JOIN l ON l.src = a.dst JOIN e b ON b.src = a.src AND b.dst = l.dst GROUP BY 1) SELECT v.id, coalesce(n, 0) AS neighbours, coalesce(m, 0) AS inside, round(CASE WHEN n > 1 THEN coalesce(m, 0) / (n * (n - 1)) ELSE 0 END, 6) AS coefficient FROM {VERTICES} v LEFT JOIN k ON k.id = v.id LEFT JOIN i ON i.id = v.id")
def clustering_coefficient(s, d):
    return users(s, d).clustering().withColumn("coefficient", F.round("coefficient", 6))


@query(f"SELECT v.id, coalesce(sum(w), 0)::DOUBLE AS total FROM {VERTICES} v LEFT JOIN {USERS} e ON e.dst = v.id GROUP BY v.id")
def incoming_weight_sum(s, d):
    return supersteps.incoming_weights(users(s, d))


_START = f"(SELECT min(src) FROM {USERS})"


def _start(g: G.Graph) -> int:
    return g.edges.agg(F.min("src")).first()[0]


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {USERS}), b(id, depth) USING KEY (id) AS (SELECT {_START}, 0 UNION SELECT e.dst, min(b.depth) + 1 FROM b JOIN e ON e.src = b.id LEFT JOIN recurring.b AS r ON r.id = e.dst WHERE r.id IS NULL GROUP BY e.dst) SELECT id, depth::INTEGER AS depth FROM b")
def bfs_depths(s, d):
    g = users(s, d)
    return supersteps.breadth_first(s, g, [_start(g)]).select("id", "depth")


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {USERS}), b(id) AS (SELECT {_START} UNION SELECT e.dst FROM b JOIN e ON e.src = b.id) SELECT v.id, b.id IS NOT NULL AS reachable FROM {VERTICES} v LEFT JOIN b ON b.id = v.id")
def transitive_closure(s, d):
    g = users(s, d)
    return supersteps.closure(s, g, [_start(g)]).state


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM {USERS} GROUP BY ALL), b(id, distance) USING KEY (id) AS (SELECT {_START}, 0::DOUBLE UNION SELECT e.dst, min(b.distance + e.w) FROM b JOIN e ON e.src = b.id LEFT JOIN recurring.b AS r ON r.id = e.dst GROUP BY e.dst HAVING min(b.distance + e.w) < coalesce(any_value(r.distance), 'inf'::DOUBLE)) SELECT v.id, coalesce(b.distance, 'inf'::DOUBLE) AS distance FROM {VERTICES} v LEFT JOIN b ON b.id = v.id")
def shortest_paths(s, d):
    g = users(s, d)
    return supersteps.shortest_paths(s, g, _start(g), "w").state.select("id", "distance")


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {USERS}), b(id) AS (SELECT {_START} UNION SELECT e.dst FROM b JOIN e ON e.src = b.id) SELECT v.id, CASE WHEN b.id IS NULL THEN 'inf'::DOUBLE ELSE 0::DOUBLE END AS distance FROM {VERTICES} v LEFT JOIN b ON b.id = v.id")
def wave_reachability(s, d):
    g = users(s, d)
    return supersteps.reached(s, g, _start(g)).state.select("id", "distance")


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {MOVES} WHERE src < dst), b(id, layer) USING KEY (id) AS (SELECT id, 0 FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) UNION SELECT e.dst, max(b.layer + 1) FROM b JOIN e ON e.src = b.id JOIN recurring.b AS r ON r.id = e.dst GROUP BY e.dst HAVING max(b.layer + 1) > any_value(r.layer)) SELECT id, layer::INTEGER AS layer FROM b")
def topological_layers(s, d):
    return ordering.layers_any(s, G.Graph.from_edges(moves(s, d).where("src < dst")))


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {USERS}), r(a, b) AS (SELECT id, id FROM {VERTICES} UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS id, min(x.b) AS label FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def scc_labels_min_id(s, d):
    return ordering.strong_labels(s, users(s, d))


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {USERS}), r(a, b) AS (SELECT id, id FROM {VERTICES} UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), l AS (SELECT min(x.b) AS label FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), n AS (SELECT count(*) AS n FROM l GROUP BY label) SELECT count(*) AS components, max(n) AS largest, count(*) <= 1 AS strongly_connected FROM n")
def strong_summary(s, d):
    return ordering.strong_summary(s, users(s, d))


@query(f"SELECT arg_min(degree, (-n, degree)) AS mode, max(degree) AS maximum, round(sum(degree * n) / sum(n), 6) AS average FROM (SELECT degree, count(*) AS n FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM {SUPPLY} UNION ALL SELECT dst FROM {SUPPLY}) GROUP BY id) GROUP BY degree)")
def degree_summary(s, d):
    return supply(s, d).degree_summary().withColumn("average", F.round("average", 6))


@query()
def breadth_first_events(s, d):
    g = users(s, d)
    return ordering.search_events(g, [_start(g)])


@query()
def distance_search_events(s, d):
    g = users(s, d)
    return ordering.search_events(g, [_start(g)], weight="w")


@query()
def strong_components_numbered(s, d):
    return ordering.strong_components_any(s, users(s, d))


@query()
def depth_first_events(s, d):
    return ordering.depth_first(users(s, d))


@query()
def topological_order(s, d):
    e = moves(s, d).where("src < dst")
    return ordering.topological_any(s, G.Graph.from_edges(e))


@query("SELECT src, dst FROM (SELECT i AS src, (i + k) % 50 AS dst FROM range(50) a(i), range(1, 5) b(k))")
def generators_circle(s, d):
    return G.circle(s, 50, 4).edges


@query("SELECT i AS src, j AS dst FROM range(10) a(i), range(10) b(j) WHERE i <> j UNION ALL SELECT i, i + 1 FROM range(9, 14) t(i) UNION ALL SELECT i + 1, i FROM range(9, 14) t(i)")
def generators_lollipop(s, d):
    return G.lollipop(s, 10, 5).edges


@query("SELECT i AS src, 0::BIGINT AS dst FROM range(20) t(i)")
def generators_star(s, d):
    return G.star(s, 20).edges


@query("SELECT i AS src, j AS dst FROM range(12) a(i), range(12) b(j)")
def generators_complete(s, d):
    return G.complete(s, 12).edges


@query("SELECT x AS sx, y AS sy, x + a AS dx, y + b AS dy FROM range(6) p(x), range(4) q(y), (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(a, b) WHERE x + a BETWEEN 0 AND 5 AND y + b BETWEEN 0 AND 3")
def grid_edges(s, d):
    return G.grid(s, 6, 4)


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {USERS}), b(root, id, depth) USING KEY (root, id) AS (SELECT id, id, 0 FROM {VERTICES} UNION SELECT b.root, e.dst, min(b.depth) + 1 FROM b JOIN e ON e.src = b.id LEFT JOIN recurring.b AS r ON r.root = b.root AND r.id = e.dst WHERE r.id IS NULL GROUP BY b.root, e.dst), p AS (SELECT root, max(depth) AS far, sum(depth) AS total, count(*) - 1 AS reached FROM b GROUP BY root), q AS (SELECT * FROM p WHERE reached > (SELECT count(*) FROM {VERTICES}) // 4 OR root = (SELECT min(id) FROM {VERTICES})) SELECT sum(total)::DOUBLE / sum(reached) AS average_path_length, max(far)::BIGINT AS diameter, min(far)::BIGINT AS radius, count(*) FILTER (far = (SELECT max(far) FROM q)) AS peripheral, count(*) FILTER (far = (SELECT min(far) FROM q)) AS central FROM q")
def distance_metrics(s, d):
    return users(s, d).distance_metrics(s).drop("central_vertex", "peripheral_vertex")


def _points(s, d) -> DataFrame:
    return raw(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query("SELECT src, dst, rank, round(similarity, 5) AS similarity FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id)::INTEGER AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5")
def exact_knn(s, d):
    p = _points(s, d)
    return knn.exact(p, 5, "cosine", p.where("id % 20 = 0")).select("src", "dst", "rank", F.round("similarity", 5).alias("similarity"))


@cache
def _knn_sql(k: int) -> str:
    return f"(SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r <= {k})"


@query(f"WITH e AS MATERIALIZED {_knn_sql(4)}, s AS (SELECT vec_id AS id, label, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id % 10 = 0), h AS (SELECT dst AS id, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.id = e.src) THEN 1 ELSE 0 END) AS m, sum(w) AS total FROM e GROUP BY dst), g AS (SELECT dst AS id, label, sum(w * score) AS got FROM e JOIN s ON s.id = e.src GROUP BY ALL), f AS (SELECT coalesce(g.id, s.id) AS id, coalesce(g.label, s.label) AS label, g.got, s.score AS seed FROM g FULL JOIN (SELECT s.* FROM s JOIN (SELECT DISTINCT id FROM g) k ON k.id = s.id) s ON g.id = s.id AND g.label = s.label) SELECT f.id, f.label, round((coalesce(seed, 0) + 0.01 * coalesce(got, 0)) / (CASE WHEN seed IS NULL THEN 0 ELSE 1 END + 0.01 * total + 0.01), 6) AS score FROM f JOIN h ON h.id = f.id UNION ALL SELECT s.id, s.label, s.score FROM s WHERE s.id NOT IN (SELECT id FROM g)")
def label_propagation_one_update(s, d):
    p = _points(s, d)
    e = knn.exact(p, 4, "cosine").select("src", "dst", F.lit(1.0).alias("w"))
    seeds = raw(s, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), "label", F.lit(1.0).alias("score"))
    out = supersteps.label_propagation(s, G.Graph(p.select("id"), e), seeds, seeds.where("false"), 2)
    return out.select("id", "label", F.round("score", 6).alias("score"))


@query()
def label_propagation_ten_steps(s, d):
    p = _points(s, d)
    e = knn.exact(p, 4, "cosine").select("src", "dst", F.lit(0.5).alias("w"))
    seeds = raw(s, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("id"), "label", F.lit(1.0).alias("score"))
    return supersteps.label_propagation(s, G.Graph(p.select("id"), e), seeds, seeds.where("false"), 10)


@query()
def approx_knn(s, d):
    p = _points(s, d)
    return knn.walked(s, p, p.where("id % 20 = 0"), 5, 10, "cosine")


# CSV


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def csv_roundtrip_sniff(s, d):
    path = f"{scratch_root(s)}/csv-{abs(hash((d, id(s))))}"
    raw(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.mode("overwrite").csv(path, header=True)
    return read_csv(s, path).df


# set operations, grouping sets, windows: what plain Spark adds


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(s, d):
    return raw(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


def _set(name: str, op: Callable, sql: str) -> None:
    def fn(s, d):
        return op(raw(s, d, "customer").select(F.col("c_nationkey").alias("n"), (F.col("c_acctbal") > 0).alias("rich")), raw(s, d, "supplier").select(F.col("s_nationkey").alias("n"), (F.col("s_acctbal") > 5000).alias("rich")))

    fn.__name__ = name
    query(f"SELECT c_nationkey AS n, c_acctbal > 0 AS rich FROM customer {sql} SELECT s_nationkey, s_acctbal > 5000 FROM supplier")(fn)


_set("union_all", lambda a, b: a.unionByName(b), "UNION ALL")
_set("union_distinct", lambda a, b: a.unionByName(b).distinct(), "UNION")
_set("intersect_sets", lambda a, b: a.intersect(b), "INTERSECT")
_set("except_sets", lambda a, b: a.exceptAll(b), "EXCEPT ALL")


@query("SELECT o_orderkey AS key FROM orders UNION ALL SELECT c_custkey FROM customer")
def concat_tables(s, d):
    return table(s, d, "orders").select("o_orderkey").named("key").concat(table(s, d, "customer").select("c_custkey").named("key")).df


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(s, d):
    return raw(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(s, d):
    return raw(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders QUALIFY rank <= 3")
def window_rank(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return raw(s, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


# event time


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(s, d):
    return E.windowed(raw(s, d, "events"), "1 hour", None, None, "event_type")


@query("SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS w, value FROM events, range(2) t(k)) GROUP BY ALL")
def sliding(s, d):
    return E.windowed(raw(s, d, "events"), "1 hour", "30 minutes")


@query("SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k")
def session(s, d):
    return E.sessions(raw(s, d, "events"), "30 minutes")
