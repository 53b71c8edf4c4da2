import duckdb
import pytest

import __spark_entry__ as entry
from tabgraph import catalogue

DIR = "/root/testdata/sf0.001"
SOME = ["filter_not_includes_nulls", "group_longest", "left_join_null_keys", "sort_two_keys_desc_nulls_first_topn", "zip_pipelines", "clustering_coefficient", "summarize_string", "session", "concat_tables", "sort_then_filter", "sort_twice", "sort_then_group", "concat_three", "gather_rows", "mask_from_positions", "mask_positions", "mask_extension", "append_rows", "group_updating_span", "table_equality"]


def test_the_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    r = c.execute(catalogue.ORACLES[name])
    at = [[x[0] for x in r.description].index(k) for k in cols]
    want = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)
    assert sorted((tuple(x[k] for k in cols) for x in df.collect()), key=str) == want
