"""Each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from gaugeloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ["events", "customer", "orders"]


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_gives_what_its_sql_gives(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = sql.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_a_query(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["win_monot", "win_coverage", "win_delta_rate", "win_slope"])
def test_windows_of_whole_series_have_no_time_frames(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "_block" in plan and "specifiedwindowframe(RangeFrame, -" not in plan
