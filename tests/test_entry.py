import importlib
import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry_mod():
    return importlib.import_module("__spark_entry__")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        path = f"{SMALL}/{f}"
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def test_entry_runs(spark, entry_mod, duck):
    df = entry_mod.entry(spark)
    assert df.count() == len(duck.sql(entry_mod.oracle_sql()["history_panel_stats"]).fetchall()) > 0
    assert {"user_id", "event_type", "event_id", "median", "iqr", "count"} <= set(df.columns)


def test_every_oracle_has_a_query(entry_mod):
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 30


@pytest.mark.parametrize("name", ["label_windows", "kaplan_meier", "split_exact", "dose_merge"])
def test_queries_run_on_smoke_data(spark, entry_mod, duck, name):
    df = entry_mod.queries()[name](spark, SMALL)
    want = duck.sql(entry_mod.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert df.count() == len(want.fetchall()) > 0
