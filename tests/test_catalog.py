"""Every query against its oracle on the smallest tables, and the driver's contract."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from kinweave.plans import catalog
from kinweave.plans.views import FILES, Views


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "<null>"
    if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)):
        return repr(round(float(x), 6))
    return str(x)


def same(df):
    df = df.reindex(sorted(df.columns), axis=1).map(plain)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in FILES:
        c.execute(f"create view {f} as select * from '{data}/{f}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_has_the_rows_of_its_oracle(spark, con, data, name):
    got = same(catalog.queries()[name](spark, data).toPandas())
    want = same(con.sql(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_oracle_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() >= 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[0] == "person_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = Views(spark, data).sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > 100")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100.0)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


@pytest.mark.parametrize("name", ["top_buyers", "connections_all", "pair_audit", "vehicle_by_tag_or_serial", "best_match", "pit_features", "golden_profile"])
def test_plans_have_no_product_of_all_rows(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
