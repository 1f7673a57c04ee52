import duckdb
import pytest

import __spark_entry__ as registered

ROOT = "/root/testdata/sf0.01"


def test_pricing_summary_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{ROOT}/lineitem.parquet')")
    want = sorted(con.sql(registered.oracle_sql()["pricing_summary"]).fetchall())
    got = sorted(tuple(r) for r in registered.queries()["pricing_summary"](spark, ROOT).collect())
    assert [r[:2] + r[5:] for r in got] == [r[:2] + r[5:] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[2:5] == pytest.approx(b[2:5], rel=1e-9)


def test_entry(spark):
    assert registered.entry(spark).count() == 6


def test_filter_reaches_the_scan(spark):
    plan = registered.queries()["pricing_summary"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(l_shipdate" in plan
