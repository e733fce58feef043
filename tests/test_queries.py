"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest
from wareflow import catalog


def _rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(repr, frame[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    with duckdb.connect() as c:
        for t in ("events", "part", "documents", "labels", "pages", "supplier"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        expected = c.sql(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got) == _rows(expected)
    assert len(got)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["usage_rollup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    plan = catalog.QUERIES["rolling_fail_rate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,view))]" in plan
