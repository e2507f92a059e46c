"""Every relational query against its DuckDB oracle (sf0.001 here; the
sf0.01 sweep is tools/oracle_check.py)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tools.oracle_check import TABLES, rows_of

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SMALL)
    srec = [r.asDict() for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orec = [dict(zip(ocols, r)) for r in cur.fetchall()]
    assert sorted(sdf.columns) == sorted(ocols)
    cols = sorted(ocols)
    assert rows_of(srec, cols) == rows_of(orec, cols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["category", "revenue"]


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())


EXPECTED_COLUMNS = {
    "sales_by_state_approx": ["customer_state", "total_revenue", "total_orders", "unique_customers", "avg_order_value"],
    "churn_leafwise_metrics": ["test_auc", "trees", "most_leaves"],
    "churn_model_metrics": ["test_auc", "train_rows", "test_rows", "validation_rows"],
    "churn_scores": ["customer_unique_id", "model_probability", "churn_probability", "risk_level"],
    "churn_drivers": ["customer_unique_id", "driver_rank", "feature", "contribution"],
    "revenue_forecast": ["series", "ds", "yhat", "yhat_lower", "yhat_upper", "is_future"],
    "forecast_metrics": ["series", "forecast_days", "total_forecast", "predicted_growth_pct", "peak_month",
                         "peak_revenue"],
}


ROWS_ONLY = sorted(EXPECTED_COLUMNS)


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_rows_only_queries_run(spark, key):
    df = E.queries()[key](spark, SMALL)
    assert df.columns == EXPECTED_COLUMNS[key]
    assert df.count() > 0
