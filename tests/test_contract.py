"""The driver contract, checked against DuckDB on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
QUICK = [
    "monthly_invoices", "month_spine_midstart", "degreedays_pivot", "model_table",
    "customer_train_decision", "dju_scores", "ols_confidence", "customer_y_final",
]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(
        tuple("NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
              for v in r)
        for r in frame.itertuples(index=False)
    )


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 45


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = contract.queries()[name](spark, SF).toPandas()
    expected = con.execute(contract.oracle_sql()[name]).df()
    assert rows(got) == rows(expected) and math.isfinite(len(got))


def test_minimum_slice_totals(spark):
    frame = contract.queries()["monthly_invoices"](spark, SF).toPandas()
    assert len(frame) == 2444 and round(frame["value"].sum()) == 359467688


def test_entry(spark):
    assert contract.entry(spark).count() > 0
