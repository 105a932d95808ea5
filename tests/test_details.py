"""Nested model records against the flat outputs, and the imputation of targets with gaps."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from panelcast.operators.details import model_details
from panelcast.operators.diagnostics import series_messages
from panelcast.operators.regression import model_rows
from panelcast.operators.reports import outliers_table
from panelcast.operators.target import impute_target
from panelcast.plans import queries
from panelcast.plans.run import cut_lineage, train_series
from panelcast.schemas import KEY
from panelcast.sources import star_views as star

from test_contract import SF, rows


@pytest.fixture(scope="module")
def fitted(spark):
    return cut_lineage(train_series(queries._series(spark, SF, window=star.SHORT_WINDOW)))


def test_nested_records_equal_flat_outputs(fitted):
    nested = {tuple(r[c] for c in KEY): r for r in model_details(fitted).collect()}
    flat = {tuple(r[c] for c in KEY): r for r in model_rows(fitted).collect()}
    assert nested.keys() == flat.keys() and len(nested) == fitted.count() > 0
    for key, model in flat.items():
        assert all(nested[key][c] == v for c, v in model.asDict().items())
        regression = model.model_family == "ols_dju_plus_factors"
        assert (nested[key].x_cols is not None) == (nested[key].y_col is not None) == regression
        assert not regression or set(nested[key].x_cols) == set(model.coefficients)
    said = {k: [] for k in nested}
    for m in series_messages(fitted).orderBy("seq").collect():
        said[tuple(m[c] for c in KEY)].append((m.code, m.text))
    assert {k: [tuple(m) for m in r.diagnostics] for k, r in nested.items()} == said
    flagged = sorted((r.id_building_primaire, r.invoice_delivery_point, r.invoice_fluid, r.invoice_start_date)
                     for r in outliers_table(fitted).collect())
    assert sorted((*k, o.start) for k, r in nested.items() for o in r.outliers) == flagged and flagged


def test_nested_records_of_nothing(fitted):
    none = model_details(fitted.where("false"))
    assert none.count() == 0 and {"outliers", "diagnostics", "x_cols"} <= set(none.columns)


@pytest.mark.parametrize("name", ["model_details", "building_report", "ranking_imputation", "target_with_missing"])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = contract.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(con.execute(contract.oracle_sql()[name]).df()) and len(got)


def line_series(spark, values, heat):
    """One series whose references are ``heat`` and a constant."""
    month = [datetime.date(2000 + k // 12, k % 12 + 1, 1) for k in range(len(values))]
    train = [(m, m, m, v, [h, 0.0], []) for m, v, h in zip(month, values, heat)]
    schema = ("id long, train array<struct<month:date,start:date,end:date,value:double,dju:array<double>,"
              "factors:array<double>>>, hdd_pos int, cdd_pos int")
    return spark.createDataFrame([(1, train, 0, None)], schema)


def test_gaps_take_the_fitted_values(spark):
    heat = [10.0 + 7 * math.sin(k) for k in range(12)]
    values = [None if k in (0, 5, 11) else 3.0 + 2 * h for k, h in enumerate(heat)]
    r = impute_target(line_series(spark, values, heat)).first()
    assert not r.raw_wins and r.n_missing == 3 and r.gap_ratio == 0.25
    assert all(abs(v - (3 + 2 * h)) < 1e-9 for v, h in zip(r.imputed, heat))


def test_gaps_without_references_take_the_ranked_filling(spark):
    heat = [10.0, 1.0, 9.0, 2.0, 8.0, 3.0, 12.0, 0.5, 11.0, 4.0, 10.5, 2.5]
    values = [None if k in (3, 8) else 3.0 + 2 * h for k, h in enumerate(heat)]
    blind = "transform(r.dju, x -> CASE WHEN r.value IS NOT NULL THEN x END) AS dju"
    frame = line_series(spark, values, heat).withColumn(
        "train", F.expr(f"transform(train, r -> struct(r.month, r.start, r.end, r.value, {blind}, r.factors))")
    )
    r = impute_target(frame).first()
    # Both forms score on the same rows, and a tie keeps the filled one.
    assert not r.raw_wins and len(r.train) == 12 and all(v is not None for v in r.imputed)
    assert [v for k, v in enumerate(r.imputed) if k not in (3, 8)] == [v for v in values if v is not None]


def test_two_known_values_are_filled_linearly(spark):
    r = impute_target(line_series(spark, [None] * 3 + [8.0, 10.0] + [None] * 3, [1.0] * 8)).first()
    assert not r.raw_wins and r.n_missing == 6 and r.imputed == [8.0] * 4 + [10.0] * 4
