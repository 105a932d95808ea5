"""Hand-worked cases of the invoice operators."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from panelcast.operators.invoices import (
    building_monthly_invoices,
    dedup_invoices,
    dedup_removed,
    monthly_invoices,
    prepare_invoices,
    prorate_to_months,
)
from panelcast.schemas import INVOICE
from panelcast.sources.catalog import conform

SCHEMA = ("invoice_id_primaire string, deliverypoint_id_primaire string, fluid string, "
          "start date, end date, value double")


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_prorata_multi_month_uses_overlap_days_and_full_month_bounds(spark):
    inv = frame(spark, ("1", "P", "gas", date(2024, 1, 15), date(2024, 3, 10), 56.0))
    rows = prorate_to_months(prepare_invoices(inv)).orderBy("start").collect()
    assert [r.value for r in rows] == [17.0, 29.0, 10.0]
    assert [(r.start, r.end) for r in rows] == [
        (date(2024, 1, 1), date(2024, 1, 31)), (date(2024, 2, 1), date(2024, 2, 29)),
        (date(2024, 3, 1), date(2024, 3, 31)),
    ]
    assert [r.invoice_duration for r in rows] == [31, 29, 31]


def test_prorata_drops_inverted_and_null_multi_month(spark):
    inv = frame(
        spark,
        ("1", "P", "gas", date(2024, 3, 15), date(2024, 1, 10), 5.0),
        ("2", "P", "gas", date(2024, 5, 15), date(2024, 7, 10), None),
        ("3", "P", "gas", None, date(2024, 7, 10), 3.0),
    )
    rows = prorate_to_months(prepare_invoices(inv)).collect()
    assert [r.invoice_id_primaire for r in rows] == ["3"]


def test_single_month_null_value_becomes_zero(spark):
    inv = frame(spark, ("1", "P", "gas", date(2024, 1, 5), date(2024, 1, 20), None))
    (row,) = monthly_invoices(inv).collect()
    assert row.value == 0.0 and row.invoice_duration == 16


def test_dedup_keeps_smallest_end_and_collapses_null_starts(spark):
    inv = frame(
        spark,
        ("1", "P", "gas", date(2024, 1, 1), None, 1.0),
        ("2", "P", "gas", date(2024, 1, 1), date(2024, 1, 31), 2.0),
        ("3", "P", "gas", date(2024, 1, 1), date(2024, 1, 20), 3.0),
        ("4", "P", "gas", None, date(2024, 2, 20), 4.0),
        ("5", "P", "gas", None, date(2024, 2, 10), 5.0),
    )
    kept = {r.invoice_id_primaire for r in dedup_invoices(inv).collect()}
    assert kept == {"3", "5"}
    assert dedup_removed(inv).collect()[0].removed_rows == 3
    again = dedup_invoices(dedup_invoices(inv).drop("n_candidates"))
    assert {r.invoice_id_primaire for r in again.collect()} == kept


def test_equal_periods_keep_the_smallest_id_numerically(spark):
    raw = spark.createDataFrame(
        [(11648, "P", date(2024, 1, 1), date(2024, 1, 9), 1.0),
         (4368, "P", date(2024, 1, 1), date(2024, 1, 9), 2.0)],
        "invoice_id_primaire bigint, deliverypoint_id_primaire string, start date, end date, "
        "value double",
    )
    kept = dedup_invoices(conform(raw, INVOICE), ["deliverypoint_id_primaire"]).collect()
    assert [r.invoice_id_primaire for r in kept] == [4368]


def test_nan_is_null(spark):
    inv = frame(
        spark,
        ("1", "P", "gas", date(2024, 1, 1), date(2024, 1, 10), float("nan")),
        ("2", "P", "gas", date(2024, 1, 11), date(2024, 1, 20), 7.0),
    )
    assert monthly_invoices(inv).collect()[0].value == 7.0


def test_meter_attributes_before_or_after_reduction(spark):
    """Reducing by meter first equals joining every invoice, also for a hot meter and
    repeated meter rows; pro-rata conserves the value of every kept invoice."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        meter = "HOT" if i % 3 == 0 else f"M{rng.randrange(12)}"
        start = date(2022, 1, 1) + timedelta(days=rng.randrange(700))
        rows.append((f"{i:04d}", meter, None, start, start + timedelta(days=rng.randrange(80)),
                     float(rng.randrange(1, 10_000))))
    inv = spark.createDataFrame(rows, SCHEMA).drop("fluid").repartition(7)
    dp = spark.createDataFrame(
        [("HOT", "B1", "gas"), ("HOT", "B1", "gas"), ("HOT", "B1", "power")]
        + [(f"M{k}", f"B{k % 2}", "gas") for k in range(12)],
        "deliverypoint_id_primaire string, id_building_primaire string, fluid string",
    )
    columns = ["id_building_primaire", "deliverypoint_id_primaire", "fluid", "start", "end",
               F.round("value", 6).alias("value"), "invoice_id_primaire"]
    late = building_monthly_invoices(inv, dp).select(*columns)
    early = monthly_invoices(
        inv.join(dp, "deliverypoint_id_primaire"),
        ["id_building_primaire", "deliverypoint_id_primaire", "fluid"],
    ).select(*columns)
    assert sorted(late.collect()) == sorted(early.collect())
    kept = dedup_invoices(inv, ["deliverypoint_id_primaire"]).agg(F.sum("value")).first()[0]
    total = monthly_invoices(inv, ["deliverypoint_id_primaire"]).agg(F.sum("value")).first()[0]
    assert abs(kept - total) < 1e-6 * kept
