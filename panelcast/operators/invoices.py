"""Irregular invoices to one row per delivery point, fluid and month.

The reduction happens before any join: duplicate starts collapse in a partial aggregate, so a
delivery point holding a large share of all invoices is shrunk map-side to at most one row per
calendar day before it is shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalars import days_inclusive, month_end, month_start, to_date, to_double
from panelcast.schemas import PDL_KEY

# Columns taken from the earliest piece of a month, when the input has them.
ATTRIBUTES = [
    "invoice_id_primaire", "invoice_code", "id_building_primaire", "deliverypoint_code",
    "deliverypoint_number", "fluid_unit",
]


def prepare_invoices(invoices: DataFrame) -> DataFrame:
    """Coerce types and add the inclusive duration in days."""
    return invoices.withColumns(
        {
            "start": to_date(F.col("start")),
            "end": to_date(F.col("end")),
            "value": to_double(F.col("value")),
        }
    ).withColumn("invoice_duration", days_inclusive(F.col("start"), F.col("end")))


def dedup_invoices(invoices: DataFrame, keys: list[str] = PDL_KEY) -> DataFrame:
    """Keep one invoice per (keys, start): smallest end (NULL last), then smallest id.

    ``n_candidates`` counts the invoices that competed, so removed = n_candidates - 1.
    """
    rest = [c for c in invoices.columns if c not in (*keys, "start")]
    tie = ["invoice_id_primaire"] if "invoice_id_primaire" in rest else []
    ordered = [c for c in rest if c not in ("end", *tie)]
    best = F.min(
        F.struct(F.col("end").isNull().alias("no_end"), F.col("end"), *tie, *ordered)
    )
    return (
        invoices.groupBy(*keys, "start")
        .agg(best.alias("b"), F.count(F.lit(1)).alias("n_candidates"))
        .select(*keys, "start", *[F.col(f"b.{c}").alias(c) for c in rest], "n_candidates")
    )


def dedup_removed(invoices: DataFrame, keys: list[str] = PDL_KEY) -> DataFrame:
    """Number of invoices the dedup drops, per series."""
    return (
        dedup_invoices(invoices, keys)
        .groupBy(*keys)
        .agg(F.sum(F.col("n_candidates") - 1).alias("removed_rows"))
    )


def prorate_to_months(invoices: DataFrame) -> DataFrame:
    """Split multi-month invoices by overlap days; single-month invoices pass through.

    A piece carries full-month bounds. Multi-month invoices with a non-positive duration or no
    value vanish. ``source_start`` keeps the invoice's own start for stable ordering.
    """
    start, end, value = F.col("start"), F.col("end"), F.col("value")
    multi = F.coalesce(month_start(start) != month_start(end), F.lit(False))
    usable = (F.col("invoice_duration") > 0) & value.isNotNull()
    months = F.sequence(
        month_start(start), F.greatest(month_start(start), month_start(end)),
        F.expr("interval 1 month"),
    )
    pieces = (
        F.when(multi & usable, months)
        .when(multi, F.array().cast("array<date>"))
        .otherwise(F.array(F.lit(None).cast("date")))
    )
    m = F.col("piece_month")
    split = m.isNotNull()
    days = days_inclusive(F.greatest(start, m), F.least(end, month_end(m)))
    kept = [c for c in invoices.columns if c not in ("start", "end", "value", "invoice_duration")]
    return invoices.withColumn("piece_month", F.explode(pieces)).select(
        *kept,
        start.alias("source_start"),
        F.when(split, m).otherwise(start).alias("start"),
        F.when(split, month_end(m)).otherwise(end).alias("end"),
        F.when(split, value * days / F.col("invoice_duration")).otherwise(value).alias("value"),
        F.when(split, days_inclusive(m, month_end(m)))
        .otherwise(F.col("invoice_duration"))
        .alias("invoice_duration"),
        split.alias("is_prorated"),
    )


def aggregate_months(pieces: DataFrame, keys: list[str] = PDL_KEY) -> DataFrame:
    """One row per (keys, month of end); an all-NULL month sums to 0.0; NULL keys are dropped."""
    end_month = month_start(F.col("end"))
    attrs = [c for c in ATTRIBUTES if c in pieces.columns and c not in keys]
    not_null: Column = F.col("end").isNotNull()
    for k in keys:
        not_null = not_null & F.col(k).isNotNull()
    first = F.min(
        F.struct(
            F.col("start").isNull().alias("no_start"), "start", "is_prorated", "source_start",
            *attrs,
        )
    )
    return (
        pieces.where(not_null)
        .groupBy(*keys, end_month.alias("month_end_date"))
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"),
            first.alias("f"),
        )
        .select(
            *keys, "start", "end", "value",
            days_inclusive(F.col("start"), F.col("end")).alias("invoice_duration"),
            month_start(F.col("start")).alias("month"),
            F.date_format("start", "yyyyMM").alias("month_year"),
            F.date_format("month_end_date", "yyyyMM").alias("month_year_end_date"),
            *[F.col(f"f.{c}").alias(c) for c in attrs],
        )
    )


def monthly_invoices(invoices: DataFrame, keys: list[str] = PDL_KEY) -> DataFrame:
    """prepare -> dedup -> pro-rata -> monthly aggregate."""
    prepared = prepare_invoices(invoices)
    return aggregate_months(prorate_to_months(dedup_invoices(prepared, keys)), keys)


def attach_deliverypoints(monthly: DataFrame, deliverypoints: DataFrame) -> DataFrame:
    """Give per-meter months their building and fluid.

    Dedup, pro-rata and the monthly sum depend on the meter alone, so joining afterwards yields
    the same months as joining every raw invoice first and moves far fewer rows.
    """
    attrs = [c for c in ("deliverypoint_code", "deliverypoint_number", "fluid_unit")
             if c in deliverypoints.columns]
    meters = (
        deliverypoints.where(F.col("fluid").isNotNull())
        .groupBy("deliverypoint_id_primaire", "id_building_primaire", "fluid")
        .agg(F.min(F.struct(*attrs)).alias("a") if attrs else F.count(F.lit(1)).alias("a"))
        .select(
            "deliverypoint_id_primaire", "id_building_primaire", "fluid",
            *[F.col(f"a.{c}").alias(c) for c in attrs],
        )
    )
    return monthly.join(meters, "deliverypoint_id_primaire")


def building_monthly_invoices(invoices: DataFrame, deliverypoints: DataFrame) -> DataFrame:
    """Monthly invoices of every (building, delivery point, fluid)."""
    slim = invoices.select(
        *[c for c in ("invoice_id_primaire", "invoice_code", "deliverypoint_id_primaire",
                      "start", "end", "value") if c in invoices.columns]
    )
    return attach_deliverypoints(
        monthly_invoices(slim, ["deliverypoint_id_primaire"]), deliverypoints
    )
