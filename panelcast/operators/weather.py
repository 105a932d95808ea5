"""Degree-days: pivot to one row per station and month, and its gaps."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalars import to_date
from panelcast.schemas import DJU_COLUMNS


def _reference() -> Column:
    return F.concat("indicator", F.col("basis").cast("string"))


def with_month(degreedays: DataFrame) -> DataFrame:
    """Adds ``month`` (first day), NULL for text that is no month inside the calendar."""
    return degreedays.withColumn("month", to_date(F.concat("period_month", F.lit("-01"))))


def pivot_references(degreedays: DataFrame) -> DataFrame:
    """Long degree-days to ``station_id, month, dju[6], present[6]``.

    ``present`` says whether a row exists at all, which differs from a NULL value. A reference
    occurring twice in a month keeps its largest value; see ``reference_problems``. Rows whose month
    is no month, or lies outside the calendar, are left out.
    """
    ref = _reference()
    degreedays = with_month(degreedays).where("month IS NOT NULL")
    aggs = [F.max(F.when(ref == c, F.col("value"))).alias(c) for c in DJU_COLUMNS]
    seen = [F.coalesce(F.bool_or(ref == c), F.lit(False)).alias(f"has_{c}") for c in DJU_COLUMNS]
    return (
        degreedays.where(ref.isin(DJU_COLUMNS))
        .groupBy("station_id", "month")
        .agg(*aggs, *seen)
        .select(
            "station_id", "month",
            F.array(*DJU_COLUMNS).alias("dju"),
            F.array(*[f"has_{c}" for c in DJU_COLUMNS]).alias("present"),
        )
    )


def reference_problems(degreedays: DataFrame) -> DataFrame:
    """Per station: ``n_bad_months`` rows without a usable month, ``n_ambiguous`` references with several values."""
    return (
        with_month(degreedays).groupBy("station_id", "month", "indicator", "basis")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .groupBy("station_id")
        .agg(
            F.coalesce(F.sum(F.when(F.col("month").isNull(), F.col("n"))), F.lit(0)).alias("n_bad_months"),
            F.count_if(F.col("month").isNotNull() & (F.col("low") < F.col("high"))).alias("n_ambiguous"),
        )
    )


def _first_present(flags: list[Column]) -> Column:
    """Ordinal of the first reference that is present, NULL if none is."""
    return F.least(*[F.when(f, F.lit(i)) for i, f in enumerate(flags)])


def degreedays_pivot(degreedays: DataFrame, months: DataFrame) -> DataFrame:
    """Six columns per station for the requested months (``station_id, month``).

    The first reference with any row anchors the result: months it lacks are dropped, whatever
    the other references hold.
    """
    pivot = pivot_references(degreedays).join(
        months.select("station_id", "month").distinct(), ["station_id", "month"], "left_semi"
    )
    station = Window.partitionBy("station_id")
    anchor = _first_present(
        [F.bool_or(F.col("present")[i]).over(station) for i in range(len(DJU_COLUMNS))]
    )
    return (
        pivot.withColumn("anchor", anchor)
        .where(F.get("present", F.col("anchor")))
        .select(
            "station_id", "month",
            *[F.col("dju")[i].alias(c) for i, c in enumerate(DJU_COLUMNS)],
        )
    )


def missing_months(degreedays: DataFrame, months: DataFrame) -> DataFrame:
    """Requested months without a row, per station and reference: ``station_id, ref, month``."""
    refs = F.explode(F.array(*[F.lit(c) for c in DJU_COLUMNS]))
    wanted = months.select("station_id", "month").distinct().withColumn("ref", refs)
    have = degreedays.select(
        "station_id", to_date(F.concat("period_month", F.lit("-01"))).alias("month"),
        _reference().alias("ref"),
    )
    return wanted.join(have, ["station_id", "month", "ref"], "left_anti")


def weather_matrix(degreedays: DataFrame) -> DataFrame:
    """One row per station: ``weather_first`` month and ``weather`` indexed by month offset.

    Entries are STRUCT(dju[6], present[6]), NULL where a month has no row. The calendar bounds
    the array, and a series finds its months by position.
    """
    return (
        pivot_references(degreedays)
        .groupBy("station_id")
        .agg(
            F.min("month").alias("weather_first"),
            F.max("month").alias("last"),
            F.map_from_entries(
                F.collect_list(F.struct("month", F.struct("dju", "present")))
            ).alias("by_month"),
        )
        .select(
            F.col("station_id").alias("weather_station"),
            "weather_first",
            F.expr(
                "transform(sequence(weather_first, last, interval 1 month), "
                "m -> try_element_at(by_month, m))"
            ).alias("weather"),
        )
    )
