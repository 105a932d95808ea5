"""Model table: every series on its month spine with degree-days, factors and split flags.

The table exists in two shapes. ``series_table`` holds one row per series with its months as an
array (bounded by the calendar), so every later per-series step runs without another shuffle.
``model_table`` is the same data as one row per series and month.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalars import full_month_starts, month_start, month_text
from panelcast.functions.series import interpolate, let
from panelcast.functions.shape import settle, unfold
from panelcast.operators.weather import weather_matrix
from panelcast.schemas import DJU_COLUMNS, KEY

# Series per task when one building has more than this many meters.
SERIES_PER_PART = 200
WINDOW_COLUMNS = ["start_ref", "end_ref", "start_pred", "end_pred"]


def usable_sites(
    params: DataFrame, building: DataFrame, degreedays: DataFrame, factors: DataFrame | None
) -> DataFrame:
    """One row per request that can run, with everything its series share.

    Needs a known building with a station and an ordered prediction window. ``factors`` is a
    factor matrix, or None for models without factors.
    """
    stations = building.select(F.col("weather_station").alias("station_id")).distinct()
    degreedays = degreedays.join(stations, "station_id", "left_semi")
    sites = (
        params.where(F.col("start_pred") <= F.col("end_pred"))
        .join(
            building.where(F.coalesce("weather_station", F.lit("")) != "").select(
                "id_building_primaire", "weather_station"
            ),
            "id_building_primaire",
        )
        .join(weather_matrix(degreedays), "weather_station", "left")
    )
    if factors is None:
        return sites.withColumns(
            {
                "factor_types": F.array().cast("array<string>"),
                "factor_first": F.lit(None).cast("date"),
                "factor_values": F.array().cast("array<array<double>>"),
            }
        )
    return sites.join(factors, "id_building_primaire", "left").withColumn(
        "factor_types", F.coalesce("factor_types", F.array().cast("array<string>"))
    )


def observed_pairs(monthly: DataFrame) -> DataFrame:
    """Series that have invoices; pairs without any never appear."""
    return monthly.select(*KEY).distinct()


def building_parts(deliverypoints: DataFrame) -> DataFrame:
    """Into how many parts each building's series are split, from its number of meters."""
    return deliverypoints.groupBy("id_building_primaire").agg(
        F.ceil(F.count(F.lit(1)) / SERIES_PER_PART).cast("int").alias("parts")
    )


def spread(monthly: DataFrame, parts: DataFrame) -> DataFrame:
    """Partition monthly rows by (building, part): the one shuffle of all per-series work.

    A series stays whole, and a building with a large share of all series is divided over many
    tasks. The partition count is explicit because the work per byte is high: merging small
    partitions by size would leave most cores idle.
    """
    part = F.pmod(F.hash("deliverypoint_id_primaire", "fluid"), F.col("parts"))
    tasks = int(monthly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        monthly.join(parts, "id_building_primaire")
        .withColumn("part", part)
        .repartition(tasks, "id_building_primaire", "part")
    )


def reaggregate_months(monthly: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row per series and start month. Rows without a start month are dropped."""
    return (
        monthly.where(F.col("start").isNotNull())
        .groupBy(*keys, month_start(F.col("start")).alias("month"))
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"),
            F.count(F.lit(1)).alias("n_invoices"),
        )
    )


def _rows_on_spine(pred: str) -> str:
    """Invoiced months plus the prediction months without invoice, ordered by month.

    Flags: train = a real value fully inside the reference window; test = a month of the
    prediction window, its partial first month included.
    """
    extra = f"""transform(array_except({pred}, inv.month), m -> struct(
        m AS month, m AS start, last_day(m) AS end, CAST(NULL AS DOUBLE) AS value,
        0L AS n_invoices))"""
    return f"""transform(sort_array(concat(inv, {extra})), r -> struct(
        r.month AS month, r.start AS start, r.end AS end, r.value AS value,
        r.n_invoices AS n_invoices,
        coalesce(r.value IS NOT NULL AND r.start >= start_ref AND r.end <= end_ref, false)
            AS is_train,
        r.month BETWEEN trunc(start_pred, 'MM') AND trunc(end_pred, 'MM') AS is_test))"""


def series_table(monthly: DataFrame, sites: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per series: site columns, ``rows`` ordered by month, ``dju_seen[6]`` and
    ``dju_gaps[6]`` (spine months without a row, per reference).

    Degree-days of a month count only if the series' anchor reference (the first one with any
    row on its spine) has a row that month. Factors are gap-filled on row position.

    Each site row is repeated once per part of its building (``building_parts``), so the join
    keeps the partitioning of the series and no task receives a whole large building.
    """
    keys = [*KEY, "part"]
    per_part = sites.join(parts, "id_building_primaire").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    series = (
        reaggregate_months(spread(monthly, parts), keys)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("month", "start", "end", "value", "n_invoices")).alias("inv"))
        .join(per_part, ["id_building_primaire", "part"])
        .withColumn("pred_months", full_month_starts(F.col("start_pred"), F.col("end_pred")))
        .withColumn("spine", F.expr(_rows_on_spine("pred_months")))
    )
    refs = f"sequence(0, {len(DJU_COLUMNS) - 1})"
    number = "(12 * year({0}) + month({0}))"

    def from_first(first: str, array: str) -> str:
        """The elements of a calendar array, which begins with month ``first``, at the months of the spine."""
        return let(number.format(first), "m0", f"transform(month_numbers, m -> get({array}, m - m0))")

    factor = from_first("factor_first", "values")
    no_dju = f"array_repeat(CAST(NULL AS DOUBLE), {len(DJU_COLUMNS)})"
    table = (
        series.withColumn("month_numbers", F.expr(f"transform(spine, r -> {number.format('r.month')})"))
        .withColumn("station", F.expr(from_first("weather_first", "weather")))
        .withColumn(
            "dju_seen",
            F.expr(f"transform({refs}, k -> exists(station, w -> coalesce(get(w.present, k), false)))"),
        )
        .withColumn("anchor", F.expr("array_position(dju_seen, true) - 1"))
        .withColumn(
            "dju_gaps",
            F.expr(
                f"""transform({refs}, k -> transform(
                    filter(spine, (r, i) -> NOT coalesce(get(get(station, i).present, k), false)),
                    r -> date_format(r.month, 'yyyy-MM')))"""
            ),
        )
        .withColumn("filled", F.expr(f"transform(factor_values, values -> {interpolate(factor)})"))
        .withColumn(
            "rows",
            F.expr(
                f"""transform(spine, (r, i) -> struct(
                    r.month AS month, r.start AS start, r.end AS end, r.value AS value,
                    r.n_invoices AS n_invoices, r.is_train AS is_train, r.is_test AS is_test,
                    CASE WHEN anchor >= 0 AND get(get(station, i).present, int(anchor))
                        THEN get(station, i).dju ELSE {no_dju} END AS dju,
                    coalesce(transform(filled, c -> get(c, i)), array()) AS factors))"""
            ),
        )
        .select(
            *KEY, "weather_station", *WINDOW_COLUMNS, "factor_types", "dju_seen", "dju_gaps", "rows"
        )
    )
    # dju_gaps stays outside, so that plans that do not read it do not work it out.
    return settle(table, ["dju_seen", "rows"]).select(table.columns)


def dju_column(k: int) -> Column:
    return F.get("dju", F.lit(k))


def model_table(series: DataFrame) -> DataFrame:
    """One row per series and month, factors as MAP(type -> value)."""
    return unfold(series, [*KEY, "factor_types"], "rows").select(
        *KEY,
        "month",
        month_text(F.col("month")).alias("month_year"),
        "start", "end", "value", "is_train", "is_test",
        *[dju_column(i).alias(c) for i, c in enumerate(DJU_COLUMNS)],
        F.map_from_arrays("factor_types", "factors").alias("factors"),
    )


def split_train_test(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference rows and prediction rows; a row may be in both."""
    table = model_table(series)
    return table.where("is_train"), table.where("is_test")
