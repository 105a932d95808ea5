"""Registered queries: each operator over the domain views of a star schema.

Dates are shown as text. Amounts are rounded for display; a nudge far below the shown digits
keeps exact halves from depending on summation order.
"""

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.linear import fit_if_enough, fitted_values, moments
from panelcast.functions.scalars import month_text, months_covered, normalise_month
from panelcast.functions.shape import settle, unfold
from panelcast.functions.series import iqr_fence, known, let, lowess, mean, theil_sen
from panelcast.operators.anomalies import (
    detect_anomalies,
    fill_for_detection,
    rank_impute,
    seasonal_fill,
    seasonally_adjust,
)
from panelcast.operators.calendar import month_spine
from panelcast.operators.details import model_details
from panelcast.operators.diagnostics import distinct_notes, series_messages
from panelcast.operators.invoices import (
    dedup_invoices,
    dedup_removed,
    monthly_invoices,
    prepare_invoices,
    prorate_to_months,
)
from panelcast.operators.ordered import fill_gaps, positions
from panelcast.operators.panel import model_table, observed_pairs
from panelcast.operators.least_squares import fit_groups, terms
from panelcast.operators.regression import ACCURACY, accuracy, choose_family, fit_series, model_rows, predict
from panelcast.operators.reports import (
    building_metrics,
    missing_prediction_months,
    outliers_table,
    target_table,
    until_month,
)
from panelcast.operators.selection import quantiles
from panelcast.operators.strategy import add_mean_model, decide_strategy, mean_model, score_table
from panelcast.operators.target import build_target, impute_target
from panelcast.operators.usage import (
    filter_usage,
    interpolate_long,
    monthly_from_daily,
    monthly_usage,
    non_constant,
    profile_columns,
    widen,
)
from panelcast.operators.weather import degreedays_pivot, missing_months
from panelcast.plans.run import (
    build_series,
    cut_lineage,
    monthly_panel,
    prepare_series,
    requested_usage,
    shared_folder,
    train_series,
)
from panelcast.schemas import DJU_COLUMNS, INVOICE, KEY, MONTH_PATTERN, PDL_KEY, SEASON, SEASONAL_STRENGTH
from panelcast.sources import star_views as star
from panelcast.sources.catalog import building_invoices as sourced_invoices
from panelcast.sources.catalog import building_usage as sourced_usage
from panelcast.sources.catalog import input_problems
from panelcast.sources.catalog import site_lookup as sourced_sites
from panelcast.sources.catalog import station_degreedays as sourced_degreedays
from panelcast.sources.sinks import (
    invalid_months,
    persist_results,
    published_models,
    published_predictions,
    stage_results,
)

FACTORS = ["fi_A", "fi_N", "fi_R"]
NUDGE = {0: 1e-4, 1: 1e-5, 2: 1e-6, 4: 1e-8, 6: 1e-9}


def shown(c: str | Column, digits: int = 2) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(NUDGE[digits]), digits)


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def count(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _inputs(spark, sf_dir, grain="segment", window=star.STANDARD_WINDOW):
    return star.star_sources(spark, sf_dir, grain), star.params(spark, sf_dir, window)


def _series(spark, sf_dir, grain="segment", window=star.STANDARD_WINDOW, with_factors=False):
    return build_series(*_inputs(spark, sf_dir, grain, window), with_factors)


def _raw_invoices(spark, sf_dir, grain="segment"):
    sources, params = _inputs(spark, sf_dir, grain)
    return sourced_invoices(sources.table("invoice"), sources.table("deliverypoint"), params)


def _ready(prepared: DataFrame) -> DataFrame:
    return prepared.where(F.col("status_code") == "note_annual_ref")


# --- sources -----------------------------------------------------------------------------------
def site_lookup(spark, sf_dir):
    sources, params = _inputs(spark, sf_dir)
    return sourced_sites(sources.table("building"), params).select(
        "id_building_primaire", "name", "weather_station", "surface", count("occupant").alias("occupant")
    )


def building_invoices(spark, sf_dir):
    return _raw_invoices(spark, sf_dir).select(
        count("invoice_id_primaire").alias("invoice_id"), *KEY, "fluid_unit", day("start"),
        day("end"), "value",
    )


def building_usage(spark, sf_dir):
    sources, params = _inputs(spark, sf_dir)
    windows = params.select(
        "id_building_primaire", F.col("start_pred").alias("start"), F.col("end_pred").alias("end")
    )
    return sourced_usage(sources, windows).select(
        "id_building_primaire", day("date"), "type", "n_rows", shown("total").alias("total")
    )


def station_degreedays(spark, sf_dir):
    sources, params = _inputs(spark, sf_dir, window=star.MIDSTART_WINDOW)
    sites = sourced_sites(sources.table("building"), params)
    windows = params.join(sites.select("id_building_primaire", "weather_station"),
                          "id_building_primaire").select(
        F.col("weather_station").alias("station_id"), F.col("start_pred").alias("start"),
        F.col("end_pred").alias("end"),
    )
    return sourced_degreedays(sources.table("degreedays"), windows).select(
        "station_id", "period_month", "indicator", count("basis").alias("basis"),
        shown("value").alias("value"),
    )


# --- invoices ----------------------------------------------------------------------------------
def invoice_dedup(spark, sf_dir):
    kept = dedup_invoices(prepare_invoices(_raw_invoices(spark, sf_dir)))
    return kept.select(
        count("invoice_id_primaire").alias("invoice_id"), *PDL_KEY, day("start"), day("end"),
        "value", F.col("invoice_duration").cast("double").alias("invoice_duration"),
    )


def invoice_dedup_removed(spark, sf_dir):
    return dedup_removed(prepare_invoices(_raw_invoices(spark, sf_dir)))


def invoice_prorata(spark, sf_dir):
    kept = dedup_invoices(prepare_invoices(_raw_invoices(spark, sf_dir)))
    return prorate_to_months(kept).select(
        count("invoice_id_primaire").alias("invoice_id"), *PDL_KEY, day("start"), day("end"),
        shown("value").alias("value"),
        F.col("invoice_duration").cast("double").alias("invoice_duration"), "is_prorated",
    )


def _monthly_view(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        *KEY, "month_year", "month_year_end_date", day("start"), day("end"),
        shown("value").alias("value"), count("invoice_duration").alias("invoice_duration"),
        count("invoice_id_primaire").alias("first_invoice_id"),
    )


def monthly_invoices_query(spark, sf_dir):
    return _monthly_view(monthly_panel(*_inputs(spark, sf_dir)))


def single_building_run(spark, sf_dir):
    """The monthly table of one requested building: other meters drop out before any aggregation."""
    sources, params = _inputs(spark, sf_dir)
    return _monthly_view(monthly_panel(sources, params.where("id_building_primaire = 'B_1'")))


def customer_monthly_invoices(spark, sf_dir):
    return _monthly_view(monthly_panel(*_inputs(spark, sf_dir, "customer")))


def joined_monthly_invoices(spark, sf_dir):
    """The same months, attaching meter attributes to every raw invoice first."""
    monthly = monthly_invoices(_raw_invoices(spark, sf_dir), KEY)
    return _monthly_view(monthly)


def series_pairs(spark, sf_dir):
    return observed_pairs(monthly_panel(*_inputs(spark, sf_dir)))


# --- spine, weather, usage ---------------------------------------------------------------------
def _spine_view(spark, sf_dir, window):
    sources, params = _inputs(spark, sf_dir, window=window)
    spine = month_spine(monthly_panel(sources, params), params)
    return spine.select(*KEY, month_text(F.col("month")).alias("month_str"))


def month_spine_query(spark, sf_dir):
    return _spine_view(spark, sf_dir, star.STANDARD_WINDOW)


def month_spine_midstart(spark, sf_dir):
    return _spine_view(spark, sf_dir, star.MIDSTART_WINDOW)


def _station_months(sources, params):
    """Every month of the two windows, per station."""
    sites = sourced_sites(sources.table("building"), params)
    return params.join(
        sites.select("id_building_primaire", "weather_station"), "id_building_primaire"
    ).select(
        F.col("weather_station").alias("station_id"),
        F.explode(months_covered(F.least("start_ref", "start_pred"),
                                 F.greatest("end_ref", "end_pred"))).alias("month"),
    )


def degreedays_pivot_query(spark, sf_dir):
    sources, params = _inputs(spark, sf_dir)
    pivot = degreedays_pivot(sources.table("degreedays"), _station_months(sources, params))
    return pivot.select(
        "station_id", month_text(F.col("month")).alias("month_str"),
        *[shown(c).alias(c) for c in DJU_COLUMNS],
    )


def degreedays_missing_months(spark, sf_dir):
    """Months of the whole order history (1995-01 to 2001-12) without degree-days."""
    sources, params = _inputs(spark, sf_dir)
    stations = sourced_sites(sources.table("building"), params).select(
        F.col("weather_station").alias("station_id")
    )
    months = stations.select(
        "station_id",
        F.explode(months_covered(F.lit("1995-01-01").cast("date"),
                                 F.lit("2001-12-31").cast("date"))).alias("month"),
    )
    return (
        missing_months(sources.table("degreedays"), months)
        .groupBy("station_id", "ref")
        .agg(F.array_join(F.array_sort(F.collect_list(month_text(F.col("month")))), ",")
             .alias("missing_months"))
    )


def usage_monthly(spark, sf_dir):
    sources, params = _inputs(spark, sf_dir)
    return monthly_from_daily(requested_usage(sources, params)).select(
        "id_building_primaire", month_text(F.col("month")).alias("month_str"), "type",
        shown("value", 6).alias("value"),
    )


def usage_non_constant(spark, sf_dir):
    sources, params = _inputs(spark, sf_dir)
    kept = non_constant(monthly_from_daily(requested_usage(sources, params)))
    return kept.select(
        "id_building_primaire", month_text(F.col("month")).alias("month_str"), "type",
        shown("value", 6).alias("value"),
    )


def usage_wide(spark, sf_dir):
    """All usage of 1998, one column per type."""
    usage = star.star_sources(spark, sf_dir).table("usage_data")
    recent = filter_usage(usage, start="1998-01-01", end="1998-12-31")
    return widen(monthly_usage(recent), FACTORS).select(
        "id_building_primaire", month_text(F.col("month")).alias("month_str"),
        *[shown(c, 6).alias(c) for c in FACTORS],
    )


def factor_profile(spark, sf_dir):
    """Columns of the wide usage table that could serve as factors."""
    usage = star.star_sources(spark, sf_dir).table("usage_data")
    wide = widen(monthly_usage(usage), [*FACTORS, "fi_absent"]).drop("id_building_primaire")
    return profile_columns(wide.withColumnRenamed("month", "month_year"))


def usage_interpolated(spark, sf_dir):
    """Monthly usage of each type on the month list of its building, months without a reading of the type filled."""
    monthly = monthly_usage(star.star_sources(spark, sf_dir).table("usage_data"))
    months = monthly.select("id_building_primaire", "month").distinct()
    types = monthly.select("id_building_primaire", "type").distinct()
    keys = ["id_building_primaire", "type"]
    gappy = months.join(types, "id_building_primaire").join(monthly, [*keys, "month"], "left")
    return interpolate_long(gappy, keys, "month", "value").select(
        *keys, month_text(F.col("month")).alias("month_str"), F.col("value").isNull().alias("was_unknown"),
        shown("value_filled", 6).alias("value"),
    )


# --- model table -------------------------------------------------------------------------------
def _table_view(series: DataFrame) -> DataFrame:
    return model_table(series).select(
        *KEY, F.col("month_year").alias("month_str"), day("start"), day("end"),
        shown("value").alias("value"), "is_train", "is_test",
        *[shown(c).alias(c) for c in DJU_COLUMNS],
        *[shown(F.try_element_at("factors", F.lit(c)), 4).alias(c) for c in FACTORS],
    )


def model_table_query(spark, sf_dir):
    return _table_view(_series(spark, sf_dir, with_factors=True))


def customer_model_table(spark, sf_dir):
    return _table_view(_series(spark, sf_dir, "customer", star.SHORT_WINDOW, True))


def train_test_flags(spark, sf_dir):
    table = model_table(_series(spark, sf_dir, window=star.MIDSTART_WINDOW))
    return table.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.count_if("is_train").alias("n_train"),
        F.count_if("is_test").alias("n_test"),
        F.count_if(F.col("is_test") & F.col("value").isNotNull()).alias("n_test_invoiced"),
    )


# --- decisions ---------------------------------------------------------------------------------
def _decision_view(series: DataFrame) -> DataFrame:
    return decide_strategy(series).select(
        *KEY, count("n_train").alias("n_train"), count("n_zero").alias("n_zero"),
        "status_code", "status",
    )


def train_decision(spark, sf_dir):
    return _decision_view(_series(spark, sf_dir))


def customer_train_decision(spark, sf_dir):
    return _decision_view(_series(spark, sf_dir, "customer", star.SHORT_WINDOW))


def mean_model_query(spark, sf_dir):
    series = decide_strategy(_series(spark, sf_dir)).where("n_train > 0")
    return mean_model(series).select(
        *KEY, month_text(F.col("month")).alias("month_str"),
        shown("real_consumption").alias("real_consumption"),
        shown("predictive_consumption").alias("predictive_consumption"),
        shown("confidence_lower95").alias("confidence_lower95"),
        shown("confidence_upper95").alias("confidence_upper95"),
        shown("annual_consumption_reference").alias("annual_consumption_reference"),
    )


def _scores_view(series):
    return score_table(prepare_series(series)).select(*KEY, "ref", shown("adj_r2", 6).alias("adj_r2"))


def dju_scores(spark, sf_dir):
    return _scores_view(_series(spark, sf_dir))


def customer_dju_scores(spark, sf_dir):
    return _scores_view(_series(spark, sf_dir, "customer", star.SHORT_WINDOW))


def dju_best(spark, sf_dir):
    return prepare_series(_series(spark, sf_dir)).select(*KEY, "best_hdd", "best_cdd")


# --- regression --------------------------------------------------------------------------------
_POINTS = """filter(transform(train, r -> struct(r.value AS y,
    get(r.dju, hdd_pos) AS a, get(r.dju, cdd_pos) AS b)),
    r -> r.y IS NOT NULL AND r.a IS NOT NULL AND r.b IS NOT NULL)"""


def ols_two_factor(spark, sf_dir):
    ready = _ready(prepare_series(_series(spark, sf_dir)))
    fit = let(
        moments(_POINTS), "m",
        let(fit_if_enough("m", "2"), "w",
            "struct(m.n AS n, w.b0 AS b0, w.ba AS ba, w.bb AS bb, w.sse AS sse)"),
    )
    return ready.select(*KEY, F.expr(fit).alias("w")).select(
        *KEY, count("w.n").alias("n"), shown("w.b0", 1).alias("b_coefficient"),
        shown("w.ba").alias("a_hdd"), shown("w.bb").alias("a_cdd"),
        shown(F.sqrt(F.col("w.sse") / F.greatest(F.col("w.n") - 3, F.lit(1))), 1).alias("sigma"),
    )


def fitted_two_factor(spark, sf_dir):
    ready = _ready(prepare_series(_series(spark, sf_dir)))
    fitted = fitted_values(
        _POINTS, "transform(rows, r -> get(r.dju, hdd_pos))",
        "transform(rows, r -> get(r.dju, cdd_pos))", "2",
    )
    pairs = "transform(rows, (r, i) -> struct(r.month AS month, get(fitted, i) AS fitted))"
    return (
        ready.withColumn("fitted", F.expr(fitted))
        .select(*KEY, F.inline_outer(F.expr(pairs)))
        .select(*KEY, month_text(F.col("month")).alias("month_str"), shown("fitted", 1).alias("fitted"))
    )


#: Factors of `ols_many_factors`: five of full rank, and five of which two depend on the others.
MANY = ["days", "day_of_year", "month_number", "weekday", "remainder"]
DEPENDENT = ["days", "twice_days", "month_number", "weekday", "twelve"]


def ols_many_factors(spark, sf_dir):
    """Regression of raw invoice values of each building and fluid on five factors, from all their invoices."""
    start = F.col("start")
    rows = _raw_invoices(spark, sf_dir).select(
        "id_building_primaire", "fluid", "value",
        (F.datediff("end", start) + 1).alias("days"),
        (2 * (F.datediff("end", start) + 1)).alias("twice_days"),
        F.dayofyear(start).alias("day_of_year"),
        (12 * (F.year(start) - 1992) + F.month(start)).alias("month_number"),
        F.dayofweek(start).alias("weekday"),
        (F.col("invoice_id_primaire").cast("bigint") % 11).alias("remainder"),
        F.lit(12.0).alias("twelve"),
    )
    keys = ["id_building_primaire", "fluid"]
    designs = [
        terms(fit_groups(rows, keys, "value", xs), keys, xs).withColumn("design", F.lit(name))
        for name, xs in (("full", MANY), ("dependent", DEPENDENT))
    ]
    return designs[0].unionByName(designs[1]).select(
        *keys, "design", "term", count("n").alias("n"), count("rank").alias("rank"),
        shown("beta").alias("beta"), shown("std_error").alias("std_error"),
        shown(F.sqrt("sigma2"), 1).alias("sigma"),
    )


def _plain_fit(spark, sf_dir):
    """Regression of the raw value on the two chosen references."""
    ready = _ready(prepare_series(_series(spark, sf_dir)))
    return fit_series(ready, target="train", y="value")


def ols_confidence(spark, sf_dir):
    fitted = choose_family(_plain_fit(spark, sf_dir))
    return predict(fitted).select(
        *KEY, "month_str", shown("predictive_consumption", 1).alias("fit"),
        shown("confidence_lower95", 1).alias("lower95"),
        shown("confidence_upper95", 1).alias("upper95"),
    )


def accuracy_query(spark, sf_dir):
    """Accuracy of the two-factor fit on its own training rows."""
    pairs = """transform(fit_rows, r -> struct(r.y AS y,
        beta[0] + beta[1] * r.x[1] + beta[2] * r.x[2] AS fitted))"""
    long = unfold(_plain_fit(spark, sf_dir).where("beta IS NOT NULL"), KEY, pairs, marker="y")
    out = accuracy(long, KEY, "y", "fitted", 2)
    return out.select(
        *KEY, "n_pairs", shown("ME", 1).alias("ME"), shown("RMSE", 1).alias("RMSE"),
        shown("MAE", 1).alias("MAE"), shown("MPE", 1).alias("MPE"), shown("MAPE", 1).alias("MAPE"),
        shown("R2", 6).alias("R2"), shown("adjR2", 6).alias("adjR2"),
    )


# --- ordered series ----------------------------------------------------------------------------
def _values(spark, sf_dir, grain, window):
    prepared = decide_strategy(_series(spark, sf_dir, grain, window))
    return _ready(prepared).withColumn("y", F.expr("transform(train, r -> r.value)"))


def _smooth_view(df: DataFrame, expression: str) -> DataFrame:
    pairs = "transform(train, (r, i) -> struct(r.month AS month, get(s, i) AS smooth))"
    return unfold(df.withColumn("s", F.expr(expression)), KEY, pairs).select(
        *KEY, month_text(F.col("month")).alias("month_str"), shown("smooth").alias("smooth")
    )


def theil_sen_query(spark, sf_dir):
    df = _values(spark, sf_dir, "customer", star.SHORT_WINDOW).where(F.size("y") <= SEASON)
    return _smooth_view(df, theil_sen("y"))


def lowess_equispaced(spark, sf_dir):
    df = _values(spark, sf_dir, "segment", star.STANDARD_WINDOW).where(F.size("y") > SEASON)
    return _smooth_view(df, lowess("y"))


def iqr_fence_query(spark, sf_dir):
    """Fence of the raw values of each series."""
    df = _values(spark, sf_dir, "customer", star.STANDARD_WINDOW)
    fences = settle(df.select(*KEY, F.expr(iqr_fence("y", 3.0)).alias("f")), ["f"])
    return fences.where("f IS NOT NULL").select(
        *KEY, *[shown(f"f.{c}").alias(c) for c in ("q1", "q3", "low", "high")]
    )


def _anomaly_view(df: DataFrame) -> DataFrame:
    flagged = detect_anomalies(df, "y", "anomaly")
    pairs = "transform(train, (r, i) -> struct(r.month AS month, get(anomaly, i) AS is_anomaly))"
    return unfold(flagged, KEY, pairs).select(
        *KEY, month_text(F.col("month")).alias("month_str"), "is_anomaly"
    )


def anomalies_short(spark, sf_dir):
    return _anomaly_view(_values(spark, sf_dir, "segment", star.SHORT_WINDOW))


def customer_anomalies_short(spark, sf_dir):
    return _anomaly_view(_values(spark, sf_dir, "customer", star.SHORT_WINDOW))


def anomalies_long(spark, sf_dir):
    return _anomaly_view(_values(spark, sf_dir, "segment", star.STANDARD_WINDOW))


# --- target, models, reports -------------------------------------------------------------------
def _short_target(spark, sf_dir, grain):
    """Targets of series of at most two years."""
    ready = _ready(prepare_series(_series(spark, sf_dir, grain, star.SHORT_WINDOW)))
    return build_target(ready, impute=False)


def _target_view(df: DataFrame) -> DataFrame:
    return target_table(df).select(
        *KEY, month_text(F.col("month")).alias("month_str"), "best_y", "drop_zeros", "is_anomaly",
        shown("consumption_imputation", 1).alias("consumption_imputation"),
        shown("consumption_correction", 1).alias("consumption_correction"),
        shown("y_final", 1).alias("y_final"),
    )


def y_final(spark, sf_dir):
    return _target_view(_short_target(spark, sf_dir, "segment"))


def customer_y_final(spark, sf_dir):
    return _target_view(_short_target(spark, sf_dir, "customer"))


def outliers_table_query(spark, sf_dir):
    return outliers_table(_short_target(spark, sf_dir, "segment")).select(
        "id_building_primaire", "invoice_delivery_point", "invoice_fluid",
        day("invoice_start_date"), day("invoice_end_date"),
        shown("invoice_consumption").alias("invoice_consumption"), "is_missing",
        shown("invoice_consumption_imputation").alias("invoice_consumption_imputation"),
        "is_anomaly",
        shown("invoice_consumption_correction", 1).alias("invoice_consumption_correction"),
    )


def _trained(spark, sf_dir, grain="segment", window=star.STANDARD_WINDOW):
    return train_series(_series(spark, sf_dir, grain, window, with_factors=True))


def outlier_notes(spark, sf_dir):
    """Anomaly counts and months, once per building and text."""
    fitted = train_series(_series(spark, sf_dir, window=star.SHORT_WINDOW))
    return distinct_notes(series_messages(fitted)).select("id_building_primaire", "code", "text")


def missing_months_query(spark, sf_dir):
    """Prediction months whose factors or degree-days are missing, to the end of 2002."""
    window = (*star.STANDARD_WINDOW[:2], star.date(2001, 6, 1), star.date(2002, 6, 30))
    fitted = _trained(spark, sf_dir, window=window)
    return missing_prediction_months(predict(fitted)).select(
        *KEY, F.array_join("missing_months", ",").alias("missing_months")
    )


def building_metrics_query(spark, sf_dir):
    """Roll-up of the mean-model annual references."""
    sources, params = _inputs(spark, sf_dir)
    series = decide_strategy(build_series(sources, params, False)).where("n_train > 0")
    annual = mean_model(series).groupBy(*KEY).agg(
        F.first("annual_consumption_reference").alias("annual_consumption_reference")
    )
    out = building_metrics(annual, sourced_sites(sources.table("building"), params))
    return out.select(
        "id_building_primaire",
        *[shown(c).alias(c) for c in out.columns if c != "id_building_primaire"],
    )


def final_predictions(spark, sf_dir):
    """Predictions of the full models, all months of the window."""
    return predict(_trained(spark, sf_dir))


def horizon_cut(spark, sf_dir):
    """The monthly table up to a horizon; the cut is the operator shown here."""
    return until_month(month_spine_query(spark, sf_dir), "2000-11")


def final_model(spark, sf_dir):
    models = model_rows(_trained(spark, sf_dir))
    return models.withColumn("coefficients", F.to_json("coefficients"))


def customer_final_model(spark, sf_dir):
    models = model_rows(_trained(spark, sf_dir, "customer", star.SHORT_WINDOW))
    return models.withColumn("coefficients", F.to_json("coefficients"))


def model_details_query(spark, sf_dir):
    """Models of series of at most two years, without usage factors, from the nested records of the run's own fit."""
    rows = model_details(train_series(_series(spark, sf_dir, window=star.SHORT_WINDOW)))
    outliers = F.transform("outliers", lambda r: F.concat(
        month_text(r.month), F.lit("="), F.format_string("%.1f", shown(r.consumption_correction, 1))
    ))
    notes = F.filter("diagnostics", lambda m: m.code.isin("note_005", "debug_outliers_months"))
    return rows.select(
        *KEY, "model_family", "status", "chosen_hdd", "chosen_cdd", F.array_join("x_cols", ",").alias("x_cols"),
        "y_col", *[shown(c, 1).alias(c) for c in ("b_coefficient", "annual_consumption_reference")],
        *[shown(c).alias(c) for c in ("a_hdd", "a_cdd", "monthly_mean", "monthly_sd")],
        *[shown(c, 1).alias(c) for c in ("ME", "RMSE", "MAE", "MPE", "MAPE")],
        *[shown(c, 6).alias(c) for c in ("R2", "adjR2")],
        F.array_join(outliers, ",").alias("outliers"),
        F.array_join(F.transform(notes, lambda m: m.text), "; ").alias("outlier_notes"),
    )


def building_report(spark, sf_dir):
    """Roll-up of the models' own annual references, regression or mean, of series of at most two years."""
    sources, params = _inputs(spark, sf_dir, window=star.SHORT_WINDOW)
    models = model_rows(train_series(build_series(sources, params, False)))
    out = building_metrics(models, sourced_sites(sources.table("building"), params))
    return out.select(
        "id_building_primaire", *[shown(c, 1).alias(c) for c in out.columns if c != "id_building_primaire"]
    )


def _with_gaps(spark, sf_dir, window=star.SHORT_WINDOW):
    """Series whose value is unknown in two of seven months."""
    unknown = "(12 * year(r.month) + month(r.month)) % 7 < 2"
    ready = _ready(prepare_series(_series(spark, sf_dir, window=window)))
    return ready.withColumn("reference", F.col("train")).withColumn("train", F.expr(
        f"transform(train, r -> struct(r.month, r.start, r.end, CASE WHEN NOT {unknown} THEN r.value END AS value, "
        "r.dju, r.factors))"
    ))


def ranking_imputation(spark, sf_dir):
    """Unknown values as the mean of the linear and the structural arm."""
    df = rank_impute(_with_gaps(spark, sf_dir).withColumn("y", F.expr("transform(train, r -> r.value)")), "y", "filled")
    pairs = "transform(train, (r, i) -> struct(r.month AS month, r.value AS value, get(filled, i) AS filled))"
    return unfold(df, KEY, pairs).select(
        *KEY, month_text(F.col("month")).alias("month_str"), shown("value").alias("value"),
        shown("filled", 1).alias("filled"),
    )


def _long_with_gaps(spark, sf_dir):
    """Series over two years with unknown months, and their values as ``y``."""
    df = _with_gaps(spark, sf_dir, star.STANDARD_WINDOW).withColumn("y", F.expr("transform(train, r -> r.value)"))
    return df.where(F.size("y") > 2 * SEASON)


def seasonal_strength(spark, sf_dir):
    """Strength of the season of series over two years, and how months filled by trend and season compare with the rest.

    Two digits: the robust weights of some series do not settle within the method's rounds, which makes them
    sensitive to rounding from the fourth digit on.
    """
    df = _long_with_gaps(spark, sf_dir).withColumn("whole", F.expr("transform(reference, r -> r.value)"))
    df = seasonally_adjust(fill_for_detection(df, "y", "filled"), "whole", "adjusted")
    df = settle(df, ["filled", "adjusted_strength"])
    unknown = F.expr(mean("filter(filled, (v, i) -> get(y, i) IS NULL)"))
    return df.select(
        *KEY, F.size("whole").cast("bigint").alias("n_months"), shown("adjusted_strength").alias("strength"),
        (F.col("adjusted_strength") >= SEASONAL_STRENGTH).alias("is_strong"),
        shown(unknown / F.expr(mean(known("y")))).alias("filled_to_known"),
    )


def seasonal_imputation(spark, sf_dir):
    """Unknown months of series over two years by the seasonal arm alone."""
    df = seasonal_fill(_long_with_gaps(spark, sf_dir), "y", "filled")
    pairs = "transform(train, (r, i) -> struct(r.month AS month, r.value AS value, get(filled, i) AS filled))"
    return unfold(df, KEY, pairs).select(
        *KEY, month_text(F.col("month")).alias("month_str"), shown("value").alias("value"),
        shown("filled", 1).alias("filled"),
    )


def target_with_missing(spark, sf_dir):
    """Targets of series with unknown values: fitted or ranked filling, or the raw rows where they score better."""
    df = impute_target(_with_gaps(spark, sf_dir))
    pairs = "transform(train, (r, i) -> struct(r.month AS month, r.value AS value, get(imputed, i) AS imputed))"
    return unfold(df, [*KEY, "n_missing", "gap_ratio", "raw_wins"], pairs).select(
        *KEY, month_text(F.col("month")).alias("month_str"), shown("value").alias("value"),
        shown("imputed", 1).alias("consumption_imputation"), count("n_missing").alias("n_missing"),
        shown("gap_ratio", 6).alias("gap_ratio"), "raw_wins",
    )


def run_messages(spark, sf_dir):
    return series_messages(_trained(spark, sf_dir))


def month_validation(spark, sf_dir):
    """Order months written in four notations: the invalid ones and their repaired form."""
    d = F.col("o_orderdate").cast("date")
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format(d, "yyyy-MM"))
        .when(kind == 1, F.date_format(d, "yyyyMM"))
        .when(kind == 2, F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.date_format(d, "MM/yyyy"))
    )
    orders = star.read(spark, sf_dir, "orders").select(text.alias("month_str"))
    bad = invalid_months(orders)
    return (
        bad.withColumn("normalised", normalise_month(F.col("month_str")))
        .withColumn("repaired", F.col("normalised").rlike(MONTH_PATTERN))
        .groupBy("month_str", "normalised", "repaired")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def persist_roundtrip(spark, sf_dir):
    """What readers see after three runs: one for all buildings, a later one for two of them, of which one has no
    rows any more, and one that was written but never committed."""
    series = decide_strategy(_series(spark, sf_dir)).where("n_train > 0")
    predictions = mean_model(series).withColumn("month_str", month_text(F.col("month")))
    models = add_mean_model(series).select(
        *KEY, *[F.lit(None).cast("string").alias(c) for c in ("chosen_hdd", "chosen_cdd")], "status",
        F.lit("mean").alias("model_family"), F.col("monthly_mean").alias("b_coefficient"),
        (12 * F.col("monthly_mean")).alias("annual_consumption_reference"),
        *[F.lit(None).cast("double").alias(c) for c in ("a_hdd", "a_cdd", *ACCURACY)],
    )
    predictions, models = cut_lineage(predictions), cut_lineage(models)
    base = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    asked = star.params(spark, sf_dir)
    noon = datetime(2020, 1, 1, 12, tzinfo=timezone.utc)
    persist_results(predictions, models, asked, base, "first", noon)
    kept = "id_building_primaire = 'B_0'"
    again = predictions.withColumn("predictive_consumption", 2 * F.col("predictive_consumption")).where(kept)
    pair = asked.where("id_building_primaire IN ('B_0', 'B_1')")
    persist_results(again, models.where(kept), pair, base, "second", noon + timedelta(hours=1))
    stage_results(again, models, asked, base, "third", noon + timedelta(hours=2))
    described = published_models(spark, base).select(
        *KEY, F.col("run_id").alias("model_run"), shown("annual_consumption_reference").alias("annual")
    )
    return published_predictions(spark, base).join(described, KEY).select(
        *KEY, "month_str", "run_id", "model_run", shown("predictive_consumption").alias("predictive"), "annual"
    )


def quantile_selection(spark, sf_dir):
    """Exact quantiles of all order prices as one group, and of each customer segment's orders."""
    orders = star.read(spark, sf_dir, "orders").join(
        star.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    groups = [
        quantiles(orders.withColumn("grp", g), ["grp"], "o_totalprice", probabilities, cut_lineage)
        for g in (F.lit("all"), F.col("c_mktsegment"))
    ]
    return groups[0].unionByName(groups[1]).select(
        "grp", count("n").alias("n"), "probability", shown("quantile", 4).alias("quantile")
    )


def ordered_notes(spark, sf_dir):
    """Outlier notes of each building, once per text, numbered by first appearance over its series."""
    fitted = train_series(_series(spark, sf_dir, window=star.SHORT_WINDOW))
    notes = distinct_notes(series_messages(fitted))
    order = ["deliverypoint_id_primaire", "fluid", "seq"]
    numbered = positions(notes, ["id_building_primaire"], order, "ordinal", cut_lineage)
    return numbered.select("id_building_primaire", count("ordinal").alias("ordinal"), "code", "text")


def usage_gapfill_long(spark, sf_dir):
    """All orders as the readings of one meter, a third of them unknown in stretches of up to 30: one long series."""
    key = F.col("o_orderkey")
    unknown = (F.floor(key / 30) % 3 == 1) | (key % 17 == 0)
    readings = star.read(spark, sf_dir, "orders").select(
        F.lit("meter").alias("meter"), "o_orderdate", "o_orderkey", F.when(~unknown, F.col("o_totalprice")).alias("value")
    )
    filled = fill_gaps(readings, ["meter"], ["o_orderdate", "o_orderkey"], "value", cut_lineage)
    return filled.select(key.alias("reading"), shown("value").alias("value"), shown("value_filled").alias("filled"))


def input_problems_query(spark, sf_dir):
    """What is wrong with an invoice table whose dates and values are text, some of it unreadable."""
    okey = F.col("o_orderkey")
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = star.read(spark, sf_dir, "orders").select(
        okey.alias("invoice_id_primaire"),
        F.concat(F.lit("PDL_"), F.col("o_custkey").cast("string")).alias("deliverypoint_id_primaire"),
        F.when(okey % 23 == 0, F.lit("soon")).when(okey % 29 == 0, F.lit(None)).otherwise(start).alias("start"),
        F.when(okey % 31 == 0, F.lit("9999-12-31")).when(okey % 37 == 0, F.lit("1500-01-01"))
        .when(okey % 41 == 0, F.lit("1996-02-30")).otherwise(start).alias("end"),
        F.when(okey % 13 == 0, F.lit("n/a")).when(okey % 17 == 0, F.lit("NaN")).when(okey % 19 == 0, F.lit("-Infinity"))
        .otherwise(F.col("o_totalprice").cast("string")).alias("value"),
    )
    found = input_problems(raw, INVOICE, "invoice")
    return found.select("table", "column", "problem", count("n_rows").alias("n_rows"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    renamed = {
        "monthly_invoices_query": "monthly_invoices",
        "month_spine_query": "month_spine",
        "degreedays_pivot_query": "degreedays_pivot",
        "model_table_query": "model_table",
        "mean_model_query": "mean_model",
        "accuracy_query": "accuracy",
        "theil_sen_query": "theil_sen",
        "iqr_fence_query": "iqr_fence",
        "outliers_table_query": "outliers_table",
        "missing_months_query": "missing_prediction_months",
        "building_metrics_query": "building_metrics",
        "input_problems_query": "input_problems",
        "model_details_query": "model_details",
    }
    listed = [
        site_lookup, building_invoices, building_usage, station_degreedays, invoice_dedup,
        invoice_dedup_removed, invoice_prorata, monthly_invoices_query, single_building_run,
        customer_monthly_invoices,
        joined_monthly_invoices, series_pairs, month_spine_query, month_spine_midstart,
        degreedays_pivot_query, degreedays_missing_months, usage_monthly, usage_non_constant,
        usage_wide, factor_profile, usage_interpolated, model_table_query, customer_model_table,
        train_test_flags, train_decision, customer_train_decision, mean_model_query, dju_scores,
        customer_dju_scores, dju_best, ols_two_factor, fitted_two_factor, ols_confidence,
        ols_many_factors,
        accuracy_query, theil_sen_query, lowess_equispaced, iqr_fence_query, anomalies_short,
        customer_anomalies_short, anomalies_long, y_final, customer_y_final, outliers_table_query,
        outlier_notes, missing_months_query, building_metrics_query, final_predictions, horizon_cut,
        final_model, customer_final_model, run_messages, month_validation, persist_roundtrip,
        quantile_selection, ordered_notes, usage_gapfill_long, input_problems_query,
        model_details_query, building_report, ranking_imputation, target_with_missing,
        seasonal_strength, seasonal_imputation,
    ]
    return {renamed.get(f.__name__, f.__name__): f for f in listed}
