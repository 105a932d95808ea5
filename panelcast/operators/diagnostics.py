"""Messages as data: one row per series, position, code and text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalars import month_text
from panelcast.operators.strategy import test_rows
from panelcast.operators.weather import reference_problems
from panelcast.schemas import DJU_COLUMNS, GAP_WARNING, KEY

NO_FACTORS = "no usage factor that varies is available"


def _text(*parts) -> Column:
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null"))
          for p in parts]
    )


def _list(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))


def _message(when: Column, code: str, *text) -> Column:
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(F.lit(code).alias("code"), _text(*text).alias("text")),
    )


def message_list() -> Column:
    """Everything a finished series has to say: an array of (code, text) in processing order."""
    c = F.col
    always = F.lit(True)
    any_dju = F.exists("dju_seen", lambda s: s)
    n_train, ready = c("n_train"), c("status_code") == "note_annual_ref"
    name = (c("fluid"), " PDL ", c("deliverypoint_id_primaire"))
    test = test_rows()
    starts = F.transform("train", lambda r: r.start)
    dup_starts = n_train - F.size(F.array_distinct(starts))
    months = c("rows.month")
    invoices = F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, r: s + r.n_invoices)
    invoiced = F.size(F.filter("rows", lambda r: r.n_invoices > 0))
    repeated = F.size(F.filter("rows", lambda r: r.n_invoices > 1))
    regression = c("beta").isNotNull()
    no_reference = c("best_hdd").isNull() & c("best_cdd").isNull()
    unpredicted = F.transform(
        F.filter(
            test,
            lambda r: F.exists(
                F.concat(F.transform("dju_positions", lambda k: F.get(r.dju, k)), r.factors),
                lambda v: v.isNull(),
            ),
        ),
        lambda r: month_text(r.month),
    )

    messages = []
    for k, ref in enumerate(DJU_COLUMNS):
        seen = c("dju_seen")[k]
        messages += [
            _message(any_dju & ~seen, "error_008", f"reference {ref} never occurs at the station"),
            _message(
                seen & (F.size(c("dju_gaps")[k]) > 0),
                "error_009", f"reference {ref} lacks the months ", _list(c("dju_gaps")[k]),
            ),
        ]
    messages += [
        _message(~any_dju, "error_010", "none of the six references exists for station ",
                 c("weather_station")),
        _message(~any_dju, "note", "the series goes without degree-days"),
        _message(repeated > 0, "debug_invoices", repeated, " months are billed more than once"),
        _message(always, "debug_invoices_agg", "monthly rows ", invoices, " merged into ", invoiced),
        _message(F.size("factor_types") == 0, "note_012", NO_FACTORS),
        _message(always, "debug_model_table", "months: ", F.size("rows"),
                 ", with a value: ", F.size(F.filter("rows", lambda r: r.value.isNotNull()))),
        _message(always, "note_annual_ref", *name, ": the annual reference rests on ",
                 n_train, " months"),
        _message(always, "debug_ref_bounds", "reference from ", c("start_ref"), " to ",
                 c("end_ref")),
        _message(n_train > 0, "debug_ref_window", "training months ",
                 month_text(F.array_min(c("train.month"))), " to ",
                 month_text(F.array_max(c("train.month")))),
        _message(dup_starts > 0, "debug_duplicates", dup_starts,
                 " training rows repeat a start date"),
        _message(always, "debug_pred_bounds", "prediction from ", c("start_pred"), " to ",
                 c("end_pred")),
        _message(F.size(test) > 0, "debug_test", "months to predict: ", F.size(test)),
        _message(F.size(test) == 0, "note", "no month to predict"),
        _message(n_train == 0, "note", "no training row in the reference period"),
        _message(n_train == 0, "note_000", *name, ": nothing billed in the reference period"),
        _message((n_train > 0) & (c("n_value") == 0), "note_000", *name,
                 ": every reference value is missing"),
        _message((c("n_value") > 0) & (c("n_zero") == n_train), "note_000", *name,
                 ": every reference value is zero"),
        _message(c("status_code") == "note_001", "note_001", *name, ": too few observations, ",
                 n_train),
        _message(ready & no_reference, "note", "no heating or cooling reference could be scored"),
        _message(ready & c("best_hdd").isNotNull(), "debug_postprocess_dju", "heating ",
                 c("best_hdd"), ", adjusted R2 ", F.round(F.get("dju_scores", c("hdd_pos")), 3)),
        _message(ready & c("best_cdd").isNotNull(), "debug_postprocess_dju", "cooling ",
                 c("best_cdd"), ", adjusted R2 ", F.round(F.get("dju_scores", c("cdd_pos")), 3)),
        _message(ready & (c("gap_ratio") >= GAP_WARNING), "note_003",
                 "more than a fifth of the values is missing, treat results with care"),
        _message(ready & (c("n_missing") > 0), "note_004", "missing values: ",
                 c("n_missing")),
        _message(ready & c("raw_wins"), "note", "the raw series fits better than the filled one, its gaps are dropped"),
        _message(ready & (c("n_anomalies") > 0), "note_005", "anomalous values: ",
                 c("n_anomalies")),
        _message(ready & (c("n_anomalies") > 0), "debug_outliers_months",
                 _list(c("anomaly_months"))),
        _message(ready & (c("n_anomalies") > 0), "debug_outliers_iqr",
                 "fence ", F.round("anomaly_fence.low", 2), " to ", F.round("anomaly_fence.high", 2),
                 ", quartiles ", F.round("anomaly_fence.q1", 2), " and ", F.round("anomaly_fence.q3", 2)),
        _message(ready & c("drop_zeros"), "note_006", "months of zero are left out"),
        _message(ready & ~c("drop_zeros"), "note_007",
                 "months of zero stay in"),
        _message(ready, "note_008", "target: ", c("best_y")),
        _message(ready & c("best_hdd").isNotNull(), "debug_dju_choice", "heating: ",
                 c("best_hdd")),
        _message(ready & c("best_cdd").isNotNull(), "debug_dju_choice", "cooling: ",
                 c("best_cdd")),
        _message(regression & (F.size(unpredicted) > 0), "note",
                 "no prediction, as a predictor is missing, in ",
                 _list(unpredicted)),
        _message(ready & ~regression, "note",
                 "no regression possible, the mean is used"),
    ]
    return F.array_compact(F.array(*messages))


def series_messages(df: DataFrame) -> DataFrame:
    """The messages of every series, one per row (``seq`` from 0)."""
    return df.select(*KEY, F.posexplode(message_list()).alias("seq", "m")).select(*KEY, "seq", "m.code", "m.text")


def building_messages(
    params: DataFrame, building: DataFrame, monthly: DataFrame, sites: DataFrame,
    degreedays: DataFrame,
) -> DataFrame:
    """Why a requested building yields nothing, or loses rows; such buildings do not fail others."""
    dates = ["start_ref", "end_ref", "start_pred", "end_pred"]
    params = params.groupBy("id_building_primaire").agg(
        # as one value, so that requests without some date count, too
        F.count_distinct(F.struct(*dates)).alias("n_requests"),
        F.max(F.exists(F.array(*dates), lambda d: d.isNull())).alias("incomplete"),
        F.max("start_pred").alias("start_pred"), F.min("end_pred").alias("end_pred"),
    )
    have = monthly.groupBy("id_building_primaire").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.count_if(F.col("start").isNull()).alias("n_no_start"),
    )
    known = building.select(
        "id_building_primaire", "weather_station", F.lit(True).alias("known")
    )
    factors = sites.select("id_building_primaire", F.size("factor_types").alias("n_factors"))
    stations = building.select(F.col("weather_station").alias("station_id")).distinct()
    problems = reference_problems(degreedays.join(stations, "station_id", "left_semi")).select(
        F.col("station_id").alias("weather_station"), "n_bad_months", "n_ambiguous"
    )
    joined = (
        params.join(known, "id_building_primaire", "left")
        .join(have, "id_building_primaire", "left")
        .join(factors, "id_building_primaire", "left")
        .join(problems, "weather_station", "left")
    )
    unknown = F.col("known").isNull()
    messages = [
        _message(unknown, "error_building", "unknown building"),
        _message(~unknown & (F.coalesce("weather_station", F.lit("")) == ""), "error_station",
                 "no weather station, degree-days cannot be read"),
        _message(F.col("start_pred") > F.col("end_pred"), "error_window",
                 "start_pred must be <= end_pred"),
        _message(~unknown & F.col("n_months").isNull(), "warning", "no invoice found"),
        _message(F.col("n_no_start") > 0, "warning", F.col("n_no_start"),
                 " months have no first day and were left out"),
        _message(F.col("n_factors") == 0, "note_012", NO_FACTORS),
        _message(F.col("n_requests") > 1, "error_request", F.col("n_requests"),
                 " different requests for one building, none was run"),
        _message(F.col("incomplete"), "error_request", "a date of the request is missing"),
        _message(F.col("n_bad_months") > 0, "warning", F.col("n_bad_months"),
                 " degree-day rows without a usable month were left out"),
        _message(F.col("n_ambiguous") > 0, "warning", F.col("n_ambiguous"),
                 " degree-day references have several values in a month, the largest counts"),
    ]
    return joined.select(
        "id_building_primaire", F.inline(F.array_compact(F.array(*messages)))
    )


def distinct_notes(messages: DataFrame) -> DataFrame:
    """Outlier notes once per building and text, in order of first appearance."""
    return (
        messages.where(F.col("code").isin("note_005", "debug_outliers_months"))
        .groupBy("id_building_primaire", "code", "text")
        .agg(F.min(F.struct("deliverypoint_id_primaire", "fluid", "seq")).alias("first_seen"))
        .select("id_building_primaire", "code", "text", "first_seen.*")
    )
