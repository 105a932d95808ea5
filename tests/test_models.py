"""Decisions, targets, accuracy and the end-to-end run on small literal inputs."""

import time
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.calendar import month_spine
from panelcast.operators.panel import series_table
from panelcast.operators.regression import accuracy, accuracy_of_pairs
from panelcast.operators.reports import building_metrics, outliers_table, until_month
from panelcast.operators.strategy import choose_references, decide_strategy
from panelcast.operators.target import build_target
from panelcast.operators.usage import monthly_usage, monthly_usage_factors, profile_columns
from panelcast.operators.weather import degreedays_pivot, missing_months, reference_problems
from panelcast.plans.run import build_series, monthly_panel, run, run_and_persist
from panelcast.schemas import DJU_SPECS, MODEL_COLUMNS, PREDICTION_COLUMNS
from panelcast.sources.catalog import Sources, unknown_buildings
from panelcast.sources.sinks import persist_results, published_models, published_predictions, validate_months

KEYS = "id_building_primaire string, deliverypoint_id_primaire string, fluid string"
ROW = ("struct<month:date,start:date,end:date,value:double,n_invoices:bigint,is_train:boolean,"
       "is_test:boolean,dju:array<double>,factors:array<double>>")


def months(n, first=2020):
    return [date(first + k // 12, k % 12 + 1, 1) for k in range(n)]


def series(spark, *values, dju=None):
    rows = []
    for k, v in enumerate(values):
        entries = [
            (m, m, m, None if y is None else float(y), 1, True, False,
             (dju[i] if dju else [0.0] * 6), [])
            for i, (m, y) in enumerate(zip(months(len(v)), v))
        ]
        rows.append(("B", f"P{k}", "gas", [], entries))
    return spark.createDataFrame(rows, f"{KEYS}, factor_types array<string>, rows array<{ROW}>")


def test_strategy(spark):
    df = series(spark, [], [None] * 7, [0] * 7, [1] * 5, [1, 0, 0, 0, 0, 0])
    got = decide_strategy(df).orderBy("deliverypoint_id_primaire").collect()
    assert [r.status_code for r in got] == ["note_000"] * 3 + ["note_001", "note_annual_ref"]
    assert got[3].status == "TrainStatus.TOO_FEW_OBSERVATIONS"


def test_constant_reference_is_a_candidate_and_ties_keep_order(spark):
    rng = np.random.default_rng(0)
    h = rng.uniform(0, 100, 12)
    dju = [[float(v), float(v), float(v) / 2, 0.0, 0.0, 0.0] for v in h]
    y = 3 * h + rng.normal(0, 1, 12)
    (r,) = choose_references(decide_strategy(series(spark, y, dju=dju))).collect()
    assert (r.best_hdd, r.best_cdd) == ("hdd10", "cdd21")
    assert r.dju_scores[3] == pytest.approx(1 - 11 / 10)
    flat = choose_references(decide_strategy(series(spark, [4.0] * 12, dju=dju))).collect()[0]
    assert flat.best_hdd is None and flat.best_cdd is None


def prepared(spark, y, noise=1.0):
    rng = np.random.default_rng(7)
    h = rng.uniform(0, 100, len(y))
    dju = [[float(v)] * 3 + [0.0] * 3 for v in h]
    values = [None if a is None else float(a + 3 * b) if a != 0 else 0.0 for a, b in zip(y, h)]
    return choose_references(decide_strategy(series(spark, values, dju=dju))), h, values


def test_target_imputes_missing_with_fitted_values(spark):
    base = list(50 + np.random.default_rng(1).normal(0, 1, 20))
    base[4] = base[11] = None
    df, h, values = prepared(spark, base)
    (r,) = build_target(df, impute=True).collect()
    ok = [i for i, v in enumerate(values) if v is not None]
    fit = np.polyfit(h[ok], [values[i] for i in ok], 1)
    if r.raw_wins:
        assert len(r.target) == 18
    else:
        assert r.target[4].consumption_imputation == pytest.approx(np.polyval(fit, h[4]), rel=1e-6)
    assert r.n_missing == 2 and r.gap_ratio == pytest.approx(0.1)


def test_zero_rule(spark):
    """Zeros that spoil the fit are dropped; without zeros the rule still reports a drop."""
    base = list(50 + np.random.default_rng(1).normal(0, 1, 24))
    df, _, _ = prepared(spark, base)
    (clean,) = build_target(df, impute=False).collect()
    assert clean.drop_zeros and len(clean.target) == 24
    assert clean.best_y == "consumption_imputation"
    base[3] = base[9] = 0
    df, _, _ = prepared(spark, base)
    (zeros,) = build_target(df, impute=False).collect()
    assert zeros.drop_zeros and len(zeros.target) == 22
    flagged = outliers_table(build_target(df, impute=False)).collect()
    assert all(o.invoice_consumption_imputation != 0 for o in flagged)


def test_accuracy(spark):
    df = spark.createDataFrame(
        [("k", 1.0, 2.0), ("k", 2.0, 2.0), ("k", 4.0, 0.0), ("k", 5.0, float("nan"))],
        "id string, y double, f double",
    )
    (r,) = accuracy(df, ["id"], "y", "f", 1).collect()
    assert r.n_pairs == 3 and r.ME == pytest.approx(-1) and r.MPE == pytest.approx(25)
    assert r.MAE == pytest.approx(5 / 3) and r.R2 == pytest.approx(1 - 17 / (14 / 3))


def test_building_ratios(spark):
    building = spark.createDataFrame(
        [("B", 0.0, 3), ("E", 5.0, 1)], "id_building_primaire string, surface double, occupant int"
    )
    models = spark.createDataFrame(
        [("B", 10.0), ("B", None), ("B", 5.0)],
        "id_building_primaire string, annual_consumption_reference double",
    )
    got = {r.id_building_primaire: r for r in building_metrics(models, building).collect()}
    assert got["B"].total_energy_annual_consumption_reference == 15
    assert got["B"].ratio_kwh_m2 is None and got["B"].ratio_kwh_occupant == 5
    assert got["E"].total_energy_annual_consumption_reference is None


def test_spine_skips_a_partial_first_month(spark):
    monthly = spark.createDataFrame(
        [("B", "P", "gas", date(2024, 11, 5)), ("B", "P", "gas", None)], f"{KEYS}, start date"
    )
    params = spark.createDataFrame(
        [("B", date(2025, 1, 15), date(2025, 3, 10))],
        "id_building_primaire string, start_pred date, end_pred date",
    )
    got = sorted(r.month for r in month_spine(monthly, params).collect())
    assert got == [date(2024, 11, 1), date(2025, 2, 1), date(2025, 3, 1)]


def test_weather_anchor_and_gaps(spark):
    dd = spark.createDataFrame(
        [("S", "2024-01", "hdd", 10, 1.0), ("S", "2024-01", "hdd", 15, 2.0),
         ("S", "2024-02", "hdd", 15, 3.0), ("S", "2024-03", "hdd", 10, None),
         ("S", "2024-03", "hdd", 10, 4.0), ("S", "2024-03", "hdd", 10, 6.0)],
        "station_id string, period_month string, indicator string, basis int, value double",
    )
    wanted = spark.createDataFrame(
        [("S", date(2024, m, 1)) for m in (1, 2, 3)], "station_id string, month date"
    )
    rows = {r.month.month: r for r in degreedays_pivot(dd, wanted).collect()}
    assert set(rows) == {1, 3} and rows[1].hdd15 == 2.0 and rows[3].hdd15 is None
    gaps = {(r.ref, r.month.month) for r in missing_months(dd, wanted).collect()}
    assert ("hdd10", 2) in gaps and ("hdd15", 3) in gaps and ("hdd10", 1) not in gaps
    assert sum(r.n_ambiguous for r in reference_problems(dd).collect()) == 1


def test_usage_constant_and_profile(spark):
    usage = spark.createDataFrame(
        [("B", date(2024, m, 3), t, v) for m in (1, 2, 3)
         for t, v in (("A", 5.0), ("fi_x", float(m)), ("hdd10", float(m)))]
        + [("B", date(2024, 1, 9), "C", 1.0)],
        "id_building_primaire string, date date, type string, value double",
    )
    kept = {r.type: r.factor_class for r in monthly_usage_factors(usage).collect()}
    assert kept == {"fi_x": 0, "C": 1}
    assert monthly_usage(usage).count() == 10
    wide = spark.createDataFrame(
        [("2024-01", "1.5", "text", None)], "month_year string, a string, b string, c double"
    )
    assert [r.column_name for r in profile_columns(wide).collect()] == ["a"]


def lake(spark):
    """Two buildings with 36 reference months and a year to predict; a third without invoices."""
    rng = np.random.default_rng(11)
    building = spark.createDataFrame(
        [("B1", "S"), ("B2", "S"), ("B3", "S"), ("B4", None)],
        "id_building_primaire string, weather_station string",
    )
    meters = spark.createDataFrame(
        [("P1", "B1", "gas"), ("P2", "B1", "power"), ("P3", "B2", "gas"), ("P4", "B4", "gas")],
        "deliverypoint_id_primaire string, id_building_primaire string, fluid string",
    )
    heat = {m: float(max(0, 300 * np.cos(2 * np.pi * k / 12) + rng.normal(0, 20)))
            for k, m in enumerate(months(48))}
    dd = spark.createDataFrame(
        [("S", m.strftime("%Y-%m"), ind, basis,
          v * basis / 10 + 3 * m.month if ind == "hdd" else max(0.0, 200 - v))
         for m, v in heat.items() for ind, basis in DJU_SPECS],
        "station_id string, period_month string, indicator string, basis int, value double",
    )
    usage = spark.createDataFrame(
        [("B1", m, "fi_area", float(rng.uniform(50, 60))) for m in months(48)],
        "id_building_primaire string, date date, type string, value double",
    )
    rows = []
    for p, slope in (("P1", 4.0), ("P2", 0.5), ("P3", 2.0), ("P4", 1.0)):
        for k, m in enumerate(months(36)):
            v = 500 + slope * heat[m] + float(rng.normal(0, 10))
            if p == "P1" and k == 20:
                v += 5000
            rows.append((f"{p}-{k}", p, m, date(m.year, m.month, 28), v))
    invoice = spark.createDataFrame(
        rows,
        "invoice_id_primaire string, deliverypoint_id_primaire string, start date, end date, "
        "value double",
    )
    return Sources({"building": building, "deliverypoint": meters, "degreedays": dd,
                    "usage_data": usage, "invoice": invoice})


def requests(spark, *ids):
    return spark.createDataFrame(
        [(i, date(2020, 1, 1), date(2022, 12, 31), date(2023, 1, 1), date(2023, 12, 31))
         for i in ids],
        "id_building_primaire string, start_ref date, end_ref date, start_pred date, end_pred date",
    )


def test_end_to_end(spark, tmp_path):
    sources = lake(spark)
    asked = requests(spark, "B1", "B2", "B3", "B4", "B9")
    base = str(tmp_path / "out")
    results, run_id = run_and_persist(sources, asked, base)
    models = {r.deliverypoint_id_primaire: r for r in results.models.collect()}
    assert set(models) == {"P1", "P2", "P3"}
    assert all(m.model_family == "ols_dju_plus_factors" for m in models.values())
    assert models["P3"].R2 > 0.9 and set(models["P1"].coefficients) >= {"fi_area"}
    predictions = results.predictions.collect()
    assert len(predictions) == 36
    assert all(p.confidence_lower95 <= p.predictive_consumption <= p.confidence_upper95
               for p in predictions)
    found = results.outliers.collect()
    assert ("P1", date(2021, 9, 1)) in {(o.invoice_delivery_point, o.invoice_start_date)
                                        for o in found}
    why = {(r.id_building_primaire, r.code) for r in results.building_messages.collect()}
    assert {("B3", "warning"), ("B4", "error_station"), ("B9", "error_building"),
            ("B2", "note_012")} <= why
    assert [r[0] for r in unknown_buildings(sources.table("building"), asked).collect()] == ["B9"]
    codes = {r.code for r in results.messages.where("deliverypoint_id_primaire = 'P1'").collect()}
    assert {"note_005", "debug_outliers_months", "note_008", "note_annual_ref"} <= codes
    assert until_month(results.predictions, "2023-03").count() == 9
    assert results.outlier_notes.count() >= 2

    stored = published_predictions(spark, base)
    assert set(stored.columns) == set(PREDICTION_COLUMNS) and stored.count() == 36
    assert set(published_models(spark, base).columns) == set(MODEL_COLUMNS)

    again, second = run_and_persist(sources, requests(spark, "B2"), base)
    ids = {(r.id_building_primaire, r.run_id) for r in
           published_models(spark, base).collect()}
    assert ids == {("B1", run_id), ("B2", second)}

    empty = again.predictions.where("false"), again.models.where("false")
    persist_results(*empty, requests(spark, "B1"), base)
    left = published_models(spark, base).select("id_building_primaire").distinct()
    assert [r[0] for r in left.collect()] == ["B2"]


def test_run_without_factors_equals_numpy(spark):
    """The final regression of an outlier-free series is plain least squares on the two refs."""
    series_rows = build_series(lake(spark), requests(spark, "B2"))
    (m,) = run(lake(spark), requests(spark, "B2")).models.collect()
    (row,) = choose_references(decide_strategy(series_rows)).collect()
    x = np.array([[1, r.dju[row.hdd_pos], r.dju[row.cdd_pos]] for r in row.train])
    y = np.array([r.value for r in row.train])
    outliers = run(lake(spark), requests(spark, "B2")).outliers.count()
    if outliers == 0:
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose([m.b_coefficient, m.a_hdd, m.a_cdd], beta, rtol=1e-6)


def test_bad_month_is_rejected_before_any_write(spark, tmp_path):
    bad = spark.createDataFrame([("2025-1",), ("2025-01",), (None,)], "month_str string")
    with pytest.raises(ValueError, match="2025-1"):
        validate_months(bad)
    with pytest.raises(ValueError, match="missing columns"):
        persist_results(bad, bad, requests(spark, "B1"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_input_partitioning_does_not_matter(spark):
    a = build_series(lake(spark), requests(spark, "B1")).select("rows").collect()
    mixed = lake(spark)
    shuffled = Sources({n: mixed.table(n).repartition(5, F.rand(3)) for n in
                        ("building", "deliverypoint", "degreedays", "usage_data", "invoice")})
    b = build_series(shuffled, requests(spark, "B1")).select("rows").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_odd_inputs_end_in_messages(spark):
    """Bad months, numeric meter ids, open-ended dates and contradicting requests neither fail nor merge."""
    clean = lake(spark)
    numbers = {"P1": 101, "P2": 102, "P3": 103}
    number = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    meter = number[F.col("deliverypoint_id_primaire")]
    known = F.col("deliverypoint_id_primaire").isin(*numbers)
    dd = clean.table("degreedays")
    extra = dd.limit(1).withColumn("period_month", F.lit("no month"))
    twice = dd.where("value > 0").limit(1).withColumn("value", F.col("value") + 1)
    invoice = clean.table("invoice").where(known).withColumn("deliverypoint_id_primaire", meter)
    endless = invoice.limit(1).withColumns({"invoice_id_primaire": F.lit("open"), "end": F.to_date(F.lit("9999-12-31"))})
    sources = Sources({
        "building": clean.table("building"), "usage_data": clean.table("usage_data"),
        "degreedays": dd.unionByName(extra).unionByName(twice),
        "deliverypoint": clean.table("deliverypoint").where(known).withColumn("deliverypoint_id_primaire", meter.cast("string")),
        "invoice": invoice.unionByName(endless),
    })
    other = requests(spark, "B1").withColumn("end_pred", F.to_date(F.lit("2023-06-30")))
    asked = requests(spark, "B1", "B2", "B2").unionByName(other)
    results = run(sources, asked)
    buildings = {r.id_building_primaire for r in results.models.select("id_building_primaire").collect()}
    assert buildings == {"B2"}
    assert results.models.groupBy("id_building_primaire", "deliverypoint_id_primaire").count().where("count > 1").count() == 0
    why = [(r.id_building_primaire, r.code, r.text) for r in results.building_messages.collect()]
    assert [w[:2] for w in why].count(("B1", "error_request")) == 1 and ("B2", "error_request") not in [w[:2] for w in why]
    assert any("without a usable month" in t for _, _, t in why) and any("several values" in t for _, _, t in why)


def test_invoices_are_restricted_before_any_shuffle_of_them(spark):
    panel = monthly_panel(lake(spark), requests(spark, "B2"))
    plan = panel._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = max(k for k, line in enumerate(plan) if "LeftSemi" in line and "deliverypoint_id_primaire" in line)
    first_sum = max(k for k, line in enumerate(plan) if "Aggregate" in line and "invoice_id_primaire" in line)
    assert semi > first_sum  # deeper in the plan, so earlier in the run


def test_accuracy_of_a_long_series_takes_the_mean_once(spark):
    """With the mean worked out again for every pair these 4,000 pairs need about 1.7e9 steps."""
    rng = np.random.default_rng(3)
    y, fitted = rng.normal(50, 9, 4000), rng.normal(50, 9, 4000)
    pairs = [(float(a), float(b)) for a, b in zip(y, fitted)]
    df = spark.createDataFrame([(pairs, 2), ([], 2)], "pairs array<struct<y:double,fitted:double>>, p int")
    began = time.time()
    got, empty = df.select(*[c.alias(n) for n, c in accuracy_of_pairs(F.col("pairs"), F.col("p")).items()]).collect()
    assert time.time() - began < 15
    err = fitted - y
    r2 = 1 - (err**2).sum() / ((y - y.mean()) ** 2).sum()
    assert got.RMSE == pytest.approx(np.sqrt((err**2).mean())) and got.ME == pytest.approx(err.mean())
    assert got.R2 == pytest.approx(r2) and got.adjR2 == pytest.approx(1 - (1 - r2) * 3999 / 3997)
    assert all(v is None for v in empty)


def test_scores_of_targets_that_are_equal_or_not(spark):
    """A target equal to an earlier one takes its score; zeros and anomalies are scored by themselves."""
    rng = np.random.default_rng(5)
    h = rng.uniform(10, 100, 12)
    dju = [[float(v)] * 3 + [0.0] * 3 for v in h]
    plain = 3 * h + rng.normal(0, 2, 12)
    zeros, spike = plain.copy(), 200 + np.arange(12.0) + rng.normal(0, 0.1, 12)
    zeros[4] = 0.0
    spike[6] += 500
    both = spike.copy()
    both[2] = 0.0
    df = choose_references(decide_strategy(series(spark, plain, zeros, spike, both, dju=dju)))
    got = build_target(df, impute=False).orderBy("deliverypoint_id_primaire").collect()

    def score(y, a, p):
        x = np.column_stack([np.ones(len(a)), a])
        sse = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
        return 1 - sse / ((y - y.mean()) ** 2).sum() * (len(y) - 1) / (len(y) - p - 1)

    factors = [(r.hdd_pos is not None) + (r.cdd_pos is not None) for r in got]
    for r, y, p in zip(got, (plain, zeros, spike, both), factors):
        kept = np.ones(12, bool) if not r.drop_zeros else y != 0
        assert r.score_imputed == pytest.approx(score(y[kept], h[kept], p))
        months_kept = {t.month: t.consumption_correction for t in r.target}
        corrected = np.array([months_kept[m] for m, k in zip(months(12), kept) if k])
        assert r.score_corrected == pytest.approx(score(corrected, h[kept], p))
    assert [r.n_anomalies > 0 for r in got][::2] == [False, True] and got[1].drop_zeros


def test_gaps_of_weather_are_worked_out_only_where_they_are_read(spark):
    """A series table read without its gaps of weather has no text of months in its plan."""
    at = date(2020, 1, 1)
    monthly = spark.createDataFrame(
        [("B", "P", "gas", at, date(2020, 1, 31), 5.0)], f"{KEYS}, start date, end date, value double"
    )
    sites = spark.createDataFrame(
        [("B", "S", at, date(2020, 12, 31), date(2021, 1, 1), date(2021, 2, 28), at,
          [([1.0] * 6, [True] * 6)], [], None, [])],
        "id_building_primaire string, weather_station string, start_ref date, end_ref date, start_pred date, "
        "end_pred date, weather_first date, weather array<struct<dju:array<double>,present:array<boolean>>>, "
        "factor_types array<string>, factor_first date, factor_values array<array<double>>",
    )
    parts = spark.createDataFrame([("B", 1)], "id_building_primaire string, parts int")
    table = series_table(monthly, sites, parts)
    (r,) = table.collect()
    assert list(r.dju_gaps) == [["2021-01", "2021-02"]] * 6
    assert [x.dju for x in r.rows] == [[1.0] * 6, [None] * 6, [None] * 6]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "yyyy-MM" in plan(table) and "yyyy-MM" not in plan(table.select("rows"))
