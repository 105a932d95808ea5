"""Operators on groups of any size: least squares, windowed usage, publication, selection."""

from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.diagnostics import building_messages
from panelcast.operators.least_squares import fit_groups, terms
from panelcast.operators.selection import iqr_bounds, quantiles, rank_values
from panelcast.operators.usage import monthly_from_daily, monthly_usage
from panelcast.plans.run import cut_lineage
from panelcast.schemas import MODELS, PREDICTIONS, USAGE
from panelcast.sources import sinks
from panelcast.sources.catalog import Sources, building_usage, daily_usage, in_windows, input_problems

XS = [f"x{i}" for i in range(5)]


def design(kind, rng):
    n = {"square": 6, "short": 3, "one": 1}.get(kind, 60)
    x = rng.normal(size=(n, 5)) * [1, 10, 1000, 0.01, 3] + [0, 5, 1e5, 2, -7]
    if kind == "combination":
        x[:, 3], x[:, 4] = 2 * x[:, 0] - x[:, 1], 12
    if kind == "copies":
        x[:, 1] = x[:, 4] = x[:, 0]
    if kind == "constants":
        x[:] = 7.0
    if kind == "far":
        x += 1e7
    y = x @ [1, 2, 0.3, 40, 5] + rng.normal(size=n) + 3
    return x, (np.full(n, 4.0) if kind == "flat" else y)


KINDS = ["plain", "square", "short", "one", "combination", "copies", "constants", "far", "flat"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(1)
    designs = {k: design(k, rng) for k in KINDS}
    rows = [(k, float(b), *map(float, a)) for k, (x, y) in designs.items() for a, b in zip(x, y)]
    rows += [("plain", None, *[1.0] * 5), ("plain", float("nan"), *[1.0] * 5), ("plain", 1.0, float("inf"), *[1.0] * 4)]
    rows += [("incomplete", 1.0, None, *[1.0] * 4)]
    df = spark.createDataFrame(rows, "k string, y double, " + ", ".join(f"{c} double" for c in XS))
    return designs, df.repartition(7), {r.k: r for r in fit_groups(df.repartition(7), ["k"], "y", XS).collect()}


@pytest.mark.parametrize("kind", KINDS)
def test_least_squares_equals_the_pseudo_inverse(fitted, kind):
    x, y = fitted[0][kind]
    got, full = fitted[2][kind], np.c_[np.ones(len(x)), x]
    pseudo = np.linalg.pinv(full)
    want, rank = pseudo @ y, np.linalg.matrix_rank(full)
    if kind == "far":  # the uncentred design has too few digits for the check itself
        slopes = np.linalg.lstsq(x - x.mean(0), y - y.mean())[0]
        want, rank = np.array([y.mean() - x.mean(0) @ slopes, *slopes]), 6
    assert np.allclose(full @ np.array(got.beta), full @ want, rtol=0, atol=1e-6 * max(1, np.abs(y).max()))
    loose = 1e-5 if kind == "far" else 1e-6  # a deviation of 0.01 around 1e7 leaves so many digits in the data
    assert np.allclose(got.beta, want, rtol=loose, atol=1e-7 * np.abs(want).max())
    assert got.n == len(x) and got["rank"] == rank and got.dof == max(len(x) - 6, 1)
    assert np.isclose(got.sse, ((y - full @ want) ** 2).sum(), rtol=1e-5, atol=1e-9 * (1 + ((y - y.mean()) ** 2).sum()))
    if kind != "far":
        inverse = pseudo @ pseudo.T
        assert np.allclose(np.array(got.gram_inverse).reshape(6, 6), inverse, rtol=1e-6, atol=1e-6 * np.abs(inverse).max())


def test_least_squares_rows_and_plan(fitted):
    _, df, got = fitted
    assert set(got) == set(KINDS)  # no complete row, no result
    out = terms(fit_groups(df, ["k"], "y", XS), ["k"], XS)
    assert out.columns == ["k", "n", "rank", "sigma2", "term", "beta", "std_error"]
    plain = {r.term: r for r in out.where("k = 'plain'").collect()}
    full = np.c_[np.ones(60), fitted[0]["plain"][0]]
    want = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * got["plain"].sigma2)
    assert np.allclose([plain[t].std_error for t in ["intercept", *XS]], want, rtol=1e-6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_covar_pop" in plan and "Python" not in plan
    assert fit_groups(df.where("false"), ["k"], "y", XS).count() == 0


def usage_rows(spark):
    rng = np.random.default_rng(2)
    rows = [("B1", date(2020, 1, 1) + timedelta(int(d)), t, float(v))
            for d, t, v in zip(rng.integers(0, 800, 3000), rng.choice(["fi_a", "u"], 3000), rng.normal(size=3000))]
    rows += [("B2", date(2020, 5, 5), "u", None), ("B2", date(2020, 5, 5), "u", 3.0), ("B2", None, "u", 1.0)]
    return spark.createDataFrame(rows, "id_building_primaire string, date date, type string, value double")


def test_usage_in_windows(spark):
    usage = usage_rows(spark)
    windows = spark.createDataFrame(
        [("B1", date(2020, 3, 17), date(2021, 1, 31)), ("B1", date(2021, 1, 31), date(2021, 2, 1)),
         ("B2", date(2020, 5, 5), date(2020, 5, 5)), ("B2", date(2020, 6, 1), date(2020, 5, 1)), ("B3", None, date(2020, 1, 1))],
        "id_building_primaire string, start date, end date",
    )
    got = in_windows(daily_usage(usage), windows)
    want = usage.join(windows, "id_building_primaire").where("date BETWEEN start AND end")
    want = want.groupBy("id_building_primaire", "date", "type", "start").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    key = lambda r: (r[0], r[1], r[2], r[3], None if r[4] is None else round(r[4], 9))
    rows = got.select("id_building_primaire", "date", "type", "n_rows", "total").collect()
    assert sorted(map(key, rows)) == sorted(map(key, want.drop("start").collect()))
    assert ("B2", 2, 1, 3.0) in {(r.id_building_primaire, r.n_rows, r.n_values, r.total) for r in got.collect()}
    none = windows.where("false")
    sources = Sources({"usage_data": usage})
    assert building_usage(sources, none).count() == 0 and building_usage(sources, windows).count() == got.count()
    means = {tuple(r)[:3]: r.value for r in monthly_usage(usage).collect()}
    reduced = {tuple(r)[:3]: r.value for r in monthly_from_daily(daily_usage(usage)).collect()}
    assert set(means) == set(reduced) and all(
        (a is None) == (reduced[k] is None) and (a is None or np.isclose(a, reduced[k])) for k, a in means.items()
    )


def test_window_bounds_reach_the_scan(spark, tmp_path):
    usage_rows(spark).write.parquet(f"{tmp_path}/silver/usage_data/usage_data.parquet")
    sources = Sources.from_parquet(spark, str(tmp_path))
    windows = spark.createDataFrame([("B1", date(2020, 2, 1), date(2020, 3, 1))], "id_building_primaire string, start date, end date")
    out = building_usage(sources, windows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2020-02-01)" in plan and "LessThanOrEqual(date,2020-03-01)" in plan
    # raw readings are reduced before the join with the windows
    assert plan.index("HashAggregate") > plan.index("Join") and 0 < out.count() <= 60


def results(spark, buildings, value):
    predictions = [(b, "P", "gas", "2020-01", 1.0, value, None, None) for b in buildings]
    p = spark.createDataFrame(predictions, ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in PREDICTIONS if f.name not in ("run_id", "created_at")))
    m = spark.createDataFrame([], MODELS).drop("run_id", "created_at")
    rows = spark.createDataFrame([(b, "P", "gas", value) for b in buildings],
                                 "id_building_primaire string, deliverypoint_id_primaire string, fluid string, b_coefficient double")
    return p, m.unionByName(rows, allowMissingColumns=True)


def asked(spark, *buildings):
    return spark.createDataFrame([(b,) for b in buildings], "id_building_primaire string")


def seen(spark, base):
    return tuple(
        {r[0]: r[1] for r in df.select("id_building_primaire", c).collect()}
        for df, c in ((sinks.published_predictions(spark, base), "predictive_consumption"),
                      (sinks.published_models(spark, base), "b_coefficient"))
    )


def test_publication(spark, tmp_path):
    base, noon = str(tmp_path / "out"), datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    assert seen(spark, base) == ({}, {})
    sinks.persist_results(*results(spark, ["007", "B=1/x", "B2"], 1.0), asked(spark, "007", "B=1/x", "B2"), base, "a", noon)
    first = {"007": 1.0, "B=1/x": 1.0, "B2": 1.0}
    assert seen(spark, base) == (first, first)
    # written, but not committed: nothing changes
    later = noon + timedelta(hours=1)
    sinks.stage_results(*results(spark, ["007"], 2.0), asked(spark, "007", "B2"), base, "b", later)
    assert seen(spark, base) == (first, first)
    sinks.commit_run(spark, base, "b", later)
    second = {"007": 2.0, "B=1/x": 1.0}
    assert seen(spark, base) == (second, second)
    # an older run that is committed late does not win
    sinks.persist_results(*results(spark, ["007"], 9.0), asked(spark, "007", None), base, "old", noon - timedelta(days=1))
    assert seen(spark, base) == (second, second)
    assert {r.run_id for r in sinks.superseded_runs(spark, base).collect()} == {"old"}
    # nothing but empty results for all
    sinks.persist_results(*results(spark, [], 0.0), asked(spark, "007", "B=1/x", "B2"), base, "c", later + timedelta(hours=1))
    assert seen(spark, base) == ({}, {})


def test_selection_equals_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=997), "ties": rng.choice([1.0, 2.0, 2.0, 5.0], 400), "one": np.array([3.5]),
        "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 200), -(10.0 ** rng.integers(-300, 300, 200)), np.zeros(9)]),
        "near": 1.0 + np.arange(300) * 2.0**-52, "two": np.array([1.0, 4.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    rows += [("normal", None), ("normal", float("nan")), ("normal", float("inf")), ("nothing", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    p = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.probability): (r.n, r.quantile) for r in quantiles(df, ["g"], "v", p, cut_lineage).collect()}
    assert set(got) == {(g, q) for g in groups for q in p}
    for (g, q), (n, value) in got.items():
        assert n == len(groups[g]) and np.isclose(value, np.quantile(groups[g], q), rtol=1e-14, atol=0)
    ranks = spark.createDataFrame([("near", r) for r in (0, 17, 299, 300, -1)], "g string, rank long")
    at = {r.rank: r.value_at for r in rank_values(df, ["g"], "v", ranks, cut_lineage).collect()}
    assert at == {r: 1.0 + r * 2.0**-52 for r in (0, 17, 299)}
    fences = {r.g: r for r in iqr_bounds(df, ["g"], "v", 1.5, cut_lineage).collect()}
    q1, q3 = np.quantile(groups["normal"], [0.25, 0.75])
    assert np.isclose(fences["normal"].high, q3 + 1.5 * (q3 - q1)) and "one" not in fences
    assert quantiles(df.where("false"), ["g"], "v", p, cut_lineage).count() == 0


def test_rejected_values_are_counted_while_reading(spark):
    usage = spark.createDataFrame(
        [("B", "2020-01-01", "u", "1.5"), ("B", "later", "u", "x"), ("B", "9999-12-31", "u", "NaN"), ("B", None, "u", None),
         ("B", "2020-01-02", "u", "Infinity"), ("B", "1500-01-01", "u", "2")],
        "id_building_primaire string, date string, type string, value string",
    )
    sources = Sources({"usage_data": usage}, count_problems=True)
    assert sources.table("usage_data").where("value IS NOT NULL").count() == 3
    want = {("date", "bad_value"): 1, ("date", "out_of_calendar"): 2, ("value", "bad_value"): 1, ("value", "nan"): 1,
            ("value", "infinity"): 1}
    assert sources.problems() == {"usage_data": want}
    listed = input_problems(usage, USAGE, "usage_data").collect()
    assert {(r["column"], r.problem): r.n_rows for r in listed} == want
    clean = Sources({"usage_data": usage_rows(spark)}, count_problems=True)
    clean.table("usage_data").count()
    assert clean.problems() == {"usage_data": {}} and Sources({"usage_data": usage}).problems() == {}
    assert input_problems(usage.select("type"), USAGE, "usage_data").count() == 0


def test_requests_without_a_date_are_reported(spark):
    days = (date(2020, 1, 1), date(2020, 12, 31), date(2021, 1, 1))
    params = spark.createDataFrame(
        [("A", *days, date(2021, 12, 31)), ("B", *days, None), ("C", *days, None), ("C", *days, date(2021, 12, 31))],
        "id_building_primaire string, start_ref date, end_ref date, start_pred date, end_pred date",
    )
    building = spark.createDataFrame([(b, "S") for b in "ABC"], "id_building_primaire string, weather_station string")
    monthly = spark.createDataFrame([("A", days[0]), ("A", None), ("B", days[0]), ("C", days[0])], "id_building_primaire string, start date")
    sites = spark.createDataFrame([(b, ["fi_x"]) for b in "ABC"], "id_building_primaire string, factor_types array<string>")
    weather = spark.createDataFrame([], "station_id string, period_month string, indicator string, basis int, value double")
    got = {}
    for r in building_messages(params, building, monthly, sites, weather).collect():
        got.setdefault(r.id_building_primaire, []).append((r.code, r.text))
    assert [c for c, _ in got["A"]] == ["warning"] and got["A"][0][1].startswith("1 month")
    assert got["B"] == [("error_request", "a date of the request is missing")]
    assert [t.split()[0] for c, t in got["C"] if c == "error_request"] == ["2", "a"]
