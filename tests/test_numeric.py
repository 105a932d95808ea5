"""Array maths against brute force."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions.linear import adj_r2_score, fit_if_enough, moments
from panelcast.functions.seasonal import _loess, decompose
from panelcast.functions.series import (
    interpolate,
    iqr_fence,
    let,
    lowess,
    smooth,
    theil_sen,
    var_pop,
)
from panelcast.functions.solve import ols_solve, solve_stack, t_975
from panelcast.functions.structural import smoothed_level
from panelcast.operators.anomalies import detect_anomalies, seasonal_fill
from panelcast.operators.usage import interpolate_long
from panelcast.plans.oracle_seasonal import decomposition


def arrays(spark, rows, name="y"):
    return spark.createDataFrame(
        [(i, [None if v is None else float(v) for v in r]) for i, r in enumerate(rows)],
        f"id int, {name} array<double>",
    )


def evaluate(spark, rows, expression):
    df = arrays(spark, rows).select("id", F.expr(expression).alias("out"))
    return [r.out for r in df.orderBy("id").collect()]


def brute_interpolate(v):
    x = np.array([np.nan if a is None else a for a in v], float)
    ok = np.flatnonzero(~np.isnan(x))
    return None if not len(ok) else np.interp(np.arange(len(x)), ok, x[ok])


def test_interpolation_both_forms_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [[None, 1, None, None, 4, None], [None, None], [None, 7, None]]
    for _ in range(20):
        r = rng.normal(size=rng.integers(2, 30))
        rows.append([None if rng.random() < 0.4 else float(v) for v in r])
    got = evaluate(spark, rows, interpolate("y"))
    long = arrays(spark, rows).select("id", F.posexplode("y").alias("t", "v"))
    filled = interpolate_long(long, ["id"], "t", "v").orderBy("id", "t").collect()
    for i, (r, g) in enumerate(zip(rows, got)):
        expected = brute_interpolate(r)
        other = [f.v_filled for f in filled if f.id == i]
        if expected is None:
            assert all(v is None for v in g) and all(v is None for v in other)
        else:
            assert np.allclose(g, expected) and np.allclose(other, expected)


def test_fence_and_variance(spark):
    (fence,) = evaluate(spark, [[8, 1, None, 2, 16, 4]], iqr_fence("y", 3.0))
    assert (fence.q1, fence.q3, fence.low, fence.high) == (2.0, 8.0, -16.0, 26.0)
    assert evaluate(spark, [[3, 3, 3, 3]], iqr_fence("y", 3.0)) == [None]
    assert evaluate(spark, [[1, 2, 3, 4]], var_pop("y"))[0] == pytest.approx(1.25)


def brute_lowess(y):
    n = len(y)
    k = int((0.25 if n < 40 else 0.2 if n < 100 else 0.15) * n + 1e-10)
    out = []
    for i in range(n):
        lo = max(0, min(n - k, i - k // 2))
        j = np.arange(lo, lo + k)
        h = max(i - lo, lo + k - 1 - i)
        w = np.clip(1 - (np.abs(j - i) / h) ** 3, 0, None) ** 3
        if (w > 0).sum() <= 1:
            out.append(y[i])
            continue
        x = np.column_stack([np.ones(k), j - i]) * np.sqrt(w)[:, None]
        out.append(np.linalg.lstsq(x, y[j] * np.sqrt(w), rcond=None)[0][0])
    return np.array(out)


def test_smoothers_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [list(rng.normal(100, 10, n)) for n in (6, 9, 12, 13, 14, 17, 24, 36, 48, 120)]
    got = evaluate(spark, rows, smooth("y", 12))
    for r, g in zip(rows, got):
        y, n = np.array(r), len(r)
        if n <= 12:
            i, j = np.triu_indices(n, 1)
            slope = np.median((y[j] - y[i]) / (j - i))
            t = np.arange(1, n + 1)
            expected = np.median(y) - slope * np.median(t) + slope * t
        else:
            expected = brute_lowess(y)
        assert np.allclose(g, expected, rtol=1e-10)
    assert evaluate(spark, [rows[4]], lowess("y"))[0][1:-1] == rows[4][1:-1]
    assert np.allclose(evaluate(spark, [[1, 3, 5, 7]], theil_sen("y"))[0], [1, 3, 5, 7])


def spiky(n, at, size):
    t = np.arange(1, n + 1)
    y = 100 + 2 * t + (-1.0) ** t
    y[at - 1] += size
    return list(y)


def test_anomaly_spikes(spark):
    rows = [spiky(20, 10, 20), spiky(20, 10, 40), spiky(14, 10, 20), [5.0] * 18]
    out = detect_anomalies(arrays(spark, rows), "y", "hit").orderBy("id").collect()
    first = [[i + 1 for i, h in enumerate(r.hit) if h] for r in out]
    assert 10 in first[0] and 10 in first[1]
    assert {9, 10, 11} <= set(first[1])
    assert first[2] == [] and first[3] == []


def brute_pass(x):
    """One seasonal pass on a complete long series: flags outside the fence."""
    season, trend = (v[0] for v in decompose(x[None]))
    detrended = x - trend
    if 1 - np.var(detrended - season) / np.var(detrended) >= 0.6:
        x = x - season
    resid = x - brute_lowess(x)
    q1, q3 = np.quantile(resid, [0.25, 0.75])
    return (resid < q1 - 3 * (q3 - q1)) | (resid > q3 + 3 * (q3 - q1))


def test_long_series_spike_in_a_season(spark):
    """The smoother is not robust, so a large spike also flags points whose window holds it;
    flags must equal two brute-force passes, the second on a seasonally refilled series."""
    t = np.arange(60)
    rng = np.random.default_rng(5)
    y = 200 + 0.3 * t + 50 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 1, 60)
    y[30] += 200
    first = brute_pass(y)
    line = np.interp(t, t[~first], y[~first])
    season, trend = (v[0] for v in decompose(line[None]))
    expected = first | brute_pass(np.where(first, season + trend, y))
    (row,) = detect_anomalies(arrays(spark, [y]), "y", "hit").collect()
    assert first[30] and row.hit == list(expected)


def test_decomposition_recovers_a_season():
    t = np.arange(72)
    season = 10 * np.sin(2 * np.pi * t / 12)
    y = np.array([5 + 0.2 * t + season + np.random.default_rng(k).normal(0, 0.2, 72)
                  for k in range(4)])
    y[:, 40] += 60
    s, trend = decompose(y)
    assert np.abs(s - season).max() < 1.0 and np.abs(trend - (5 + 0.2 * t)).max() < 1.0
    one, _ = decompose(y[1:2])
    assert np.allclose(one, s[1:2])
    for n in range(25, 38):
        s, trend = decompose(y[:, :n])
        assert s.shape == (4, n) and np.isfinite(s).all() and np.isfinite(trend).all()


def test_structural_level_follows_a_line_and_a_step():
    t = np.arange(20)
    assert np.allclose(smoothed_level((3 + 2.0 * t)[None]), 3 + 2.0 * t)
    noisy = 50 + np.random.default_rng(0).normal(0, 5, 36)[None]
    assert smoothed_level(noisy).std() < noisy.std()


def test_decomposition_equals_sql_on_lists():
    rng = np.random.default_rng(0)
    ys = []
    for n in (25, 30, 47, 48, 60):
        t = np.arange(n)
        for k in range(3):
            y = 1000 + 5 * t + 300 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 50, n)
            y[rng.integers(0, n, 3 * (k == 1))] += 5000
            ys.append(y if k < 2 else rng.normal(0, 1, n) ** 5)
    con = duckdb.connect()
    con.execute("CREATE TABLE q (d INT, y DOUBLE[])")
    con.executemany("INSERT INTO q VALUES (?, ?)", [[i, [float(v) for v in y]] for i, y in enumerate(ys)])
    steps = [("q_lists", "SELECT 0 AS b, d, 0 AS f, len(y) AS n, y FROM q"), *decomposition("q")]
    chain = ", ".join(f"{name} AS ({sql})" for name, sql in steps)
    found = con.execute(f"WITH RECURSIVE {chain} SELECT season, trend FROM q_parts ORDER BY d").fetchall()
    for y, (season, trend) in zip(ys, found, strict=True):
        s, t = decompose(y[None])
        scale = np.abs(y).max()
        assert np.allclose(s[0] / scale, np.array(season) / scale, atol=1e-9)
        assert np.allclose(t[0] / scale, np.array(trend) / scale, atol=1e-9)


def test_end_without_weight_repeats_its_neighbour():
    y = np.array([[5.0, 6.0, 7.0]])
    assert _loess(y, 7, np.zeros((1, 3)), extend=True).tolist() == [[5.0, 5.0, 6.0, 7.0, 7.0]]


def test_seasonal_fill_restores_a_season_and_leaves_others_alone(spark):
    t = np.arange(48)
    whole = 100 + t + 40 * np.sin(2 * np.pi * t / 12)
    gappy = [None if k % 11 == 5 else v for k, v in enumerate(whole)]
    rows = [gappy, list(whole), gappy[:24], [None] * 46 + [1.0, 3.0], [None] * 30]
    got = [r.filled for r in seasonal_fill(arrays(spark, rows), "y", "filled").orderBy("id").collect()]
    assert np.allclose(got[0], whole, atol=1.5)
    assert all(v is None or v == w for v, w in zip(gappy, got[0]))
    assert got[1] is None and got[2] is None
    assert got[3] == [1.0] * 47 + [3.0] and got[4] == [None] * 30


def dense_level(y):
    """Best linear prediction of the level with the whole covariance matrix, ratio by ratio."""
    n = len(y)
    t = np.arange(n)
    past = np.tril(np.ones((n, n)), -1)
    seasonal = n > 24
    x = np.column_stack([np.ones(n), t])
    pulse = np.zeros((n, n))
    if seasonal:
        x = np.column_stack([x, *[(t % 12 == m) * 1.0 - (t % 12 == 11) for m in range(11)]])
        for u in range(n):
            for v in range(u + 1, n):
                pulse[v, u] = ((v - u) % 12 == 1) * 1.0 - ((v - u) % 12 == 2)
    best = None
    for level in [0.0, 0.01, 0.1, 1.0, 10.0]:
        for slope in [0.0, 0.001, 0.01, 0.1]:
            for season in [0.0, 0.01, 0.1] if seasonal else [0.0]:
                trend = level * past @ past.T + slope * past @ past @ past.T @ past.T
                cov = np.eye(n) + trend + season * pulse @ pulse.T
                gram = x.T @ np.linalg.solve(cov, x)
                start = np.linalg.solve(gram, x.T @ np.linalg.solve(cov, y))
                rest = np.linalg.solve(cov, y - x @ start)
                spare = n - x.shape[1]
                rating = -spare * np.log(y @ rest / spare)
                rating -= np.linalg.slogdet(cov)[1] + np.linalg.slogdet(gram)[1]
                if best is None or rating > best[0]:
                    best = rating, x[:, :2] @ start[:2] + trend @ rest
    return best[1]


@pytest.mark.parametrize("n", [4, 9, 24, 25, 26, 37, 60, 96])
def test_structural_level_equals_the_dense_form(n):
    rng = np.random.default_rng(n)
    t = np.arange(n)
    y = np.array([
        100 + a * t + b * np.sin(2 * np.pi * t / 12) + rng.normal(0, c, n) + rng.normal(0, d, n).cumsum()
        for a, b, c, d in [(0, 0, 1, 0), (1, 5, 1, 0), (-2, 20, 3, 1), (0, 0, 0.1, 5), (0, 50, 10, 0.3)]
    ])
    assert np.allclose(smoothed_level(y), [dense_level(v) for v in y], rtol=1e-8, atol=0)


def test_structural_level_memory_is_linear_in_the_length():
    peaks = []
    for n in (400, 1600):
        y = 50 + np.random.default_rng(n).normal(0, 5, (4, n))
        tracemalloc.start()
        level = smoothed_level(y)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert np.isfinite(level).all() and level.std() < y.std()
    assert peaks[1] < 5 * peaks[0]


def test_structural_level_of_short_odd_and_many_series():
    assert (smoothed_level(np.array([[5.0, 1.0]])) == [[5.0, 1.0]]).all()
    assert smoothed_level(np.empty((0, 30))).shape == (0, 30)
    assert np.allclose(smoothed_level(np.array([[1.0, 2.0, 6.0]])), [[0.5, 3.0, 5.5]])
    assert np.allclose(smoothed_level(np.full((1, 40), 7.0)), 7.0)
    y = np.random.default_rng(3).normal(10, 2, (1100, 30))
    assert np.allclose(smoothed_level(y)[[0, 1030]], smoothed_level(y[[0, 1030]]))


def test_t_quantiles():
    known = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228]
    assert [round(t_975(k), 3) for k in range(1, 11)] == known
    assert t_975(100_000) == pytest.approx(1.95998, abs=1e-4)


def designs():
    rng = np.random.default_rng(4)
    out = []
    for k in range(40):
        n = int(rng.integers(6, 30))
        a, b = rng.uniform(0, 300, n), rng.uniform(0, 200, n)
        if k % 5 == 1:
            a[:] = 0
        if k % 5 == 2:
            b[:] = 7
        if k % 5 == 3:
            a[:], b[:] = 4, 0
        if k % 5 == 4:
            b = 3 + 2 * a
        out.append((a, b, rng.normal(1000, 50, n)))
    return out


def test_two_factor_closed_form_equals_minimum_norm(spark):
    data = designs()
    df = spark.createDataFrame(
        [(i, [(float(v), float(x), float(z)) for x, z, v in zip(a, b, y)])
         for i, (a, b, y) in enumerate(data)],
        "id int, rows array<struct<y:double,a:double,b:double>>",
    )
    fit = let(moments("rows"), "m", fit_if_enough("m", "2"))
    got = df.select("id", F.expr(fit).alias("w"), F.expr(adj_r2_score("rows", "2")).alias("adj"))
    for r in got.orderBy("id").collect():
        a, b, y = data[r.id]
        x = np.column_stack([np.ones(len(a)), a, b])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        sse = ((y - x @ beta) ** 2).sum()
        assert np.allclose([r.w.b0, r.w.ba, r.w.bb], beta, rtol=1e-7, atol=1e-9)
        n, sst = len(y), ((y - y.mean()) ** 2).sum()
        assert r.adj == pytest.approx(1 - (sse / sst) * (n - 1) / (n - 3), abs=1e-9)


def test_stacked_solver_equals_lstsq_and_pinv(spark):
    rows = []
    for i, (a, b, y) in enumerate(designs()):
        x = np.column_stack([np.ones(len(a)), a, b, a + b][: 3 + i % 2])
        rows.append((i, [float(v) for v in y], [float(v) for v in x.ravel()], x.shape[1]))
    rows.append((len(rows), None, None, 0))
    df = spark.createDataFrame(rows, "id int, y array<double>, x array<double>, p int")
    out = df.select("id", ols_solve("y", "x").alias("s")).orderBy("id").collect()
    assert out[-1].s is None
    for (i, y, flat, p), r in zip(rows[:-1], out):
        y, x = np.array(y), np.array(flat).reshape(-1, p)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose(r.s.beta, beta, rtol=1e-7, atol=1e-8)
        expected = np.linalg.pinv(x.T @ x)
        assert np.allclose(np.reshape(r.s.gram_inverse, (p, p)), expected, rtol=1e-4, atol=1e-7)
        assert r.s.dof == max(len(y) - p, 1)
    b, _, sse = solve_stack(np.ones((1, 5, 1)), np.arange(5.0)[None])
    assert b[0, 0] == pytest.approx(2) and sse[0] == pytest.approx(10)
