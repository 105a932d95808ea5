"""Final models per series: regression on references and factors, predictions and accuracy."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalars import is_finite, month_text
from panelcast.functions.shape import settle, unfold
from panelcast.functions.solve import ols_solve
from panelcast.operators.strategy import add_mean_model, test_rows
from panelcast.schemas import DJU_COLUMNS, KEY, MIN_OBSERVATIONS, NORMAL_95

ACCURACY = ["ME", "RMSE", "MAE", "MPE", "MAPE", "R2", "adjR2"]


def accuracy_aggregates(y: Column, fitted: Column, p: Column) -> dict[str, Column]:
    """Aggregates over finite pairs; errors are fitted - actual, percentages divide by fitted.

    R2 is NULL for a flat target; adjusted R2 uses ``p`` explanatory variables.
    """
    ok = is_finite(y) & is_finite(fitted)
    err = F.when(ok, fitted - y)
    pct = F.when(ok & (fitted != 0), (fitted - y) / F.when(fitted != 0, fitted) * 100)
    n = F.count(err)
    sse = F.sum(err * err)
    sst = F.var_pop(F.when(ok, y)) * n
    p = F.first(p)
    r2 = F.when((n >= 3) & (sst > 1e-12), 1 - sse / F.when(sst > 1e-12, sst))
    spare = F.when(n - p - 1 > 0, n - p - 1)
    adj = 1 - (1 - r2) * (n - 1) / spare
    return {
        "n_pairs": n,
        "ME": F.avg(err),
        "RMSE": F.sqrt(F.avg(err * err)),
        "MAE": F.avg(F.abs(err)),
        "MPE": F.avg(pct),
        "MAPE": F.avg(F.abs(pct)),
        "R2_plain": F.when(sst > 0, 1 - sse / F.when(sst > 0, sst)),
        "R2": r2,
        "adjR2": adj,
    }


def accuracy(df: DataFrame, keys: list[str], y: str, fitted: str, p: int) -> DataFrame:
    """One row of accuracy measures per key, in a single partial aggregation."""
    aggs = accuracy_aggregates(F.col(y), F.col(fitted), F.lit(p))
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: a column used n times is worked out n times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mean(values: Column) -> Column:
    """Mean of an array without NULLs; NULL for an empty one."""
    return _let(values, lambda a: F.when(
        F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    ))


def accuracy_of_pairs(pairs: Column, p: Column) -> dict[str, Column]:
    """The measures of ``accuracy_aggregates`` as folds over one array of finite (y, fitted)."""
    n = F.size(pairs)
    err = F.transform(pairs, lambda r: r.fitted - r.y)
    pct = F.transform(
        F.filter(pairs, lambda r: r.fitted != 0), lambda r: (r.fitted - r.y) / r.fitted * 100
    )
    squares = F.transform(err, lambda e: e * e)
    # The mean is taken before the pass over the pairs, not once for each of them.
    sst = _let(_mean(F.transform(pairs, lambda r: r.y)), lambda m: n * _mean(
        F.transform(pairs, lambda r: (r.y - m) * (r.y - m))
    ))
    r2 = _let(sst, lambda s: F.when(
        (n >= 3) & (s > 1e-12), 1 - n * _mean(squares) / F.when(s > 1e-12, s)
    ))
    spare = F.when(n - p - 1 > 0, n - p - 1)
    return {
        "ME": _mean(err),
        "RMSE": F.sqrt(_mean(squares)),
        "MAE": _mean(F.transform(err, lambda e: F.abs(e))),
        "MPE": _mean(pct),
        "MAPE": _mean(F.transform(pct, lambda e: F.abs(e))),
        "R2": r2,
        "adjR2": 1 - (1 - r2) * (n - 1) / spare,
    }


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def quadratic_form(x: Column, matrix: Column) -> Column:
    """x' M x with M flattened row by row."""
    p = F.size(x)
    return F.aggregate(
        F.transform(x, lambda xi, i: xi * dot(F.slice(matrix, i * p + 1, p), x)),
        F.lit(0.0),
        lambda s, v: s + v,
    )


def _design_row(r: Column) -> Column:
    """Intercept, chosen references, influencing factors, usage factors."""
    return F.concat(
        F.array(F.lit(1.0)),
        F.transform("dju_positions", lambda k: F.get(r.dju, k)),
        r.factors,
    )


def _complete(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull())


def fit_series(df: DataFrame, target: str = "target", y: str = "y_final") -> DataFrame:
    """Add ``x_cols``, ``fit_rows`` and the solution columns; NULL ``beta`` = not usable.

    Needs ``hdd_pos``/``cdd_pos`` and a target array. Rows are used when the target and every
    regressor are present.
    """
    positions = F.array_compact(F.array("hdd_pos", "cdd_pos"))
    names = F.array(*[F.lit(c) for c in DJU_COLUMNS])
    df = df.withColumn("dju_positions", positions).withColumn(
        "x_cols",
        F.concat(F.transform("dju_positions", lambda k: F.get(names, k)), F.col("factor_types")),
    )
    rows = F.transform(
        target,
        lambda r: F.struct(
            r.month.alias("month"), r.value.alias("value"), r[y].alias("y"),
            _design_row(r).alias("x"),
        ),
    )
    df = df.withColumn("fit_rows", F.filter(rows, lambda r: r.y.isNotNull() & _complete(r.x)))
    usable = f"size(dju_positions) > 0 AND size(fit_rows) >= {MIN_OBSERVATIONS}"
    y_arg = F.expr(f"CASE WHEN {usable} THEN fit_rows.y END")
    x_arg = F.expr(f"CASE WHEN {usable} THEN flatten(fit_rows.x) END")
    return (
        df.withColumn("solution", ols_solve(y_arg, x_arg))
        .select("*", "solution.*")
        .drop("solution")
    )


def coefficients(df: DataFrame) -> DataFrame:
    """Add the intercept, the reference slopes and ``coefficients`` MAP(regressor -> slope)."""
    slope = F.map_from_arrays("x_cols", F.slice("beta", 2, F.size("x_cols")))
    return (
        df.withColumn("coefficients", F.when(F.col("beta").isNotNull(), slope))
        .withColumn("b_coefficient", F.get("beta", F.lit(0)))
        .withColumn("a_hdd", F.try_element_at("coefficients", F.col("best_hdd")))
        .withColumn("a_cdd", F.try_element_at("coefficients", F.col("best_cdd")))
    )


def predict(df: DataFrame) -> DataFrame:
    """Long predictions of every fitted series (regression, or mean where it is not usable).

    Regression months with a missing regressor are kept with NULL predictions. Series without
    reference data produce no rows.
    """
    months = F.transform(
        test_rows(),
        lambda r: F.struct(
            r.month.alias("month"), r.value.alias("real_consumption"), _design_row(r).alias("x")
        ),
    )
    kept = ["model_family", "beta", "gram_inverse", "sigma2", "t_crit", "monthly_mean",
            "monthly_sd"]
    long = unfold(df.where(F.col("model_family").isNotNull()), [*KEY, *kept], months)
    ready = F.col("beta").isNotNull() & _complete(F.col("x"))
    fit = F.when(ready, dot(F.col("x"), F.col("beta")))
    spread = quadratic_form(F.col("x"), F.col("gram_inverse")) * F.col("sigma2")
    half = F.when(ready, F.col("t_crit") * F.sqrt(F.greatest(spread, F.lit(0.0))))
    by_mean = F.col("model_family") == "mean"
    flat_half = F.lit(NORMAL_95) * F.col("monthly_sd")
    return (
        long.withColumn("fit", F.when(by_mean, F.col("monthly_mean")).otherwise(fit))
        .withColumn("half", F.when(by_mean, flat_half).otherwise(half))
        .select(
            *KEY,
            month_text(F.col("month")).alias("month_str"),
            "real_consumption",
            F.col("fit").alias("predictive_consumption"),
            (F.col("fit") - F.col("half")).alias("confidence_lower95"),
            (F.col("fit") + F.col("half")).alias("confidence_upper95"),
        )
    )


def choose_family(df: DataFrame) -> DataFrame:
    """Add ``model_family``: none, mean (few rows or unusable regression), or regression."""
    return add_mean_model(df).withColumn(
        "model_family",
        F.when(F.col("status_code") == "note_000", F.lit(None))
        .when(F.col("beta").isNotNull(), "ols_dju_plus_factors")
        .otherwise("mean"),
    )


def model_rows(df: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """One model row per series with its accuracy on the rows it was fitted on, and the ``carried`` columns."""
    ols = F.col("model_family") == "ols_dju_plus_factors"
    pairs = F.transform(
        "fit_rows",
        lambda r: F.struct(r.y.alias("y"), dot(r.x, F.col("beta")).alias("fitted")),
    )
    described = coefficients(df).withColumns(
        {
            "chosen_hdd": F.when(ols, F.col("best_hdd")),
            "chosen_cdd": F.when(ols, F.col("best_cdd")),
            "p": F.size("x_cols"),
        }
    )
    carried = carried or []
    kept = [
        "model_family", "chosen_hdd", "chosen_cdd", "status", "status_code", "b_coefficient",
        "a_hdd", "a_cdd", "coefficients", "monthly_mean", "p",
    ]
    # One row per series stays one row: the measures are folds over its own pairs, without a shuffle.
    finite = F.filter(F.coalesce("pairs", F.array()), lambda r: is_finite(r.y) & is_finite(r.fitted))
    described = described.withColumn("pairs", F.when(ols, pairs))
    described = settle(described.withColumn("pairs", finite.cast("array<struct<y:double,fitted:double>>")), ["pairs"])
    measures = accuracy_of_pairs(F.col("pairs"), F.col("p"))
    annual = F.when(F.col("model_family") == "mean", 12 * F.col("monthly_mean")).otherwise(
        12 * _mean(F.transform("pairs", lambda r: r.fitted))
    )
    return described.select(
        *KEY, *kept[:-2], annual.alias("annual_consumption_reference"),
        *[measures[a].alias(a) for a in ACCURACY], *carried,
    )
