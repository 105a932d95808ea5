"""Iterated anomaly detection on one array per series.

Every function takes the name of a DataFrame's array column and adds columns; nothing is
shuffled. Seasonal steps apply only beyond two full years, so short series never reach Python.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.seasonal import seasonal_trend
from panelcast.functions.series import (
    blank,
    fill_from,
    has_gaps,
    interpolate,
    iqr_fence,
    known,
    smooth,
    subtract,
    var_pop,
)
from panelcast.functions.shape import settle
from panelcast.functions.structural import structural_level
from panelcast.schemas import FENCE_WIDTH, SEASON, SEASONAL_STRENGTH

# Spread below which a series counts as constant.
_FLAT = "1e-8D"


def _long(y: str) -> str:
    """More than two seasons of points: seasonal steps apply."""
    return f"size({y}) > {2 * SEASON}"


def _decompose(df: DataFrame, y: str, condition: str, out: str) -> DataFrame:
    """Add the seasonal and trend parts of ``y`` where ``condition`` holds, NULL elsewhere."""
    return df.withColumn(out, seasonal_trend(F.expr(f"CASE WHEN {condition} THEN {y} END")))


def fill_for_detection(df: DataFrame, y: str, out: str) -> DataFrame:
    """Fill gaps with trend + seasonal when the series is long enough, else linearly."""
    df = df.withColumn("_line", F.expr(f"CASE WHEN {has_gaps(y)} THEN {interpolate(y)} END"))
    df = _decompose(df, "_line", f"{_long('_line')} AND NOT {has_gaps('_line')}", "_parts")
    filler = "coalesce(zip_with(_parts.trend, _parts.seasonal, (t, s) -> t + s), _line)"
    filled = f"CASE WHEN {has_gaps(y)} THEN {fill_from(y, filler)} ELSE {y} END"
    return df.withColumn(out, F.expr(filled)).drop("_line", "_parts")


def seasonally_adjust(df: DataFrame, y: str, out: str) -> DataFrame:
    """Remove the seasonal part where it is strong; also adds ``<out>_strength``."""
    df = _decompose(df, y, f"{_long(y)} AND NOT {has_gaps(y)}", "_parts")
    df = df.withColumn("_detrended", F.expr(subtract(y, "_parts.trend")))
    rest = var_pop(subtract("_detrended", "_parts.seasonal"))
    strength = f"""CASE WHEN _parts IS NOT NULL THEN
        coalesce(1 - ({rest}) / nullif({var_pop('_detrended')}, 0D), 0D) END"""
    df = df.withColumn(f"{out}_strength", F.expr(strength))
    adjusted = f"""CASE WHEN {out}_strength >= {SEASONAL_STRENGTH}D
        THEN {subtract(y, '_parts.seasonal')} ELSE {y} END"""
    return df.withColumn(out, F.expr(adjusted)).drop("_parts", "_detrended")


def detect_once(df: DataFrame, y: str, missing: str, out: str) -> DataFrame:
    """Flag residuals outside the fence: adds ``<out>`` (flags) and ``<out>_fence``.

    ``missing`` marks originally missing points: they shape neither fence nor flags.
    """
    df = fill_for_detection(df, y, "_filled")
    varies = f"NOT {has_gaps('_filled')} AND sqrt({var_pop('_filled')}) > {_FLAT}"
    df = df.withColumn("_x", F.expr(f"CASE WHEN {varies} THEN _filled END"))
    df = seasonally_adjust(df, "_x", "_adjusted")
    df = df.withColumn("_smooth", F.expr(smooth("_adjusted", SEASON)))
    residual = blank(subtract("_adjusted", "_smooth"), missing)
    df = df.withColumn("_residual", F.expr(residual))
    df = df.withColumn(f"{out}_fence", F.expr(iqr_fence("_residual", FENCE_WIDTH)))
    flags = f"""coalesce(
        transform(_residual, r -> coalesce(r < {out}_fence.low OR r > {out}_fence.high, false)),
        transform({y}, v -> false))"""
    return df.withColumn(out, F.expr(flags)).drop(
        "_filled", "_x", "_adjusted", "_adjusted_strength", "_smooth", "_residual"
    )


def any_true(mask: str) -> str:
    return f"exists({mask}, m -> m)"


def detect_anomalies(df: DataFrame, y: str, out: str) -> DataFrame:
    """Two passes; the second blanks the first one's hits and runs only where there are any.

    Adds ``<out>`` (flags) and ``<out>_fence`` (of the last pass that ran, NULL without one).
    """
    df = df.withColumn("_missing", F.expr(f"transform({y}, v -> v IS NULL)"))
    df = detect_once(df, y, "_missing", "_first")
    again = f"CASE WHEN {any_true('_first')} THEN {blank(y, '_first')} END"
    df = detect_once(df.withColumn("_again", F.expr(again)), "_again", "_missing", "_second")
    both = "zip_with(_first, _second, (a, b) -> a OR b)"
    df = (
        df.withColumn(out, F.expr(f"CASE WHEN _again IS NULL THEN _first ELSE {both} END"))
        .withColumn(
            f"{out}_fence",
            F.expr("CASE WHEN _again IS NULL THEN _first_fence ELSE _second_fence END"),
        )
        .drop("_missing", "_first", "_first_fence", "_again", "_second", "_second_fence")
    )
    return settle(df, [out, f"{out}_fence"])


def seasonal_fill(df: DataFrame, y: str, out: str) -> DataFrame:
    """Fill gaps of series over two years by interpolating what is left without the season.

    The season comes from the linearly filled series. NULL for series without gaps or of at most two years;
    below three known points the linear filling itself.
    """
    gaps = f"{has_gaps(y)} AND {_long(y)}"
    df = df.withColumn("_base", F.expr(f"CASE WHEN {gaps} THEN {interpolate(y)} END"))
    df = _decompose(df, "_base", f"size({known(y)}) >= 3", "_parts")
    rest = interpolate(subtract(y, "_parts.seasonal"))
    df = df.withColumn("_rest", F.expr(f"CASE WHEN _parts IS NOT NULL THEN {rest} END"))
    whole = "coalesce(zip_with(_rest, _parts.seasonal, (r, s) -> r + s), _base)"
    return df.withColumn(out, F.expr(fill_from(y, whole))).drop("_base", "_parts", "_rest")


def rank_impute(df: DataFrame, y: str, out: str) -> DataFrame:
    """Fill gaps with the mean of a linear, a structural and (long series) a seasonal arm.

    Series without gaps, or NULL, come back unchanged and never reach Python. Below three known
    points every arm is the linear one.
    """
    enough = f"size({known(y)}) >= 3"
    df = df.withColumn("_line", F.expr(f"CASE WHEN {has_gaps(y)} THEN {interpolate(y)} END"))
    df = df.withColumn("_level", structural_level(F.expr(f"CASE WHEN {enough} THEN _line END")))
    finite = "forall(_level, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('inf'))"
    level = f"CASE WHEN {finite} THEN _level ELSE _line END"
    df = seasonal_fill(df, y, "_third")
    total = f"zip_with(_line, {level}, (a, b) -> a + b)"
    df = df.withColumn("_two", F.expr(total))
    combined = """CASE WHEN _third IS NULL THEN transform(_two, v -> v / 2)
        ELSE zip_with(_two, _third, (ab, c) -> (ab + c) / 3) END"""
    filled = f"CASE WHEN {has_gaps(y)} THEN {fill_from(y, combined)} ELSE {y} END"
    return df.withColumn(out, F.expr(filled)).drop("_line", "_level", "_two", "_third")
