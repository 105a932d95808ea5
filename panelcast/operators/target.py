"""Building the regression target: imputation, anomaly correction, zero rule, final choice.

Input is one row per series with ``train`` (rows ordered by month) and the chosen reference
positions ``hdd_pos`` / ``cdd_pos``. Scores are adjusted R2 of the target on the chosen
references; a NULL score means "cannot be scored" and loses every comparison.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.linear import adj_r2_score, fitted_values
from panelcast.functions.series import blank, fill_from, has_gaps
from panelcast.functions.shape import settle
from panelcast.operators.anomalies import any_true, detect_anomalies, rank_impute


def _points(y: str) -> str:
    """Complete (y, a, b) rows of a target array."""
    rows = f"transform({y}, (v, i) -> struct(v AS y, get(fa, i) AS a, get(fb, i) AS b))"
    return f"filter({rows}, r -> r.y IS NOT NULL AND r.a IS NOT NULL AND r.b IS NOT NULL)"


def _without_zeros(y: str) -> str:
    """The target with NULL where the imputed series is 0."""
    return f"zip_with({y}, imputed, (v, z) -> CASE WHEN z = 0 THEN NULL ELSE v END)"


def _scores(targets: list[str]) -> str:
    """One score per target array."""
    rows = ", ".join(_points(t) for t in targets)
    return f"transform(array({rows}), rows_of_one -> {adj_r2_score('rows_of_one', 'n_factors')})"


def _at_least(a: str, b: str) -> str:
    """a >= b with NULL below everything."""
    return f"coalesce({a}, double('-inf')) >= coalesce({b}, double('-inf'))"


def _refit(y: str, when: str) -> str:
    return f"CASE WHEN {when} THEN {fitted_values(_points(y), 'fa', 'fb', 'n_factors')} END"


def _with_factors(df: DataFrame) -> DataFrame:
    """The chosen references per training row; zeros where none was chosen."""
    factor = "transform(train, r -> CASE WHEN {0} IS NULL THEN 0D ELSE get(r.dju, {0}) END)"
    return df.withColumns(
        {
            "raw": F.expr("transform(train, r -> r.value)"),
            "fa": F.expr(factor.format("hdd_pos")),
            "fb": F.expr(factor.format("cdd_pos")),
            "n_factors": F.expr("int(hdd_pos IS NOT NULL) + int(cdd_pos IS NOT NULL)"),
        }
    )


def impute_target(df: DataFrame) -> DataFrame:
    """Fill missing raw values, then drop them again if the raw series scores strictly better."""
    df = rank_impute(_with_factors(df), "raw", "filled")
    df = df.withColumn("refit", F.expr(_refit("raw", has_gaps("raw"))))
    filler = f"CASE WHEN refit IS NULL THEN filled ELSE {fill_from('refit', 'filled')} END"
    df = df.withColumn("imputed", F.expr(fill_from("raw", filler)))
    df = df.withColumn("scores", F.expr(_scores(["raw", "imputed"])))
    return (
        df.withColumns(
            {
                "n_missing": F.expr("size(filter(raw, v -> v IS NULL))"),
                "raw_wins": F.expr(f"{has_gaps('raw')} AND NOT {_at_least('scores[1]', 'scores[0]')}"),
            }
        )
        .withColumn("gap_ratio", F.expr("n_missing / nullif(size(raw), 0)"))
        .withColumn(
            "imputed",
            F.expr(
                "CASE WHEN raw_wins THEN filter(imputed, (v, i) -> get(raw, i) IS NOT NULL) "
                "ELSE imputed END"
            ),
        )
        .withColumn(
            "train",
            F.expr(
                "CASE WHEN raw_wins THEN filter(train, r -> r.value IS NOT NULL) ELSE train END"
            ),
        )
        .drop("raw", "filled", "refit", "scores", "fa", "fb", "n_factors")
    )


def build_target(df: DataFrame, impute: bool = True) -> DataFrame:
    """Add ``target`` (array of rows with every stage) and the facts behind each decision.

    ``impute=False`` skips the missing-value stage for inputs that cannot have any, as training
    rows of a model table.
    """
    if impute:
        df = impute_target(df)
    else:
        df = df.withColumns(
            {
                "imputed": F.expr("transform(train, r -> r.value)"),
                "n_missing": F.lit(0),
                "gap_ratio": F.lit(0.0),
                "raw_wins": F.lit(False),
            }
        )
    df = detect_anomalies(_with_factors(df), "imputed", "anomaly")

    df = df.withColumns(
        {
            "n_anomalies": F.expr("size(filter(anomaly, m -> m))"),
            "blanked": F.expr(
                f"CASE WHEN {any_true('anomaly')} THEN {blank('imputed', 'anomaly')} END"
            ),
        }
    )
    df = rank_impute(df, "blanked", "ranked")
    df = df.withColumn("refit", F.expr(_refit("ranked", "ranked IS NOT NULL")))
    filler = f"CASE WHEN refit IS NULL THEN ranked ELSE {fill_from('refit', 'ranked')} END"
    corrected = f"CASE WHEN blanked IS NULL THEN raw ELSE {fill_from('blanked', filler)} END"
    df = df.withColumn("corrected", F.expr(corrected))

    has_zeros = "exists(imputed, v -> v = 0)"
    same = "(n_anomalies = 0 AND n_missing = 0)"
    # A target that equals an earlier one is not scored again.
    targets = [
        "imputed",
        f"CASE WHEN {has_zeros} THEN {_without_zeros('imputed')} END",
        f"CASE WHEN NOT {same} THEN corrected END",
        f"CASE WHEN {has_zeros} AND NOT {same} THEN {_without_zeros('corrected')} END",
    ]
    df = df.withColumn("scores", F.expr(_scores(targets)))
    df = df.withColumn(
        "score_nonzero", F.expr(f"CASE WHEN {has_zeros} THEN scores[1] ELSE scores[0] END")
    )
    df = df.withColumn(
        "drop_zeros",
        F.expr(f"score_nonzero IS NOT NULL AND {_at_least('score_nonzero', 'scores[0]')}"),
    )
    df = df.withColumns(
        {
            "score_imputed": F.expr("CASE WHEN drop_zeros THEN score_nonzero ELSE scores[0] END"),
            "score_corrected": F.expr(
                f"""CASE WHEN {same} THEN CASE WHEN drop_zeros THEN score_nonzero ELSE scores[0] END
                WHEN drop_zeros AND {has_zeros} THEN scores[3] ELSE scores[2] END"""
            ),
        }
    )
    df = df.withColumn(
        "best_y",
        F.expr(
            f"""CASE WHEN {same} OR {_at_least('score_imputed', 'score_corrected')}
            THEN 'consumption_imputation' ELSE 'consumption_correction' END"""
        ),
    )
    rows = """transform(train, (r, i) -> struct(
        r.month AS month, r.start AS start, r.end AS end, r.value AS value, r.dju AS dju,
        r.factors AS factors, r.value IS NULL AS is_missing,
        get(imputed, i) AS consumption_imputation, get(anomaly, i) AS is_anomaly,
        get(corrected, i) AS consumption_correction,
        CASE WHEN best_y = 'consumption_imputation' THEN get(imputed, i)
            ELSE get(corrected, i) END AS y_final))"""
    hits = "filter(train, (r, i) -> get(anomaly, i))"
    df = df.withColumns(
        {
            "target": F.expr(
                f"""filter({rows},
                r -> NOT drop_zeros OR coalesce(r.consumption_imputation <> 0, true))"""
            ),
            "anomaly_months": F.expr(f"transform({hits}, r -> date_format(r.month, 'yyyy-MM'))"),
        }
    ).drop(
        "raw", "imputed", "fa", "fb", "n_factors", "anomaly", "blanked", "ranked", "refit",
        "corrected", "scores", "score_nonzero",
    )
    return settle(
        df,
        ["target", "anomaly_months", "n_anomalies", "drop_zeros", "best_y", "score_imputed",
         "score_corrected"],
    )
