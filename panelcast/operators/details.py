"""One nested record per series: its model with target, regressors, outliers and diagnostics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.diagnostics import message_list
from panelcast.operators.regression import model_rows

#: Fields of an outlier, as in the flat table of outliers.
OUTLIER_FIELDS = [
    "month", "start", "end", "value", "is_missing", "consumption_imputation", "is_anomaly", "consumption_correction",
]
NESTED = ["x_cols", "y_col", "monthly_mean", "monthly_sd", "outliers", "diagnostics"]


def model_details(fitted: DataFrame) -> DataFrame:
    """The model rows, each with everything that belongs to its model.

    Added: ``x_cols`` (regressors in design order) and ``y_col`` (the chosen target), both NULL without a
    regression; ``monthly_mean`` and ``monthly_sd``; ``outliers``, the flagged training rows that survived the zero
    rule, by month; ``diagnostics``, all messages in processing order. Everything comes from the series' own row, so
    nothing is grouped or shuffled.
    """
    regression = F.col("model_family") == "ols_dju_plus_factors"
    hits = F.filter("target", lambda r: r.is_anomaly)
    nested = {
        "outliers": F.transform(hits, lambda r: F.struct(*[r[c].alias(c) for c in OUTLIER_FIELDS])),
        "diagnostics": message_list(),
        "y_col": F.when(regression, F.col("best_y")),
        "x_cols": F.when(regression, F.col("x_cols")),
    }
    # The names of the regressors are also the keys of the coefficients, so they are replaced last.
    rows = model_rows(fitted.withColumns({c: nested[c] for c in ("outliers", "diagnostics", "y_col")}), NESTED)
    return rows.withColumn("x_cols", nested["x_cols"])
