"""Month spine: which months a series covers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalars import full_month_starts, month_start
from panelcast.schemas import KEY


def month_spine(monthly: DataFrame, params: DataFrame) -> DataFrame:
    """Distinct invoice start months plus the prediction months, per series.

    Months are gathered per series (a calendar bounds them) so the monthly table is read once.
    """
    pred = params.select(
        "id_building_primaire",
        full_month_starts(F.col("start_pred"), F.col("end_pred")).alias("pred_months"),
    )
    return (
        monthly.where(F.col("start").isNotNull())
        .groupBy(*KEY)
        .agg(F.collect_set(month_start(F.col("start"))).alias("invoice_months"))
        .join(pred, "id_building_primaire")
        .select(*KEY, F.explode(F.array_union("invoice_months", "pred_months")).alias("month"))
    )
