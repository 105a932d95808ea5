"""Projections and roll-ups over finished results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.shape import unfold
from panelcast.schemas import KEY

# --- fixed values: published names of the outlier columns -----------------------------------
OUTLIER_NAMES = {
    "deliverypoint_id_primaire": "invoice.delivery_point",
    "fluid": "invoice.fluid",
    "start": "invoice_start_date",
    "end": "invoice_end_date",
    "value": "invoice.consumption",
    "is_missing": "is_missing",
    "consumption_imputation": "invoice.consumption_imputation",
    "is_anomaly": "is_anomaly",
    "consumption_correction": "invoice.consumption_correction",
}


def target_table(df: DataFrame) -> DataFrame:
    """The corrected training rows, one per series and month."""
    return unfold(df, [*KEY, "best_y", "drop_zeros"], "target")


def outliers_table(df: DataFrame, dotted: bool = False) -> DataFrame:
    """Flagged training rows that survived the zero rule, with their building and month."""
    rows = target_table(df).where("is_anomaly")
    names = OUTLIER_NAMES if dotted else {k: v.replace(".", "_") for k, v in OUTLIER_NAMES.items()}
    return rows.select(
        "id_building_primaire", *[F.col(k).alias(v) for k, v in names.items()]
    )


def until_month(predictions: DataFrame, max_month: str | None) -> DataFrame:
    """Optional horizon: keep months up to ``max_month`` ('YYYY-MM')."""
    if max_month is None:
        return predictions
    return predictions.where(F.col("month_str") <= F.lit(max_month))


def missing_prediction_months(predictions: DataFrame) -> DataFrame:
    """Months without a prediction, per series (bounded by the prediction window)."""
    return (
        predictions.where(F.col("predictive_consumption").isNull())
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list("month_str")).alias("missing_months"))
    )


def building_metrics(models: DataFrame, building: DataFrame) -> DataFrame:
    """Annual reference per building, per square metre and per occupant.

    A divisor that is missing or 0 gives NULL, and so does a building without references.
    """
    total = models.groupBy("id_building_primaire").agg(
        F.sum("annual_consumption_reference").alias("total_energy_annual_consumption_reference")
    )

    def ratio(divisor: str):
        d = F.col(divisor)
        return F.col("total_energy_annual_consumption_reference") / F.when(d != 0, d)

    return (
        building.select("id_building_primaire", "surface", "occupant")
        .join(total, "id_building_primaire", "left")
        .select(
            "id_building_primaire",
            "total_energy_annual_consumption_reference",
            ratio("surface").alias("ratio_kwh_m2"),
            ratio("occupant").alias("ratio_kwh_occupant"),
        )
    )
