"""Result tables: contract checks, atomic publication and latest-wins replacement per building.

A run writes both outputs and the list of its buildings into folders of its own, which no reader looks at yet. Its
publication is one row in the table of commits. Readers take, for each building, the newest committed run that asked
for it, so predictions and models change together, a building whose new run has no rows loses its old ones, and a run
that ends before its commit changes nothing. Folders of a run never change, so a reader that has chosen its runs keeps
a consistent picture while others are published.
"""

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.schemas import (
    COMMITS,
    MODEL_COLUMNS,
    MODELS,
    MONTH_PATTERN,
    PREDICTION_COLUMNS,
    PREDICTIONS,
    RUN_REQUESTS,
)

# --- fixed values: where the two results lie below a base folder ------------------------------
PREDICTIONS_PATH = "silver/resultats/predictions_monthly"
MODELS_PATH = "silver/resultats/models"

REQUESTS_PATH = "silver/resultats/requests"
COMMITS_PATH = "silver/resultats/commits"

_GENERATED = {
    "id_building_primaire", "run_id", "created_at", "confidence_lower95", "confidence_upper95",
}


def ensure_columns(df: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def invalid_months(df: DataFrame) -> DataFrame:
    """Rows whose ``month_str`` is not YYYY-MM (a NULL month is not)."""
    return df.where(~F.coalesce(F.col("month_str").rlike(MONTH_PATTERN), F.lit(False)))


def validate_months(df: DataFrame) -> None:
    ensure_columns(df, ["month_str"])
    examples = [r.month_str for r in invalid_months(df).select("month_str").limit(5).collect()]
    if examples:
        raise ValueError(f"invalid month_str (expected YYYY-MM), for example: {examples}")


def stamp(df: DataFrame, run_id: str, created_at: datetime) -> DataFrame:
    return df.withColumns(
        {"run_id": F.lit(run_id), "created_at": F.lit(created_at).cast("timestamp")}
    )


def new_run() -> tuple[str, datetime]:
    return str(uuid.uuid4()), datetime.now(timezone.utc)


def _stage(df: DataFrame, path: str, run_id: str, sort_by: list[str]) -> None:
    """Write a run's rows to its own folder below ``path``, one folder per building.

    Rebalancing splits a building that dominates the output instead of giving it one task. A run id is used once.
    """
    (
        df.drop("run_id")
        .hint("rebalance", "id_building_primaire")
        .sortWithinPartitions("id_building_primaire", *sort_by)
        .write.mode("errorifexists")
        .partitionBy("id_building_primaire")
        .parquet(f"{path}/run_id={run_id}")
    )


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table below ``path`` with its declared columns; a table that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path).select(schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stage_results(
    predictions: DataFrame, models: DataFrame, requested: DataFrame, base: str, run_id: str, created_at: datetime
) -> None:
    """Check both outputs, then write them and the requested buildings. Nothing is visible before ``commit_run``."""
    out_predictions = prediction_output(predictions, run_id, created_at)
    out_models = model_output(models, run_id, created_at)
    validate_months(out_predictions)
    order = ["fluid", "deliverypoint_id_primaire"]
    _stage(out_predictions, f"{base}/{PREDICTIONS_PATH}", run_id, [*order, "month_str"])
    _stage(out_models, f"{base}/{MODELS_PATH}", run_id, order)
    asked = requested.select("id_building_primaire").where("id_building_primaire IS NOT NULL").distinct()
    asked.write.mode("errorifexists").parquet(f"{base}/{REQUESTS_PATH}/run_id={run_id}")


def commit_run(spark: SparkSession, base: str, run_id: str, created_at: datetime) -> None:
    """Publish a staged run: one row, one file, added to the table of commits."""
    row = spark.createDataFrame([(run_id, created_at)], COMMITS)
    row.coalesce(1).write.mode("append").parquet(f"{base}/{COMMITS_PATH}")


def current_runs(spark: SparkSession, base: str) -> DataFrame:
    """The run whose results count for each building: the newest committed one (largest run id among equal times)."""
    requests = _read(spark, f"{base}/{REQUESTS_PATH}", RUN_REQUESTS)
    return (
        requests.join(_read(spark, f"{base}/{COMMITS_PATH}", COMMITS), "run_id")
        .groupBy("id_building_primaire")
        .agg(F.max(F.struct("created_at", "run_id")).alias("newest"))
        .select("id_building_primaire", "newest.run_id")
    )


def superseded_runs(spark: SparkSession, base: str) -> DataFrame:
    """Committed runs that no building refers to any more; their folders can be removed."""
    return _read(spark, f"{base}/{COMMITS_PATH}", COMMITS).join(current_runs(spark, base), "run_id", "left_anti")


def published_predictions(spark: SparkSession, base: str) -> DataFrame:
    """Published predictions of every building."""
    rows = _read(spark, f"{base}/{PREDICTIONS_PATH}", PREDICTIONS)
    return rows.join(current_runs(spark, base), ["id_building_primaire", "run_id"], "left_semi")


def published_models(spark: SparkSession, base: str) -> DataFrame:
    """Published models of every building."""
    rows = _read(spark, f"{base}/{MODELS_PATH}", MODELS)
    return rows.join(current_runs(spark, base), ["id_building_primaire", "run_id"], "left_semi")


def prediction_output(df: DataFrame, run_id: str, created_at: datetime) -> DataFrame:
    """Fixed column order; interval columns are optional in the input."""
    ensure_columns(df, [c for c in PREDICTION_COLUMNS if c not in _GENERATED])
    for c in ("confidence_lower95", "confidence_upper95"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    return stamp(df, run_id, created_at).select(*PREDICTION_COLUMNS)


def model_output(df: DataFrame, run_id: str, created_at: datetime) -> DataFrame:
    ensure_columns(df, [c for c in MODEL_COLUMNS if c not in _GENERATED])
    return stamp(df, run_id, created_at).select(*MODEL_COLUMNS)


def persist_results(
    predictions: DataFrame, models: DataFrame, requested: DataFrame, base: str,
    run_id: str | None = None, created_at: datetime | None = None,
) -> tuple[str, datetime]:
    """Check both outputs, write them, then publish them as the requested buildings' results."""
    fresh_id, now = new_run()
    run_id, created_at = run_id or fresh_id, created_at or now
    stage_results(predictions, models, requested, base, run_id, created_at)
    commit_run(predictions.sparkSession, base, run_id, created_at)
    return run_id, created_at
