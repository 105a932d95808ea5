"""End to end: every requested building, delivery point and fluid in one plan."""

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.diagnostics import (
    building_messages,
    distinct_notes,
    series_messages,
)
from panelcast.operators.invoices import building_monthly_invoices
from panelcast.operators.panel import building_parts, series_table, usable_sites
from panelcast.operators.regression import choose_family, fit_series, model_rows, predict
from panelcast.operators.reports import building_metrics, outliers_table, until_month
from panelcast.operators.strategy import choose_references, decide_strategy
from panelcast.operators.target import build_target
from panelcast.operators.usage import factor_matrix, monthly_from_daily
from panelcast.sources.catalog import Sources, building_usage, site_lookup
from panelcast.sources.sinks import persist_results


@dataclass(frozen=True)
class Results:
    predictions: DataFrame
    models: DataFrame
    outliers: DataFrame
    messages: DataFrame
    building_messages: DataFrame
    building_metrics: DataFrame

    @property
    def outlier_notes(self) -> DataFrame:
        return distinct_notes(self.messages)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="run-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def single_requests(params: DataFrame) -> DataFrame:
    """Requests of buildings that are asked for once. Equal requests count once; a building with
    different ones is left out, which its message says.
    """
    distinct = params.distinct()
    several = distinct.groupBy("id_building_primaire").count().where("count > 1")
    return distinct.join(several, "id_building_primaire", "left_anti")


def requested_meters(sources: Sources, params: DataFrame) -> DataFrame:
    ids = params.select("id_building_primaire").distinct()
    return sources.table("deliverypoint").join(ids, "id_building_primaire", "left_semi")


def monthly_panel(sources: Sources, params: DataFrame) -> DataFrame:
    """Monthly invoices of the requested buildings."""
    meters = requested_meters(sources, params)
    # Before any aggregation, so that a request for one building does not shuffle the whole lake.
    ids = meters.select("deliverypoint_id_primaire").distinct()
    return building_monthly_invoices(
        sources.table("invoice").join(ids, "deliverypoint_id_primaire", "left_semi"), meters
    )


def requested_usage(sources: Sources, params: DataFrame) -> DataFrame:
    """Daily usage between the earlier start and the later end of each request's two windows."""
    windows = params.select(
        "id_building_primaire",
        F.least("start_ref", "start_pred").alias("start"),
        F.greatest("end_ref", "end_pred").alias("end"),
    )
    return building_usage(sources, windows)


def build_sites(sources: Sources, params: DataFrame, with_factors: bool = True) -> DataFrame:
    """One row per runnable request with its weather and factors."""
    factors = factor_matrix(monthly_from_daily(requested_usage(sources, params))) if with_factors else None
    building = site_lookup(sources.table("building"), params)
    return usable_sites(params, building, sources.table("degreedays"), factors)


def build_series(sources: Sources, params: DataFrame, with_factors: bool = True) -> DataFrame:
    """The model table of every requested series (one row per series)."""
    return series_table(
        monthly_panel(sources, params),
        build_sites(sources, params, with_factors),
        building_parts(requested_meters(sources, params)),
    )


def prepare_series(series: DataFrame) -> DataFrame:
    """Strategy and references. Only series cleared for a model keep their references."""
    return choose_references(decide_strategy(series))


def train_series(series: DataFrame) -> DataFrame:
    """Strategy, references, target and fit for every series.

    Series that will not be regressed carry empty targets, so no later step works on them.
    """
    prepared = prepare_series(series)
    ready = F.col("status_code") == "note_annual_ref"
    reference = prepared.withColumn("reference", F.col("train")).withColumn(
        "train", F.when(ready, F.col("train")).otherwise(F.slice("train", 1, 0))
    )
    built = build_target(reference, impute=False)
    fitted = fit_series(built.withColumn("train", F.col("reference")).drop("reference"))
    return choose_family(fitted)


def run(sources: Sources, params: DataFrame, max_month: str | None = None) -> Results:
    """All outputs for all requests.

    The monthly table, the sites and the fitted series are each computed once and checkpointed;
    every output is a projection or a small aggregate of them.
    """
    requests, params = params, single_requests(params)
    building = site_lookup(sources.table("building"), params)
    monthly = cut_lineage(monthly_panel(sources, params))
    sites = cut_lineage(build_sites(sources, params))
    parts = building_parts(requested_meters(sources, params))
    series = series_table(monthly, sites, parts)
    fitted = cut_lineage(train_series(series))
    models = model_rows(fitted)
    return Results(
        predictions=until_month(predict(fitted), max_month),
        models=models,
        outliers=outliers_table(fitted),
        messages=series_messages(fitted),
        building_messages=building_messages(
            requests, site_lookup(sources.table("building"), requests), monthly, sites,
            sources.table("degreedays"),
        ),
        building_metrics=building_metrics(models, building),
    )


def run_and_persist(
    sources: Sources, params: DataFrame, base: str, max_month: str | None = None
) -> tuple[Results, str]:
    """Run, then replace the requested buildings' results below ``base``."""
    results = run(sources, params, max_month)
    run_id, _ = persist_results(results.predictions, results.models, params, base)
    return results, run_id
