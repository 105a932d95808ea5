"""Input tables and the four lookups on them, for any number of buildings at once."""

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast import schemas
from panelcast.functions.scalars import month_start, months_covered, to_date, to_double

TABLES: dict[str, tuple[str, T.StructType]] = {
    "building": ("silver/building/building.parquet", schemas.BUILDING),
    "deliverypoint": ("silver/deliverypoint/deliverypoint.parquet", schemas.DELIVERYPOINT),
    "invoice": ("silver/invoice/invoice.parquet", schemas.INVOICE),
    "usage_data": ("silver/usage_data/usage_data.parquet", schemas.USAGE),
    "degreedays": ("silver/degreedays/degreedays_monthly.parquet", schemas.DEGREEDAYS),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns: bad values and NaN become NULL, absent columns are NULL.

    A whole-number invoice id keeps its type, so that "smallest id" stays numeric. All identifiers that
    tables are joined on become text.
    """
    cols = []
    numbered = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    for field in schema.fields:
        if field.name not in df.columns:
            c = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.DoubleType):
            c = to_double(F.col(field.name))
        elif isinstance(field.dataType, T.DateType):
            c = to_date(F.col(field.name))
        elif field.name == "invoice_id_primaire" and field.name in numbered:
            c = F.col(field.name)
        else:
            c = F.col(field.name).try_cast(field.dataType)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def problem_flags(df: DataFrame, schema: T.StructType) -> dict[tuple[str, str], Column]:
    """Per (column, problem) whether a row's raw value is lost or odd after ``conform``.

    ``bad_value``: a value that does not read as the column's type; ``nan``; ``infinity`` (kept as it is); for dates
    ``out_of_calendar``. Nulls and absent columns are no problem.
    """
    flags = {}
    for field in schema.fields:
        if field.name not in df.columns:
            continue
        raw = F.col(field.name)
        read = raw.try_cast(field.dataType)
        if isinstance(field.dataType, T.StringType):
            continue  # everything reads as text
        flags[field.name, "bad_value"] = raw.isNotNull() & read.isNull()
        if isinstance(field.dataType, T.DoubleType):
            flags[field.name, "nan"] = F.isnan(read)
            flags[field.name, "infinity"] = F.abs(read) == F.lit(float("inf"))
        elif isinstance(field.dataType, T.DateType):
            flags[field.name, "out_of_calendar"] = read.isNotNull() & to_date(raw).isNull()
    return flags


def input_problems(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """``table``, ``column``, ``problem`` and ``n_rows`` of every problem that occurs; one aggregation of one scan."""
    flags = problem_flags(df, schema)
    if not flags:
        return df.sparkSession.createDataFrame([], "table string, column string, problem string, n_rows bigint")
    counts = df.agg(*[F.count_if(flag).alias(f"p{k}") for k, flag in enumerate(flags.values())])
    listed = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(problem).alias("problem"), F.col(f"p{k}").alias("n_rows"))
        for k, (c, problem) in enumerate(flags)
    ])
    return counts.select(F.lit(table).alias("table"), F.inline(listed)).where("n_rows > 0")


class Sources:
    """The five input tables as conformed DataFrames, each opened on first use.

    With ``count_problems`` every table counts its rejected values while it is read for something else; see
    ``problems``.
    """

    def __init__(self, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], count_problems: bool = False):
        self._given = dict(tables)
        self._opened: dict[str, DataFrame] = {}
        self._observed: dict[str, tuple[Observation, list[tuple[str, str]]]] = {}
        self._count_problems = count_problems

    def _raw(self, name: str) -> DataFrame:
        given = self._given[name]
        df = given() if callable(given) else given
        flags = problem_flags(df, TABLES[name][1]) if self._count_problems else {}
        if not flags:
            return df
        watch = Observation(f"{name}-{uuid.uuid4().hex}")
        self._observed[name] = watch, list(flags)
        return df.observe(watch, *[F.count_if(flag).alias(f"p{k}") for k, flag in enumerate(flags.values())])

    def problems(self) -> dict[str, dict[tuple[str, str], int]]:
        """Per table that an action has read, the (column, problem) counts above zero of its first reading."""
        found = {}
        for name, (watch, listed) in self._observed.items():
            counts = watch.get
            found[name] = {key: n for k, key in enumerate(listed) if (n := counts.get(f"p{k}"))}
        return found

    @classmethod
    def from_parquet(cls, spark: SparkSession, base: str, count_problems: bool = False) -> "Sources":
        """Read the fixed relative paths below ``base`` (any filesystem Spark can reach)."""
        def reader(path: str):
            return lambda: spark.read.parquet(f"{base}/{path}")

        return cls({n: reader(path) for n, (path, _) in TABLES.items()}, count_problems)

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = conform(self._raw(name), TABLES[name][1])
        return self._opened[name]

    def between(self, name: str, column: str, first, last) -> DataFrame:
        """``table(name)`` with the date ``column`` inside [first, last] (a null bound: no row).

        Where the source has a date column, the bounds are compared with it as it is, so that the scan can skip by them.
        """
        if first is None or last is None:
            return self.table(name).where(F.lit(False))
        df = self._raw(name)
        kind = df.schema[column].dataType if column in df.columns else None
        if isinstance(kind, T.DateType) and not self._count_problems:  # counting needs all rows
            df = df.where(F.col(column).between(F.lit(first), F.lit(last)))
        conformed = conform(df, TABLES[name][1])
        return conformed.where(F.col(column).between(F.lit(first), F.lit(last)))

    def register_views(self) -> None:
        for name in self._given:
            self.table(name).createOrReplaceTempView(name)


def site_lookup(building: DataFrame, params: DataFrame) -> DataFrame:
    """One building row per requested id (the smallest one if an id repeats)."""
    ids = params.select("id_building_primaire").distinct()
    rest = [c for c in building.columns if c != "id_building_primaire"]
    return (
        building.join(ids, "id_building_primaire", "left_semi")
        .groupBy("id_building_primaire")
        .agg(F.min(F.struct(*rest)).alias("r"))
        .select("id_building_primaire", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def unknown_buildings(building: DataFrame, params: DataFrame) -> DataFrame:
    """Requested ids that have no building row."""
    return (
        params.select("id_building_primaire")
        .distinct()
        .join(building, "id_building_primaire", "left_anti")
    )


def building_invoices(
    invoice: DataFrame, deliverypoint: DataFrame, params: DataFrame
) -> DataFrame:
    """Raw invoices of the requested buildings with their meter attributes.

    Repeated meter rows repeat the invoice. Each side is size-checked by the planner, so the
    meter list is broadcast only while it is small.
    """
    ids = params.select("id_building_primaire").distinct()
    meters = deliverypoint.join(ids, "id_building_primaire", "left_semi").select(
        "deliverypoint_id_primaire", "id_building_primaire",
        *[c for c in ("deliverypoint_code", "deliverypoint_number", "fluid", "fluid_unit")
          if c in deliverypoint.columns],
    )
    return invoice.join(meters, "deliverypoint_id_primaire")


def window_bounds(windows: DataFrame) -> tuple:
    """First start and last end of all windows (two values); two nulls without a window."""
    return tuple(windows.agg(F.min("start"), F.max("end")).first())


def daily_usage(usage: DataFrame) -> DataFrame:
    """Readings reduced to one row per building, date and type: ``n_rows``, ``n_values``, ``total``.

    The reduction starts in the scan's own tasks, so a building with most of the readings is combined before it moves.
    """
    return usage.groupBy("id_building_primaire", "date", "type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.sum("value").alias("total")
    )


def in_windows(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each building inside its inclusive [start, end]; a row stands once per window that holds it.

    ``windows``: id_building_primaire, start, end. The range condition becomes an equal-key join on building and month
    of the months that a window touches; days are compared only within a month.
    """
    months = windows.where("start <= end").select(
        F.col("id_building_primaire").alias("w_building"), F.col("start").alias("w_start"),
        F.col("end").alias("w_end"), F.explode(months_covered(F.col("start"), F.col("end"))).alias("w_month"),
    )
    same_month = (F.col("id_building_primaire") == F.col("w_building")) & (
        month_start(F.col("date")) == F.col("w_month")
    )
    return daily.join(months, same_month & F.col("date").between(F.col("w_start"), F.col("w_end"))).select(daily.columns)


def building_usage(sources: Sources, windows: DataFrame) -> DataFrame:
    """Daily usage (see ``daily_usage``) of each requested building inside its inclusive [start, end].

    The earliest start and the latest end are read first, one row, and bound the dates of the scan.
    """
    first, last = window_bounds(windows)
    ids = windows.select("id_building_primaire").distinct()
    readings = sources.between("usage_data", "date", first, last)
    return in_windows(daily_usage(readings.join(ids, "id_building_primaire", "left_semi")), windows)


def station_degreedays(degreedays: DataFrame, windows: DataFrame) -> DataFrame:
    """Degree-days of each station between two months inclusive (bounds snapped to months).

    ``windows``: station_id, start, end. Adds ``month`` (DATE); order is left to the caller.
    """
    w = windows.select(
        "station_id",
        month_start(F.col("start")).alias("w_start"),
        month_start(F.col("end")).alias("w_end"),
    )
    return (
        degreedays.withColumn("month", to_date(F.concat("period_month", F.lit("-01"))))
        .join(w, "station_id")
        .where(F.col("month").between(F.col("w_start"), F.col("w_end")))
        .drop("w_start", "w_end")
    )
