"""Usage factors: monthly means, constant-factor removal, profiling and gap filling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalars import factor_class, month_start, to_double
from panelcast.schemas import DJU_COLUMNS, STANDARD_COLUMNS


def filter_usage(usage: DataFrame, building: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of a building, with optional inclusive date bounds."""
    out = usage
    if building is not None:
        out = out.where(F.col("id_building_primaire") == building)
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end))
    return out


def monthly_usage(usage: DataFrame) -> DataFrame:
    """Mean per building, month and type (long form)."""
    return usage.groupBy(
        "id_building_primaire", month_start(F.col("date")).alias("month"), "type"
    ).agg(F.avg("value").alias("value"))


def monthly_from_daily(daily: DataFrame) -> DataFrame:
    """``monthly_usage`` from the sums and counts of ``daily_usage``."""
    return (
        daily.groupBy("id_building_primaire", month_start(F.col("date")).alias("month"), "type")
        .agg(F.sum("total").alias("total"), F.sum("n_values").alias("n"))
        .select("id_building_primaire", "month", "type", F.expr("total / nullif(n, 0)").alias("value"))
    )


def _by_type(monthly: DataFrame) -> DataFrame:
    """One row per (building, type) with its months as an array; unusable types are gone.

    Dropped: types that never have a value or hold one constant. A single month is kept.
    """
    return (
        monthly.groupBy("id_building_primaire", "type")
        .agg(
            F.count("value").alias("n"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.array_sort(F.collect_list(F.struct("month", "value"))).alias("entries"),
        )
        .where((F.col("n") == 1) | (F.col("lo") != F.col("hi")))
        .select("id_building_primaire", "type", "entries")
    )


def non_constant(monthly: DataFrame) -> DataFrame:
    """Monthly factors without the unusable types (long form)."""
    return _by_type(monthly).select("id_building_primaire", "type", F.inline("entries"))


def _is_factor() -> Column:
    return factor_class(F.col("type")).isNotNull() & ~F.col("type").isin(STANDARD_COLUMNS)


def monthly_usage_factors(usage: DataFrame) -> DataFrame:
    """Monthly means of the usable types, with their class (0 influencing, 1 usage)."""
    return non_constant(monthly_usage(usage).where(_is_factor())).withColumn(
        "factor_class", factor_class(F.col("type"))
    )


def factor_matrix(monthly: DataFrame) -> DataFrame:
    """From monthly means, one row per building: ``factor_types``, ``factor_first`` month and ``factor_values``.

    Types are in regressor order (influencing first, then usage, each by name);
    ``factor_values[type][month offset]`` is the monthly mean, NULL where there is none.
    """
    dense = """transform(t, x -> transform(array(map_from_entries(x.entries)), m -> transform(
        sequence(factor_first, factor_last, interval 1 month), d -> try_element_at(m, d)))[0])"""
    return (
        _by_type(monthly.where(_is_factor()))
        .groupBy("id_building_primaire")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(factor_class(F.col("type")).alias("c"), "type", "entries"))
            ).alias("t")
        )
        .withColumn("factor_first", F.expr("array_min(transform(t, x -> x.entries[0].month))"))
        .withColumn(
            "factor_last", F.expr("array_max(transform(t, x -> element_at(x.entries, -1).month))")
        )
        .select(
            "id_building_primaire",
            F.col("t.type").alias("factor_types"),
            "factor_first",
            F.expr(dense).alias("factor_values"),
        )
    )


def widen(factors: DataFrame, types: list[str]) -> DataFrame:
    """One column per type, for callers who know the names."""
    return factors.groupBy("id_building_primaire", "month").pivot("type", types).agg(F.first("value"))


def profile_columns(df: DataFrame) -> DataFrame:
    """Columns usable as factors: not standard, not degree-days, some numeric value. One scan."""
    names = [c for c in df.columns if c not in STANDARD_COLUMNS and c not in DJU_COLUMNS]
    seen = df.agg(*[F.count(to_double(F.col(f"`{c}`"))).alias(c) for c in names])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_numeric"))
                  for c in names])
    )
    return seen.select(pairs.alias("p")).select("p.*").where("n_numeric > 0")


def interpolate_long(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Linear gap fill on row position, edges held constant; adds ``<value>_filled``.

    Both directions use running frames, so a series costs two sorts and no quadratic frame.
    """
    asc = Window.partitionBy(*keys).orderBy(order)
    desc = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    past = asc.rowsBetween(Window.unboundedPreceding, 0)
    ahead = desc.rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct("_pos", value))
    span = F.col("_n.`_pos`") - F.col("_p.`_pos`")
    line = F.col(f"_p.{value}") + (F.col(f"_n.{value}") - F.col(f"_p.{value}")) * (
        F.col("_pos") - F.col("_p.`_pos`")
    ) / F.when(span != 0, span)
    return (
        df.withColumn("_pos", F.row_number().over(asc))
        .withColumn("_p", F.last(known, ignorenulls=True).over(past))
        .withColumn("_n", F.last(known, ignorenulls=True).over(ahead))
        .withColumn(
            f"{value}_filled",
            F.coalesce(F.col(value), line, F.col(f"_p.{value}"), F.col(f"_n.{value}")),
        )
        .drop("_pos", "_p", "_n")
    )
