"""Order-dependent work on groups of any size: positions and gap filling without a single-task sort.

Rows are dealt out by ranges of (key, order), so a group lies in consecutive parts. What a part needs of the others is
carried in a small table with one row per group and part: how many rows lie before it, and the nearest known value on
either side. Everything else happens within a part.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_parts(df: DataFrame, keys: list[str], order: list[str], settle: Callable[[DataFrame], DataFrame], parts: int | None):
    """``df`` by ranges with ``_part`` and ``_at``, the row number within group and part.

    Range bounds are drawn from a sample, so the dealt rows are settled: every later reader sees the same parts.
    """
    number = [parts] if parts else []
    dealt = settle(df.repartitionByRange(*number, *keys, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    return dealt.withColumn("_at", F.row_number().over(within).cast("long"))


def _with_carried(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Join on group and part; null keys form a group of their own."""
    side = carried.select(*[F.col(c).alias(f"_c_{c}") for c in (*keys, "_part")], F.struct("*").alias("_c"))
    same = F.lit(True)
    for c in (*keys, "_part"):
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return df.join(side, same).drop(*[f"_c_{c}" for c in (*keys, "_part")])


def positions(
    df: DataFrame, keys: list[str], order: list[str], name: str, settle: Callable[[DataFrame], DataFrame],
    parts: int | None = None,
) -> DataFrame:
    """Add ``name``, the place (from 1) of each row in its group by the columns ``order`` (nulls first).

    Rows that are equal in ``order`` get consecutive places in any order. Null keys form a group of their own.
    """
    rows = _in_parts(df, keys, order, settle, parts)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("n"))
    carried = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return _with_carried(rows, carried, keys).select(*df.columns, (F.col("_c.before") + F.col("_at")).alias(name))


def _line(value: Column, place: Column, past: Column, ahead: Column) -> Column:
    """Linear between the known neighbours (structs of place and value), held constant at the edges."""
    span = ahead.at - past.at
    slope = (ahead.v - past.v) * (place - past.at) / F.when(span != 0, span)
    return F.coalesce(value, past.v + slope, past.v, ahead.v)


def fill_gaps(
    df: DataFrame, keys: list[str], order: list[str], value: str, settle: Callable[[DataFrame], DataFrame],
    parts: int | None = None,
) -> DataFrame:
    """Add ``<value>_filled``: linear gap fill on row position, edges held constant, for series of any length.

    Like ``interpolate_long``, but a series is spread over many tasks: a gap that reaches over parts finds its ends in
    the carried table. A series without a known value stays null. Positions of rows equal in ``order`` are not defined.
    """
    rows = _in_parts(df, keys, order, settle, parts)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).alias("v")))
    ends = rows.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("n"), F.min(known).alias("first"), F.max(known).alias("last")
    )
    by_part = Window.partitionBy(*keys).orderBy("_part")
    earlier, later = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def placed(end: str) -> Column:
        here = F.struct((F.col("before") + F.col(f"{end}.at")).alias("at"), F.col(f"{end}.v").alias("v"))
        return F.when(F.col(end).isNotNull(), here)

    carried = carried.withColumns({"first": placed("first"), "last": placed("last")}).withColumns(
        {"past": F.last("last", ignorenulls=True).over(earlier), "ahead": F.first("first", ignorenulls=True).over(later)}
    )
    joined = _with_carried(rows, carried.select(*keys, "_part", "before", "past", "ahead"), keys)
    joined = joined.withColumn("_place", F.col("_c.before") + F.col("_at"))
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("_place").alias("at"), F.col(value).alias("v")))
    up = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_part").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("_past", F.coalesce(F.last(here, ignorenulls=True).over(up), F.col("_c.past"))).withColumn(
        "_ahead", F.coalesce(F.last(here, ignorenulls=True).over(down), F.col("_c.ahead"))
    )
    filled = _line(F.col(value), F.col("_place"), F.col("_past"), F.col("_ahead"))
    return joined.select(*df.columns, filled.alias(f"{value}_filled"))
