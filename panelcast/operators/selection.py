"""Exact quantiles of groups of any size by distributed selection.

No group is sorted or gathered. A wanted rank lies in an interval of values; each round counts the values of the
interval by bucket, a partial aggregation that sends at most ``BUCKETS`` rows per interval and task, and goes on with
the bucket that holds the rank, cut down to the smallest and largest value in it. Equal values are counted, never
spread, so a value that half of a group has costs no more than any other.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalars import is_finite

BUCKETS = 4096
#: An interval inside one power of two is cut into BUCKETS parts a round, so 52 bits of fraction need five rounds.
MOST_ROUNDS = 8
#: Up to so many intervals (some ten bytes each) go to every task; more are joined by key, with skewed keys split.
MOST_BROADCAST = 100_000


def _first_bucket(v: Column) -> Column:
    """A number that does not fall as the value rises: the power of two below it, with its sign."""
    power = F.floor(F.log2(F.when(v != 0, F.abs(v)))) + 2000
    return F.when(v == 0, F.lit(0)).when(v > 0, power).otherwise(-power).cast("long")


def _bucket(v: Column) -> Column:
    """Part of [lo, hi] in equal steps; the first round's intervals are too wide for that."""
    part = F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS).cast("long")
    return F.when(F.col("wide"), _first_bucket(v)).otherwise(part)


def rank_values(
    df: DataFrame, keys: list[str], value: str, ranks: DataFrame, settle: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The value at each wanted rank: ``ranks`` (``keys``, ``rank`` from 0) with ``value_at``.

    Nulls, NaN and infinities do not count, rows with a null key neither; ranks outside a group are left out. ``settle`` cuts the lineage of the
    small table of intervals between rounds.
    """
    v = F.col(f"`{value}`").cast("double")
    rows = df.where(is_finite(v)).select(*keys, v.alias("v"))
    bounds = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    # An interval is known by its group and the number of smaller values of the group.
    open_ranks = settle(
        ranks.join(bounds, keys).where("rank >= 0 AND rank < n").select(
            *keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.lit(True).alias("wide")
        )
    )
    found = open_ranks.where("lo = hi")
    open_ranks = open_ranks.where("lo < hi")
    here = [*keys, "below"]
    for _ in range(MOST_ROUNDS):
        left = open_ranks.count()
        if not left:
            break
        intervals = open_ranks.select(*keys, "below", "lo", "hi", "wide").distinct()
        if left <= MOST_BROADCAST:
            intervals = F.broadcast(intervals)
        inside = rows.join(intervals, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy(*here, _bucket(F.col("v")).alias("bucket")).agg(
            F.count(F.lit(1)).alias("m"), F.min("v").alias("b_lo"), F.max("v").alias("b_hi")
        )
        order = Window.partitionBy(*here).orderBy("bucket")
        steps = counts.withColumn("upto", F.col("below") + F.sum("m").over(order))
        steps = steps.withColumn("from", F.col("upto") - F.col("m"))
        nearer = open_ranks.drop("lo", "hi", "wide").join(steps, here).where("rank >= from AND rank < upto")
        nearer = settle(
            nearer.select(
                *keys, "rank", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), F.col("from").alias("below"),
                F.lit(False).alias("wide"),
            )
        )
        found = found.unionByName(nearer.where("lo = hi"))
        open_ranks = nearer.where("lo < hi")
    else:
        if not open_ranks.isEmpty():
            raise RuntimeError("the values of an interval could not be told apart")
    return found.select(*keys, "rank", F.col("lo").alias("value_at"))


def quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: list[float], settle: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Type-7 quantiles per key: ``keys``, ``n``, ``probability``, ``quantile`` (linear between neighbouring ranks).

    Groups without a finite value have no row.
    """
    v = F.col(f"`{value}`").cast("double")
    sizes = df.where(is_finite(v)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select(
        *keys, "n", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    ).withColumn("h", (F.col("n") - 1) * F.col("probability"))
    wanted = settle(
        wanted.withColumn("low", F.floor("h").cast("long")).withColumn("high", F.least(F.col("low") + 1, F.col("n") - 1))
    )
    ranks = wanted.select(*keys, F.explode(F.array("low", "high")).alias("rank")).distinct()
    at = rank_values(df, keys, value, ranks, settle)

    def picked(rank: str, name: str) -> DataFrame:
        return at.select(*keys, F.col("rank").alias(rank), F.col("value_at").alias(name))

    part = F.col("h") - F.col("low")
    return (
        wanted.join(picked("low", "v_low"), [*keys, "low"])
        .join(picked("high", "v_high"), [*keys, "high"])
        .select(*keys, "n", "probability", ((1 - part) * F.col("v_low") + part * F.col("v_high")).alias("quantile"))
    )


def iqr_bounds(
    df: DataFrame, keys: list[str], value: str, width: float, settle: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Quartiles and fence of each group: ``q1``, ``q3``, ``low``, ``high``; groups without spread have no row."""
    quarters = quantiles(df, keys, value, [0.25, 0.75], settle)
    both = quarters.groupBy(*keys).agg(
        F.max(F.when(F.col("probability") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("probability") == 0.75, F.col("quantile"))).alias("q3"),
    )
    spread = F.col("q3") - F.col("q1")
    return both.where(spread > 0).select(
        *keys, "q1", "q3", (F.col("q1") - width * spread).alias("low"), (F.col("q3") + width * spread).alias("high")
    )
