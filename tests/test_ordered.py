"""Positions and gap filling over parts, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.ordered import fill_gaps, positions
from panelcast.operators.usage import interpolate_long
from panelcast.plans.run import cut_lineage


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    groups = {"long": 900, "a": 7, "b": 40, None: 25, "unknown": 30, "one": 1}
    out = []
    for g, n in groups.items():
        gap = 0
        for k in range(n):
            gap = gap - 1 if gap else rng.choice([0, 0, 0, 0, 2, 120 if g == "long" else 3])
            out.append((g, k * 10, None if gap or g == "unknown" else rng.random()))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_positions_and_gaps_over_parts(spark, rows, parts):
    df = spark.createDataFrame(rows, "g string, t int, value double").withColumn("_c", F.lit(1)).drop("_c")
    got = {(r.g, r.t): r.p for r in positions(df, ["g"], ["t"], "p", cut_lineage, parts).collect()}
    assert got == {(g, t): t // 10 + 1 for g, t, _ in rows}
    filled = {(r.g, r.t): r.value_filled for r in fill_gaps(df, ["g"], ["t"], "value", cut_lineage, parts).collect()}
    assert len(filled) == len(rows)
    for g in {g for g, _, _ in rows}:
        series = sorted((t, v) for k, t, v in rows if k == g)
        known = [(t, v) for t, v in series if v is not None]
        for t, _ in series:
            if not known:
                assert filled[g, t] is None
            else:
                assert np.isclose(filled[g, t], np.interp(t, *zip(*known)), rtol=1e-12)
    short = {(r.g, r.t): r.value_filled for r in interpolate_long(df, ["g"], "t", "value").collect()}
    assert all((short[k] is None and v is None) or np.isclose(short[k], v) for k, v in filled.items())


def test_ties_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1)] * 50 + [("x", 2)], "g string, t int")
    got = sorted(r.p for r in positions(df, ["g"], ["t"], "p", cut_lineage, 5).collect())
    assert got == list(range(1, 52))
    empty = df.where("false")
    assert positions(empty, ["g"], ["t"], "p", cut_lineage, 3).count() == 0
    assert fill_gaps(empty.withColumn("value", F.lit(1.0)), ["g"], ["t"], "value", cut_lineage, 3).count() == 0


def test_no_task_holds_a_whole_series(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), F.col("id").alias("t"), F.when(F.col("id") % 5 == 0, 1.0).alias("value"))
    sizes = []

    def watched(frame):
        kept = cut_lineage(frame)
        sizes.extend(r["count"] for r in kept.groupBy("_part").count().collect())
        return kept

    assert fill_gaps(df, ["g"], ["t"], "value", watched, 20).where("value_filled <> 1").count() == 0
    assert len(sizes) == 20 and max(sizes) < 2500
