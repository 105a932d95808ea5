"""Per-series decisions: training strategy, mean model, best degree-day references."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.linear import adj_r2, one_factor_moments
from panelcast.functions.series import let, mean, var_pop
from panelcast.functions.shape import settle, unfold
from panelcast.schemas import (
    CDD_COLUMNS,
    DJU_COLUMNS,
    HDD_COLUMNS,
    KEY,
    MIN_OBSERVATIONS,
    NORMAL_95,
    STATUS_TEXT,
)


def train_rows() -> Column:
    return F.filter("rows", lambda r: r.is_train)


def test_rows() -> Column:
    return F.filter("rows", lambda r: r.is_test)


def decide_strategy(series: DataFrame) -> DataFrame:
    """Add ``train``, ``n_train``, ``n_value``, ``n_zero``, ``status_code`` and ``status``."""
    code = (
        F.when((F.col("n_value") == 0) | (F.col("n_zero") == F.col("n_train")), "note_000")
        .when(F.col("n_train") < MIN_OBSERVATIONS, "note_001")
        .otherwise("note_annual_ref")
    )
    text = F.lit(None).cast("string")
    for c, t in STATUS_TEXT.items():
        text = F.when(F.col("status_code") == c, t).otherwise(text)
    return (
        series.withColumn("train", train_rows())
        .withColumns(
            {
                "n_train": F.size("train"),
                "n_value": F.expr("size(filter(train, r -> r.value IS NOT NULL))"),
                "n_zero": F.expr("size(filter(train, r -> r.value = 0))"),
            }
        )
        .withColumn("status_code", code)
        .withColumn("status", text)
    )


def add_mean_model(series: DataFrame) -> DataFrame:
    """Add ``monthly_mean`` and ``monthly_sd`` (sample) of the reference values."""
    sd = f"CASE WHEN size(v) >= 2 THEN sqrt(({var_pop('v')}) * size(v) / (size(v) - 1)) END"
    stats = let(
        "filter(transform(train, r -> r.value), x -> x IS NOT NULL)", "v",
        f"struct({mean('v')} AS m, {sd} AS sd)",
    )
    return (
        series.withColumn("mean_stats", F.expr(stats))
        .withColumns({"monthly_mean": F.col("mean_stats.m"), "monthly_sd": F.col("mean_stats.sd")})
        .drop("mean_stats")
    )


def mean_model(series: DataFrame) -> DataFrame:
    """Constant prediction with mean +- 1.96 sd for every prediction month."""
    half = F.lit(NORMAL_95) * F.col("monthly_sd")
    stats = ["monthly_mean", "monthly_sd"]
    return unfold(add_mean_model(series), [*KEY, *stats], test_rows()).select(
        *KEY, *stats,
        (12 * F.col("monthly_mean")).alias("annual_consumption_reference"),
        "month",
        F.col("value").alias("real_consumption"),
        F.col("monthly_mean").alias("predictive_consumption"),
        (F.col("monthly_mean") - half).alias("confidence_lower95"),
        (F.col("monthly_mean") + half).alias("confidence_upper95"),
    )


def reference_scores() -> Column:
    """Adjusted R2 of value ~ reference for the six references; NULL if it cannot be tested.

    A constant reference explains nothing but stays a legal candidate (R2 = 0).
    """

    pairs = """filter(
        transform(train, r -> struct(r.value AS y, get(r.dju, k) AS a)),
        r -> r.y IS NOT NULL AND r.a IS NOT NULL)"""
    sse = "(m.syy - CASE WHEN m.saa = 0 THEN 0D ELSE m.say * m.say / m.saa END)"
    score = f"CASE WHEN m.n >= {MIN_OBSERVATIONS} THEN {adj_r2('m.n', sse, 'm.syy', '1')} END"
    last = len(DJU_COLUMNS) - 1
    # Series with fewer rows have no score, so none of their sums is worked out.
    return F.expr(
        f"""transform(sequence(0, {last}), k -> CASE WHEN size(train) >= {MIN_OBSERVATIONS}
            THEN {let(one_factor_moments(pairs), 'm', score)} END)"""
    )


def _best(names: list[str]) -> Column:
    """Position in DJU_COLUMNS of the highest score; the earlier reference wins a tie."""
    scored = F.array(
        *[
            F.when(
                F.col("dju_scores")[k].isNotNull(),
                F.struct(F.col("dju_scores")[k].alias("s"), F.lit(-k).alias("o")),
            )
            for k, c in enumerate(DJU_COLUMNS)
            if c in names
        ]
    )
    return -F.array_max(F.array_compact(scored)).o


def choose_references(series: DataFrame) -> DataFrame:
    """Add ``dju_scores[6]``, ``hdd_pos``/``cdd_pos`` and ``best_hdd``/``best_cdd``."""
    names = F.array(*[F.lit(c) for c in DJU_COLUMNS])
    return (
        settle(series.withColumn("dju_scores", reference_scores()), ["dju_scores"])
        .withColumns({"hdd_pos": _best(HDD_COLUMNS), "cdd_pos": _best(CDD_COLUMNS)})
        .withColumns(
            {"best_hdd": F.get(names, F.col("hdd_pos")), "best_cdd": F.get(names, F.col("cdd_pos"))}
        )
    )


def score_table(series: DataFrame) -> DataFrame:
    """The testable references of each series with their adjusted R2 (long form)."""
    pairs = F.transform(
        F.array(*[F.lit(c) for c in DJU_COLUMNS]),
        lambda c, k: F.struct(c.alias("ref"), F.get("dju_scores", k).alias("adj_r2")),
    )
    return unfold(series, KEY, pairs, marker="adj_r2")
