"""The five domain tables as deterministic views over a star schema.

"Temperature" is ``l_quantity``; one region is one building and one weather station. Meters come
at two grains: ``segment`` (one per nation and market segment, long dense series) and
``customer`` (one per customer, so the number of series grows with the data).
"""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast import schemas
from panelcast.functions.scalars import month_text
from panelcast.sources.catalog import Sources

# The columns the views read, so that opening a table needs no job of its own.
STAR = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_suppkey BIGINT, l_quantity DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
}

STANDARD_WINDOW = (date(1996, 1, 1), date(1999, 12, 31), date(2000, 1, 1), date(2000, 12, 31))
MIDSTART_WINDOW = (date(1996, 1, 1), date(1999, 12, 31), date(2000, 1, 15), date(2000, 6, 30))
SHORT_WINDOW = (date(1996, 1, 1), date(1997, 12, 31), date(1998, 1, 1), date(1998, 12, 31))


def _prefixed(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("_", *[p.cast("string") for p in parts]))


def _meter(grain: str) -> Column:
    if grain == "customer":
        return _prefixed("PDL_", F.col("c_custkey"))
    return _prefixed("PDL_", F.col("c_nationkey"), F.col("c_mktsegment"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR[name]).parquet(f"{sf_dir}/{name}.parquet")


def building(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(
        _prefixed("B_", F.col("r_regionkey")).alias("id_building_primaire"),
        F.col("r_name").alias("name"),
        _prefixed("ST_", F.col("r_regionkey")).alias("weather_station"),
        (F.lit(1000) * F.col("r_regionkey")).cast("double").alias("surface"),
        (F.lit(10) * F.col("r_regionkey")).alias("occupant"),
    )


def deliverypoint(spark: SparkSession, sf_dir: str, grain: str = "segment") -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    customer = read(spark, sf_dir, "customer")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _meter(grain).alias("deliverypoint_id_primaire"),
            _prefixed("B_", F.col("n_regionkey")).alias("id_building_primaire"),
            F.col("c_mktsegment").alias("fluid"),
            F.lit("kWh").alias("fluid_unit"),
        )
        .distinct()
    )


def invoice(spark: SparkSession, sf_dir: str, grain: str = "segment") -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    customer = read(spark, sf_dir, "customer")
    okey, start = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        okey.alias("invoice_id_primaire"),
        _meter(grain).alias("deliverypoint_id_primaire"),
        start.alias("start"),
        F.when(okey % 211 != 0, F.date_add(start, (okey % 70).cast("int"))).alias("end"),
        F.when(okey % 97 == 0, F.lit(None))
        .when(okey % 53 == 0, F.lit(0.0))
        .otherwise(F.col("o_totalprice"))
        .alias("value"),
    )


def _supplier_regions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    lineitem = read(spark, sf_dir, "lineitem").select("l_suppkey", *columns)
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return lineitem.join(regions, F.col("l_suppkey") == F.col("s_suppkey"))


def degreedays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six conditional sums in one pass, then unpivoted: the line items are never multiplied."""
    q = F.col("l_quantity")
    sums = [
        F.sum(F.greatest((b - q) if ind == "hdd" else (q - b), F.lit(0.0))).alias(f"{ind}{b}")
        for ind, b in schemas.DJU_SPECS
    ]
    refs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(ind).alias("indicator"), F.lit(b).alias("basis"),
                    F.col(f"{ind}{b}").alias("value"),
                )
                for ind, b in schemas.DJU_SPECS
            ]
        )
    ).alias("r")
    return (
        _supplier_regions(spark, sf_dir, "l_shipdate", "l_quantity")
        .groupBy(
            _prefixed("ST_", F.col("n_regionkey")).alias("station_id"),
            month_text(F.col("l_shipdate")).alias("period_month"),
        )
        .agg(*sums)
        .select("station_id", "period_month", refs)
        .select("station_id", "period_month", "r.*")
    )


def usage_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_regions(spark, sf_dir, "l_shipdate", "l_returnflag", "l_quantity").select(
        _prefixed("B_", F.col("n_regionkey")).alias("id_building_primaire"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat(F.lit("fi_"), F.col("l_returnflag")).alias("type"),
        F.col("l_quantity").alias("value"),
    )


def star_sources(spark: SparkSession, sf_dir: str, grain: str = "segment") -> Sources:
    return Sources(
        {
            "building": lambda: building(spark, sf_dir),
            "deliverypoint": lambda: deliverypoint(spark, sf_dir, grain),
            "invoice": lambda: invoice(spark, sf_dir, grain),
            "usage_data": lambda: usage_data(spark, sf_dir),
            "degreedays": lambda: degreedays(spark, sf_dir),
        }
    )


def params(spark: SparkSession, sf_dir: str, window=STANDARD_WINDOW) -> DataFrame:
    """One request per building, all with the same dates."""
    names = ("start_ref", "end_ref", "start_pred", "end_pred")
    return building(spark, sf_dir).select(
        "id_building_primaire", *[F.lit(d).alias(n) for n, d in zip(names, window)]
    )
