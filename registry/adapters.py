"""Views of the driver's tables in the shapes the package works on."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns that order observations which are otherwise equal.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations, some without value or release date."""
    shipped = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", F.lit("_"), "l_linestatus").alias("series_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "bls").otherwise("fred").alias("source"),
        F.trunc(shipped, "month").alias("date"),
        F.when(F.col("l_partkey") % 97 != 0, F.col("l_extendedprice")).alias("value"),
        F.when(F.col("l_orderkey") % 53 != 0, F.date_add(shipped, (F.col("l_orderkey") % 40).cast("int"))).alias(
            "release_date"
        ),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
        *LINE_ORDER,
    )


def idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one monthly index per priority."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    monthly = (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderpriority").alias("series_id"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"),
            cents.alias("c"),
        )
        .groupBy("series_id", "date")
        .agg((F.sum("c").cast("double") / F.count(F.lit(1)).cast("double")).alias("value"))
    )
    lag_days = (F.lit(10) + F.month("date") % 5).cast("int")
    return monthly.select(
        "series_id", F.lit("bls").alias("source"), "date", "value", F.date_add(F.last_day("date"), lag_days).alias("release_date")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one daily series per event type."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("date"), cents.alias("c"))
        .groupBy("series_id", "date")
        .agg((F.sum("c").cast("double") / F.count(F.lit(1)).cast("double")).alias("value"))
        .select("series_id", F.lit("fred").alias("source"), "date", "value", F.date_add("date", 1).alias("release_date"))
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release calendar of the index months, every seventh month left out."""
    kept = idx(spark, sf_dir).where((F.year("date") * 12 + F.month("date")) % 7 != 0)
    return kept.select(
        F.lit("Index").alias("release_name"),
        F.date_format("date", "yyyy-MM").alias("reference_period"),
        F.date_add(F.last_day("date"), 12).alias("release_date"),
        F.lit("08:30").alias("release_time"),
    ).distinct()


def mom_id() -> Column:
    return F.concat(F.lit("mom_"), F.col("series_id"))
