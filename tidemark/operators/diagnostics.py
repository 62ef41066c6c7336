"""Coverage of observations and missingness of features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import quality as Q
from tidemark.functions import scalars as S
from tidemark.operators.targets import filter_series
from tidemark.schemas import FEATURE_PREFIX, MISSINGNESS


def coverage(observations: DataFrame, source: str | None = None, series_id: str | None = None) -> DataFrame:
    """Per source and series: rows, date range, release range, missing release dates."""
    chosen = filter_series(observations, series_id, source)
    return chosen.groupBy("source", "series_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.min("release_date").alias("min_release_date"),
        F.max("release_date").alias("max_release_date"),
        F.count_if(F.col("release_date").isNull()).alias("missing_release_date_count"),
    )


def feature_missingness(dataset: DataFrame) -> DataFrame:
    """One row per ``feature_*`` column, from a single pass over the dataset."""
    Q.require_columns(dataset, ["forecast_timestamp"], "dataset")
    names = [c for c in dataset.columns if c.startswith(FEATURE_PREFIX)]
    if not names:
        return dataset.sparkSession.createDataFrame([], MISSINGNESS)
    typed = dataset.select(
        S.moment(dataset, "forecast_timestamp").alias("ts"), *[S.number(dataset, n).alias(f"f{i}") for i, n in enumerate(names)]
    )
    stats = [
        F.struct(
            F.lit(name).alias("feature_name"),
            F.count(f"f{i}").alias("valid"),
            F.min(F.when(F.col(f"f{i}").isNotNull(), F.col("ts"))).alias("first_valid_timestamp"),
            F.max(F.when(F.col(f"f{i}").isNotNull(), F.col("ts"))).alias("last_valid_timestamp"),
        )
        for i, name in enumerate(names)
    ]
    one_row = typed.agg(F.count(F.lit(1)).alias("n"), F.array(*stats).alias("features"))
    missing = F.col("n") - F.col("f.valid")
    return one_row.select("n", F.explode("features").alias("f")).select(
        "f.feature_name",
        missing.alias("missing_count"),
        F.when(F.col("n") > 0, missing / F.col("n") * 100.0).otherwise(F.lit(0.0)).alias("missing_pct"),
        "f.first_valid_timestamp",
        "f.last_valid_timestamp",
        (F.col("f.valid") == 0).alias("all_missing"),
    )
