"""Report tables and chart frames over forecasts and metrics."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import quality as Q
from tidemark.functions import scalars as S
from tidemark.schemas import METRICS_COLUMNS, NAIVE

FORECAST_REPORT_COLUMNS = ["forecast_timestamp", "actual", "prediction", "model_name"]


def normalize_report_metrics(metrics: DataFrame) -> DataFrame:
    """All nine metric columns, unreadable numbers as missing."""
    Q.require_columns(metrics, METRICS_COLUMNS, "metrics")
    return metrics.withColumns({c: S.number(metrics, c) for c in METRICS_COLUMNS if c != "model_name"})


def normalize_report_forecasts(forecasts: DataFrame) -> DataFrame:
    """Report columns of the forecasts, unreadable timestamps and numbers as missing."""
    Q.require_columns(forecasts, FORECAST_REPORT_COLUMNS, "forecast")
    return forecasts.withColumns(
        {
            "forecast_timestamp": S.moment(forecasts, "forecast_timestamp", strict=False),
            "actual": S.number(forecasts, "actual"),
            "prediction": S.number(forecasts, "prediction"),
        }
    )


def plot_ready_forecasts(forecasts: DataFrame) -> DataFrame:
    """Forecasts that can be drawn: readable, with timestamp, actual and prediction. No rows at all is an error."""
    Q.require_columns(forecasts, FORECAST_REPORT_COLUMNS, "forecast")
    if forecasts.isEmpty():
        raise ValueError("There are no forecasts to draw.")
    typed = forecasts.withColumns(
        {
            "forecast_timestamp": S.moment(forecasts, "forecast_timestamp"),
            "actual": S.number(forecasts, "actual", strict=True),
            "prediction": S.number(forecasts, "prediction", strict=True),
        }
    )
    return typed.dropna(subset=["forecast_timestamp", "actual", "prediction"])


def forecast_counts(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("model_name").agg(F.count(F.lit(1)).alias("forecast_count"))


def actual_stats(forecasts: DataFrame) -> DataFrame:
    """Mean and sample deviation of the actual values over all rows."""
    rows = normalize_report_forecasts(forecasts)
    return rows.agg(F.avg("actual").alias("actual_mean"), F.stddev_samp("actual").alias("actual_std"))


def prediction_stats(forecasts: DataFrame) -> DataFrame:
    """Mean and sample deviation of the predictions per model."""
    rows = normalize_report_forecasts(forecasts)
    return rows.groupBy("model_name").agg(
        F.avg("prediction").alias("prediction_mean"), F.stddev_samp("prediction").alias("prediction_std")
    )


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """One row: models, rows, distinct timestamps, time range and sorted target ids."""
    rows = normalize_report_forecasts(forecasts)
    target = F.col("target_id") if "target_id" in rows.columns else F.lit(None).cast("string")
    return rows.agg(
        F.count_distinct("model_name").alias("models"),
        F.count(F.lit(1)).alias("forecast_rows"),
        F.count_distinct("forecast_timestamp").alias("unique_timestamps"),
        F.min("forecast_timestamp").alias("min_timestamp"),
        F.max("forecast_timestamp").alias("max_timestamp"),
        F.array_join(F.sort_array(F.collect_set(target)), ", ").alias("target_ids"),
    )


def verdicts(metrics: DataFrame) -> DataFrame:
    """Per model other than the benchmark: does it beat it on rmse and on mae."""
    rows = normalize_report_metrics(metrics).where(F.col("model_name").isNull() | (F.col("model_name") != NAIVE))

    def verdict(flag):
        return F.when(F.col(flag) == 1.0, "beats").otherwise("does not beat")

    return rows.select(
        "model_name",
        verdict("beats_naive_rmse").alias("rmse_verdict"),
        verdict("beats_naive_mae").alias("mae_verdict"),
    )


def actuals_series(forecasts: DataFrame) -> DataFrame:
    """Chart lines in long form: one actual per timestamp and each model's predictions."""
    rows = plot_ready_forecasts(forecasts)
    ties = [c for c in ("model_name", "target_id", "target_reference_date") if c in rows.columns]
    actual = rows.groupBy("forecast_timestamp").agg(F.min_by("actual", F.struct(*ties)).alias("y"))
    lines = rows.where(F.col("model_name").isNotNull()).select(
        F.concat("model_name", F.lit(" prediction")).alias("series"), "forecast_timestamp", F.col("prediction").alias("y")
    )
    return actual.select(F.lit("actual").alias("series"), "forecast_timestamp", "y").unionByName(lines)


def forecast_errors(forecasts: DataFrame) -> DataFrame:
    """Prediction minus actual per model over time."""
    rows = plot_ready_forecasts(forecasts).where(F.col("model_name").isNotNull())
    return rows.select("model_name", "forecast_timestamp", (F.col("prediction") - F.col("actual")).alias("error"))


def metric_bars(metrics: DataFrame, wanted: Sequence[str] = ("rmse", "mae")) -> DataFrame:
    """Chart bars in long form: model, metric, value. A metric without any value fails."""
    unknown = [m for m in wanted if m not in ("rmse", "mae")]
    if unknown or not wanted:
        raise ValueError(f"Bars can show rmse and mae, not {list(wanted)}.")
    Q.require_columns(metrics, ["model_name", *wanted], "metrics")
    typed = metrics.select("model_name", *[S.number(metrics, m).alias(m) for m in wanted])
    bars = typed.unpivot("model_name", list(wanted), "metric", "value")
    if metrics.isEmpty():
        raise ValueError("There are no metrics to draw.")
    counts = typed.agg(*[F.count(m).alias(m) for m in wanted]).first().asDict()
    empty = [m for m, n in counts.items() if not n]
    if empty:
        raise ValueError(f"No number to draw for {empty}.")
    return bars


def comparison_report(metrics: DataFrame, forecasts: DataFrame) -> dict[str, DataFrame]:
    """The report's tables by name, ready for ``write_table``."""
    rows = normalize_report_forecasts(forecasts)
    table = normalize_report_metrics(metrics).select(*METRICS_COLUMNS)
    return {
        "metrics": table,
        "verdicts": verdicts(table),
        "summary": forecast_summary(rows),
        "forecast_counts": forecast_counts(rows),
        "actual_stats": actual_stats(rows),
        "prediction_stats": prediction_stats(rows),
    }
