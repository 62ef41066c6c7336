"""Column contracts and Spark schemas of every table the package reads or returns."""

from pyspark.sql import types as T

# Marker for an observation whose release date is unknown, and the
# audit states of an ingestion run.
MISSING_RELEASE_KEY = "__MISSING__"
STARTED, SUCCEEDED, FAILED = "started", "succeeded", "failed"

FEATURE_PREFIX = "feature_"
NAIVE = "naive_last_value"

OBSERVATIONS = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("value", T.DoubleType()),
        T.StructField("source", T.StringType(), False),
        T.StructField("release_date", T.DateType()),
        T.StructField("fetched_at", T.TimestampType(), False),
    ]
)
OBSERVATION_COLUMNS = OBSERVATIONS.fieldNames()
VINTAGE_KEY = ["series_id", "source", "date", "release_date_key"]

TARGETS = T.StructType(
    [
        T.StructField("target_id", T.StringType()),
        T.StructField("target_name", T.StringType()),
        T.StructField("series_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("reference_date", T.DateType()),
        T.StructField("release_date", T.DateType()),
        T.StructField("target_value", T.DoubleType()),
        T.StructField("target_units", T.StringType()),
    ]
)
TARGET_COLUMNS = TARGETS.fieldNames()

DATASET_COLUMNS = [
    "forecast_timestamp",
    "target_id",
    "target_reference_date",
    "target_release_date",
    "target_value",
]

FORECASTS = T.StructType(
    [
        T.StructField("forecast_timestamp", T.TimestampType()),
        T.StructField("target_id", T.StringType()),
        T.StructField("target_reference_date", T.DateType()),
        T.StructField("target_release_date", T.DateType()),
        T.StructField("actual", T.DoubleType()),
        T.StructField("prediction", T.DoubleType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("fold_number", T.LongType()),
    ]
)
FORECAST_COLUMNS = FORECASTS.fieldNames()
ALIGNMENT_KEYS = ["forecast_timestamp", "target_id", "target_reference_date"]

METRICS = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("n_forecasts", T.LongType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("directional_accuracy", T.DoubleType()),
        T.StructField("beats_naive_rmse", T.DoubleType()),
        T.StructField("beats_naive_mae", T.DoubleType()),
        T.StructField("rmse_vs_naive", T.DoubleType()),
        T.StructField("mae_vs_naive", T.DoubleType()),
    ]
)
METRICS_COLUMNS = METRICS.fieldNames()

MISSINGNESS = T.StructType(
    [
        T.StructField("feature_name", T.StringType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("missing_pct", T.DoubleType()),
        T.StructField("first_valid_timestamp", T.TimestampType()),
        T.StructField("last_valid_timestamp", T.TimestampType()),
        T.StructField("all_missing", T.BooleanType()),
    ]
)

CALENDAR = T.StructType(
    [
        T.StructField("release_name", T.StringType()),
        T.StructField("reference_period", T.StringType()),
        T.StructField("release_date", T.StringType()),
        T.StructField("release_time", T.StringType()),
    ]
)
CALENDAR_COLUMNS = CALENDAR.fieldNames()

RUN_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("event_seq", T.IntegerType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("series_id", T.StringType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("rows_seen", T.LongType()),
        T.StructField("inserted", T.LongType()),
        T.StructField("updated", T.LongType()),
        T.StructField("skipped", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("parameters_json", T.StringType()),
    ]
)
RUN_COLUMNS = [name for name in RUN_EVENTS.fieldNames() if name != "event_seq"]


def feature_columns(df, requested=None):
    """All ``feature_*`` columns, or the requested ones; none or unknown is an error."""
    found = list(requested) if requested is not None else [c for c in df.columns if c.startswith(FEATURE_PREFIX)]
    if not found:
        raise ValueError("No feature columns available.")
    unknown = [c for c in found if c not in df.columns]
    if unknown:
        raise ValueError(f"Unknown feature columns: {unknown}")
    return found
