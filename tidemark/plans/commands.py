"""The user-facing jobs, each composed from the operators."""

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_features, lagged_targets
from tidemark.operators.comparison import compare_models, walk_forward
from tidemark.operators.diagnostics import feature_missingness
from tidemark.operators.metrics import compare_to_naive, evaluate_forecasts
from tidemark.operators.summaries import (
    actuals_series,
    comparison_report,
    forecast_errors,
    metric_bars,
    verdicts,
)
from tidemark.operators.targets import HEADLINE_SERIES, HEADLINE_SOURCE, mom_target, target_shell
from tidemark.schemas import NAIVE
from tidemark.session import stage
from tidemark.sources import calendar as C
from tidemark.sources import payloads as P
from tidemark.sources.store import ObservationStore
from tidemark.sources.tables import write_comparison, write_table


def ingest_fred(store: ObservationStore, landing_path: str, series_id: str, merge_chunks: bool = False, **parameters) -> dict:
    """Landed FRED responses of a series into the store, as one audited run."""

    def fetch():
        landed = P.read_landing(store.spark, landing_path).where(F.col("series_id") == series_id)
        return P.normalize_fred(landed, merge_chunks)

    return store.run_ingestion("fred", series_id, fetch, P.validate_fred, {"series_id": series_id, **parameters})


def ingest_bls(
    store: ObservationStore,
    landing_path: str,
    series_id: str,
    calendar_path: str | None = None,
    strict_calendar: bool = False,
    **parameters,
) -> dict:
    """Landed BLS responses of a series into the store, dated by a release calendar."""
    if strict_calendar and calendar_path is None:
        raise ValueError("strict_calendar requires calendar_path.")

    def fetch():
        landed = P.read_landing(store.spark, landing_path).where(F.col("series_id") == series_id)
        rows = P.normalize_bls(landed)
        if calendar_path is None:
            warnings.warn("No release calendar: release dates stay missing.", RuntimeWarning, stacklevel=2)
            return rows
        calendar = C.read_release_calendar(store.spark, calendar_path)
        rows = stage(rows)  # Parsed once, for the coverage and for the merge.
        C.assert_calendar_coverage(rows, calendar, strict_calendar)
        return C.map_release_dates(rows, calendar)

    asked = {"series_id": series_id, "release_calendar": calendar_path, "strict_calendar": strict_calendar}
    return store.run_ingestion("bls", series_id, fetch, P.validate_bls, asked | parameters)


def check_calendar(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Validate a calendar file, and its coverage of a range; returns its summary."""
    calendar = C.read_release_calendar(spark, path)
    missing = sorted(r[0] for r in C.calendar_range_gaps(calendar, start, end).collect())
    if missing:
        raise C.CalendarCoverageError(f"Release calendar missing reference periods: {missing}")
    return C.calendar_summary(calendar)


def build_target(
    store: ObservationStore,
    series_id: str = HEADLINE_SERIES,
    source: str = HEADLINE_SOURCE,
    allow_missing_release_dates: bool = False,
    output: str | None = None,
    format: str = "parquet",
) -> DataFrame:
    """The target's dataset shell; only its series and source are read."""
    rows = store.read(source, series_id)
    targets = mom_target(rows, series_id, source, strict=not allow_missing_release_dates)
    shell = target_shell(targets, validate=not allow_missing_release_dates)
    if output:
        write_table(shell, output, format, ["target_id", "target_reference_date"])
    return shell


def build_feature_matrix(
    store: ObservationStore,
    target_series_id: str = HEADLINE_SERIES,
    target_source: str = HEADLINE_SOURCE,
    features: Sequence[str] | None = None,
    include_lagged_target: bool = False,
    allow_missing_release_dates: bool = False,
    output: str | None = None,
    format: str = "parquet",
) -> DataFrame:
    """Targets with the latest released value of each feature series."""
    strict = not allow_missing_release_dates
    targets = mom_target(store.read(target_source, target_series_id), target_series_id, target_source, strict)
    matrix = asof_features(target_shell(targets), store.read(), features, strict)
    if include_lagged_target:
        # The shell is unique per target and period, so one target has one row per day at most.
        matrix = lagged_targets(matrix, bounded=True)
    if output:
        write_table(matrix, output, format, ["target_id", "target_reference_date"])
    return matrix


def validate_model(
    dataset: DataFrame,
    model: str,
    min_train_size: int = 24,
    output: str | None = None,
    format: str = "parquet",
    **options,
) -> dict[str, DataFrame]:
    """Forecasts of one model, their metrics, and the comparison with the benchmark."""
    forecasts = stage(walk_forward(dataset, model, min_train_size, **options))
    result = {"forecasts": forecasts, "metrics": evaluate_forecasts(forecasts)}
    if model != NAIVE:
        by = {"by": options["by"]} if "by" in options else {}
        comparison = compare_to_naive(forecasts, walk_forward(dataset, NAIVE, min_train_size, **by))
        flags = comparison.select(
            F.lit(model).alias("model_name"),
            F.lit(None).cast("long").alias("n_forecasts"),
            F.col("model_rmse").alias("rmse"),
            F.col("model_mae").alias("mae"),
            F.lit(None).cast("double").alias("directional_accuracy"),
            F.col("model_beats_naive_rmse").alias("beats_naive_rmse"),
            F.col("model_beats_naive_mae").alias("beats_naive_mae"),
            F.col("rmse_improvement").alias("rmse_vs_naive"),
            F.col("mae_improvement").alias("mae_vs_naive"),
        )
        result |= {"comparison": comparison, "verdicts": verdicts(flags)}
    if output:
        write_table(forecasts, output, format, ["forecast_timestamp", "target_id"])
    return result


def compare(
    dataset: DataFrame,
    models: Sequence[str] = (NAIVE, "ridge"),
    min_train_size: int = 24,
    output_dir: str | None = None,
    prefix: str = "model_comparison",
    report_dir: str | None = None,
    include_charts: bool = False,
    format: str = "parquet",
    **options,
) -> dict[str, DataFrame]:
    """Compare models; optionally save the outputs and the report's tables."""
    if include_charts and report_dir is None:
        raise ValueError("include_charts requires report_dir.")
    forecasts, metrics = compare_models(dataset, models, min_train_size, **options)
    metrics = stage(metrics)
    if output_dir:
        write_comparison(forecasts, metrics, output_dir, prefix, format)
    if report_dir:
        report(metrics, forecasts, report_dir, include_charts, format)
    return {"forecasts": forecasts, "metrics": metrics, "verdicts": verdicts(metrics)}


def report(
    metrics: DataFrame, forecasts: DataFrame, output_dir: str, include_charts: bool = False, format: str = "parquet"
) -> dict[str, str]:
    """Write the report's tables, and its chart frames if wanted; returns their paths."""
    tables = comparison_report(metrics, forecasts)
    if include_charts:
        tables |= {
            "predictions_vs_actuals": actuals_series(forecasts),
            "forecast_errors": forecast_errors(forecasts),
            "metric_comparison": metric_bars(metrics),
        }
    base = output_dir.rstrip("/")
    return {name: write_table(df, f"{base}/{name}", format, mode="overwrite") for name, df in tables.items()}


def feature_diagnostics(dataset: DataFrame, output: str | None = None, format: str = "parquet") -> DataFrame:
    summary = feature_missingness(dataset)
    if output:
        write_table(summary, output, format, ["feature_name"])
    return summary
