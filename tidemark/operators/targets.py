"""Target rows: period-over-period change of a series, their contract and dataset shells."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import quality as Q
from tidemark.functions import scalars as S
from tidemark.schemas import DATASET_COLUMNS, TARGET_COLUMNS

# Fixed values of the default target.
HEADLINE_SERIES, HEADLINE_SOURCE = "CUSR0000SA0", "bls"
HEADLINE_ID, HEADLINE_NAME = "cpi_mom", "Headline CPI month-over-month inflation"


def filter_series(observations: DataFrame, series=None, source: str | None = None) -> DataFrame:
    """Equality or IN filter on series and source, in a form that reaches the scan."""
    if series is not None:
        wanted = [series] if isinstance(series, str) else list(series)
        observations = observations.where(
            F.col("series_id") == wanted[0] if len(wanted) == 1 else F.col("series_id").isin(wanted)
        )
    return observations if source is None else observations.where(F.col("source") == source)


def mom_target(
    observations: DataFrame,
    series_id: str | Sequence[str] | None = HEADLINE_SERIES,
    source: str | None = HEADLINE_SOURCE,
    strict: bool = True,
    target_id: str | Column = HEADLINE_ID,
    target_name: str | Column = HEADLINE_NAME,
) -> DataFrame:
    """Percent change of each observation over the previous one of its series and source.

    Previous means the previous row by (date, release_date). Rows without a result are
    dropped. ``series_id=None`` builds targets for every series; pass ``target_id`` as a
    column expression then.

    No group outgrows the calendar: inside one date a series has one row per release
    date (checked), and across dates only the last row of each date matters.
    """
    Q.require_columns(observations, ["series_id", "source", "date", "value", "release_date"], "observation")
    chosen = filter_series(observations, series_id, source)
    rows = chosen.select(
        "series_id",
        "source",
        S.day(chosen, "date").alias("date"),
        S.number(chosen, "value", strict=True).alias("value"),
        S.day(chosen, "release_date").alias("release_date"),
    )
    rules = [(F.col("date").isNull(), "date cannot be missing.")]
    if strict:
        rules.append((F.col("release_date").isNull(), "strict targets require release_date on every observation."))
    series = ["series_id", "source"]
    # Both uses below start from this one shuffle, so the observations are scanned once.
    rows = Q.guard(rows, *rules).dropna(subset=[*series, "date"]).repartition(*series, "date")

    in_date = Window.partitionBy(*series, "date").orderBy(F.col("release_date").asc_nulls_last())
    vintages = rows.withColumns(
        {
            "_first": F.row_number().over(in_date) == 1,
            "_earlier": F.lag("value").over(in_date),
            "_repeated": F.lag("release_date").over(in_date).eqNullSafe(F.col("release_date")),
        }
    )
    vintages = Q.guard(
        vintages,
        (
            ~F.col("_first") & F.col("_repeated"),
            F.concat(F.lit("Duplicate observations for one date and release date: "), Q.shown("series_id", "date", "release_date")),
        ),
    )

    last_of_date = rows.groupBy(*series, "date").agg(
        F.max_by(F.struct("value"), F.struct(*S.last_key("release_date"))).alias("last")
    )
    by_date = Window.partitionBy(*series).orderBy("date")
    carried = last_of_date.select(*series, "date", F.lag("last.value").over(by_date).alias("_carried"))

    previous = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_earlier"))
    return (
        vintages.join(carried, [*series, "date"], "left")
        .select(
            (F.lit(target_id) if isinstance(target_id, str) else target_id).alias("target_id"),
            (F.lit(target_name) if isinstance(target_name, str) else target_name).alias("target_name"),
            "series_id",
            "source",
            F.col("date").alias("reference_date"),
            "release_date",
            S.percent_over(F.col("value"), previous).alias("target_value"),
            F.lit("percent").alias("target_units"),
        )
        .where(F.col("target_value").isNotNull())
    )


def validate_targets(targets: DataFrame, month_end_ids: Sequence[str] = (HEADLINE_ID,)) -> DataFrame:
    """The targets, typed and checked: released, numeric, one row per period, and for
    ``month_end_ids`` released after the month they describe."""
    Q.require_columns(targets, TARGET_COLUMNS, "target")
    typed = targets.select(
        "target_id",
        "target_name",
        "series_id",
        "source",
        S.day(targets, "reference_date").alias("reference_date"),
        S.day(targets, "release_date", strict=False).alias("release_date"),
        S.number(targets, "target_value", strict=True).alias("target_value"),
        "target_units",
    )
    monthly = F.col("target_id").isin(list(month_end_ids))
    checked = Q.guard(
        typed,
        (F.col("release_date").isNull(), "A target has no release_date."),
        (
            monthly & (F.col("release_date") <= F.last_day("reference_date")),
            F.concat(F.lit("Target released before its month ended: "), Q.shown("target_id", "reference_date", "release_date")),
        ),
    )
    return Q.unique_by(checked, ["target_id", "reference_date"], "target")


def target_shell(targets: DataFrame, validate: bool = True, **contract) -> DataFrame:
    """The five dataset columns; ``validate=False`` lets release dates be missing."""
    rows = validate_targets(targets, **contract) if validate else targets
    return rows.select(
        F.col("release_date").alias("forecast_timestamp"),
        "target_id",
        F.col("reference_date").alias("target_reference_date"),
        F.col("release_date").alias("target_release_date"),
        "target_value",
    )


def normalize_targets(targets: DataFrame) -> DataFrame:
    """Targets or dataset rows as typed, checked dataset rows."""
    already_unique = set(TARGET_COLUMNS) <= set(targets.columns)
    if already_unique:
        targets = target_shell(targets)
    else:
        Q.require_columns(targets, DATASET_COLUMNS, "target dataset")
    typed = targets.select(
        S.moment(targets, "forecast_timestamp", strict=False).alias("forecast_timestamp"),
        "target_id",
        S.day(targets, "target_reference_date").alias("target_reference_date"),
        S.day(targets, "target_release_date", strict=False).alias("target_release_date"),
        S.number(targets, "target_value", strict=True).alias("target_value"),
    )
    checked = Q.guard(
        typed,
        (F.col("forecast_timestamp").isNull(), "forecast_timestamp cannot be missing."),
        (F.col("target_release_date").isNull(), "target_release_date cannot be missing."),
    )
    return checked if already_unique else Q.unique_by(checked, ["target_id", "target_reference_date"], "target")
