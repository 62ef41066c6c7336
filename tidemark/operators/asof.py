"""Point-in-time features: the latest value released by each forecast timestamp.

Release dates are calendar days, so what is known depends on the forecast *day* only.
The join therefore runs on a grid with one row per distinct forecast day: observations
shrink to one candidate per (series, release day), days and candidates of a series meet
in one window of at most two rows per calendar day, and the targets join the finished
grid by day. Neither the number of targets nor of observations per series widens any
window, and the grid's size is bounded by the calendar.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import quality as Q
from tidemark.functions import scalars as S
from tidemark.functions.ordered import timeline
from tidemark.operators.targets import filter_series, normalize_targets
from tidemark.schemas import DATASET_COLUMNS

DEFAULT_TIES = ("fetched_at", "value")


def normalize_feature_obs(
    observations: DataFrame,
    feature_series: Sequence[str] | None = None,
    strict: bool = True,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """Released observations of the wanted series; unreleased ones are an error if strict."""
    Q.require_columns(observations, ["series_id", "source", "date", "value", "release_date"], "observation")
    ties = tie_columns(observations, tie_break)
    chosen = filter_series(observations, feature_series)
    typed = chosen.select(
        "series_id",
        "source",
        S.day(chosen, "date").alias("date"),
        S.number(chosen, "value").alias("value"),
        S.day(chosen, "release_date").alias("release_date"),
        *[name for name in ties if name not in {"series_id", "source", "date", "value", "release_date"}],
    )
    if strict:
        return Q.guard(typed, (F.col("release_date").isNull(), "An observation has no release_date, which strict mode refuses."))
    return typed.where(F.col("release_date").isNotNull())


def tie_columns(observations: DataFrame, tie_break: Sequence[str] | None) -> list[str]:
    """Columns that order otherwise equal observations, in place of a row number."""
    if tie_break is None:
        return [name for name in DEFAULT_TIES if name in observations.columns]
    Q.require_columns(observations, tie_break, "tie-break")
    return list(tie_break)


def _rank(names: Sequence[str]):
    return F.struct(*[part.alias(f"r{i}") for i, part in enumerate(p for n in names for p in S.last_key(n))])


def latest_vintage(observations: DataFrame, keys: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Per key the last row by (release_date, date, source, ties), its value even if missing."""
    order = [n for n in ["release_date", "date", "source", *ties] if n not in keys]
    carried = [n for n in ["release_date", "date", "source", "value"] if n not in keys]
    return observations.groupBy(*keys).agg(F.max_by(F.struct(*carried), _rank(order)).alias("latest"))


def distinct_series(observations: DataFrame) -> DataFrame:
    return observations.where(F.col("series_id").isNotNull()).select("series_id").distinct()


def series_names(observations: DataFrame) -> list[str]:
    """The sorted series, as they become columns; refuses more than Spark lets a pivot have."""
    limit = int(observations.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    names = [row[0] for row in distinct_series(observations).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"More than {limit} series cannot all become columns; pass feature_series.")
    return sorted(names)


def asof_features(
    targets: DataFrame,
    observations: DataFrame,
    feature_series: Sequence[str] | None = None,
    strict: bool = True,
    tie_break: Sequence[str] | None = None,
    exclude_series: Sequence[str] = (),
    allow_exact: bool = True,
) -> DataFrame:
    """Dataset rows plus ``feature_<series>_latest`` for each series.

    By default a value released at the forecast timestamp itself counts, and without
    ``feature_series`` that includes the target's own series. ``allow_exact=False`` or
    ``exclude_series`` shut that out.
    """
    rows = normalize_targets(targets)
    ties = tie_columns(observations, tie_break)
    released = normalize_feature_obs(observations, feature_series, strict, ties)
    names = list(feature_series) if feature_series is not None else series_names(released)
    names = [name for name in names if name not in set(exclude_series)]
    if not names:
        return rows

    known_at = F.col("forecast_timestamp")
    if not allow_exact:
        known_at = known_at - F.expr("interval 1 microsecond")
    dated = rows.withColumn("_day", F.to_date(known_at))
    grid = day_grid(dated.select("_day"), released, names, ties)
    return dated.join(grid, "_day", "left").select(
        *DATASET_COLUMNS, *[F.col(f"`{_feature(name)}`") for name in names]
    )


def _feature(series_id: str) -> str:
    return f"feature_{series_id}_latest"


def day_grid(days: DataFrame, released: DataFrame, names: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """One row per distinct ``_day`` with the latest released value of each series."""
    candidates = latest_vintage(
        released.where(F.col("series_id").isin(list(names))), ["series_id", "release_date"], ties
    ).select(
        "series_id", F.col("release_date").alias("_day"), F.lit(0).alias("_probe"), F.struct("latest.value").alias("_known")
    )
    probes = days.distinct().select(
        F.explode(F.array(*[F.lit(name) for name in names])).alias("series_id"),
        "_day",
        F.lit(1).alias("_probe"),
        F.lit(None).cast("struct<value:double>").alias("_known"),
    )
    # Observations sort before probes of the same day, so release on the day counts.
    upto = Window.partitionBy("series_id").orderBy("_day", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        candidates.unionByName(probes)
        .withColumn("_known", F.last("_known", ignorenulls=True).over(upto))
        .where("_probe = 1")
    )
    grid = filled.groupBy("_day").pivot("series_id", list(names)).agg(F.first("_known.value"))
    return grid.withColumnsRenamed({name: _feature(name) for name in names})


def lagged_targets(
    dataset: DataFrame, lags: Sequence[int] = (1,), bounded: bool = False, rows_per_tile: int | None = None
) -> DataFrame:
    """Add ``feature_target_lag_<k>``: the target's value k rows earlier."""
    if any(lag < 1 for lag in lags):
        raise ValueError("Lags count rows back, from 1 on.")
    Q.require_columns(dataset, DATASET_COLUMNS, "feature dataset")
    if not lags:
        return dataset
    typed = dataset.withColumn("target_reference_date", S.day(dataset, "target_reference_date"))
    line = timeline(
        typed,
        ["target_id"],
        ["target_reference_date", "forecast_timestamp"],
        bounded=bounded,
        rows_per_tile=rows_per_tile,
    )
    return line.look_back(
        max(lags),
        lambda w: {f"feature_target_lag_{k}": F.lag("target_value", k).over(w) for k in lags},
    ).rows()
