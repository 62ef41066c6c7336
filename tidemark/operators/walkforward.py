"""Expanding-window forecasts: every forecast uses only rows before its own.

Rows are ordered by forecast timestamp within ``by`` (one timeline per target by default;
``by=()`` puts all targets on one timeline). The first ``min_train_size`` rows of a
timeline only train; each later row is one fold.
"""

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import quality as Q
from tidemark.functions import scalars as S
from tidemark.functions.expanding import expanding_median, exclusive_median
from tidemark.functions.ordered import TILE, Timeline, measure, settled, timeline, warn_dropped
from tidemark.schemas import DATASET_COLUMNS, FORECAST_COLUMNS, FORECASTS, NAIVE, feature_columns
from tidemark.session import stage

ORDER = ("forecast_timestamp", "target_id", "target_reference_date")
ROW = "_row"


@dataclass(frozen=True)
class Walk:
    """A numbered timeline of dataset rows and how many rows only train."""

    line: Timeline
    min_train_size: int

    @property
    def fold(self) -> Column:
        return F.col(ROW) - F.lit(self.min_train_size)

    def staged(self) -> "Walk":
        """This walk with its numbered rows written once, for several models to read."""
        return replace(self, line=replace(self.line, frame=stage(self.line.frame)))

    def forecasts(self, frame: DataFrame, prediction: Column, model_name: str) -> DataFrame:
        return frame.where(self.fold >= 1).select(
            *DATASET_COLUMNS[:4],
            F.col("target_value").alias("actual"),
            prediction.alias("prediction"),
            F.lit(model_name).alias("model_name"),
            self.fold.alias("fold_number"),
        )


def prepare_dataset(dataset: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """Dataset columns and ``features``, typed; rows without a target value stay for now."""
    Q.require_columns(dataset, DATASET_COLUMNS, "dataset")
    return dataset.select(
        S.moment(dataset, "forecast_timestamp").alias("forecast_timestamp"),
        "target_id",
        S.day(dataset, "target_reference_date").alias("target_reference_date"),
        S.day(dataset, "target_release_date").alias("target_release_date"),
        S.number(dataset, "target_value").alias("target_value"),
        *[S.number(dataset, name).alias(name) for name in features],
    )


def open_walk(
    dataset: DataFrame,
    min_train_size: int = 24,
    by: Sequence[str] = ("target_id",),
    features: Sequence[str] = (),
    rows_per_tile: int | None = None,
) -> Walk:
    """Order and number the rows. One job measures the timelines; it also finds rows
    without a target (dropped with a warning) and too short inputs (an error)."""
    if min_train_size < 1:
        raise ValueError("min_train_size must be at least 1.")
    typed = settled(prepare_dataset(dataset, features))
    sizes = measure(typed, by, "target_value")
    warn_dropped(sizes, "target_value")
    if sizes.largest_group <= min_train_size:
        raise ValueError(
            f"The longest timeline has {sizes.largest_group} rows with a target, which leaves nothing to "
            f"forecast after min_train_size={min_train_size}."
        )
    rows = typed.where(F.col("target_value").isNotNull())
    line = timeline(rows, by, ORDER, sizes=sizes, rows_per_tile=rows_per_tile)
    return Walk(line.number(ROW), min_train_size)


def fold_numbers(dataset: DataFrame, min_train_size: int = 24, by: Sequence[str] = ("target_id",)) -> DataFrame:
    """The dataset rows that are forecast, with their 1-based fold number."""
    walk = open_walk(dataset, min_train_size, by)
    return walk.line.rows().where(walk.fold >= 1).select(*DATASET_COLUMNS, walk.fold.alias("fold_number"))


def naive_predictions(dataset: DataFrame, by: Sequence[str] = ("target_id",), **sizing) -> DataFrame:
    """Every row with the previous target value as ``prediction`` (missing for the first)."""
    Q.require_columns(dataset, ["forecast_timestamp", "target_value"], "dataset")
    line = timeline(dataset, by, [c for c in ORDER if c in dataset.columns], **sizing)
    return line.look_back(1, lambda w: {"prediction": F.lag("target_value").over(w)}).rows()


def walk_forward_naive(
    dataset: DataFrame,
    min_train_size: int = 24,
    by: Sequence[str] = ("target_id",),
    model_name: str = NAIVE,
    rows_per_tile: int | None = None,
) -> DataFrame:
    """Forecast each row with the previous target value."""
    return naive_over(open_walk(dataset, min_train_size, by, rows_per_tile=rows_per_tile), model_name)


def naive_over(walk: Walk, model_name: str = NAIVE) -> DataFrame:
    """The last-value forecasts of an opened walk."""
    line = walk.line.look_back(1, lambda w: {"_previous": F.lag("target_value").over(w)})
    return walk.forecasts(line.frame, F.col("_previous"), model_name)


def expanding_moments(
    dataset: DataFrame,
    columns: Sequence[str],
    min_train_size: int = 24,
    by: Sequence[str] = ("target_id",),
    rows_per_tile: int | None = None,
) -> DataFrame:
    """Per fold and column: training count, mean, population deviation and median."""
    walk = open_walk(dataset, min_train_size, by, columns, rows_per_tile)
    line = expanding_median(walk.line, {name: f"_median_{name}" for name in columns}, ROW)
    # Sums of distances from the first value, so that large levels do not cancel.
    line = line.first_known({name: f"_o_{name}" for name in columns})
    sums = {}
    for name in columns:
        apart = F.coalesce(F.col(name) - F.col(f"_o_{name}"), F.lit(0.0))
        sums[f"_n_{name}"] = F.when(F.col(name).isNotNull(), 1).otherwise(0).cast("long")
        sums[f"_s_{name}"] = apart
        sums[f"_q_{name}"] = apart * apart
    line = line.running(sums)
    cells = []
    for name in columns:
        n = F.col(f"_n_{name}")
        offset = F.try_divide(F.col(f"_s_{name}"), n)
        mean = offset + F.col(f"_o_{name}")
        variance = F.greatest(F.try_divide(F.col(f"_q_{name}"), n) - offset * offset, F.lit(0.0))
        cells.append(
            F.struct(
                F.lit(name).alias("column_name"),
                n.alias("train_count"),
                mean.alias("train_mean"),
                F.sqrt(variance).alias("train_std"),
                F.col(f"_median_{name}").alias("train_median"),
            )
        )
    keys = [*DATASET_COLUMNS[:3], walk.fold.alias("fold_number")]
    folds = line.frame.where(walk.fold >= 1).select(*keys, F.explode(F.array(*cells)).alias("c"))
    return folds.select(*DATASET_COLUMNS[:3], "fold_number", "c.*")


def usable_features(
    dataset: DataFrame,
    min_train_size: int = 24,
    features: Sequence[str] | None = None,
    by: Sequence[str] = ("target_id",),
) -> DataFrame:
    """Per fold the features with at least one training value; a fold without any fails."""
    names = feature_columns(dataset, features)
    walk = open_walk(dataset, min_train_size, by, names)
    line = walk.line.running({f"_n{i}": F.when(F.col(n).isNotNull(), 1).otherwise(0) for i, n in enumerate(names)})
    kept = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") > 0, F.lit(n)) for i, n in enumerate(names)]))
    folds = line.frame.where(walk.fold >= 1).select(
        *DATASET_COLUMNS[:3], walk.fold.alias("fold_number"), kept.alias("usable_features")
    )
    return Q.guard(folds, (F.size("usable_features") == 0, "No usable feature columns remain for a fold."))


def walk_forward_ridge(
    dataset: DataFrame,
    min_train_size: int = 24,
    features: Sequence[str] | None = None,
    by: Sequence[str] = ("target_id",),
    alpha: float = 1.0,
    model_name: str = "ridge",
    rows_per_tile: int | None = None,
) -> DataFrame:
    """Ridge regression refitted for every fold, without copying training rows.

    A fold's fit needs sums over its training rows only, so each tile computes them as
    cumulative sums. Missing values are imputed with the fold's median by adding
    ``median * (sums over the missing mask)``; standardizing is a rescaling of the same
    sums. Features without a training value get weight zero.
    """
    names = feature_columns(dataset, features)
    return ridge_over(open_walk(dataset, min_train_size, by, names, rows_per_tile), names, alpha, model_name)


def ridge_over(walk: Walk, names: Sequence[str], alpha: float = 1.0, model_name: str = "ridge") -> DataFrame:
    """The ridge forecasts of an opened walk."""
    min_train_size = walk.min_train_size
    if min_train_size < 2:
        raise ValueError("Ridge requires at least two training rows with targets.")
    line = walk.line
    medians = [f"_m{i}" for i in range(len(names))]
    if line.split:
        line = expanding_median(line, dict(zip(names, medians)), ROW)
    columns = [*line.keys, *DATASET_COLUMNS, *names, ROW, *(medians if line.split else [])]
    rows = line.frame.select(*dict.fromkeys(columns))
    solve = _RidgeFolds(names, medians if line.split else None, min_train_size, alpha, model_name)
    if not line.split:
        return rows.groupBy(*line.keys).applyInPandas(lambda pdf: solve.whole_group(pdf), FORECASTS)
    tiles = rows.groupBy(*line.keys)
    carried = _carried_sums(line, rows, solve).groupBy(*line.keys)
    return tiles.cogroup(carried).applyInPandas(lambda pdf, sums: solve.one_tile(pdf, sums), FORECASTS)


def _carried_sums(line: Timeline, rows: DataFrame, solve: "_RidgeFolds") -> DataFrame:
    """Per tile the sums over all earlier tiles of its group, and the group's shift."""
    names = ["target_value", *solve.names]
    origins = {name: f"_o{i}" for i, name in enumerate(names)}
    shifted = replace(line, frame=rows, order=(ROW,)).first_known(origins).frame
    shifted = shifted.withColumn("_shift", F.array(*origins.values())).drop(*origins.values())
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in line.keys)
    totals = shifted.groupBy(*line.keys).applyInPandas(
        solve.tile_totals(line.keys), f"{key_fields}, _shift array<double>, _sums array<double>"
    )
    cells = totals.select(*line.keys, "_shift", F.posexplode("_sums").alias("_i", "_v"))
    before = Window.partitionBy(*line.by, "_i").orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    prefix = cells.withColumn("_v", F.coalesce(F.sum("_v").over(before), F.lit(0.0)))
    packed = prefix.groupBy(*line.keys).agg(
        F.any_value("_shift").alias("_shift"), F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_c")
    )
    return packed.select(*line.keys, "_shift", F.col("_c._v").alias("_sums"))


class _RidgeFolds:
    """Per-task helper: cumulative sums of one tile and a batched p-by-p solve."""

    def __init__(self, names, medians, min_train_size, alpha, model_name):
        self.names, self.medians = list(names), medians
        self.min_train_size, self.alpha, self.model_name = min_train_size, alpha, model_name

    def _centred(self, pdf, shift):
        y = pdf["target_value"].to_numpy(float) - shift[0]
        x = pdf[self.names].to_numpy(float)
        if np.isinf(x).any() or np.isinf(y).any():
            raise ValueError("Ridge targets and features must be finite or missing.")
        mask = np.isnan(x)
        return y, np.where(mask, 0.0, x - shift[1:]), mask.astype(float)

    @staticmethod
    def _products(y, x, m):
        """Row contributions: columns y, x, m, xy, my and outer products xx, xm, mm."""
        n, p = x.shape
        outer = lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(n, p * p)
        return np.hstack([y[:, None], x, m, x * y[:, None], m * y[:, None], outer(x, x), outer(x, m), outer(m, m)])

    def _shift(self, pdf):
        columns = pdf[["target_value", *self.names]].to_numpy(float)
        known = ~np.isnan(columns)
        first = known.argmax(axis=0)
        return np.where(known.any(axis=0), columns[first, np.arange(columns.shape[1])], 0.0)

    def tile_totals(self, keys):
        def totals(pdf):
            shift = np.nan_to_num(np.asarray(pdf["_shift"].iloc[0], dtype=float))
            sums = self._products(*self._centred(pdf, shift)).sum(axis=0)
            return pd.DataFrame([[*pdf[keys].iloc[0], shift, sums]], columns=[*keys, "_shift", "_sums"])

        return totals

    def whole_group(self, pdf):
        pdf = pdf.sort_values(ROW)
        width = 1 + 4 * len(self.names) + 3 * len(self.names) ** 2
        return self._forecast(pdf, self._shift(pdf), np.zeros(width))

    def one_tile(self, pdf, carried):
        if pdf.empty:
            return pd.DataFrame(columns=FORECAST_COLUMNS)
        shift = np.asarray(carried["_shift"].iloc[0], dtype=float)
        return self._forecast(pdf.sort_values(ROW), shift, np.asarray(carried["_sums"].iloc[0], dtype=float))

    def _forecast(self, pdf, shift, sums):
        y, x, m = self._centred(pdf, shift)
        if self.medians is None:
            medians = np.column_stack([exclusive_median(pdf[n].to_numpy(float)) for n in self.names])
        else:
            medians = pdf[self.medians].to_numpy(float)
        centres = np.nan_to_num(medians - shift[1:])
        trained = pdf[ROW].to_numpy() - 1
        predictions = np.empty(len(pdf))
        step = max(1, 2_000_000 // (3 * x.shape[1] ** 2 + 1))
        for a in range(0, len(pdf), step):
            part = slice(a, a + step)
            rows = self._products(y[part], x[part], m[part])
            # Sums before each row: a row's own values never enter its forecast, not even to be taken off again.
            upto = np.cumsum(np.vstack([sums, rows]), axis=0)
            predictions[part] = self._solve(upto[:-1], trained[part], x[part], m[part], centres[part])
            sums = upto[-1]
        folds = trained >= self.min_train_size
        out = pdf[DATASET_COLUMNS].rename(columns={"target_value": "actual"})
        out["prediction"] = predictions + shift[0]
        out["model_name"] = self.model_name
        out["fold_number"] = trained - self.min_train_size + 1
        return out.loc[folds, FORECAST_COLUMNS]

    def _solve(self, sums, n, x, m, mu):
        p = x.shape[1]
        cut = np.cumsum([1, p, p, p, p, p * p, p * p, p * p])[:-1]
        sy, sx, sm, sxy, smy, xx, xm, mm = np.split(sums, cut, axis=1)
        folds = n >= self.min_train_size
        if (folds & (sm >= n[:, None]).all(axis=1)).any():
            raise ValueError("No usable feature columns remain for a fold.")
        n = np.maximum(n, 1).astype(float)[:, None]
        square = lambda a: a.reshape(-1, p, p)
        left, right = mu[:, :, None], mu[:, None, :]
        zz = square(xx) + right * square(xm) + left * square(xm).transpose(0, 2, 1) + left * right * square(mm)
        mean = (sx + mu * sm) / n
        second = zz / n[:, :, None]
        cov = second - mean[:, :, None] * mean[:, None, :]
        var = np.einsum("kii->ki", cov)
        flat = var <= 8 * np.finfo(float).eps * np.einsum("kii->ki", second)
        scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var)))
        lhs = n[:, :, None] * cov / (scale[:, :, None] * scale[:, None, :])
        off = flat[:, :, None] | flat[:, None, :]
        lhs = np.where(off, 0.0, lhs) + self.alpha * np.eye(p)
        rhs = np.where(flat, 0.0, (sxy + mu * smy - mean * sy) / scale)
        weights = np.linalg.solve(lhs, rhs[:, :, None])[:, :, 0]
        tested = x + mu * m
        return sy[:, 0] / n[:, 0] + (weights * (tested - mean) / scale).sum(axis=1)
