"""Forecast errors, alignment with a benchmark and the metrics table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import quality as Q
from tidemark.functions import scalars as S
from tidemark.functions.ordered import timeline
from tidemark.schemas import ALIGNMENT_KEYS, METRICS_COLUMNS, NAIVE

LOOSE_KEYS = [*ALIGNMENT_KEYS, "target_release_date"]


# Aggregates over two columns of the same rows.


def mae(actual: Column, prediction: Column) -> Column:
    return F.avg(F.abs(actual - prediction))


def rmse(actual: Column, prediction: Column) -> Column:
    error = actual - prediction
    return F.sqrt(F.avg(error * error))


def level_direction(actual: Column, prediction: Column) -> Column:
    """Share of rows whose actual and prediction have the same sign (0 is its own)."""
    return F.avg((F.signum(actual) == F.signum(prediction)).cast("double"))


def score_levels(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mae, rmse and level direction per ``by``; no complete row is an error."""
    a, p = F.col("actual"), F.col("prediction")
    scored = rows.groupBy(*by).agg(
        mae(a, p).alias("mae"),
        rmse(a, p).alias("rmse"),
        level_direction(a, p).alias("level_direction"),
        F.count(a - p).alias("_n"),
    )
    return Q.guard(scored, (F.col("_n") == 0, "There is no pair of values to score.")).drop("_n")


def complete(forecasts: DataFrame) -> DataFrame:
    """Forecasts that have both an actual and a prediction."""
    Q.require_columns(forecasts, ["actual", "prediction"], "forecast")
    typed = forecasts.withColumns({name: S.number(forecasts, name) for name in ("actual", "prediction")})
    return typed.where(F.col("actual").isNotNull() & F.col("prediction").isNotNull())


def change_direction(forecasts: DataFrame, by: Sequence[str] = (), **sizing) -> DataFrame:
    """Complete forecasts with ``same_direction``: whether actual and prediction moved the
    same way since the previous row (missing for the first row)."""
    rows = complete(forecasts)
    order = [c for c in ALIGNMENT_KEYS if c in rows.columns and c not in by]

    def moves(w):
        step = {c: F.col(c) - F.lag(c).over(w) for c in ("actual", "prediction")}
        same = F.signum(step["actual"]) == F.signum(step["prediction"])
        # An infinite value less itself has no direction and matches nothing.
        lost = F.isnan(step["actual"]) | F.isnan(step["prediction"])
        return {"same_direction": F.when(lost, F.lit(False)).otherwise(same)}

    return timeline(rows, by, order, **sizing).look_back(1, moves).rows()


def evaluate_forecasts(forecasts: DataFrame, by: Sequence[str] = (), **sizing) -> DataFrame:
    """rmse, mae, change direction and row count per ``by`` (the whole frame by default)."""
    a, p = F.col("actual"), F.col("prediction")
    scored = (
        change_direction(forecasts, by, **sizing)
        .groupBy(*by)
        .agg(
            rmse(a, p).alias("rmse"),
            mae(a, p).alias("mae"),
            F.avg(F.col("same_direction").cast("double")).alias("directional_accuracy"),
            F.count(F.lit(1)).alias("n_forecasts"),
        )
    )
    return Q.guard(
        scored, (F.col("n_forecasts") == 0, "No forecast has both a prediction and an actual value.")
    )


def _both(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, names=("model", "naive")) -> DataFrame:
    """Join where missing keys match missing keys; shared columns get a suffix."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    l = left.withColumnsRenamed({c: f"{c}_{names[0]}" for c in shared})
    r = right.withColumnsRenamed({**{c: f"{c}_{names[1]}" for c in shared}, **{k: f"_r_{k}" for k in keys}})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return l.join(r, same, how)


def align_loose(model: DataFrame, naive: DataFrame) -> DataFrame:
    """Inner join on the four keys; duplicates multiply."""
    Q.require_columns(model, LOOSE_KEYS, "model forecast")
    Q.require_columns(naive, LOOSE_KEYS, "naive forecast")
    return _both(model, naive, LOOSE_KEYS, "inner").drop(*[f"_r_{k}" for k in LOOSE_KEYS])


def compare_to_naive(model: DataFrame, naive: DataFrame) -> DataFrame:
    """One row: both models' rmse and mae, the improvements and strict-less flags."""
    aligned = align_loose(model, naive)
    columns, counts = [], []
    for side in ("model", "naive"):
        a, p = (S.null_if_nan(F.col(f"{c}_{side}").cast("double")) for c in ("actual", "prediction"))
        columns += [rmse(a, p).alias(f"{side}_rmse"), mae(a, p).alias(f"{side}_mae")]
        counts.append(F.count(a - p).alias(f"_{side}"))
    scored = Q.guard(
        aligned.agg(*columns, *counts, F.count(F.lit(1)).alias("_rows")),
        (F.col("_rows") == 0, "Model and benchmark have no forecast in common."),
        (F.least("_model", "_naive") == 0, "No forecast has both a prediction and an actual value."),
    )
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return scored.select(
        "model_rmse",
        "naive_rmse",
        (F.col("naive_rmse") - F.col("model_rmse")).alias("rmse_improvement"),
        "model_mae",
        "naive_mae",
        (F.col("naive_mae") - F.col("model_mae")).alias("mae_improvement"),
        flag(F.col("model_rmse") < F.col("naive_rmse")).alias("model_beats_naive_rmse"),
        flag(F.col("model_mae") < F.col("naive_mae")).alias("model_beats_naive_mae"),
    )


def normalize_forecasts(forecasts: DataFrame, keys: Sequence[str] = ALIGNMENT_KEYS) -> DataFrame:
    """Typed alignment columns, each key at most once."""
    required = [*ALIGNMENT_KEYS, "target_release_date", "actual", "prediction"]
    Q.require_columns(forecasts, required, "forecast")
    typed = forecasts.withColumns(
        {
            "forecast_timestamp": S.moment(forecasts, "forecast_timestamp"),
            "target_reference_date": S.day(forecasts, "target_reference_date"),
            "target_release_date": S.day(forecasts, "target_release_date"),
            "actual": S.number(forecasts, "actual"),
            "prediction": S.number(forecasts, "prediction"),
        }
    )
    return Q.unique_by(typed, keys, "forecast alignment rows")


def key_set_diff(model: DataFrame, naive: DataFrame) -> DataFrame:
    """Alignment keys that only one side has, with ``missing_from``."""
    here, there = model.select(*ALIGNMENT_KEYS), naive.select(*ALIGNMENT_KEYS)
    return here.subtract(there).withColumn("missing_from", F.lit("naive")).unionByName(
        there.subtract(here).withColumn("missing_from", F.lit("model"))
    )


def align_strict(forecasts: DataFrame, naive: DataFrame, models: Sequence[str]) -> DataFrame:
    """Each model's forecasts beside the benchmark's, one to one on the three keys.

    A key on one side only, other release dates or other actual values are errors. One
    full outer join serves all models: the benchmark rows are repeated per model name.
    """
    keys = ["model_name", *ALIGNMENT_KEYS]
    model = normalize_forecasts(forecasts.where(F.col("model_name").isin(list(models))), keys)
    columns = [*ALIGNMENT_KEYS, "target_release_date", "actual", "prediction"]
    benchmark = normalize_forecasts(naive).select(
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model_name"), *columns
    )
    model = model.select("model_name", *columns).withColumn("_in_model", F.lit(True))
    joined = _both(model, benchmark.withColumn("_in_naive", F.lit(True)), keys, "full_outer")
    checked = Q.guard(
        joined,
        (
            F.col("_in_model").isNull(),
            F.concat(F.lit("Missing from model: "), F.to_json(F.struct(*[F.col(f"_r_{k}").alias(k) for k in keys]))),
        ),
        (F.col("_in_naive").isNull(), F.concat(F.lit("Missing from naive: "), Q.shown(*keys))),
        (
            ~F.coalesce(F.col("target_release_date_model") == F.col("target_release_date_naive"), F.lit(False)),
            F.concat(F.lit("Forecast target_release_date mismatch: "), Q.shown(*keys)),
        ),
        (
            ~S.close(F.col("actual_model"), F.col("actual_naive")),
            F.concat(F.lit("Forecast actual values do not match: "), Q.shown(*keys)),
        ),
    )
    return checked.drop("_in_model", "_in_naive", *[f"_r_{k}" for k in keys])


def metrics_table(
    forecasts: DataFrame, naive: DataFrame, models: Sequence[str], rows_per_tile: int | None = None
) -> DataFrame:
    """The nine metric columns per model; improvements are benchmark minus model."""
    aligned = align_strict(forecasts, naive, models)
    columns = {}
    for side in ("model", "naive"):
        both = F.col(f"actual_{side}").isNotNull() & F.col(f"prediction_{side}").isNotNull()
        columns[f"_has_{side}"] = both
    rows = aligned.withColumns(columns)

    # Only complete model rows count as neighbours, so the others go to a line of their own.
    def moves(w):
        step = {c: F.col(f"{c}_model") - F.lag(f"{c}_model").over(w) for c in ("actual", "prediction")}
        same = F.signum(step["actual"]) == F.signum(step["prediction"])
        lost = F.isnan(step["actual"]) | F.isnan(step["prediction"])
        return {"_same": F.when(F.col("_has_model"), F.when(lost, F.lit(False)).otherwise(same))}

    line = timeline(rows, ["model_name", "_has_model"], ALIGNMENT_KEYS, rows_per_tile=rows_per_tile)
    scored_rows = line.look_back(1, moves).rows()
    a, p = F.col("actual_model"), F.col("prediction_model")
    na, np_ = F.col("actual_naive"), F.col("prediction_naive")
    scored = Q.guard(
        scored_rows.groupBy("model_name").agg(
            F.count_if("_has_model").alias("n_forecasts"),
            rmse(a, p).alias("rmse"),
            mae(a, p).alias("mae"),
            F.avg(F.col("_same").cast("double")).alias("directional_accuracy"),
            rmse(na, np_).alias("_naive_rmse"),
            mae(na, np_).alias("_naive_mae"),
            F.count_if("_has_naive").alias("_naive_n"),
        ),
        (
            F.least("n_forecasts", "_naive_n") == 0,
            "No forecast has both a prediction and an actual value.",
        ),
    )
    benchmark = F.col("model_name") == NAIVE
    zero = lambda c: F.when(benchmark, F.lit(0.0)).otherwise(c)
    return scored.select(
        "model_name",
        "n_forecasts",
        "rmse",
        "mae",
        "directional_accuracy",
        zero((F.col("rmse") < F.col("_naive_rmse")).cast("double")).alias("beats_naive_rmse"),
        zero((F.col("mae") < F.col("_naive_mae")).cast("double")).alias("beats_naive_mae"),
        zero(F.col("_naive_rmse") - F.col("rmse")).alias("rmse_vs_naive"),
        zero(F.col("_naive_mae") - F.col("mae")).alias("mae_vs_naive"),
    ).select(*METRICS_COLUMNS)
