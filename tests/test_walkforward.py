from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from helpers import breaks, rows
from pyspark.sql import functions as F

from tidemark.functions.expanding import exclusive_median, expanding_median
from tidemark.functions.ordered import timeline
from tidemark.operators import walkforward as W
from tidemark.operators.comparison import compare_models, walk_forward
from tidemark.operators.supervised import fit_predict_boosted, fit_predict_ridge, supervised_guard
from tidemark.session import stage

FEATURES = ["feature_x", "feature_y", "feature_z"]


def monthly(n, target="t", **features):
    start = pd.Timestamp("2026-01-01")
    days = [start + pd.DateOffset(months=i) for i in range(n)]
    frame = pd.DataFrame(
        {
            "forecast_timestamp": days,
            "target_id": target,
            "target_reference_date": [t.date() for t in days],
            "target_release_date": [t.date() for t in days],
            "target_value": np.arange(n, dtype=float),
        }
    )
    return frame.assign(**features)


def to_spark(spark, pdf):
    names = [c for c in pdf.columns if c.startswith("feature_")]
    return spark.createDataFrame(pdf).withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in names})


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(0)
    n = 240
    days = pd.date_range("2000-01-01", periods=n)
    pdf = pd.DataFrame(
        {
            "forecast_timestamp": days,
            "target_id": rng.choice(["a", "b"], n, p=[0.7, 0.3]),
            "target_reference_date": (days - pd.Timedelta(days=20)).date,
            "target_release_date": days.date,
            "target_value": rng.normal(size=n),
            "feature_x": np.where(rng.random(n) < 0.3, np.nan, np.cumsum(rng.normal(size=n))),
            "feature_y": np.round(rng.normal(size=n)),
            "feature_z": np.where(np.arange(n) < 90, np.nan, rng.normal(size=n) + 50),
        }
    )
    return pdf, stage(to_spark(spark, pdf))


def direct_ridge(pdf, min_train):
    """Every fold fitted from scratch with NumPy."""
    pdf = pdf.sort_values("forecast_timestamp").reset_index(drop=True)
    out = []
    for i in range(min_train, len(pdf)):
        train = pdf.iloc[:i]
        used = [f for f in FEATURES if train[f].notna().any()]
        medians = train[used].median()
        x = train[used].fillna(medians).to_numpy()
        tested = pdf.loc[i, used].astype(float).fillna(medians).to_numpy()
        y = train["target_value"].to_numpy()
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd[sd < 1e-9] = 1.0
        z = (x - mean) / sd
        z[:, x.std(axis=0) < 1e-9] = 0.0
        w = np.linalg.solve(z.T @ z + np.eye(len(used)), z.T @ (y - y.mean()))
        out.append((pdf.loc[i, "forecast_timestamp"], y.mean() + ((tested - mean) / sd) @ w))
    return pd.DataFrame(out, columns=["forecast_timestamp", "direct"])


def test_fold_counts_and_naive(spark):
    frame = to_spark(spark, monthly(8, feature_x=np.arange(8.0)))
    made = rows(W.walk_forward_naive(frame, 3).select("fold_number", "actual", "prediction"), "fold_number")
    assert made == [(k, 2.0 + k, 1.0 + k) for k in range(1, 6)]
    assert W.walk_forward_ridge(frame, 3).count() == 5
    assert [r[0] for r in rows(W.naive_predictions(frame).select("prediction", "target_value"), "target_value")][:2] == [None, 0.0]


def test_errors(spark):
    frame = to_spark(spark, monthly(4, feature_x=np.arange(4.0)))
    breaks(lambda: W.walk_forward_naive(frame, 0), "at least 1")
    breaks(lambda: W.walk_forward_naive(frame, 4), "nothing to forecast")
    breaks(lambda: walk_forward(frame, "oracle"), "No model is called")
    breaks(lambda: W.walk_forward_ridge(frame.drop("feature_x"), 2), "No feature columns")
    breaks(lambda: W.walk_forward_ridge(frame, 2, ["feature_none"]), "Unknown feature columns")
    breaks(lambda: W.walk_forward_ridge(frame, 1), "two training rows")
    breaks(lambda: W.walk_forward_naive(frame.drop("target_id"), 2), "Missing required")
    empty = frame.withColumn("feature_x", F.lit(None).cast("double"))
    breaks(lambda: W.walk_forward_ridge(empty, 2), "No usable feature columns")
    breaks(lambda: W.usable_features(empty, 2), "No usable feature columns")


def test_rows_without_target_are_dropped_with_a_warning(spark):
    frame = to_spark(spark, monthly(6)).withColumn(
        "target_value", F.when(F.col("target_value") != 2.0, F.col("target_value"))
    )
    with pytest.warns(RuntimeWarning, match="Dropping 1 rows"):
        made = W.walk_forward_naive(frame, 3)
    assert made.count() == 2


def test_all_missing_training_feature_is_left_out_of_that_fold(spark):
    late = [None] * 5 + [1.0, 2.0, 3.0]
    frame = to_spark(spark, monthly(8, feature_x=np.arange(8.0), feature_late=late))
    used = rows(W.usable_features(frame, 3).select("fold_number", "usable_features"), "fold_number")
    assert used[0][1] == ["feature_x"] and used[-1][1] == ["feature_x", "feature_late"]
    only_x = rows(W.walk_forward_ridge(frame, 3, ["feature_x"]).select("fold_number", "prediction"), "fold_number")
    both = rows(W.walk_forward_ridge(frame, 3).select("fold_number", "prediction"), "fold_number")
    assert np.allclose([r[1] for r in both[:3]], [r[1] for r in only_x[:3]])


@pytest.mark.parametrize("rows_per_tile", [None, 40])
def test_ridge_equals_direct_fits(noisy, rows_per_tile):
    pdf, frame = noisy
    made = W.walk_forward_ridge(frame, 24, by=(), rows_per_tile=rows_per_tile).toPandas()
    both = made.merge(direct_ridge(pdf, 24), on="forecast_timestamp")
    assert len(both) == len(pdf) - 24
    assert np.abs(both["prediction"] - both["direct"]).max() < 1e-9

    made = W.walk_forward_ridge(frame, 24, rows_per_tile=rows_per_tile).toPandas()
    for name in ("a", "b"):
        both = made[made["target_id"] == name].merge(direct_ridge(pdf[pdf["target_id"] == name], 24), on="forecast_timestamp")
        assert len(both) == (pdf["target_id"] == name).sum() - 24
        assert np.abs(both["prediction"] - both["direct"]).max() < 1e-9


def test_moments_and_naive_on_tiles(noisy):
    _, frame = noisy
    for by in ((), ("target_id",)):
        keys = ["target_id", "target_reference_date"]
        plain = W.expanding_moments(frame, FEATURES, 24, by=by).toPandas().sort_values([*keys, "column_name"])
        split = W.expanding_moments(frame, FEATURES, 24, by=by, rows_per_tile=30).toPandas().sort_values([*keys, "column_name"])
        assert np.array_equal(plain["train_median"], split["train_median"], equal_nan=True)
        for c in ("train_count", "train_mean", "train_std"):
            assert np.allclose(plain[c], split[c], equal_nan=True)
        naive = [W.walk_forward_naive(frame, 24, by=by, rows_per_tile=n) for n in (None, 30)]
        assert rows(naive[0], *keys) == rows(naive[1], *keys)


def test_medians_on_two_hundred_tiles(spark):
    """Trends, few distinct values, gaps, infinities and a column of one value, on tiles of 10 rows."""
    rng = np.random.default_rng(4)
    n = 2000
    pdf = pd.DataFrame(
        {
            "g": np.where(np.arange(n) % 4 == 0, "b", "a"),
            "t": np.arange(n),
            "trend": np.arange(n) + rng.normal(0, 30, n),
            "few": rng.integers(0, 3, n).astype(float),
            "gaps": np.where(rng.random(n) < 0.7, np.nan, rng.normal(0, 1, n)),
            "late": np.where(np.arange(n) < 1500, np.nan, 7.0),
            "none": np.full(n, np.nan),
        }
    )
    names = list(pdf.columns[2:])
    cells = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in names]
    frame = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).select("g", "t", *cells)
    for by in ([], ["g"]):
        line = timeline(frame, by, ["t"], rows_per_tile=10).number("row")
        assert line.split and line.frame.select("_tile").distinct().count() > 150
        made = expanding_median(line, {c: f"m_{c}" for c in names}, "row").frame.toPandas().sort_values("t")
        groups = pdf.groupby("g") if by else [("", pdf)]
        for _, part in groups:
            mine = made[made["t"].isin(part["t"])]
            for c in names:
                assert np.array_equal(exclusive_median(part[c].to_numpy()), mine[f"m_{c}"].to_numpy(float), equal_nan=True), c


def test_later_rows_do_not_change_earlier_forecasts(noisy):
    _, frame = noisy
    cut = datetime(2000, 6, 1)
    early = F.col("forecast_timestamp") < F.lit(cut)
    changed = frame.withColumn("target_value", F.when(early, F.col("target_value")).otherwise(F.lit(99.0)))
    changed = changed.withColumn("feature_x", F.when(early, F.col("feature_x")).otherwise(F.lit(-99.0)))
    for model in (W.walk_forward_naive, W.walk_forward_ridge):
        keys = ["target_id", "target_reference_date"]
        assert rows(model(frame, 24).where(early), *keys) == rows(model(changed, 24).where(early), *keys)


def test_single_split_ridge_equals_walk_forward(noisy):
    pdf, frame = noisy
    one = pdf[pdf["target_id"] == "a"].sort_values("forecast_timestamp")
    edge = one["forecast_timestamp"].iloc[60]
    mine = frame.where("target_id = 'a'")
    at = F.col("forecast_timestamp")
    made = fit_predict_ridge(mine.where(at < edge), mine.where(at == edge), FEATURES).first()["prediction"]
    walked = W.walk_forward_ridge(mine, 24).where(at == edge).first()["prediction"]
    assert abs(made - walked) < 1e-9


def test_supervised_guard(spark):
    frame = to_spark(spark, monthly(4, feature_x=np.arange(4.0)))
    assert supervised_guard(frame, frame, ["feature_x"]).count() == 4
    breaks(lambda: supervised_guard(frame, frame, []), "nothing to learn")
    breaks(lambda: supervised_guard(frame, frame.drop("feature_x"), ["feature_x"]), "test data lacks")
    breaks(lambda: supervised_guard(frame.drop("target_value"), frame, ["feature_x"]), "training data lacks")
    breaks(lambda: supervised_guard(frame.limit(1), frame, ["feature_x"]), "nothing to learn from 1 rows")
    gone = frame.withColumn("feature_x", F.lit(None).cast("double"))
    breaks(lambda: supervised_guard(gone, frame, ["feature_x"]), "nothing to learn")


def test_boosted_trees(noisy):
    _, frame = noisy
    fast = {"rounds": 3, "leaves": 4}
    made = walk_forward(frame, "boosted_trees", 24, refit_every=100, **fast).cache()
    naive = W.walk_forward_naive(frame, 24)
    keys = ["target_id", "target_reference_date", "fold_number"]
    assert rows(made.select(*keys), *keys) == rows(naive.select(*keys), *keys)
    again = walk_forward(frame, "lightgbm", 24, refit_every=100, **fast)
    assert rows(again.select(*keys, "prediction"), *keys) == rows(made.select(*keys, "prediction"), *keys)
    assert again.first()["model_name"] == "boosted_trees"
    # Rows after the first refit block cannot reach back into it.
    edge = made.agg(F.min("forecast_timestamp")).first()[0]
    later = F.col("forecast_timestamp") > F.lit(edge)
    changed = frame.withColumn("target_value", F.when(later, 99.0).otherwise(F.col("target_value")))
    first = walk_forward(changed, "boosted_trees", 24, refit_every=100, **fast)
    at_edge = F.col("forecast_timestamp") == F.lit(edge)
    assert first.where(at_edge).first()["prediction"] == made.where(at_edge).first()["prediction"]
    split = F.col("forecast_timestamp") < "2000-06-01"
    assert fit_predict_boosted(frame.where(split), frame.where(~split), FEATURES, **fast).where("prediction is null").count() == 0


def test_compare_models(noisy):
    _, frame = noisy
    breaks(lambda: compare_models(frame, []), "choose one or more of")
    breaks(lambda: compare_models(frame, ["oracle"]), "choose one or more of")
    forecasts, table = compare_models(frame, ["ridge", "ridge"], 24)
    assert [r.model_name for r in table.collect()] == ["ridge"]
    assert {r.model_name for r in forecasts.select("model_name").distinct().collect()} == {"ridge"}
    _, both = compare_models(frame, ["naive_last_value", "ridge"], 24)
    scored = {r.model_name: r for r in both.collect()}
    assert scored["naive_last_value"].rmse_vs_naive == 0.0
    gain = scored["naive_last_value"].rmse - scored["ridge"].rmse
    assert abs(scored["ridge"].rmse_vs_naive - gain) < 1e-12 and scored["ridge"].beats_naive_rmse == float(gain > 0)
