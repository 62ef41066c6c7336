import math

import pytest
from helpers import breaks, d, rows, ts
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import summaries as R
from tidemark.schemas import FORECASTS, METRICS, NAIVE


def forecasts(spark, actual, predicted, model="m", target="t"):
    data = [
        (ts(f"2026-{i + 1:02d}-10"), target, d(f"2026-{i + 1:02d}-01"), d(f"2026-{i + 1:02d}-10"), a, p, model, i + 1)
        for i, (a, p) in enumerate(zip(actual, predicted))
    ]
    return spark.createDataFrame(data, FORECASTS)


def test_evaluate(spark):
    row = M.evaluate_forecasts(forecasts(spark, [1.0, 2.0, 4.0], [1.0, 1.0, 5.0])).first()
    assert math.isclose(row.rmse, math.sqrt(2 / 3)) and math.isclose(row.mae, 2 / 3)
    assert row.n_forecasts == 3 and row.directional_accuracy == 0.5


def test_evaluate_drops_incomplete_rows_and_needs_one(spark):
    row = M.evaluate_forecasts(forecasts(spark, [1.0, 2.0, None, 4.0], [1.0, None, 3.0, 5.0])).first()
    assert row.n_forecasts == 2 and row.directional_accuracy == 1.0
    one = M.evaluate_forecasts(forecasts(spark, [1.0], [float("nan")]).unionByName(forecasts(spark, [1.0], [2.0]))).first()
    assert one.n_forecasts == 1 and one.directional_accuracy is None
    breaks(lambda: M.evaluate_forecasts(forecasts(spark, [None], [1.0])), "No forecast has both")
    breaks(lambda: M.evaluate_forecasts(forecasts(spark, [1.0], [1.0]).drop("actual")), "Missing required")


def test_infinite_steps_match_nothing(spark):
    inf = float("inf")
    row = M.change_direction(forecasts(spark, [inf, inf], [1.0, 2.0])).orderBy("forecast_timestamp").collect()
    assert [r.same_direction for r in row] == [None, False]


def test_level_metrics(spark):
    row = M.score_levels(forecasts(spark, [1.0, -2.0, 3.0], [1.5, -1.0, -2.0])).first()
    assert round(row.mae, 4) == 2.1667 and round(row.rmse, 4) == 2.9580 and math.isclose(row.level_direction, 2 / 3)
    breaks(lambda: M.score_levels(forecasts(spark, [], [])), "no pair of values")


def test_compare_to_naive(spark):
    model = forecasts(spark, [1.0, 2.0, 4.0], [1.0, 2.0, 4.0])
    naive = forecasts(spark, [1.0, 2.0, 4.0], [0.0, 1.0, 2.0], NAIVE)
    row = M.compare_to_naive(model, naive).first()
    assert row.model_rmse == 0.0 and row.rmse_improvement == row.naive_rmse
    assert (row.model_beats_naive_rmse, row.model_beats_naive_mae) == (1.0, 1.0)
    breaks(lambda: M.compare_to_naive(model, naive.limit(0)), "no forecast in common")
    breaks(lambda: M.compare_to_naive(model.drop("target_id"), naive), "Missing required")


def test_loose_alignment_multiplies_and_matches_missing_keys(spark):
    model = forecasts(spark, [1.0], [1.0])
    twice = model.unionByName(model)
    assert M.align_loose(twice, twice).count() == 4
    gone = model.withColumn("target_id", F.lit(None).cast("string"))
    assert M.align_loose(gone, gone).count() == 1


def pair(spark):
    model = forecasts(spark, [1.0, 2.0, 4.0], [1.0, 2.0, 4.0])
    return model, forecasts(spark, [1.0, 2.0, 4.0], [0.0, 1.0, 2.0], NAIVE)


def test_strict_alignment(spark):
    model, naive = pair(spark)
    assert M.align_strict(model, naive, ["m"]).count() == 3
    near = naive.withColumn("actual", F.col("actual") * (1 + 1e-7))
    assert M.align_strict(model, near, ["m"]).count() == 3
    short = naive.where("fold_number < 3")
    breaks(lambda: M.align_strict(model, short, ["m"]), "Missing from naive")
    breaks(lambda: M.align_strict(model.where("fold_number < 3"), naive, ["m"]), "Missing from model")
    breaks(lambda: M.align_strict(model.unionByName(model.limit(1)), naive, ["m"]), "Duplicate forecast alignment")
    breaks(lambda: M.align_strict(model, naive.withColumn("target_release_date", F.lit(d("2020-01-01"))), ["m"]), "release_date mismatch")
    breaks(lambda: M.align_strict(model, naive.withColumn("actual", F.col("actual") + 1), ["m"]), "do not match")
    missing = [f.withColumn("actual", F.lit(None).cast("double")) for f in (model, naive)]
    assert M.align_strict(*missing, ["m"]).count() == 3
    found = rows(M.key_set_diff(model, short))
    assert len(found) == 1 and found[0][-1] == "naive"


def test_metrics_table(spark):
    model, naive = pair(spark)
    both = model.unionByName(naive)
    table = {r.model_name: r for r in M.metrics_table(both, naive, ["m", NAIVE]).collect()}
    assert table["m"].n_forecasts == 3 and table["m"].rmse == 0.0 and table["m"].beats_naive_rmse == 1.0
    assert table[NAIVE].rmse_vs_naive == 0.0 and table[NAIVE].beats_naive_mae == 0.0
    split = M.metrics_table(both, naive, ["m", NAIVE], rows_per_tile=2)
    assert rows(split, "model_name") == rows(M.metrics_table(both, naive, ["m", NAIVE]), "model_name")


def test_models_and_benchmark_drop_their_own_missing_rows(spark):
    model = forecasts(spark, [1.0, 2.0, 4.0], [1.0, None, 5.0])
    naive = forecasts(spark, [1.0, 2.0, 4.0], [None, 1.0, 2.0], NAIVE)
    row = M.metrics_table(model, naive, ["m"]).first()
    assert row.n_forecasts == 2 and math.isclose(row.mae, 0.5) and math.isclose(row.mae_vs_naive, 1.0)
    assert row.directional_accuracy == 1.0


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(NAIVE, 3, 2.0, 1.0, 0.5, 0.0, 0.0, 0.0, 0.0), ("ridge", 3, 1.0, 1.5, 0.5, 1.0, 0.0, 1.0, -0.5)], METRICS
    )


def test_verdicts_and_bars(spark, table):
    assert rows(R.verdicts(table)) == [("ridge", "beats", "does not beat")]
    assert len(rows(R.metric_bars(table))) == 4
    assert rows(R.metric_bars(table, ["rmse"]), "model_name") == [(NAIVE, "rmse", 2.0), ("ridge", "rmse", 1.0)]
    breaks(lambda: R.metric_bars(table, ["mse"]), "rmse and mae")
    breaks(lambda: R.metric_bars(table.limit(0)), "no metrics to draw")
    breaks(lambda: R.metric_bars(table.withColumn("mae", F.lit("?"))), "No number to draw")
    breaks(lambda: R.verdicts(table.drop("mae")), "Missing required metrics columns")


def test_report_tables(spark, table):
    both = forecasts(spark, [1.0, 3.0], [2.0, 2.0]).unionByName(forecasts(spark, [1.0, 3.0], [0.0, 1.0], NAIVE))
    report = R.comparison_report(table, both)
    summary = report["summary"].first()
    assert (summary.models, summary.forecast_rows, summary.unique_timestamps, summary.target_ids) == (2, 4, 2, "t")
    assert rows(report["forecast_counts"], "model_name") == [("m", 2), (NAIVE, 2)]
    stats = report["actual_stats"].first()
    assert stats.actual_mean == 2.0 and round(stats.actual_std, 6) == 1.154701
    assert rows(report["prediction_stats"], "model_name")[0] == ("m", 2.0, 0.0)
    unnamed = both.withColumn("model_name", F.lit(None).cast("string"))
    assert R.forecast_counts(unnamed).first().forecast_count == 4
    text = both.withColumn("actual", F.lit("?"))
    assert R.actual_stats(text).first().actual_mean is None


def test_chart_frames(spark):
    both = forecasts(spark, [1.0, 3.0, None], [2.0, 2.0, 1.0]).unionByName(forecasts(spark, [1.0, 3.0], [0.0, 1.0], NAIVE))
    lines = R.actuals_series(both)
    assert rows(lines.groupBy("series").count(), "series") == [("actual", 2), ("m prediction", 2), (f"{NAIVE} prediction", 2)]
    assert sorted(r.error for r in R.forecast_errors(both).collect()) == [-2.0, -1.0, -1.0, 1.0]
