"""Boosted trees against a plain version that looks at every split of every leaf."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import trees
from tidemark.functions.trees import Settings
from tidemark.operators.boosted import epoch_starts, fit_many, walk_forward_boosted
from tidemark.session import stage


def plain_split(bins, g, rows, least):
    """Best (gain, feature, bin) of a leaf by trying all."""
    best = None
    total = int(g[rows].sum())
    for f in range(bins.shape[1]):
        for s in range(trees.WIDTH - 1):
            left = rows[bins[rows, f] <= s]
            n, held = len(left), int(g[left].sum())
            if n < least or len(rows) - n < least:
                continue
            gain = float(held) ** 2 / n + float(total - held) ** 2 / (len(rows) - n) - float(total) ** 2 / len(rows)
            if gain > 1e-12 * float(total) ** 2 / len(rows) and (best is None or gain > best[0]):
                best = gain, f, s
    return best


def plain_scores(bins, y, unit, settings, base, test):
    """Scores of training and test rows; leaves are split best first, one at a time."""
    scores, out = np.full(len(y), base), np.full(len(test), base)
    for _ in range(settings.rounds):
        g = np.rint((y - scores) / unit).astype(np.int64)
        leaves = {1: (np.arange(len(y)), np.arange(len(test)))}
        splits = {1: plain_split(bins, g, leaves[1][0], settings.least)}
        if splits[1] is None:
            break
        while len(leaves) < settings.leaves and any(splits[k] for k in leaves):
            k = max((k for k in leaves if splits[k]), key=lambda k: (splits[k][0], -k))
            _, f, s = splits[k]
            rows, there = leaves.pop(k)
            for child, side in ((2 * k, True), (2 * k + 1, False)):
                leaves[child] = rows[(bins[rows, f] <= s) == side], there[(test[there, f] <= s) == side]
                splits[child] = plain_split(bins, g, leaves[child][0], settings.least)
        for rows, there in leaves.values():
            value = int(g[rows].sum()) / len(rows) * (settings.rate * unit)
            scores[rows] += value
            out[there] += value
    return out


def panel(spark, times=30, targets=4, seed=0):
    """Rows of several targets with missing values, ties and a useless feature."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(times):
        for k in range(targets):
            x, z = rng.normal(), float(rng.integers(3))
            y = 3 * (x > 0.3) * z - x + rng.normal(0, 0.3)
            rows.append((t, k, float(y), None if rng.random() < 0.15 else float(x), z, None, float(rng.integers(2)) if t > 12 else None))
    return stage(spark.createDataFrame(rows, "_when long, k int, _y double, a double, b double, c double, d double").repartition(3))


NAMES = ["a", "b", "c", "d"]


def plain_models(frame, cutoffs, settings):
    """For each cutoff its predictions for all rows, from numpy alone."""
    pdf = frame.toPandas()
    x, y, when = pdf[NAMES].to_numpy(float), pdf["_y"].to_numpy(), pdf["_when"].to_numpy()
    starts = epoch_starts(cutoffs, [(when < c).sum() for c in cutoffs])
    out = {}
    for c in cutoffs:
        old, mine = when < max(s for s in starts if s <= c), when < c
        unit = trees.unit_of(np.abs(y[old]).max())
        bins = np.zeros(x.shape, int)
        for i in range(x.shape[1]):
            known, seen = np.sort(x[old, i][~np.isnan(x[old, i])]), x[mine, i][~np.isnan(x[mine, i])]
            edges = sorted({known[k * len(known) // 255] for k in range(255)}) if len(known) else []
            fill = np.median(seen) if len(seen) else -np.inf
            bins[:, i] = [sum(e <= v for e in edges) for v in np.where(np.isnan(x[:, i]), fill, x[:, i])]
        base = unit * (int(np.rint(y[mine] / unit).astype(np.int64).sum()) / mine.sum())
        out[c] = plain_scores(bins[mine], y[mine], unit, settings, base, bins)
    return x, out


@pytest.mark.parametrize("local_bytes", [1 << 25, 0])
def test_models_equal_the_plain_version(spark, local_bytes):
    """In one task per model, and with the trees of all cutoffs grown together over chunks."""
    frame = panel(spark)
    settings = Settings(rounds=4, leaves=6)
    cutoffs = [5, 11, 12, 29]
    x, expected = plain_models(frame, cutoffs, settings)
    models = fit_many(frame, NAMES, cutoffs, [4 * c for c in cutoffs], settings, local_bytes)
    for c in cutoffs:
        np.testing.assert_allclose(models[c].predict(x), expected[c], rtol=0, atol=1e-11)
    assert len({len(t.feature) for m in models.values() for t in m.trees}) > 1


def test_both_ways_give_the_same_trees(spark):
    frame, settings = panel(spark, 40, 9, seed=3), Settings(rounds=12)
    cutoffs = list(range(6, 40, 3))
    near, far = (fit_many(frame, NAMES, cutoffs, [9 * c for c in cutoffs], settings, b) for b in (1 << 25, 0))
    for c in cutoffs:
        assert near[c].plain() == far[c].plain()


def test_jobs_do_not_depend_on_the_number_of_cutoffs(spark):
    frame = panel(spark, 24, 6, seed=1)
    used = []
    for cutoffs in ([8, 12], list(range(8, 16))):
        group = f"cutoffs-{len(cutoffs)}"
        spark.sparkContext.setJobGroup(group, group)
        fit_many(frame, NAMES, cutoffs, [6 * c for c in cutoffs], Settings(rounds=2, leaves=3), 0)
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert used[1] <= used[0] + 4, used


def test_nothing_from_the_cutoff_on_is_used(spark):
    frame = panel(spark, 20)
    later = F.col("_when") >= 10
    changed = stage(frame.withColumns({c: F.when(later, F.lit(1e9)).otherwise(F.col(c)) for c in ("_y", "a", "b", "d")}))
    for local_bytes in (1 << 25, 0):
        one, two = (fit_many(f, NAMES, [8, 10], [32, 40], Settings(rounds=2), local_bytes) for f in (frame, changed))
        assert one[8].plain() == two[8].plain() and one[10].plain() == two[10].plain()


def test_constant_and_tiny_training_sets(spark):
    rows = [(t, 1.5, float(t)) for t in range(30)]
    frame = stage(spark.createDataFrame(rows, "_when long, _y double, a double"))
    for local_bytes in (1 << 25, 0):
        models = fit_many(frame, ["a"], [3, 25], [3, 25], Settings(), local_bytes)
        assert all(not m.trees and m.base == 1.5 for m in models.values())


def test_infinite_targets_are_refused(spark):
    rows = [(f"2020-01-{d:02d}", "t", f"2020-01-{d:02d}", f"2020-01-{d:02d}", float("inf") if d == 3 else 1.0 * d, 2.0 * d) for d in range(1, 10)]
    schema = "forecast_timestamp string, target_id string, target_reference_date string, target_release_date string, target_value double, feature_a double"
    with pytest.raises(ValueError, match="finite"):
        walk_forward_boosted(spark.createDataFrame(rows, schema), 4, rounds=1)
