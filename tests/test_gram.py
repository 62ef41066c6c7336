import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import gram as G
from tidemark.operators.supervised import fit_predict_ridge


def jobs(spark, name, action):
    """How many jobs the action starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def numbers(rng, n, p):
    values = rng.normal(size=(n, p)) * 10 + 1000
    values[rng.random((n, p)) < 0.1] = np.nan
    return pd.DataFrame(values, columns=[f"x {i}" for i in range(p)])


def to_spark(spark, pdf, parts=5):
    made = spark.createDataFrame(pdf).repartition(parts)
    return made.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) for c in made.columns])


@pytest.mark.parametrize("cells", [7, 1 << 14])
def test_gram_equals_numpy(spark, monkeypatch, cells):
    monkeypatch.setattr(G, "CELLS", cells)
    monkeypatch.setattr(G, "GROUPS", 3)
    pdf = numbers(np.random.default_rng(1), 200, 6)
    z = np.column_stack([np.ones(len(pdf)), np.nan_to_num(pdf.to_numpy() - 1000.0)])
    made = G.gram(to_spark(spark, pdf, 9), [f"`{c}`" for c in pdf], [1000.0] * 6)
    assert np.allclose(made, z.T @ z)


def test_gram_of_no_rows_is_zero(spark):
    assert not G.gram(spark.createDataFrame([], "a double, b double"), ["a", "b"], [0.0, 0.0]).any()


def test_jobs_do_not_grow_with_columns(spark):
    rng = np.random.default_rng(2)
    counts = []
    for p in (2, 200):
        frame = to_spark(spark, numbers(rng, 100, p)).cache()
        frame.count()
        counts.append(jobs(spark, f"gram-{p}", lambda frame=frame, p=p: G.gram(frame, [f"`{c}`" for c in frame.columns], [0.0] * p)))
    assert counts[0] == counts[1] > 0


def test_ridge_of_500_features_equals_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = numbers(rng, 900, 500)
    pdf.columns = [f"x{i}" for i in range(500)]
    pdf["x7"], pdf["x8"] = 4.0, np.nan
    pdf["target_value"] = pdf[["x1", "x2"]].fillna(1000.0).sum(axis=1) + rng.normal(size=len(pdf))
    features = [f"x{i}" for i in range(500)]
    train, test = pdf[:700], pdf[700:].assign(row=range(200))
    made = fit_predict_ridge(to_spark(spark, train), to_spark(spark, test), features).select("row", "prediction").toPandas().sort_values("row")

    used = [c for c in features if train[c].notna().any()]
    medians = train[used].median()
    x, z = train[used].fillna(medians), test[used].fillna(medians)
    sd = x.std(ddof=0)
    sd[sd < 1e-9] = 1.0
    centred, y = ((x - x.mean()) / sd).to_numpy(), train["target_value"].to_numpy()
    w = np.linalg.solve(centred.T @ centred + np.eye(len(used)), centred.T @ (y - y.mean()))
    assert np.abs(made["prediction"].to_numpy() - (y.mean() + ((z - x.mean()) / sd).to_numpy() @ w)).max() < 1e-6
