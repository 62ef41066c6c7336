"""One train/test split: ridge and boosted trees fitted on one frame, scored on another."""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.gram import gram
from tidemark.functions.ranks import exact_medians
from tidemark.functions.trees import Settings
from tidemark.session import stage

def supervised_guard(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str = "target_value", label: str = "Model"
) -> DataFrame:
    """Training rows that have a target, typed; too little to fit on is an error."""
    wanted = {"training data": [target, *features], "test data": list(features)}
    for place, frame in (("training data", train), ("test data", test)):
        lost = [c for c in wanted[place] if c not in frame.columns]
        if lost:
            raise ValueError(f"{label}: {place} lacks {lost}.")
    rows = train.select(S.number(train, target).alias("_y"), *[S.number(train, c).alias(c) for c in features]).where("_y is not null")
    names = ["_y", *features]
    cells = rows.select(F.posexplode(F.array(*[F.col(c) for c in names])).alias("_i", "_v"))
    facts = {
        names[r["_i"]]: r for r in cells.groupBy("_i").agg(F.count("_v").alias("known"), F.count_if(F.abs("_v") == float("inf")).alias("endless")).collect()
    }
    infinite = [c for c in names if facts and facts[c]["endless"]]
    if infinite:
        raise ValueError(f"{label}: training values must be finite or missing, unlike {[target if c == '_y' else c for c in infinite]}.")
    count = facts["_y"]["known"] if facts else 0
    filled = sum(facts[c]["known"] > 0 for c in features) if facts else 0
    if count < 2 or not filled:
        raise ValueError(f"{label}: nothing to learn from {count} rows with a target and {filled} features with values.")
    return rows


def _typed_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: S.number(df, c) for c in features})


def fit_predict_ridge(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    target: str = "target_value",
    alpha: float = 1.0,
) -> DataFrame:
    """``test`` with ``prediction``: median imputation, standardizing, ridge.

    The sums a fit needs are one matrix of products, made in blocks, so jobs and groups do
    not grow with the number of features; the prediction is a plain projection over arrays.
    """
    rows = supervised_guard(train, test, features, target, "Ridge")
    medians = exact_medians(rows, features)
    used = [c for c in features if medians[c] is not None]
    p = len(used)
    base = rows.agg(F.avg("_y")).first()[0]
    # Shifting by the median keeps the sums small and makes imputed values zero.
    sums = gram(rows, ["_y", *used], [base, *[medians[c] for c in used]])
    n, sy, sx, sxy, products = sums[0, 0], sums[0, 1], sums[0, 2:], sums[1, 2:], sums[2:, 2:]
    mean = sx / n
    cov = products / n - np.outer(mean, mean)
    flat = np.diag(cov) <= 8 * np.finfo(float).eps * np.diag(products) / n
    scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, np.diag(cov))))
    lhs = np.where(flat[:, None] | flat[None, :], 0.0, n * cov / np.outer(scale, scale)) + alpha * np.eye(p)
    weights = np.linalg.solve(lhs, np.where(flat, 0.0, (sxy - mean * sy) / scale)) / scale
    numbers = lambda values: F.lit([float(v) for v in values])
    shifted = F.zip_with(F.array(*[F.col(c) for c in used]), numbers(medians[c] for c in used), lambda v, m: F.coalesce(v - m, F.lit(0.0)))
    parts = F.zip_with(F.zip_with(shifted, numbers(mean), lambda v, m: v - m), numbers(weights), lambda v, w: v * w)
    prediction = F.aggregate(parts, F.lit(float(base + sy / n)), lambda total, v: total + v)
    return _typed_features(test, features).withColumn("prediction", prediction)


def fit_predict_boosted(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str = "target_value", **settings
) -> DataFrame:
    """``test`` with ``prediction``: median imputation and boosted trees.

    ``settings`` are those of ``trees.Settings``.
    """
    # Imported here, since the walk-forward models build on this module's checks.
    from tidemark.operators.boosted import fit_many, predicted

    rows = stage(supervised_guard(train, test, features, target, "Boosted trees").withColumn("_when", F.lit(0).cast("long")))
    models = fit_many(rows, features, [1], [rows.count()], Settings(**settings))
    return predicted(_typed_features(test, features), features, models)
