import random

from helpers import OBS, breaks, d, rows, ts
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.asof import DEFAULT_TIES, asof_features, distinct_series, lagged_targets
from tidemark.operators.diagnostics import coverage, feature_missingness
from tidemark.schemas import DATASET_COLUMNS
from tidemark.session import stage

SHELL = "forecast_timestamp timestamp, target_id string, target_reference_date date, target_release_date date, target_value double"
TARGETS = [
    (ts("2026-03-11"), "cpi_mom", d("2026-02-01"), d("2026-03-11"), 1.0),
    (ts("2026-04-10"), "cpi_mom", d("2026-03-01"), d("2026-04-10"), 2.0),
]
RATES = [
    ("UNRATE", "fred", "2026-01-01", 4.0, "2026-02-06"),
    ("UNRATE", "fred", "2026-02-01", 4.1, "2026-03-06"),
    ("UNRATE", "fred", "2026-03-01", 4.2, "2026-04-04"),
    ("FEDFUNDS", "fred", "2026-03-01", 4.5, "2026-04-30"),
]


def shell(spark, data=TARGETS):
    return spark.createDataFrame(data, SHELL)


def obs(spark, data=RATES):
    return spark.createDataFrame(data, OBS)


def cells(df, *names):
    return rows(df.select("target_reference_date", *names), "target_reference_date")


def test_latest_released_value_and_no_future(spark):
    made = asof_features(shell(spark), obs(spark))
    assert made.columns[5:] == ["feature_FEDFUNDS_latest", "feature_UNRATE_latest"]
    assert cells(made, "feature_UNRATE_latest", "feature_FEDFUNDS_latest") == [
        (d("2026-02-01"), 4.1, None),
        (d("2026-03-01"), 4.2, None),
    ]


def test_given_series_keep_their_order_and_unknown_ones_are_missing(spark):
    made = asof_features(shell(spark), obs(spark), ["UNRATE", "NONE"])
    assert made.columns[5:] == ["feature_UNRATE_latest", "feature_NONE_latest"]
    assert cells(made, "feature_NONE_latest") == [(d("2026-02-01"), None), (d("2026-03-01"), None)]


def test_release_on_the_forecast_day_counts_unless_excluded(spark):
    data = [*RATES, ("UNRATE", "fred", "2026-03-01", 9.0, "2026-04-10")]
    assert cells(asof_features(shell(spark), obs(spark, data), ["UNRATE"]), "feature_UNRATE_latest")[1][1] == 9.0
    before = asof_features(shell(spark), obs(spark, data), ["UNRATE"], allow_exact=False)
    assert cells(before, "feature_UNRATE_latest")[1][1] == 4.2
    later = shell(spark).withColumn("forecast_timestamp", F.col("forecast_timestamp") + F.expr("interval 10 hours"))
    same_day = asof_features(later, obs(spark, data), ["UNRATE"], allow_exact=False)
    assert cells(same_day, "feature_UNRATE_latest")[1][1] == 9.0


def test_missing_winner_hides_earlier_values(spark):
    data = [*RATES, ("UNRATE", "fred", "2026-03-01", None, "2026-04-05")]
    assert cells(asof_features(shell(spark), obs(spark, data), ["UNRATE"]), "feature_UNRATE_latest")[1][1] is None


def test_ties_on_release_date(spark):
    tie = [
        ("X", "a", "2026-01-01", 1.0, "2026-03-01"),
        ("X", "b", "2026-01-01", 2.0, "2026-03-01"),
        ("X", "a", "2026-02-01", 3.0, "2026-03-01"),
        ("X", "b", "2026-02-01", 4.0, "2026-03-01"),
    ]
    assert cells(asof_features(shell(spark), obs(spark, tie)), "feature_X_latest")[0][1] == 4.0
    ordered = obs(spark, [tie[3], (*tie[3][:3], 5.0, tie[3][4])]).withColumn("seq", -F.col("value"))
    made = asof_features(shell(spark), ordered, tie_break=["seq"])
    assert cells(made, "feature_X_latest")[0][1] == 4.0


def test_missing_and_unreadable_release_dates(spark):
    data = [*RATES, ("UNRATE", "fred", "2026-03-01", 1.0, None)]
    breaks(lambda: asof_features(shell(spark), obs(spark, data)), "strict mode")
    relaxed = asof_features(shell(spark), obs(spark, data), strict=False)
    assert cells(relaxed, "feature_UNRATE_latest")[1][1] == 4.2
    bad = [*RATES, ("UNRATE", "fred", "2026-03-01", 1.0, "2026-13-45")]
    breaks(lambda: asof_features(shell(spark), obs(spark, bad), strict=False), "not a plain date")
    # Series that are not asked for are not parsed.
    other = [*RATES, ("BAD", "fred", "2026-03-01", 1.0, "never")]
    assert asof_features(shell(spark), obs(spark, other), ["UNRATE"]).count() == 2
    timed = [("UNRATE", "fred", "2026-01-01", 4.0, "2026-02-06 08:30:00")]
    breaks(lambda: asof_features(shell(spark), obs(spark, timed)), "not a plain date")


def test_empty_targets_keep_the_full_schema(spark):
    made = asof_features(shell(spark, []), obs(spark), ["UNRATE"])
    assert made.count() == 0 and made.columns[-1] == "feature_UNRATE_latest"


def range_join(targets, observations, names):
    """The same cells by the textbook inequality join."""
    series = targets.select(*DATASET_COLUMNS, F.explode(F.array(*[F.lit(n) for n in names])).alias("series_id"))
    o, t = observations.alias("o"), series.alias("t")
    reach = (F.col("t.series_id") == F.col("o.series_id")) & (F.col("o.release_date") <= F.col("t.forecast_timestamp"))
    order = ["release_date", "date", "source", *[n for n in DEFAULT_TIES if n in observations.columns]]
    columns = dict.fromkeys([*order, "value"])
    joined = t.join(o, reach, "left").select("t.*", *[f"o.{n}" for n in columns])
    parts = [part for n in order for part in S.last_key(n)]
    rank = F.struct(*[part.alias(f"r{i}") for i, part in enumerate(parts)])
    return joined.groupBy(*DATASET_COLUMNS, "series_id").agg(F.max_by(F.struct("value"), rank).getField("value").alias("value"))


def test_equals_range_join_and_ignores_the_future(spark):
    rng = random.Random(5)
    day = lambda i: str(d("2020-01-01").fromordinal(d("2020-01-01").toordinal() + i))
    data = [
        (rng.choice("abc"), rng.choice("xy"), day(rng.randrange(60)), rng.choice([None, rng.random()]), day(rng.randrange(90)))
        for _ in range(400)
    ]
    # Total order: one value per full key, so that ties cannot differ.
    frame = stage(obs(spark, data).dropDuplicates(["series_id", "source", "date", "release_date"]))
    targets = shell(spark, [(ts(day(i)), "t", d(day(i)), d(day(i)), float(i)) for i in range(0, 100, 3)])
    names = ["a", "b", "c"]
    made = asof_features(targets, frame, names)
    wide = range_join(targets, frame, names).groupBy("target_reference_date").pivot("series_id", names).agg(F.first("value"))
    columns = [f"feature_{n}_latest" for n in names]
    assert cells(made, *columns) == cells(wide, *names)

    cut = day(45)
    past = asof_features(targets.where(F.col("forecast_timestamp") <= cut), frame.where(F.col("release_date") <= cut), names)
    assert cells(made.where(F.col("forecast_timestamp") <= cut), *columns) == cells(past, *columns)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 28), st.integers(1, 28), st.one_of(st.none(), st.floats(-9, 9))), min_size=1, max_size=12))
def test_asof_matches_plain_python(spark, drawn):
    unique = {(p, r): v for p, r, v in drawn}
    data = [("s", "x", f"2026-01-{p:02d}", v, f"2026-02-{r:02d}") for (p, r), v in unique.items()]
    targets = shell(spark, [(ts(f"2026-02-{i:02d}"), "t", d(f"2026-02-{i:02d}"), d(f"2026-02-{i:02d}"), 0.0) for i in (1, 10, 20, 28)])
    made = cells(asof_features(targets, obs(spark, data), ["s"]), "feature_s_latest")
    for day, value in made:
        known = [(r, p, v) for (p, r), v in unique.items() if r <= day.day]
        assert value == (max(known, key=lambda k: k[:2])[2] if known else None)


def test_lagged_targets(spark):
    data = [(ts(f"2026-0{i}-10"), t, d(f"2026-0{i}-01"), d(f"2026-0{i}-10"), float(i)) for i in (1, 2, 3) for t in ("a", "b")]
    made = lagged_targets(shell(spark, data), [1, 2])
    last = made.where("target_id = 'b' and target_value = 3.0").first()
    assert (last.feature_target_lag_1, last.feature_target_lag_2) == (2.0, 1.0)
    assert "feature_target_lag_1" in lagged_targets(shell(spark, data)).columns
    split = lagged_targets(shell(spark, data), [1, 2], rows_per_tile=1)
    assert rows(split, "target_id", "target_value") == rows(made, "target_id", "target_value")
    breaks(lambda: lagged_targets(shell(spark), [0]), "from 1 on")
    breaks(lambda: lagged_targets(shell(spark).drop("target_value")), "Missing required")


def test_missingness(spark):
    data = [(ts(f"2026-0{i + 1}-01"), a, None) for i, a in enumerate([None, 1.0, 2.0, float("nan")])]
    frame = spark.createDataFrame(data, "forecast_timestamp timestamp, feature_a double, feature_b double")
    assert rows(feature_missingness(frame), "feature_name") == [
        ("feature_a", 2, 50.0, ts("2026-02-01"), ts("2026-03-01"), False),
        ("feature_b", 4, 100.0, None, None, True),
    ]
    assert rows(feature_missingness(frame.limit(0)))[0][1:3] == (0, 0.0)
    assert feature_missingness(frame.select("forecast_timestamp")).count() == 0
    breaks(lambda: feature_missingness(frame.select("feature_a")), "forecast_timestamp")


def test_coverage_and_series(spark):
    frame = obs(spark, [*RATES, ("UNRATE", "bls", "2026-01-01", 1.0, None)])
    found = {(r.source, r.series_id): (r.row_count, r.missing_release_date_count) for r in coverage(frame).collect()}
    assert found == {("fred", "UNRATE"): (3, 0), ("fred", "FEDFUNDS"): (1, 0), ("bls", "UNRATE"): (1, 1)}
    assert coverage(frame, "fred", "UNRATE").count() == 1
    assert sorted(r[0] for r in distinct_series(frame).collect()) == ["FEDFUNDS", "UNRATE"]
