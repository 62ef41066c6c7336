"""One query per operator: (spark, sf_dir) -> DataFrame over the driver's whole tables."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import adapters as A
from tidemark.functions import quality as Q
from tidemark.functions import scalars as S
from tidemark.operators import asof, comparison, diagnostics, metrics, summaries, supervised, targets, transforms
from tidemark.operators import walkforward as W
from tidemark.schemas import DATASET_COLUMNS, NAIVE, OBSERVATION_COLUMNS, VINTAGE_KEY
from tidemark.session import stage, staging_root
from tidemark.sources import calendar, catalog, payloads, store, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FEATURE = "feature_A_F_latest"
TWO_FEATURES = ["feature_A_F_latest", "feature_N_O_latest"]
MIN_TRAIN = 24


def query(build: Query) -> Query:
    """Register under the function's name; timestamps are compared in UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return run


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Shared inputs.


def text_obs(spark, sf_dir):
    """Observations as vendors send them: every column text."""
    rows = A.obs(spark, sf_dir)
    return rows.select(
        "series_id",
        "source",
        F.col("date").cast("string").alias("date"),
        F.col("value").cast("string").alias("value"),
        F.col("release_date").cast("string").alias("release_date"),
        F.col("fetched_at").cast("string").alias("fetched_at"),
        *A.LINE_ORDER,
    )


def idx_targets(spark, sf_dir):
    return targets.mom_target(
        A.idx(spark, sf_dir), None, "bls", target_id=A.mom_id(), target_name=F.col("series_id")
    )


def dataset(spark, sf_dir):
    return asof.asof_features(idx_targets(spark, sf_dir), A.obs(spark, sf_dir), strict=False, tie_break=A.LINE_ORDER)


def one_feature(spark, sf_dir):
    return asof.asof_features(
        idx_targets(spark, sf_dir), A.obs(spark, sf_dir), ["A_F"], strict=False, tie_break=A.LINE_ORDER
    )


def naive_and_ridge(spark, sf_dir):
    """Staged, since the metrics read it more than once: both models' forecasts."""
    rows = stage(one_feature(spark, sf_dir))
    return stage(W.walk_forward_naive(rows, MIN_TRAIN).unionByName(W.walk_forward_ridge(rows, MIN_TRAIN)))


def by_model(forecasts, name):
    return forecasts.where(F.col("model_name") == name)


# Observations.


@query
def read_observations(spark, sf_dir):
    return targets.filter_series(A.obs(spark, sf_dir), source="fred").select(*OBSERVATION_COLUMNS)


@query
def filter_series(spark, sf_dir):
    rows = targets.filter_series(A.obs(spark, sf_dir), ["A_F", "N_O"], "bls")
    return rows.select("series_id", "source", "date", "value", "release_date")


@query
def coverage(spark, sf_dir):
    return diagnostics.coverage(A.obs(spark, sf_dir))


@query
def distinct_series(spark, sf_dir):
    return asof.distinct_series(A.obs(spark, sf_dir))


@query
def duplicate_keys(spark, sf_dir):
    keyed = A.obs(spark, sf_dir).withColumn("release_date_key", S.release_date_key(F.col("release_date")))
    return Q.duplicate_keys(keyed, VINTAGE_KEY)


@query
def release_date_key(spark, sf_dir):
    rows = A.obs(spark, sf_dir)
    return rows.select(*A.LINE_ORDER, S.release_date_key(F.col("release_date")).alias("release_date_key"))


@query
def coerce_observations(spark, sf_dir):
    return store.coerce_observations(text_obs(spark, sf_dir), A.LINE_ORDER)


@query
def validate_fred(spark, sf_dir):
    rows = text_obs(spark, sf_dir).where("source = 'fred' and release_date is not null")
    return payloads.validate_fred(rows)


@query
def validate_bls(spark, sf_dir):
    return payloads.validate_bls(text_obs(spark, sf_dir).where("source = 'bls'"))


@query
def normalize_reference_period(spark, sf_dir):
    rows = text_obs(spark, sf_dir)
    return rows.groupBy(S.reference_period(rows, "date").alias("reference_period")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query
def bls_period_to_date(spark, sf_dir):
    rows = A.obs(spark, sf_dir).select(
        F.date_format("date", "yyyy").alias("year"), F.concat(F.lit("M"), F.date_format("date", "MM")).alias("period")
    )
    dated = rows.withColumn("date", payloads.bls_period_to_date(F.col("year"), F.col("period")))
    return dated.groupBy("year", "period", "date").agg(F.count(F.lit(1)).alias("row_count"))


@query
def enrich_series(spark, sf_dir):
    rows = A.obs(spark, sf_dir)
    known = rows.where("source = 'fred'").groupBy("series_id", "source").agg(F.count(F.lit(1)).alias("n"))
    dimension = known.select(
        "series_id",
        F.concat(F.lit("Shipments "), "series_id").alias("description"),
        "source",
        F.lit("shipments").alias("category"),
        F.lit("daily").alias("frequency_hint"),
    )
    columns = ["series_id", "source", "date", "value", "description", "category", "frequency_hint"]
    return catalog.enrich_series(rows, dimension).select(*columns)


# Payloads.


def _response(rows, *observations):
    """One response per row, stating 2026-01-01 as its own start."""
    body = F.struct(F.lit("2026-01-01").alias("realtime_start"), F.array(*observations).alias("observations"))
    return rows.withColumn("payload", F.to_json(body, {"ignoreNullFields": "false"})).withColumn("fetched_at", F.lit("2026-01-01").cast("timestamp"))


def _sent(date, value, released):
    """An observation as sent: a missing value is a null, a missing release date is no field."""
    fields = {"realtime_start": released, "date": date, "value": value}
    sent = F.create_map(*[part for name, c in fields.items() for part in (F.lit(name), c.cast("string"))])
    return F.map_filter(sent, lambda name, c: c.isNotNull() | (name != "realtime_start"))


@query
def normalize_fred(spark, sf_dir):
    """Each response holds an observation and a following one without value or date."""
    rows = A.obs(spark, sf_dir).where("source = 'fred'")
    own = _sent(F.col("date"), F.col("value"), F.col("release_date"))
    following = _sent(F.add_months("date", 1), F.lit("."), F.lit(None))
    return payloads.normalize_fred(_response(rows, own, following)).drop("fetched_at")


@query
def fred_release_date(spark, sf_dir):
    """All three vintage modes: own dates, requested start, stated start."""
    rows = A.obs(spark, sf_dir).where("source = 'fred' and release_date is not null")
    kind = F.col("l_orderkey") % 3
    own = _sent(F.col("date"), F.col("value"), F.when(kind == 0, F.col("release_date")))
    landed = _response(rows, own)
    landed = landed.withColumn("vintage_mode", F.when(kind == 0, "initial_release").when(kind == 1, "realtime_period"))
    landed = landed.withColumn("request_realtime_start", F.when(kind == 1, "2020-02-02"))
    return payloads.normalize_fred(landed).select("series_id", "date", "value", "release_date")


@query
def merge_vintage_chunks(spark, sf_dir):
    """Two overlapping fetches of the same observations."""
    rows = A.obs(spark, sf_dir).select(*OBSERVATION_COLUMNS, "l_orderkey")
    first, second = rows.where("date < '2000-01-01'"), rows.where("date >= '1997-01-01'")
    return payloads.merge_vintage_chunks(first.unionByName(second).drop("l_orderkey"))


@query
def union_distinct_chunks(spark, sf_dir):
    rows = A.obs(spark, sf_dir).select("series_id", "source", "date", "release_date")
    return payloads.union_distinct_chunks(
        rows.where("source = 'fred'"), rows.where("date >= '1998-01-01'"), rows.where("source = 'bls'")
    )


@query
def normalize_bls(spark, sf_dir):
    """Each response holds another series, and two months of the requested one."""
    rows = A.obs(spark, sf_dir).where("source = 'bls'")

    def sent(date, value):
        return F.struct(
            F.year(date).cast("string").alias("year"),
            F.concat(F.lit("M"), F.lpad(F.month(date).cast("string"), 2, "0")).alias("period"),
            value.alias("value"),
        )

    data = F.array(
        sent(F.col("date"), F.col("value").cast("string")), sent(F.add_months("date", 1), F.lit("not_available"))
    )
    other = F.struct(F.lit("other").alias("seriesID"), F.slice(data, 1, 1).alias("data"))
    wanted = F.struct(F.col("series_id").alias("seriesID"), data.alias("data"))
    body = F.struct(F.struct(F.array(other, wanted).alias("series")).alias("Results"))
    landed = rows.select("series_id", F.to_json(body).alias("payload"), "fetched_at")
    return payloads.normalize_bls(landed).drop("fetched_at")


# Release calendar.


@query
def validate_calendar(spark, sf_dir):
    return calendar.validate_calendar(A.calendar(spark, sf_dir))


@query
def calendar_violations(spark, sf_dir):
    """Months of the observations as a calendar with late, blank and repeated entries."""
    rows = A.idx(spark, sf_dir).select(
        F.lit("Index").alias("release_name"),
        F.when(F.month("date") == 2, F.lit(" ")).otherwise(F.date_format("date", "yyyy-MM")).alias("reference_period"),
        F.when(F.month("date") == 3, F.col("date")).otherwise(F.col("release_date")).alias("release_date"),
        F.when(F.month("date") == 4, F.lit("")).otherwise(F.lit("08:30")).alias("release_time"),
    )
    return calendar.calendar_violations(rows)


@query
def calendar_gaps(spark, sf_dir):
    return calendar.calendar_gaps(A.idx(spark, sf_dir), A.calendar(spark, sf_dir))


@query
def period_set_diff(spark, sf_dir):
    months = A.obs(spark, sf_dir).select(S.month_key(F.col("date")).alias("reference_period"))
    return months.subtract(A.calendar(spark, sf_dir).select("reference_period"))


@query
def calendar_range_gaps(spark, sf_dir):
    return calendar.calendar_range_gaps(A.calendar(spark, sf_dir), "1994-11", "2001-12")


@query
def calendar_summary(spark, sf_dir):
    return calendar.calendar_summary(A.calendar(spark, sf_dir))


@query
def map_release_dates(spark, sf_dir):
    return calendar.map_release_dates(A.idx(spark, sf_dir), A.calendar(spark, sf_dir))


# Targets.


@query
def mom_target(spark, sf_dir):
    return idx_targets(spark, sf_dir)


@query
def mom_target_vintages(spark, sf_dir):
    """Several vintages per date: the previous row may be of the same date."""
    rows = (
        A.obs(spark, sf_dir)
        .where("release_date is not null and value is not null")
        .groupBy("series_id", "source", "date", "release_date")
        .agg(F.max("value").alias("value"))
    )
    made = targets.mom_target(rows, None, None, target_id=A.mom_id(), target_name=F.col("series_id"))
    return made.select("target_id", "source", "reference_date", "release_date", "target_value")


@query
def validate_targets(spark, sf_dir):
    return targets.validate_targets(idx_targets(spark, sf_dir))


@query
def target_shell(spark, sf_dir):
    return targets.target_shell(idx_targets(spark, sf_dir))


@query
def target_shell_relaxed(spark, sf_dir):
    rows = A.idx(spark, sf_dir).withColumn("release_date", F.when(F.month("date") != 4, F.col("release_date")))
    made = targets.mom_target(rows, None, "bls", strict=False, target_id=A.mom_id(), target_name=F.col("series_id"))
    return targets.target_shell(made, validate=False)


@query
def normalize_targets(spark, sf_dir):
    return targets.normalize_targets(idx_targets(spark, sf_dir))


@query
def lagged_targets(spark, sf_dir):
    return asof.lagged_targets(targets.normalize_targets(idx_targets(spark, sf_dir)), [1, 2, 12])


# Transforms.


def _gappy_idx(spark, sf_dir):
    value = F.when(F.month("date") != 5, F.col("value"))
    return A.idx(spark, sf_dir).select("series_id", "date", value.alias("value"))


@query
def percent_change(spark, sf_dir):
    return transforms.percent_change(_gappy_idx(spark, sf_dir), "value", ["series_id"], ["date"], periods=2)


@query
def difference(spark, sf_dir):
    return transforms.difference(_gappy_idx(spark, sf_dir), "value", ["series_id"], ["date"], periods=2)


@query
def rolling_z_score(spark, sf_dir):
    scored = transforms.rolling_z_score(A.daily(spark, sf_dir), "value", ["series_id"], ["date"], window=5)
    return rounded(scored.select("series_id", "date", "rolling_z_score"), "rolling_z_score")


# Point-in-time features.


@query
def normalize_feature_obs(spark, sf_dir):
    rows = text_obs(spark, sf_dir).drop("fetched_at")
    return asof.normalize_feature_obs(rows, ["A_F", "R_O"], strict=False).drop(*A.LINE_ORDER)


@query
def latest_vintage(spark, sf_dir):
    released = A.obs(spark, sf_dir).where("release_date is not null")
    best = asof.latest_vintage(released, ["series_id", "release_date"], A.LINE_ORDER)
    return best.select("series_id", "release_date", "latest.*")


@query
def latest_by_source(spark, sf_dir):
    released = A.obs(spark, sf_dir).where("release_date is not null")
    return asof.latest_vintage(released, ["series_id", "source"], A.LINE_ORDER).select("series_id", "source", "latest.*")


@query
def asof_features(spark, sf_dir):
    return dataset(spark, sf_dir)


@query
def asof_features_before(spark, sf_dir):
    """Only values released strictly before the forecast timestamp; one series left out."""
    return asof.asof_features(
        idx_targets(spark, sf_dir),
        A.obs(spark, sf_dir),
        strict=False,
        tie_break=A.LINE_ORDER,
        exclude_series=["A_F", "N_F", "N_O", "R_F"],
        allow_exact=False,
    )


@query
def feature_missingness(spark, sf_dir):
    return rounded(diagnostics.feature_missingness(dataset(spark, sf_dir)), "missing_pct")


# Walk-forward.


@query
def prepare_dataset(spark, sf_dir):
    rows = W.prepare_dataset(one_feature(spark, sf_dir), [FEATURE])
    return rows.where("target_value is not null")


@query
def fold_number(spark, sf_dir):
    return W.fold_numbers(one_feature(spark, sf_dir), MIN_TRAIN)


@query
def naive_predictions(spark, sf_dir):
    return W.naive_predictions(targets.normalize_targets(idx_targets(spark, sf_dir)))


@query
def usable_features(spark, sf_dir):
    found = W.usable_features(dataset(spark, sf_dir), MIN_TRAIN)
    return found.withColumn("usable_features", F.array_join("usable_features", ","))


@query
def expanding_moments(spark, sf_dir):
    moments = W.expanding_moments(dataset(spark, sf_dir), TWO_FEATURES, MIN_TRAIN)
    return rounded(moments, "train_mean", "train_std", "train_median")


@query
def walk_forward_naive(spark, sf_dir):
    return W.walk_forward_naive(one_feature(spark, sf_dir), MIN_TRAIN)


@query
def walk_forward_naive_pooled(spark, sf_dir):
    """All targets on one timeline."""
    return W.walk_forward_naive(one_feature(spark, sf_dir), MIN_TRAIN, by=())


@query
def walk_forward_ridge(spark, sf_dir):
    return rounded(W.walk_forward_ridge(one_feature(spark, sf_dir), MIN_TRAIN), "prediction")


@query
def walk_forward_ridge_pooled(spark, sf_dir):
    return rounded(W.walk_forward_ridge(one_feature(spark, sf_dir), MIN_TRAIN, by=()), "prediction")


@query
def walk_forward_ridge_two(spark, sf_dir):
    return rounded(W.walk_forward_ridge(dataset(spark, sf_dir), MIN_TRAIN, TWO_FEATURES), "prediction")


@query
def walk_forward_ridge_all(spark, sf_dir):
    return W.walk_forward_ridge(dataset(spark, sf_dir), MIN_TRAIN)


@query
def fit_predict_ridge(spark, sf_dir):
    rows = stage(one_feature(spark, sf_dir))
    split = F.col("forecast_timestamp") < "1999-01-01"
    scored = supervised.fit_predict_ridge(rows.where(split), rows.where(~split), [FEATURE])
    return rounded(scored, "prediction")


@query
def supervised_guard(spark, sf_dir):
    rows = stage(dataset(spark, sf_dir))
    kept = supervised.supervised_guard(rows, rows, TWO_FEATURES)
    return kept.agg(F.count(F.lit(1)).alias("train_rows"), *[F.count(c).alias(f"known_{c}") for c in TWO_FEATURES])


@query
def fit_predict_boosted(spark, sf_dir):
    rows = stage(one_feature(spark, sf_dir))
    split = F.col("forecast_timestamp") < "1999-01-01"
    return supervised.fit_predict_boosted(rows.where(split), rows.where(~split), [FEATURE])


@query
def fit_predict_stump(spark, sf_dir):
    """One round of trees with two leaves, which SQL can follow."""
    rows = stage(one_feature(spark, sf_dir))
    split = F.col("forecast_timestamp") < "1999-01-01"
    made = supervised.fit_predict_boosted(rows.where(split), rows.where(~split), [FEATURE], rounds=1, leaves=2)
    return rounded(made, "prediction")


@query
def walk_forward_stump(spark, sf_dir):
    """One such tree for every forecast time."""
    made = comparison.walk_forward(dataset(spark, sf_dir), "boosted_trees", MIN_TRAIN, [FEATURE], rounds=1, leaves=2)
    return rounded(made, "prediction")


@query
def compare_models_linear(spark, sf_dir):
    """The models that SQL can follow, over one fold table."""
    _, table = comparison.compare_models(one_feature(spark, sf_dir), [NAIVE, "ridge"], MIN_TRAIN)
    return rounded(table, "rmse", "mae", "directional_accuracy", "rmse_vs_naive", "mae_vs_naive")


@query
def walk_forward_boosted(spark, sf_dir):
    return comparison.walk_forward(dataset(spark, sf_dir), "boosted_trees", MIN_TRAIN)


@query
def compare_models(spark, sf_dir):
    _, table = comparison.compare_models(dataset(spark, sf_dir), ["ridge", "boosted_trees"], MIN_TRAIN)
    return table


# Metrics.


@query
def mae(spark, sf_dir):
    scored = metrics.score_levels(naive_and_ridge(spark, sf_dir), ["model_name"])
    return rounded(scored.select("model_name", "mae"), "mae")


@query
def rmse(spark, sf_dir):
    scored = metrics.score_levels(naive_and_ridge(spark, sf_dir), ["model_name"])
    return rounded(scored.select("model_name", "rmse"), "rmse")


@query
def level_direction(spark, sf_dir):
    scored = metrics.score_levels(naive_and_ridge(spark, sf_dir), ["model_name"])
    return rounded(scored.select("model_name", "level_direction"), "level_direction")


@query
def change_direction(spark, sf_dir):
    moved = metrics.change_direction(naive_and_ridge(spark, sf_dir), ["model_name"])
    return moved.select("model_name", *DATASET_COLUMNS[:3], "same_direction")


@query
def evaluate_forecasts(spark, sf_dir):
    scored = metrics.evaluate_forecasts(naive_and_ridge(spark, sf_dir), ["model_name"])
    return rounded(scored, "rmse", "mae", "directional_accuracy")


@query
def align_loose(spark, sf_dir):
    both = naive_and_ridge(spark, sf_dir)
    aligned = metrics.align_loose(by_model(both, "ridge"), by_model(both, NAIVE))
    columns = [*metrics.LOOSE_KEYS, "actual_model", "prediction_model", "actual_naive", "prediction_naive"]
    return rounded(aligned.select(*columns), "prediction_model", "prediction_naive")


@query
def align_strict(spark, sf_dir):
    both = naive_and_ridge(spark, sf_dir)
    aligned = metrics.align_strict(both, by_model(both, NAIVE), ["ridge", NAIVE])
    return rounded(aligned, "prediction_model", "prediction_naive")


@query
def normalize_forecasts(spark, sf_dir):
    """Forecasts read back as text, typed again; keys unique per model."""
    text = naive_and_ridge(spark, sf_dir)
    text = text.withColumns({c: F.col(c).cast("string") for c in [*metrics.LOOSE_KEYS, "actual", "prediction"]})
    return rounded(metrics.normalize_forecasts(text, ["model_name", *metrics.ALIGNMENT_KEYS]), "prediction")


@query
def key_set_diff(spark, sf_dir):
    rows = stage(one_feature(spark, sf_dir))
    return metrics.key_set_diff(W.walk_forward_naive(rows, 30), W.walk_forward_naive(rows, MIN_TRAIN))


@query
def compare_to_naive(spark, sf_dir):
    both = naive_and_ridge(spark, sf_dir)
    scored = metrics.compare_to_naive(by_model(both, "ridge"), by_model(both, NAIVE))
    return rounded(scored, *[c for c in scored.columns if "beats" not in c])


def _metrics(spark, sf_dir):
    both = naive_and_ridge(spark, sf_dir)
    return metrics.metrics_table(both, by_model(both, NAIVE), [NAIVE, "ridge"])


@query
def metrics_row(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir), "rmse", "mae", "directional_accuracy", "rmse_vs_naive", "mae_vs_naive")


@query
def verdicts(spark, sf_dir):
    return summaries.verdicts(_metrics(spark, sf_dir))


@query
def metric_bars(spark, sf_dir):
    return rounded(summaries.metric_bars(stage(_metrics(spark, sf_dir))), "value")


# Report tables and chart frames.


@query
def union_forecasts(spark, sf_dir):
    rows = stage(one_feature(spark, sf_dir))
    both = comparison.union_forecasts([W.walk_forward_naive(rows, MIN_TRAIN), W.walk_forward_ridge(rows, MIN_TRAIN)])
    return rounded(both, "prediction")


@query
def forecast_counts(spark, sf_dir):
    return summaries.forecast_counts(naive_and_ridge(spark, sf_dir))


@query
def actual_stats(spark, sf_dir):
    return rounded(summaries.actual_stats(naive_and_ridge(spark, sf_dir)), "actual_mean", "actual_std")


@query
def prediction_stats(spark, sf_dir):
    return rounded(summaries.prediction_stats(naive_and_ridge(spark, sf_dir)), "prediction_mean", "prediction_std")


@query
def forecast_summary(spark, sf_dir):
    return summaries.forecast_summary(naive_and_ridge(spark, sf_dir))


@query
def plot_ready_forecasts(spark, sf_dir):
    ready = summaries.plot_ready_forecasts(naive_and_ridge(spark, sf_dir))
    return rounded(ready, "prediction")


@query
def normalize_report_inputs(spark, sf_dir):
    """Forecasts as text with unreadable numbers, which become missing."""
    text = naive_and_ridge(spark, sf_dir)
    spoilt = F.when(F.col("fold_number") % 5 == 0, "n/a").otherwise(F.col("actual").cast("string"))
    text = text.withColumns({"actual": spoilt, "prediction": F.col("prediction").cast("string")})
    return rounded(summaries.normalize_report_forecasts(text), "prediction")


@query
def actuals_series(spark, sf_dir):
    return rounded(summaries.actuals_series(naive_and_ridge(spark, sf_dir)), "y")


@query
def forecast_errors(spark, sf_dir):
    return rounded(summaries.forecast_errors(naive_and_ridge(spark, sf_dir)), "error")


# Store and run log.


def _stored(spark, sf_dir):
    batch = store.coerce_observations(A.obs(spark, sf_dir), A.LINE_ORDER)
    nothing = batch.limit(0)
    return store.upsert_result(nothing, batch, A.LINE_ORDER)


def _changed(spark, sf_dir):
    rows = A.obs(spark, sf_dir)
    later = F.when(F.col("l_suppkey") % 3 == 0, F.col("fetched_at") + F.expr("interval 1 day"))
    raised = F.when(F.col("l_suppkey") % 5 == 0, F.col("value") + 1.0)
    moved = rows.withColumns(
        {"fetched_at": F.coalesce(later, "fetched_at"), "value": F.coalesce(raised, "value")}
    )
    # New keys too: some observations move to a later period.
    shifted = F.when(F.col("l_suppkey") % 7 == 0, F.add_months("date", 120)).otherwise(F.col("date"))
    return store.coerce_observations(moved.withColumn("date", shifted), A.LINE_ORDER)


@query
def upsert_changes(spark, sf_dir):
    """Every batch row with what the merge does with it."""
    changes = store.upsert_changes(_stored(spark, sf_dir), _changed(spark, sf_dir), A.LINE_ORDER)
    return changes.select(*A.LINE_ORDER, "action")


@query
def upsert_counts(spark, sf_dir):
    changes = store.upsert_changes(_stored(spark, sf_dir), _changed(spark, sf_dir), A.LINE_ORDER)
    return store.upsert_counts(changes)


@query
def upsert_result(spark, sf_dir):
    return store.upsert_result(_stored(spark, sf_dir), _changed(spark, sf_dir), A.LINE_ORDER)


def _runs(spark, sf_dir):
    """Each event as an ingestion run: a started and a finishing log entry."""
    failed = F.col("event_type") == "error"
    started = A.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"), failed.alias("failed")
    )
    none = lambda kind: F.lit(None).cast(kind)
    entries = F.array(
        F.struct(
            F.lit(0).alias("event_seq"),
            F.col("kind").alias("source"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("series_id"),
            F.lit("started").alias("status"),
            F.col("ts").alias("started_at"),
            none("timestamp").alias("finished_at"),
            none("long").alias("rows_seen"),
            none("string").alias("error_message"),
        ),
        F.struct(
            F.lit(1).alias("event_seq"),
            none("string").alias("source"),
            none("string").alias("series_id"),
            F.when(F.col("failed"), "failed").otherwise("succeeded").alias("status"),
            none("timestamp").alias("started_at"),
            (F.col("ts") + F.expr("interval 1 minute")).alias("finished_at"),
            F.when(~F.col("failed"), F.col("user_id")).alias("rows_seen"),
            F.when(F.col("failed"), F.lit("error")).alias("error_message"),
        ),
    )
    log = started.select("id", F.explode(entries).alias("e")).select("id", "e.*")
    log = log.withColumns({c: none("long") for c in ("inserted", "updated", "skipped")})
    return store.run_states(log.withColumn("parameters_json", none("string")))


@query
def run_states(spark, sf_dir):
    return _runs(spark, sf_dir).select("id", "source", "series_id", "status", "started_at", "finished_at", "rows_seen", "error_message")


@query
def list_runs(spark, sf_dir):
    return store.list_runs(_runs(spark, sf_dir), 25, status="failed").select("id", "source", "status", "started_at")


@query
def get_run(spark, sf_dir):
    return store.get_run(_runs(spark, sf_dir), 77).select("id", "source", "series_id", "status", "started_at", "rows_seen")


# Tables that are written and read again, in folders of their own below the staging folder.


def _folder(spark, name):
    return f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def read_release_calendar(spark, sf_dir):
    path = tables.write_table(A.calendar(spark, sf_dir), _folder(spark, "calendar"), "csv", ["reference_period"])
    return calendar.read_release_calendar(spark, path)


@query
def read_dataset(spark, sf_dir):
    """A dataset as CSV text, typed by the operator that reads it."""
    path = tables.write_table(one_feature(spark, sf_dir), _folder(spark, "dataset"), "csv", DATASET_COLUMNS[:3])
    return W.prepare_dataset(tables.read_dataset(spark, path, "csv"), [FEATURE])


@query
def read_forecasts(spark, sf_dir):
    """Both models' forecasts beside their metrics, read back as typed columns."""
    both = naive_and_ridge(spark, sf_dir)
    scored = metrics.metrics_table(both, by_model(both, NAIVE), [NAIVE, "ridge"])
    paths = tables.write_comparison(both, scored, _folder(spark, "comparison"), format="csv")
    return rounded(tables.read_forecasts(spark, paths["forecasts"], "csv"), "prediction")


@query
def read_metrics(spark, sf_dir):
    both = naive_and_ridge(spark, sf_dir)
    scored = metrics.metrics_table(both, by_model(both, NAIVE), [NAIVE, "ridge"])
    paths = tables.write_comparison(both, scored, _folder(spark, "comparison"), format="csv")
    made = tables.read_metrics(spark, paths["metrics"], "csv")
    return rounded(made, "rmse", "mae", "directional_accuracy", "rmse_vs_naive", "mae_vs_naive")


@query
def stable_output_order(spark, sf_dir):
    """Each row of a table written in order, with its place among the rows of its files."""
    order = ["model_name", "forecast_timestamp", "target_id"]
    path = tables.write_table(naive_and_ridge(spark, sf_dir), _folder(spark, "ordered"), "parquet", order)
    rows = spark.read.parquet(path).select(*order, F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    # Files are numbered in the order of the table; a place counts the rows of earlier files.
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    ranked = sizes.alias("a").join(sizes.alias("b"), F.col("b.file") < F.col("a.file"), "left")
    before = ranked.groupBy("a.file", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return rows.join(before, "file").select(*order, (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"))


@query
def preview(spark, sf_dir):
    """The first rows of the ordered dataset and how many there are."""
    first, total = tables.preview(one_feature(spark, sf_dir).orderBy(*DATASET_COLUMNS[:3]), 10)
    return first.withColumn("total_rows", F.lit(total).cast("long"))


@query
def insert_observations(spark, sf_dir):
    target = store.ObservationStore(spark, _folder(spark, "store"))
    target.insert(_stored(spark, sf_dir).select(*OBSERVATION_COLUMNS))
    return target.read()


@query
def run_ingestion(spark, sf_dir):
    """One audited run over released observations: its counts and its parameters as sorted JSON."""
    target = store.ObservationStore(spark, _folder(spark, "store"))
    rows = _stored(spark, sf_dir).where("source = 'fred' and release_date is not null").select(*OBSERVATION_COLUMNS)
    done = target.run_ingestion("fred", "ALL", lambda: rows, payloads.validate_fred, {"mode": "current", "from": "1990"})
    run = target.runs().where(F.col("id") == done["run_id"])
    return run.select("id", "source", "series_id", "status", *[F.col(c).cast("long").alias(c) for c in store.COUNTS], "parameters_json")


@query
def comparison_report(spark, sf_dir):
    """The report's tables that have a row per model, side by side."""
    both = naive_and_ridge(spark, sf_dir)
    scored = metrics.metrics_table(both, by_model(both, NAIVE), [NAIVE, "ridge"])
    made = summaries.comparison_report(scored, both)
    wide = made["metrics"].select("model_name", "rmse", "mae").join(made["forecast_counts"], "model_name")
    return rounded(wide.join(made["prediction_stats"], "model_name"), "rmse", "mae", "prediction_mean", "prediction_std")
