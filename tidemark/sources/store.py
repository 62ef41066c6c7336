"""The observation table and its ingestion log as Parquet folders.

Observations are partitioned by source, year of the period and a hash bucket of the
series. A merge writes anew only the partitions its batch touches, which for the usual batch
of one series is one bucket of a few years, and then swaps the table's list of folders; until
that moment, and if it never comes, readers see the old table (see ``snapshots``). The state
of a run is its latest event. Events are folded into larger and larger folders, so starting
or listing runs opens few of them however many there are. Both expect one writer at a time;
a second one fails at its swap.
"""

import json
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import quality as Q
from tidemark.functions import scalars as S
from tidemark.functions.ordered import timeline
from tidemark.operators.diagnostics import coverage
from tidemark.operators.targets import filter_series
from tidemark.schemas import (
    FAILED,
    OBSERVATION_COLUMNS,
    OBSERVATIONS,
    RUN_COLUMNS,
    RUN_EVENTS,
    STARTED,
    SUCCEEDED,
    VINTAGE_KEY,
)
from tidemark.session import stage
from tidemark.sources.snapshots import Snapshot, SnapshotTable

COUNTS = ["rows_seen", "inserted", "updated", "skipped"]
STORED = T.StructType(
    [
        *OBSERVATIONS.fields,
        T.StructField("release_date_key", T.StringType()),
        T.StructField("period_year", T.IntegerType()),
        T.StructField("series_bucket", T.IntegerType()),
    ]
)
PARTITIONS = ["source", "period_year", "series_bucket"]
#: So many folders of events become one folder of the next level.
EVENT_FOLDERS = 32
LAYOUT = T.StructType([T.StructField("buckets", T.IntegerType(), False)])


def coerce_observations(observations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Observations as the table stores them, with their release date key.

    Unreadable dates and values are errors, a missing release date is not.
    """
    Q.require_columns(observations, [*OBSERVATION_COLUMNS, *keep], "observation")
    typed = observations.select(
        "series_id",
        S.day(observations, "date").alias("date"),
        S.number(observations, "value", strict=True).alias("value"),
        "source",
        S.day(observations, "release_date").alias("release_date"),
        S.moment(observations, "fetched_at").alias("fetched_at"),
        *[c for c in keep if c not in OBSERVATION_COLUMNS],
    )
    required = [c for c in ("series_id", "source", "date", "fetched_at")]
    checked = Q.guard(typed, *[(F.col(c).isNull(), f"{c} cannot be missing.") for c in required])
    return checked.withColumn("release_date_key", S.release_date_key(F.col("release_date")))


def upsert_changes(
    stored: DataFrame, batch: DataFrame, order_by: Sequence[str] = ("fetched_at", "value"), rows_per_tile: int | None = None
) -> DataFrame:
    """The batch rows with ``action``: inserted, updated or skipped.

    Rows count in ``order_by`` order within their vintage key, each against the state the
    previous one left behind. Stored rows enter only if the batch names their key.
    """
    extra = [c for c in order_by if c not in (*VINTAGE_KEY, "value", "fetched_at")]
    wanted = batch.select(*VINTAGE_KEY).distinct()
    known = stored.join(wanted, VINTAGE_KEY, "left_semi").select(
        *VINTAGE_KEY, "value", "fetched_at", *[F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in extra], F.lit(0).alias("_new")
    )
    rows = known.unionByName(batch.select(*VINTAGE_KEY, "value", "fetched_at", *extra, F.lit(1).alias("_new")))
    # The table adds at most one row per key, so the batch alone tells how large groups are.
    line = timeline(rows, VINTAGE_KEY, ["_new", *order_by], measured=batch, rows_per_tile=rows_per_tile)
    seen = line.look_back(1, lambda w: {"_was": F.lag(F.struct("value", "fetched_at")).over(w)}).rows()
    same = F.col("value").eqNullSafe(F.col("_was.value")) & F.col("fetched_at").eqNullSafe(F.col("_was.fetched_at"))
    action = F.when(F.col("_was").isNull(), "inserted").when(same, "skipped").otherwise("updated")
    return seen.where("_new = 1").withColumn("action", action).drop("_new", "_was")


def upsert_counts(changes: DataFrame) -> DataFrame:
    """rows_seen, inserted, updated and skipped in one row."""
    return changes.agg(
        F.count(F.lit(1)).alias("rows_seen"),
        *[F.count_if(F.col("action") == name).alias(name) for name in COUNTS[1:]],
    )


def upsert_result(stored: DataFrame, batch: DataFrame, order_by: Sequence[str] = ("fetched_at", "value")) -> DataFrame:
    """The table after the merge: stored rows the batch does not name, plus its last states."""
    order = F.struct(*[part.alias(f"o{i}") for i, part in enumerate(p for c in order_by for p in S.last_key(c))])
    latest = (
        batch.groupBy(*VINTAGE_KEY)
        .agg(F.max_by(F.struct("value", "release_date", "fetched_at"), order).alias("s"))
        .select(*VINTAGE_KEY, "s.*")
    )
    columns = [*OBSERVATION_COLUMNS, "release_date_key"]
    kept = stored.join(batch.select(*VINTAGE_KEY).distinct(), VINTAGE_KEY, "left_anti")
    return kept.select(*columns).unionByName(latest.select(*columns))


def run_states(events: DataFrame) -> DataFrame:
    """One row per run from its events."""
    latest = lambda c: F.max_by(c, "event_seq").alias(c)
    states = events.groupBy("id").agg(
        F.max("source").alias("source"),
        F.max("series_id").alias("series_id"),
        latest("status"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in COUNTS],
        latest("error_message"),
        F.max("parameters_json").alias("parameters_json"),
    )
    return states.select(*RUN_COLUMNS)


def list_runs(runs: DataFrame, limit: int = 10, source: str | None = None, status: str | None = None) -> DataFrame:
    """The newest runs first; a top-k, so nothing is sorted as a whole."""
    if limit < 1:
        raise ValueError("Ask for one run or more.")
    if source is not None:
        runs = runs.where(F.col("source") == source)
    if status is not None:
        runs = runs.where(F.col("status") == status)
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)


def get_run(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.where(F.col("id") == run_id)


class ObservationStore:
    """Observations and ingestion runs under one folder.

    ``buckets`` is fixed by the first write; raise it for tables with many series.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark = spark
        base = path.rstrip("/")
        self.observations_path = f"{base}/observations"
        self.runs_path = f"{base}/ingestion_runs"
        self.layout_path = f"{base}/layout"
        self._observations = SnapshotTable(spark, self.observations_path, STORED)
        self._events = SnapshotTable(spark, self.runs_path, RUN_EVENTS)
        written = self._table(self.layout_path, LAYOUT).first()
        self.buckets = written.buckets if written else buckets

    def _bucket(self, series: Column) -> Column:
        return F.pmod(F.xxhash64(series), F.lit(self.buckets)).cast("int")

    def _table(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def stored(self) -> DataFrame:
        return self._observations.read(self._observations.current().folders)

    def vacuum(self) -> int:
        """Delete folders that neither table uses any more; readers of older states break."""
        return self._observations.vacuum() + self._events.vacuum()

    def read(self, source: str | None = None, series_id=None, ordered: bool = False) -> DataFrame:
        """Observations; ``source`` and ``series_id`` prune partitions and reach the files."""
        rows = filter_series(self._pruned(series_id), series_id, source).select(*OBSERVATION_COLUMNS)
        return rows.orderBy("source", "series_id", "date", "release_date") if ordered else rows

    def _pruned(self, series_id) -> DataFrame:
        """Stored rows of the buckets that these series fall into; of all buckets without series."""
        if series_id is None:
            return self.stored()
        names = [series_id] if isinstance(series_id, str) else list(series_id)
        wanted = [self._bucket(F.lit(name)) for name in names]
        buckets = set(self.spark.range(1).select(F.array(*wanted)).first()[0])
        folders = [f for f in self._observations.current().folders if _partition(f)[2] in buckets]
        return self._observations.read(folders).where(F.col("series_bucket").isin(wanted))

    def coverage(self, source: str | None = None, series_id: str | None = None) -> DataFrame:
        return coverage(self._pruned(series_id), source, series_id)

    def insert(self, observations: DataFrame) -> int:
        """Append; a key that repeats, in the batch or in the table, rejects all of it."""
        batch = stage(coerce_observations(observations))
        state = self._observations.current()
        repeated = Q.duplicate_keys(batch, VINTAGE_KEY).limit(5).collect()
        known = self._observations.read(self._touched(state, batch))
        present = known.join(batch.select(*VINTAGE_KEY), VINTAGE_KEY, "left_semi").limit(5).collect()
        if repeated or present:
            raise Q.ContractError(f"Vintage keys not unique: {[r.asDict() for r in [*repeated, *present]]}")
        rows = batch.count()
        if rows:
            self._observations.commit(state, [*state.folders, *self._write(batch)])
        return rows

    def upsert(self, observations: DataFrame, order_by: Sequence[str] = ("fetched_at", "value")) -> dict[str, int]:
        """Merge by vintage key; running the same batch again changes nothing."""
        keep = [c for c in order_by if c not in OBSERVATION_COLUMNS]
        batch = stage(coerce_observations(observations, keep))
        state = self._observations.current()
        touched = self._touched(state, batch)
        current = self._observations.read(touched)
        counts = upsert_counts(upsert_changes(current, batch, order_by)).first().asDict()
        if counts["inserted"] or counts["updated"]:
            made = self._write(upsert_result(current, batch, order_by))
            replaced = set(touched)
            self._observations.commit(state, [*[f for f in state.folders if f not in replaced], *made])
        return counts

    def _touched(self, state: Snapshot, batch: DataFrame) -> list[str]:
        """Folders of the partitions that the batch falls into."""
        parts = batch.select("source", F.year("date"), self._bucket(F.col("series_id"))).distinct()
        wanted = {tuple(row) for row in parts.collect()}
        return [folder for folder in state.folders if _partition(folder) in wanted]

    def _write(self, rows: DataFrame) -> list[str]:
        if self._table(self.layout_path, LAYOUT).isEmpty():
            layout = self.spark.createDataFrame([(self.buckets,)], LAYOUT)
            layout.coalesce(1).write.mode("append").parquet(self.layout_path)
        # Rebalancing groups files by partition and splits a partition that is large.
        placed = rows.select(
            *OBSERVATION_COLUMNS,
            "release_date_key",
            F.year("date").alias("period_year"),
            self._bucket(F.col("series_id")).alias("series_bucket"),
        )
        return self._observations.write(placed.hint("rebalance", *PARTITIONS), PARTITIONS)

    def runs(self) -> DataFrame:
        return run_states(self._events.read(self._events.current().folders))

    def list_runs(self, limit: int = 10, source: str | None = None, status: str | None = None) -> DataFrame:
        return list_runs(self.runs(), limit, source, status)

    def get_run(self, run_id: int) -> dict | None:
        row = get_run(self.runs(), run_id).first()
        return None if row is None else row.asDict()

    def _log(self, state: Snapshot, run_id: int, seq: int, status: str, **values) -> None:
        event = {name: None for name in RUN_EVENTS.fieldNames()} | values
        event |= {"id": run_id, "event_seq": seq, "status": status}
        row = self.spark.createDataFrame([tuple(event[n] for n in RUN_EVENTS.fieldNames())], RUN_EVENTS)
        folders = [*state.folders, *self._events.write(row.coalesce(1), under="level=0/")]
        level = 0
        while len(full := [f for f in folders if f.startswith(f"level={level}/")]) >= EVENT_FOLDERS:
            level += 1
            folded = self._events.write(self._events.read(full).coalesce(1), under=f"level={level}/")
            folders = [*[f for f in folders if f not in full], *folded]
        self._events.commit(state, folders, {"last_id": max(run_id, state.notes.get("last_id", 0))})

    def start_run(self, source: str, series_id: str, parameters: dict | None = None) -> int:
        state = self._events.current()
        run_id = state.notes.get("last_id", 0) + 1
        text = json.dumps(parameters or {}, sort_keys=True, default=str)
        self._log(state, run_id, 0, STARTED, source=source, series_id=series_id, started_at=_now(), parameters_json=text)
        return run_id

    def finish_run(self, run_id: int, counts: dict[str, int]) -> None:
        self._log(self._events.current(), run_id, 1, SUCCEEDED, finished_at=_now(), **{c: int(counts.get(c, 0)) for c in COUNTS})

    def fail_run(self, run_id: int, message: str) -> None:
        self._log(self._events.current(), run_id, 1, FAILED, finished_at=_now(), error_message=message)

    def run_ingestion(
        self,
        source: str,
        series_id: str,
        fetch: Callable[[], DataFrame],
        validate: Callable[[DataFrame], DataFrame],
        parameters: dict | None = None,
        store: Callable[[DataFrame], dict[str, int]] | None = None,
    ) -> dict:
        """Fetch, validate and store as one audited run; a failure is logged and raised."""
        run_id = self.start_run(source, series_id, parameters)
        try:
            counts = (store or self.upsert)(validate(fetch()))
            self.finish_run(run_id, counts)
        except Exception as error:
            self.fail_run(run_id, str(error))
            raise
        return {"run_id": run_id, "status": SUCCEEDED, **counts}


def _partition(folder: str) -> tuple[str, int, int]:
    """Source, year and bucket from a folder's name."""
    values = dict(part.split("=", 1) for part in folder.split("/"))
    return unquote(values["source"]), int(values["period_year"]), int(values["series_bucket"])


def _now() -> datetime:
    return datetime.now(UTC)
