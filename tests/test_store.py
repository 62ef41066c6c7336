import json

import pytest
from helpers import breaks, d, rows, ts
from pyspark.sql import functions as F

from tidemark.plans import commands
from tidemark.schemas import OBSERVATIONS
from tidemark.sources import snapshots
from tidemark.sources import store as store_module
from tidemark.sources.payloads import normalize_fred, validate_fred
from tidemark.sources.snapshots import ConcurrentChange, SnapshotTable
from tidemark.sources.store import COUNTS, ObservationStore
from tidemark.sources.tables import preview, read_dataset, read_forecasts, read_metrics, write_table
from tidemark.streaming.ingest import landing_stream, upsert_stream


@pytest.fixture
def store(spark, tmp_path):
    return ObservationStore(spark, str(tmp_path / "store"))


def batch(spark, value=311.25, release="2019-08-14", fetched="2026-03-04T10:00:00", series="CPIAUCSL", date="2019-07-01", source="fred"):
    released = None if release is None else d(release)
    return spark.createDataFrame([(series, d(date), value, source, released, ts(fetched))], OBSERVATIONS)


def counts(**given):
    return {name: given.get(name, 0) for name in COUNTS}


def test_upsert_inserts_skips_and_updates(spark, store):
    assert store.upsert(batch(spark)) == counts(rows_seen=1, inserted=1)
    assert store.upsert(batch(spark)) == counts(rows_seen=1, skipped=1)
    assert store.upsert(batch(spark, 312.5)) == counts(rows_seen=1, updated=1)
    assert store.upsert(batch(spark, 312.5, fetched="2026-03-05T10:00:00")) == counts(rows_seen=1, updated=1)
    assert rows(store.read().select("value", "fetched_at")) == [(312.5, ts("2026-03-05T10:00:00"))]
    assert store.upsert(batch(spark).limit(0)) == counts()


def test_missing_values_and_release_dates_are_states_too(spark, store):
    assert store.upsert(batch(spark, release=None))["inserted"] == 1
    assert store.upsert(batch(spark, release=None))["skipped"] == 1
    assert store.stored().first().release_date_key == "__MISSING__"
    assert store.upsert(batch(spark, None, release=None))["updated"] == 1
    assert store.upsert(batch(spark, float("nan"), release=None))["skipped"] == 1
    assert store.upsert(batch(spark))["inserted"] == 1
    assert store.read().count() == 2


def test_repeats_inside_a_batch_count_in_order(spark, store):
    steps = [1.0, 1.0, 2.0, 1.0]
    frame = batch(spark, steps[0]).withColumn("seq", F.lit(0))
    for i, value in enumerate(steps[1:], 1):
        frame = frame.unionByName(batch(spark, value).withColumn("seq", F.lit(i)))
    assert store.upsert(frame, ["seq"]) == counts(rows_seen=4, inserted=1, updated=2, skipped=1)
    assert store.read().first().value == 1.0
    assert store.upsert(frame, ["seq"]) == counts(rows_seen=4, updated=2, skipped=2)


def test_only_touched_partitions_are_rewritten(spark, store, tmp_path):
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "observations").rglob("*.parquet")}
    store.upsert(batch(spark).unionByName(batch(spark, date="2021-01-01")).unionByName(batch(spark, source="bls")))
    before = files()
    store.upsert(batch(spark, 1.0))
    assert len(before) == 3 and len(files()) == 4 and before.items() <= files().items()
    assert store.vacuum() == 1 and len(files()) == 3
    kept = {p for p in before if p in files()}
    assert len(kept) == 2 and store.read().count() == 3


def test_a_merge_lost_before_its_swap_changes_nothing(spark, store, monkeypatch):
    store.upsert(batch(spark).unionByName(batch(spark, series="UNRATE")))
    before = rows(store.read(), "series_id")
    with monkeypatch.context() as broken:
        broken.setattr(SnapshotTable, "commit", lambda *_: 1 / 0)
        for change in (store.upsert, store.insert):
            with pytest.raises(ZeroDivisionError):
                change(batch(spark, 1.0, date="2020-05-01"))
    again = ObservationStore(spark, store.layout_path.removesuffix("/layout"))
    assert rows(again.read(), "series_id") == before
    assert again.vacuum() == 2 and rows(again.read(), "series_id") == before
    assert again.upsert(batch(spark, 1.0, date="2020-05-01")) == counts(rows_seen=1, inserted=1)
    assert again.read().count() == 3


def test_readers_keep_their_state_and_a_second_writer_fails(spark, store, monkeypatch):
    store.upsert(batch(spark))
    early, current = store.read(), SnapshotTable.current
    state = store._observations.current()
    store.upsert(batch(spark, 1.0))
    assert early.first().value == 311.25 and store.read().first().value == 1.0
    monkeypatch.setattr(SnapshotTable, "current", lambda self: state if self is store._observations else current(self))
    with pytest.raises(ConcurrentChange):
        store.upsert(batch(spark, 2.0))
    monkeypatch.undo()
    assert store.read().first().value == 1.0


def test_old_lists_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "LISTS_KEPT", 3)
    table = SnapshotTable(spark, str(tmp_path / "t"), OBSERVATIONS)
    assert table.read(table.current().folders).count() == 0 and table.vacuum() == 0
    for i in range(6):
        state = table.current()
        table.commit(state, [*state.folders, *table.write(batch(spark, float(i)))], {"last": i})
    assert table._numbers() == [4, 5, 6] and table.current().notes == {"last": 5}
    assert table.read(table.current().folders).count() == 6
    table.commit(table.current(), [])
    assert table.vacuum(2) == 0 and table.vacuum() == 6 and table.read(table.current().folders).count() == 0


def test_sources_with_odd_names(spark, store):
    names = ["a/b", "x=y%2F", "é ü", "st*r[1]{2}", "#?"]
    for value in (1.0, 2.0):
        made = [store.upsert(batch(spark, value, source=name)) for name in names]
        assert made == [counts(rows_seen=1, **{"inserted" if value == 1 else "updated": 1})] * len(names)
    assert sorted(r.source for r in store.read().where("value = 2").collect()) == sorted(names)
    assert store.read(names[1]).count() == 1


def test_insert_rejects_a_batch_with_known_keys(spark, store):
    assert store.insert(batch(spark)) == 1
    breaks(lambda: store.insert(batch(spark, 1.0)), "not unique")
    two = batch(spark, date="2020-02-01")
    breaks(lambda: store.insert(two.unionByName(two)), "not unique")
    assert store.read().count() == 1
    assert store.insert(batch(spark).limit(0)) == 0
    breaks(lambda: store.insert(batch(spark).drop("value")), "Missing required")
    bad = batch(spark).withColumn("release_date", F.lit("soon"))
    breaks(lambda: store.insert(bad), "not a plain date")


def test_read_and_coverage(spark, store):
    store.upsert(batch(spark).unionByName(batch(spark, source="bls", series="CUSR0000SA0", release=None)))
    assert store.read("fred").first().series_id == "CPIAUCSL"
    assert store.read(series_id="CUSR0000SA0", ordered=True).count() == 1
    found = {r.source: r.missing_release_date_count for r in store.coverage().collect()}
    assert found == {"fred": 0, "bls": 1}
    plan = store.read("fred", "CPIAUCSL")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "source" in filters and "series_bucket" in filters and "EqualTo(series_id,CPIAUCSL)" in scan


def test_bucket_count_is_a_property_of_the_table(spark, store):
    store.upsert(batch(spark).unionByName(batch(spark, series="UNRATE")))
    again = ObservationStore(spark, store.layout_path.removesuffix("/layout"), buckets=3)
    assert again.buckets == 8 and again.read(series_id=["UNRATE", "CPIAUCSL"]).count() == 2


def test_run_log(spark, store):
    assert store.get_run(1) is None and store.list_runs().count() == 0
    first = store.start_run("fred", "A", {"b": 1, "a": d("2019-07-01")})
    assert store.get_run(first)["status"] == "started"
    store.finish_run(first, counts(rows_seen=3, inserted=2, skipped=1))
    second = store.start_run("bls", "B")
    store.fail_run(second, "boom")
    done, failed = store.get_run(first), store.get_run(second)
    assert (done["status"], done["rows_seen"], done["inserted"], done["error_message"]) == ("succeeded", 3, 2, None)
    assert done["parameters_json"] == '{"a": "2019-07-01", "b": 1}' and done["finished_at"] >= done["started_at"]
    assert (failed["status"], failed["rows_seen"], failed["error_message"]) == ("failed", 0, "boom")
    assert [r.id for r in store.list_runs().collect()] == [2, 1]
    assert [r.id for r in store.list_runs(source="fred", status="succeeded").collect()] == [1]
    breaks(lambda: store.list_runs(0), "one run or more")


def test_run_log_stays_in_few_folders(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "EVENT_FOLDERS", 3)
    for i in range(1, 12):
        assert store.start_run("fred", f"S{i}") == i
        store.finish_run(i, counts(rows_seen=i))
        assert len(store._events.current().folders) <= 2 * 4
    found = store.list_runs(20).collect()
    assert [(r.id, r.series_id, r.status, r.rows_seen) for r in found] == [(i, f"S{i}", "succeeded", i) for i in range(11, 0, -1)]
    # Starting a run reads the list and no event, unless it folds some.
    monkeypatch.setattr(store_module, "EVENT_FOLDERS", 100)
    monkeypatch.setattr(SnapshotTable, "read", lambda *_: 1 / 0)
    assert store.start_run("bls", "T") == 12


def land(path, series="CPIAUCSL", months=3, base=100.0):
    path.mkdir(exist_ok=True)
    observations = [
        {"realtime_start": f"2020-0{m + 1}-10", "date": f"2020-0{m}-01", "value": str(base + m)} for m in range(1, months + 1)
    ]
    document = {
        "series_id": series,
        "vintage_mode": "initial_release",
        "fetched_at": "2026-01-01T00:00:00Z",
        "payload": {"observations": observations},
    }
    (path / f"{series}-{months}.json").write_text(json.dumps(document) + "\n")
    return str(path)


def test_ingest_fred_as_an_audited_run(spark, store, tmp_path):
    path = land(tmp_path / "landing")
    result = commands.ingest_fred(store, path, "CPIAUCSL", vintage_mode="initial_release")
    assert result == {"run_id": 1, "status": "succeeded", **counts(rows_seen=3, inserted=3)}
    assert commands.ingest_fred(store, path, "CPIAUCSL")["skipped"] == 3
    with pytest.raises(ZeroDivisionError):
        store.run_ingestion("fred", "X", lambda: 1 / 0, validate_fred)
    assert store.get_run(3)["status"] == "failed" and "division" in store.get_run(3)["error_message"]


def test_ingest_bls_with_a_calendar(spark, store, tmp_path):
    data = [{"year": "2026", "period": f"M0{m}", "value": str(m)} for m in (1, 2)]
    document = {
        "series_id": "CUSR0000SA0",
        "fetched_at": "2026-04-01T00:00:00Z",
        "payload": {"Results": {"series": [{"seriesID": "CUSR0000SA0", "data": data}]}},
    }
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.json").write_text(json.dumps(document) + "\n")
    calendar = tmp_path / "calendar.csv"
    calendar.write_text("release_name,reference_period,release_date,release_time\nCPI,2026-01,2026-02-12,08:30\n")
    path = str(tmp_path / "landing")
    with pytest.raises(ValueError, match="No release date is known for 2026-02"):
        commands.ingest_bls(store, path, "CUSR0000SA0", str(calendar), strict_calendar=True)
    assert store.get_run(1)["status"] == "failed"
    with pytest.warns(RuntimeWarning):
        commands.ingest_bls(store, path, "CUSR0000SA0", str(calendar))
    assert [r.release_date for r in store.read().orderBy("date").collect()] == [d("2026-02-12"), None]
    with pytest.warns(RuntimeWarning, match="No release calendar"):
        assert commands.ingest_bls(store, path, "CUSR0000SA0")["inserted"] == 1
    breaks(lambda: commands.ingest_bls(store, path, "CUSR0000SA0", strict_calendar=True), "requires calendar_path")
    assert commands.check_calendar(spark, str(calendar), "2026-01", "2026-01").first().calendar_rows == 1
    breaks(lambda: commands.check_calendar(spark, str(calendar), "2026-01", "2026-02"), "2026-02")


def test_streaming_merge_is_idempotent(spark, store, tmp_path):
    path = land(tmp_path / "landing", months=2)

    def drain():
        query = upsert_stream(landing_stream(spark, path), store, normalize_fred, validate_fred, str(tmp_path / "checkpoint"))
        query.awaitTermination()

    drain()
    assert store.read().count() == 2
    land(tmp_path / "landing", months=3)
    drain()
    assert store.read().count() == 3


def test_commands_end_to_end(spark, store, tmp_path):
    months = [f"{2018 + i // 12}-{i % 12 + 1:02d}" for i in range(40)]
    data = []
    for i, m in enumerate(months):
        released = f"{2018 + (i + 1) // 12}-{(i + 1) % 12 + 1:02d}-12"
        data.append(("CUSR0000SA0", d(f"{m}-01"), 100.0 + i + i % 3, "bls", d(released), ts("2026-01-01")))
        data.append(("UNRATE", d(f"{m}-01"), 4.0 + i % 5, "fred", d(released.replace("-12", "-05") if not released[5:7] == "12" else released), ts("2026-01-01")))
    store.upsert(spark.createDataFrame(data, OBSERVATIONS))
    assert commands.build_target(store).count() == 39
    out = str(tmp_path / "out")
    matrix = commands.build_feature_matrix(store, features=["UNRATE"], include_lagged_target=True, output=f"{out}/matrix", format="csv")
    assert matrix.columns[-2:] == ["feature_UNRATE_latest", "feature_target_lag_1"]
    dataset = read_dataset(spark, f"{out}/matrix", "csv")
    assert dataset.count() == 39
    assert rows(commands.feature_diagnostics(dataset, f"{out}/missing"), "feature_name")[0][:2] == ("feature_UNRATE_latest", 0)
    checked = commands.validate_model(dataset, "ridge", output=f"{out}/ridge")
    assert checked["forecasts"].count() == 15 and checked["verdicts"].count() == 1
    assert "comparison" not in commands.validate_model(dataset, "naive_last_value")
    made = commands.compare(dataset, output_dir=out, report_dir=f"{out}/report", include_charts=True)
    assert made["metrics"].count() == 2
    assert read_forecasts(spark, f"{out}/model_comparison_forecasts").count() == 30
    assert read_metrics(spark, f"{out}/model_comparison_metrics").count() == 2
    assert spark.read.parquet(f"{out}/report/summary").first().forecast_rows == 30
    assert spark.read.parquet(f"{out}/report/predictions_vs_actuals").count() == 45
    breaks(lambda: commands.compare(dataset, include_charts=True), "requires report_dir")
    write_table(made["metrics"], f"{out}/metrics_csv", "csv", ["model_name"])
    assert rows(read_metrics(spark, f"{out}/metrics_csv", "csv"), "model_name") == rows(made["metrics"], "model_name")
    first, total = preview(dataset)
    assert first.count() == 10 and total == 39
    breaks(lambda: write_table(dataset, f"{out}/x", "xml"), "Unsupported format")
