import json

import pytest
from helpers import breaks, d, rows, ts
from pyspark.sql import functions as F

from tidemark.sources import calendar as C
from tidemark.sources import catalog
from tidemark.sources import payloads as P
from tidemark.sources.payloads import LANDING


def landed(spark, payload, mode=None, requested=None, series="CPIAUCSL"):
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return spark.createDataFrame([(series, mode, requested, ts("2026-03-04T10:00:00"), text)], LANDING)


def fred(*observations, **top):
    return {"realtime_start": "2026-05-01", "observations": list(observations), **top}


ONE = {"realtime_start": "2019-08-14", "date": "2019-07-01", "value": "311.25"}


def test_fred_rows(spark):
    made = P.normalize_fred(landed(spark, fred(ONE, {**ONE, "date": "2019-08-01", "value": "."}, {**ONE, "date": "2019-09-01", "value": "x"})))
    assert rows(made.select("date", "value", "source", "release_date"), "date") == [
        (d("2019-07-01"), 311.25, "fred", d("2019-08-14")),
        (d("2019-08-01"), None, "fred", d("2019-08-14")),
        (d("2019-09-01"), None, "fred", d("2019-08-14")),
    ]
    assert P.normalize_fred(landed(spark, fred())).count() == 0
    breaks(lambda: P.normalize_fred(landed(spark, {"realtime_start": "2026-05-01"})), "without observations")
    breaks(lambda: P.normalize_fred(landed(spark, fred({**ONE, "date": "soon"}))), "date is not a plain date")
    breaks(lambda: P.normalize_fred(landed(spark, fred(ONE), "newest")), "Unsupported vintage_mode")


def test_a_null_is_not_an_absent_field(spark):
    without = lambda name: {k: v for k, v in ONE.items() if k != name}
    made = P.normalize_fred(landed(spark, fred({**ONE, "value": None})))
    assert rows(made.select("date", "value")) == [(d("2019-07-01"), None)]
    breaks(lambda: P.normalize_fred(landed(spark, fred(without("value")))), "lack values")
    breaks(lambda: P.normalize_fred(landed(spark, fred(without("date")))), "lack dates")
    assert P.normalize_fred(landed(spark, fred({**ONE, "date": None}))).first().date is None
    # A null release date is the row's own, so the response's start does not replace it.
    assert P.normalize_fred(landed(spark, fred({**ONE, "realtime_start": None}))).first().release_date is None
    entry = {"year": "2026", "period": "M01"}
    assert P.normalize_bls(landed(spark, bls({**entry, "value": None}), series="CUSR0000SA0")).first().value is None
    breaks(lambda: P.normalize_bls(landed(spark, bls(entry), series="CUSR0000SA0")), "lack values")


def test_fred_release_dates_by_mode(spark):
    bare = {"date": "2019-07-01", "value": "1"}
    release = lambda df: [r.release_date for r in P.normalize_fred(df).orderBy("date").collect()]
    assert release(landed(spark, fred(ONE), "initial_release")) == [d("2019-08-14")]
    breaks(lambda: P.normalize_fred(landed(spark, fred(bare), "initial_release")), "own realtime_start")
    breaks(lambda: P.normalize_fred(landed(spark, fred(ONE, bare), "initial_release")), "own realtime_start")
    assert release(landed(spark, fred(bare), "realtime_period", "2019-01-01")) == [d("2019-01-01")]
    assert release(landed(spark, fred(bare))) == [d("2026-05-01")]
    breaks(lambda: P.normalize_fred(landed(spark, fred(bare, realtime_start=None))), "have no realtime_start")
    # Once one observation is dated, an undated one stays undated.
    later = {**bare, "date": "2019-08-01"}
    assert release(landed(spark, fred(ONE, later))) == [d("2019-08-14"), None]


def test_overlapping_chunks_keep_each_row_once(spark):
    two = landed(spark, fred(ONE)).unionByName(landed(spark, fred(ONE, {**ONE, "date": "2019-08-01"})))
    assert P.normalize_fred(two).count() == 3
    assert P.normalize_fred(two, merge_chunks=True).count() == 2


def bls(*data, name="seriesID", series="CUSR0000SA0"):
    return {"status": "OK", "Results": {"series": [{name: "other", "data": []}, {name: series, "data": list(data)}]}}


def test_bls_rows(spark):
    data = [
        {"year": "2026", "period": "M01", "periodName": "January", "value": "100.5"},
        {"year": "2026", "period": "M12", "value": "not_available"},
    ]
    for name in ("seriesID", "seriesId"):
        made = P.normalize_bls(landed(spark, bls(*data, name=name), series="CUSR0000SA0"))
        assert rows(made.select("date", "value", "source", "release_date"), "date") == [
            (d("2026-01-01"), 100.5, "bls", None),
            (d("2026-12-01"), None, "bls", None),
        ]


def test_bls_errors(spark):
    one = {"year": "2026", "period": "M01", "value": "1"}
    get = lambda payload, series="CUSR0000SA0": P.normalize_bls(landed(spark, payload, series=series))
    breaks(lambda: get(bls({**one, "period": "M13"})), "M13")
    breaks(lambda: get(bls({**one, "period": "Q01"})), "Q01")
    breaks(lambda: get(bls(one), "NONE"), "without requested series")
    breaks(lambda: get({"Results": {"series": []}}), "without Results.series")
    breaks(lambda: get({"Results": {"series": [{"seriesID": "CUSR0000SA0"}]}}), "without data")
    breaks(lambda: get(bls({"year": "2026", "value": "1"})), "without year or period")
    assert get(bls()).count() == 0


def observations(spark, **changes):
    frame = P.normalize_fred(landed(spark, fred(ONE)))
    return frame.withColumns({k: F.lit(v) for k, v in changes.items()})


def test_observation_contracts(spark):
    assert P.validate_fred(observations(spark)).count() == 1
    assert P.validate_fred(observations(spark).limit(0)).count() == 0
    breaks(lambda: P.validate_fred(observations(spark, source="bls")), "source='fred'")
    breaks(lambda: P.validate_fred(observations(spark, source=None)), "source='fred'")
    breaks(lambda: P.validate_fred(observations(spark, series_id=None)), "series_id is missing")
    breaks(lambda: P.validate_fred(observations(spark, release_date=None)), "release_date is missing")
    breaks(lambda: P.validate_fred(observations(spark, value="abc")), "value is not a number")
    breaks(lambda: P.validate_fred(observations(spark).drop("value")), "Missing required")
    own = observations(spark, source="bls", release_date=None, value="abc")
    assert P.validate_bls(own).first().value is None
    breaks(lambda: P.validate_bls(observations(spark, source="bls", release_date="soon")), "not a plain date")
    breaks(lambda: P.validate_bls(observations(spark, source="bls", date=None)), "date is missing")


CSV = "release_name,reference_period,release_date,release_time\nCPI,2026-03,2026-04-10,08:30\nCPI,2026-01,2026-02-12,08:30\n"


@pytest.fixture
def calendar_file(tmp_path):
    def write(text=CSV):
        path = tmp_path / f"calendar{len(list(tmp_path.iterdir()))}.csv"
        path.write_text(text)
        return str(path)

    return write


def test_calendar_file(spark, calendar_file):
    calendar = C.read_release_calendar(spark, calendar_file())
    assert rows(calendar.select("reference_period", "release_date"), "reference_period") == [
        ("2026-01", d("2026-02-12")),
        ("2026-03", d("2026-04-10")),
    ]
    assert C.calendar_summary(calendar).first().calendar_rows == 2
    breaks(lambda: C.read_release_calendar(spark, calendar_file() + ".none"), "PATH_NOT_FOUND")
    breaks(lambda: C.read_release_calendar(spark, calendar_file(CSV.splitlines()[0] + "\n")), "cannot be empty")
    breaks(lambda: C.read_release_calendar(spark, calendar_file(CSV.replace("release_time", "hour"))), "Missing required")
    for old, new, message in [
        ("2026-03,", "2026-01-15,", "Duplicate reference_period"),
        ("2026-04-10", "2026-03-31", "after the reference month ends"),
        ("2026-04-10", "never", "not a plain date"),
        ("2026-04-10", "", "release_date cannot be missing"),
        ("10,08:30", "10, ", "release_time cannot"),
        ("2026-03,", ",", "missing, blank or not a date"),
    ]:
        breaks(lambda: C.read_release_calendar(spark, calendar_file(CSV.replace(old, new))), message)


def test_calendar_coverage_and_mapping(spark, calendar_file):
    calendar = C.read_release_calendar(spark, calendar_file())
    months = spark.createDataFrame([(d(f"2026-0{i}-01"), d("2000-01-01")) for i in (1, 2, 3)], "date date, release_date date")
    assert rows(C.calendar_gaps(months, calendar)) == [("2026-02",)]
    with pytest.raises(C.CalendarCoverageError, match="2026-02"):
        C.assert_calendar_coverage(months, calendar)
    with pytest.warns(RuntimeWarning, match="2026-02"):
        C.assert_calendar_coverage(months, calendar, strict=False)
    mapped = C.map_release_dates(months, calendar)
    assert rows(mapped, "date") == [
        (d("2026-01-01"), d("2026-02-12")),
        (d("2026-02-01"), None),
        (d("2026-03-01"), d("2026-04-10")),
    ]
    assert rows(C.calendar_range_gaps(calendar, "2025-12", "2026-03"), "reference_period") == [("2025-12",), ("2026-02",)]
    breaks(lambda: C.calendar_range_gaps(calendar, "2026-01", None), "together")
    breaks(lambda: C.calendar_range_gaps(calendar, "2026-03", "2026-01"), "before or equal")
    breaks(lambda: C.calendar_gaps(months.withColumn("date", F.lit(None).cast("date")), calendar), "cannot be missing")


def test_catalog(spark):
    known = catalog.series_catalog(spark)
    assert known.count() == 20 and known.where("source = 'bls'").count() == 4
    frame = spark.createDataFrame([("DGS2", "fred", 1.0), ("NONE", "fred", 2.0)], "series_id string, source string, value double")
    found = {r.series_id: r.frequency_hint for r in catalog.enrich_series(frame).collect()}
    assert found == {"DGS2": "daily", "NONE": None}
