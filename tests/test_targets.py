from pyspark.sql import functions as F
from helpers import OBS, breaks, d, rows

from tidemark.operators.targets import mom_target, normalize_targets, target_shell, validate_targets

CPI = [
    ("CUSR0000SA0", "bls", "2026-01-01", 100.0, "2026-02-12"),
    ("CUSR0000SA0", "bls", "2026-02-01", 101.0, "2026-03-11"),
    ("CUSR0000SA0", "bls", "2026-03-01", 103.02, "2026-04-10"),
]


def obs(spark, data=CPI):
    return spark.createDataFrame(data, OBS)


def test_percent_change_of_each_month(spark):
    found = mom_target(obs(spark)).orderBy("reference_date").collect()
    assert [r.reference_date for r in found] == [d("2026-02-01"), d("2026-03-01")]
    assert [round(r.target_value, 9) for r in found] == [1.0, 2.0]
    assert {(r.target_id, r.target_units, r.source) for r in found} == {("cpi_mom", "percent", "bls")}


def test_other_series_and_sources_do_not_count(spark):
    data = CPI + [("OTHER", "bls", "2026-01-01", 1.0, "2026-02-01"), ("CUSR0000SA0", "fred", "2026-01-01", 5.0, "2026-02-01")]
    assert mom_target(obs(spark, data)).count() == 2
    assert mom_target(obs(spark), "OTHER").count() == 0


def test_missing_release_date_is_an_error_only_if_strict(spark):
    data = [CPI[0], (*CPI[1][:4], None), CPI[2]]
    breaks(lambda: mom_target(obs(spark, data)), "strict")
    found = mom_target(obs(spark, data), strict=False).orderBy("reference_date").collect()
    assert [r.release_date for r in found] == [None, d("2026-04-10")]


def test_duplicates_and_unreadable_input_fail(spark):
    breaks(lambda: mom_target(obs(spark, [*CPI, CPI[1]])), "Duplicate observations")
    none = (*CPI[1][:4], None)
    breaks(lambda: mom_target(obs(spark, [CPI[0], none, none]), strict=False), "Duplicate observations")
    breaks(lambda: mom_target(obs(spark, [*CPI, (*CPI[1][:4], "soon")])), "release_date is not a plain date")
    text = obs(spark).withColumn("value", F.lit("abc"))
    breaks(lambda: mom_target(text), "value is not a number")
    breaks(lambda: mom_target(obs(spark).drop("value")), "Missing required observation columns")


def test_previous_row_may_be_another_vintage_of_the_same_month(spark):
    data = [
        ("S", "bls", "2026-01-01", 100.0, "2026-02-12"),
        ("S", "bls", "2026-01-01", 110.0, "2026-03-12"),
        ("S", "bls", "2026-03-01", 121.0, "2026-04-10"),
    ]
    found = rows(mom_target(obs(spark, data), "S").select("reference_date", F.round("target_value", 6)), "reference_date")
    assert found == [(d("2026-01-01"), 10.0), (d("2026-03-01"), 10.0)]


def test_zero_and_missing_previous_values(spark):
    values = [0.0, 5.0, 0.0, 0.0, None, 7.0]
    data = [("S", "bls", f"2026-0{i + 1}-01", v, f"2026-1{i % 3}-0{i + 1}") for i, v in enumerate(values)]
    found = rows(mom_target(obs(spark, data), "S").select("reference_date", "target_value"), "reference_date")
    assert found == [(d("2026-02-01"), float("inf")), (d("2026-03-01"), -100.0)]


def test_many_series_at_once(spark):
    data = [("A", "bls", f"2026-0{i}-01", float(i), f"2026-0{i + 1}-05") for i in (1, 2, 3)]
    data += [("B", "fred", f"2026-0{i}-01", float(i * i), f"2026-0{i + 1}-05") for i in (1, 2, 3)]
    made = mom_target(obs(spark, data), None, None, target_id=F.col("series_id"), target_name=F.col("series_id"))
    assert rows(made.groupBy("target_id").count(), "target_id") == [("A", 2), ("B", 2)]


def valid(spark, **changes):
    made = mom_target(obs(spark))
    return made.withColumns({name: F.lit(v) for name, v in changes.items()})


def test_target_contract(spark):
    assert validate_targets(valid(spark)).count() == 2
    breaks(lambda: validate_targets(valid(spark, release_date=None)), "has no release_date")
    breaks(lambda: validate_targets(valid(spark, reference_date="2026-02-01")), "Duplicate target")
    breaks(lambda: validate_targets(valid(spark, release_date="2026-02-28")), "before its month ended")
    other = valid(spark, target_id="other", release_date="2026-02-28")
    assert validate_targets(other).count() == 2
    breaks(lambda: validate_targets(valid(spark).drop("source")), "Missing required target columns")


def test_shells(spark):
    shell = target_shell(mom_target(obs(spark)))
    assert shell.columns[0] == "forecast_timestamp" and shell.count() == 2
    relaxed = target_shell(valid(spark, release_date=None), validate=False)
    assert relaxed.where("forecast_timestamp is null").count() == 2


def test_normalize_targets_takes_both_shapes(spark):
    full = mom_target(obs(spark))
    assert rows(normalize_targets(full), "target_reference_date") == rows(
        normalize_targets(target_shell(full)), "target_reference_date"
    )
    shell = target_shell(full)
    breaks(lambda: normalize_targets(shell.unionByName(shell)), "Duplicate target")
    breaks(lambda: normalize_targets(shell.withColumn("forecast_timestamp", F.lit(None))), "forecast_timestamp cannot")
