import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.functions import ordered, ranks
from tidemark.functions.ordered import measure, measure_up_to, timeline
from tidemark.functions.ranks import exact_medians, exact_ranks
from tidemark.operators.transforms import difference, percent_change, rolling_z_score
from tidemark.session import stage_path


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds two thirds of the rows; some values are missing."""
    rng = random.Random(1)
    data = [("hot" if i % 3 else rng.choice("ab"), i, float(rng.randrange(9)) if i % 5 else None) for i in range(900)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t long, v double").cache()


def all_columns(df, by, rows_per_tile):
    line = timeline(df, by, ["t"], rows_per_tile=rows_per_tile)
    line = line.look_back(7, lambda w: {"l1": F.lag("v").over(w), "l7": F.lag("t", 7).over(w)})
    line = line.number("n").running({"s": F.coalesce(F.col("v"), F.lit(0.0))})
    return line.carry_forward("c", F.col("v")).first_known({"v": "f"})


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("rows_per_tile", [120, 4])
def test_tiles_do_not_change_results(hot, by, rows_per_tile):
    plain, split = all_columns(hot, by, 10**6), all_columns(hot, by, rows_per_tile)
    assert split.split and not plain.split
    columns = hot.columns + ["l1", "l7", "n", "s", "c", "f"]
    assert rows(split.rows().select(*columns), "t") == rows(plain.rows().select(*columns), "t")


def test_tiles_bound_the_largest_task(hot):
    split = timeline(hot, ["k"], ["t"], rows_per_tile=100)
    assert split.frame.groupBy("k", "_tile").count().agg(F.max("count")).first()[0] < 250


def test_full_copies_are_split_too(spark):
    copies = spark.range(600).select(F.lit("k").alias("k"), F.lit(1).alias("t"), F.lit(2.0).alias("v"))
    split = timeline(copies, ["k"], ["t"], rows_per_tile=100)
    assert split.frame.groupBy("_tile").count().agg(F.max("count")).first()[0] < 300
    numbered = split.number("n").running({"s": F.col("v")}).rows()
    assert sorted(r.n for r in numbered.collect()) == list(range(1, 601))
    assert numbered.agg(F.max("s")).first()[0] == 1198.0 and numbered.columns == ["k", "t", "v", "n", "s"]


def test_measure_counts_once(hot):
    sizes = measure(hot, ["k"], "v")
    assert (sizes.rows, sizes.dropped) == (720, 180) and sizes.largest_group == 480


def test_measure_up_to_finds_the_same_cuts(hot, spark, monkeypatch):
    nothing = spark.range(0).select(F.lit("k").alias("k"))
    for slots in (1, 2, 1 << 14):
        monkeypatch.setattr(ordered, "SLOTS", slots)
        for limit in (10, 599, 600, 10**6):
            for by in (["k"], []):
                sizes, exact = measure_up_to(hot, by, limit), measure(hot, by)
                assert sizes.rows == 900 and (sizes.largest_group > limit) == (exact.largest_group > limit)
        assert measure_up_to(nothing, ["k"], 5).rows == 0


def test_costly_inputs_are_computed_once(hot, monkeypatch):
    staged = []
    monkeypatch.setattr(ordered, "stage", lambda df: staged.append(df) or df)
    scan = hot.sparkSession.read.parquet(stage_path(hot))
    timeline(scan.where("v > 1").withColumn("x", F.col("v") + 1), ["k"], ["t"])
    assert not staged
    timeline(scan.groupBy("k").agg(F.max("t").alias("t")), ["k"], ["t"])
    assert len(staged) == 1


def test_transforms(spark):
    frame = spark.createDataFrame([("s", i, v) for i, v in enumerate([100.0, 105.0, 110.25])], "k string, t int, v double")
    pick = lambda df, c: [None if r[0] is None else round(r[0], 9) for r in df.orderBy("t").select(c).collect()]
    assert pick(percent_change(frame, "v", ["k"], ["t"]), "percent_change") == [None, 5.0, 5.0]
    frame2 = spark.createDataFrame([("s", i, v) for i, v in enumerate([100.0, 105.0, 103.0])], "k string, t int, v double")
    assert pick(difference(frame2, "v", ["k"], ["t"]), "difference") == [None, 5.0, -2.0]
    frame3 = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, 2.0, 3.0])], "k string, t int, v double")
    assert pick(rolling_z_score(frame3, "v", ["k"], ["t"], 3), "rolling_z_score") == [None, None, 1.0]
    with pytest.raises(ValueError):
        rolling_z_score(frame3, "v", ["k"], ["t"], 1)


def test_transforms_with_missing_values(spark):
    frame = spark.createDataFrame([("s", i, v) for i, v in enumerate([100.0, None, 110.0, 0.0, 0.0])], "k string, t int, v double")
    pick = lambda df, c: [None if r[0] is None else round(r[0], 9) for r in df.orderBy("t").select(c).collect()]
    assert pick(percent_change(frame, "v", ["k"], ["t"]), "percent_change") == [None, 0.0, 10.0, -100.0, None]
    bare = percent_change(frame, "v", ["k"], ["t"], carry_forward=False)
    assert pick(bare, "percent_change") == [None, None, None, -100.0, None]
    assert pick(rolling_z_score(frame, "v", ["k"], ["t"], 2), "rolling_z_score")[1:3] == [None, None]
    # A constant window has no deviation, so no score.
    assert pick(rolling_z_score(frame, "v", ["k"], ["t"], 2), "rolling_z_score")[4] is None


@pytest.mark.parametrize("by", [["k"], []])
def test_transforms_on_tiles(hot, by):
    for make in (
        lambda **s: percent_change(hot, "v", by, ["t"], periods=3, out="x", **s),
        lambda **s: difference(hot, "v", by, ["t"], periods=2, out="x", **s),
        lambda **s: rolling_z_score(hot, "v", by, ["t"], 4, out="x", **s),
    ):
        clean = lambda df: [(r.t, None if r.x is None else round(r.x, 9)) for r in df.orderBy("t").collect()]
        assert clean(make(rows_per_tile=50)) == clean(make(bounded=True))


def test_reach_of_many_tiles(spark):
    """A window over far more rows than a tile has, and one over half the timeline."""
    n, reach = 200_000, 100_000
    frame = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("t"), (F.col("id") % 977).cast("double").alias("v"))
    line = timeline(frame, ["k"], ["t"], rows_per_tile=n // 50)
    back = line.look_back(reach, lambda w: {"far": F.lag("t", reach).over(w), "near": F.lag("t").over(w)}).rows()
    assert line.split and back.columns == ["k", "t", "v", "far", "near"]
    wrong = (~F.col("far").eqNullSafe(F.when(F.col("t") >= reach, F.col("t") - reach))) | (
        ~F.col("near").eqNullSafe(F.when(F.col("t") >= 1, F.col("t") - 1))
    )
    assert back.agg(F.count(F.lit(1)), F.count_if(wrong)).first() == (n, 0)
    short = frame.where("t < 6000")
    last = lambda **s: rows(rolling_z_score(short, "v", ["k"], ["t"], 1500, out="z", **s).select("t", F.round("z", 9)), "t")
    assert last(rows_per_tile=120) == last(bounded=True)


def test_no_cell_holds_other_rows(hot):
    line = timeline(hot, ["k"], ["t"], rows_per_tile=50)
    plan = line.look_back(300, lambda w: {"x": F.lag("v", 300).over(w)}).frame._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_ties_come_out_alike_however_rows_lie(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), i % 7, float(rng.randrange(4)), rng.choice([None, "x", "y"])) for i in range(400)]
    found = []
    for seed, size in [(1, 10**6), (2, 10**6), (3, 30), (4, 30)]:
        random.Random(seed).shuffle(data)
        frame = spark.createDataFrame(data, "k string, t int, v double, s string").repartition(3 + seed)
        line = timeline(frame, ["k"], ["t"], rows_per_tile=size)
        made = line.look_back(2, lambda w: {"l": F.lag("v", 2).over(w)}).number("n").carry_forward("c", F.col("s")).rows()
        found.append(rows(made, "k", "n"))
    assert found[0] == found[1] == found[2] == found[3]


def test_wide_rows_make_smaller_tiles(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CELLS_PER_TILE", 1000)
    wide = spark.range(60).select("id", *[F.lit(1.0).alias(f"c{i}") for i in range(49)])
    line = timeline(wide, [], ["id"])
    assert line.split and line.rows_per_tile == 20


def test_exact_ranks_of_many_columns(spark, monkeypatch):
    rng = random.Random(3)
    data = [(rng.gauss(0, 1), float(rng.randrange(3)), None, 5.0, rng.choice([-0.0, 0.0, float("inf"), -1e300, 1e-310]) if i % 2 else None) for i in range(4001)]
    names = ["a", "b", "c", "d", "e"]
    frame = spark.createDataFrame(data, "a double, b double, c double, d double, e double").repartition(5).cache()
    columns = {n: sorted(r[i] for r in data if r[i] is not None) for i, n in enumerate(names)}
    ranks_of = lambda n: [0, n // 3, n // 3, n - 1]
    expected = {n: [v[k] for k in ranks_of(len(v))] if v else [] for n, v in columns.items()}
    medians = exact_medians(frame, names)
    assert exact_ranks(frame, names, ranks_of) == expected
    # With no candidate fetched early, every bit is decided by counting.
    monkeypatch.setattr(ranks, "FEW", 0)
    assert exact_ranks(frame, names, ranks_of) == expected
    assert exact_medians(frame, names) == medians
    assert medians["c"] is None and medians["d"] == 5.0 and medians["a"] == columns["a"][2000]
    assert exact_medians(frame.limit(0), names) == dict.fromkeys(names) and exact_ranks(frame, [], ranks_of) == {}
