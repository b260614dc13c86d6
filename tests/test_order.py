"""Operators that depend on file order, and the slicing that keeps large groups out of one task."""

import random

import pytest
from conftest import by, rows_of
from pyspark.sql import functions as F

import ballstats as bs
from ballstats.operators.totals import running_sums, with_group_totals
from ballstats.plans.progression import progression_rows


def test_progression_of_an_innings(raw):
    """0.5 one run, 0.6 none, a wide at 1.1, 1.2 two runs: the wide adds a row only for its new over."""
    rows = [
        {"ball": 0.5, "runs_off_bat": 1},
        {"ball": 0.6},
        {"ball": 1.1, "wides": 1},
        {"ball": 1.2, "runs_off_bat": 2},
    ]
    progress = bs.batter_progression(bs.prepare_deliveries(raw(rows)))
    assert sorted((r["over"], r["runs"], r["balls"]) for r in rows_of(progress)) == [
        (1, 1, 1), (1, 1, 2), (2, 1, 2), (2, 3, 3),
    ]
    got = by(bs.progression_by_ball(progress), "balls")
    assert (got[2]["runs"], got[2]["count"], got[2]["ave_runs"], got[2]["sr"]) == (2, 2, 1.0, 50.0)
    assert got[3]["sr"] == 100.0


def test_no_ball_faced_yet_is_undefined(raw):
    progress = bs.batter_progression(bs.prepare_deliveries(raw([{"wides": 1}, {"ball": 0.2, "runs_off_bat": 4}])))
    by_ball = bs.progression_by_ball(progress)
    got = by(by_ball, "balls")
    assert got[0]["count"] == 0 and got[0]["ave_runs"] is None and got[0]["sr"] is None
    wide = rows_of(bs.pivot_by_ball(by_ball, "ave_runs", ["A", "Z"]))
    assert wide == [{"year": 2023, "balls": 1, "A": 4.0, "Z": None}]


def test_bowler_progression(raw):
    rows = [{"ball": 0.1, "runs_off_bat": 1, "wides": 1}, {"ball": 0.2, "noballs": 1, "runs_off_bat": 2}]
    running = bs.bowler_running(bs.prepare_deliveries(raw(rows)))
    assert [(r["runs"], r["balls"]) for r in rows_of(running.orderBy("seq"))] == [(2, 0), (5, 1)]
    assert progression_rows(running, "bowler").count() == 2


def test_null_striker_has_no_running_total(raw):
    d = bs.prepare_deliveries(raw([{"runs_off_bat": 1}, {"striker": None, "runs_off_bat": 4}, {"runs_off_bat": 2}]))
    got = [r["runs"] for r in rows_of(bs.batter_running(d).orderBy("seq"))]
    assert got == [1, None, 3]


def test_positions(raw):
    """The opener faces all of over 1, the partner never faces, a third player comes in."""
    rows = [{"striker": "A", "non_striker": "B", "ball": (i + 1) / 10} for i in range(6)]
    rows += [{"striker": "C", "non_striker": "A", "ball": 1.1}, {"striker": "A", "non_striker": "C", "ball": 1.2}]
    rows += [{"striker": "D", "non_striker": "A", "ball": 1.3}]
    rows += [{"striker": "B", "non_striker": "Q", "batting_team": "T9", "match_id": 2}]
    rows += [{"striker": "E", "batting_team": None}, {"striker": None}]
    placed = by(bs.with_batting_position(bs.prepare_deliveries(raw(rows))), "match_id", "striker")
    got = {k: v["batting_position"] for k, v in placed.items()}
    assert got == {(1, "A"): 1, (1, "C"): 3, (1, "D"): 4, (2, "B"): 1, (1, "E"): 0, (1, None): 0}


def test_opener_named_as_own_partner(raw):
    rows = [{"striker": "A", "non_striker": "A"}, {"striker": "B", "non_striker": "A", "ball": 0.2}]
    placed = by(bs.with_batting_position(bs.prepare_deliveries(raw(rows))), "striker")
    assert {k: v["batting_position"] for k, v in placed.items()} == {"A": 2, "B": 2}


def test_positions_in_small_chunks(raw):
    names = list("ABCDEFGH")
    rows = [{"striker": names[i // 3], "non_striker": "H", "ball": 0.1} for i in range(21)]
    d = bs.prepare_deliveries(raw(rows))
    whole = {(r["seq"], r["batting_position"]) for r in rows_of(bs.with_batting_position(d))}
    cut = {(r["seq"], r["batting_position"]) for r in rows_of(bs.with_batting_position(d, chunk_rows=2))}
    assert whole == cut
    assert {p for _, p in whole} == {1, 3, 4, 5, 6, 7, 8}


def test_career_innings(raw):
    rows = [{"match_id": m, "striker": s, "ball": b / 10} for m in (7, 3, 9) for s in "AB" for b in (1, 2) if (m, s) != (3, "B")]
    got = bs.career_innings_no(bs.prepare_deliveries(raw(rows)), chunk_rows=2)
    assert {(r["player"], r["match_id"], r["ci"]) for r in rows_of(got)} == {
        ("A", 3, 1), ("A", 7, 2), ("A", 9, 3), ("B", 7, 1), ("B", 9, 2),
    }


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
@pytest.mark.parametrize("structured", [False, True])
def test_running_sums_against_brute_force(spark, chunk, structured):
    """One key holds most rows; chunk borders fall anywhere; order may be a position struct."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(0, 6)) for i in range(300)]
    want, total = {}, {}
    for i, k, v in rows:
        if k is not None:
            total[k] = total.get(k, 0) + v
        want[i] = total.get(k) if k is not None else None
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, k string, v int").repartition(5)
    order = F.struct(F.lit("f").alias("file"), F.floor(F.col("i") / chunk).alias("block"), F.col("i").alias("row"))
    df = df.withColumn("seq", order if structured else F.col("i"))
    got = running_sums(df, ["k"], "seq", {"s": F.col("v")}, chunk)
    assert {r["i"]: r["s"] for r in rows_of(got)} == want


def executed(df):
    """The plan that ran, where a shuffle that is shared stands once."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final_scans(df):
    plan = executed(df).split("== Initial Plan ==")[0]
    return plan.count("FileScan")


@pytest.fixture
def stored(spark, tmp_path):
    from conftest import SF

    from ballstats.sources.starschema import deliveries_from_events

    bs.prepare_deliveries(deliveries_from_events(spark, SF)).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


@pytest.mark.parametrize("chunk", [100, 1 << 20])
def test_running_totals_read_the_source_once(stored, chunk):
    assert final_scans(bs.batter_running(stored, chunk_rows=chunk)) == 1
    assert final_scans(bs.batter_running(stored, chunk_rows=chunk).select("seq", "runs")) == 1
    assert final_scans(bs.bowler_progression(stored, chunk_rows=chunk)) == 1


@pytest.mark.parametrize("chunk", [100, 1 << 20])
def test_positions_read_the_source_once(stored, chunk):
    placed = bs.with_batting_position(stored, chunk_rows=chunk)
    assert final_scans(placed) == 1
    assert final_scans(placed.select("seq", "batting_position")) == 1


@pytest.mark.parametrize("slices", [1, 4, 32])
def test_group_totals_of_a_hot_group(spark, slices):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 5 + ["x", "y"]), f"p{i}", rng.randint(0, 9)) for i in range(400)]
    total = {}
    for k, _, v in rows:
        total[k] = total.get(k, 0) + v
    got = with_group_totals(spark.createDataFrame(rows, "k string, p string, v long"), ["k"], "p", {"t": "v"}, slices)
    assert {(r["p"], r["t"]) for r in rows_of(got)} == {(p, total[k]) for k, p, _ in rows}
    with pytest.raises(ValueError):
        with_group_totals(got, ["k"], "p", {"t2": "v"}, 3)
