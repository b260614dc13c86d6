"""Batting against hand-worked tables."""

import random

import pytest
from conftest import by, rows_of

import ballstats as bs
from ballstats.operators.baseline import CLAMP1, IEEE
from ballstats.operators.entry_point import entry_points
from ballstats.plans.batting import batting_cells

INF = float("inf")


def stratum():
    """A: 4 balls, 6 runs, out once.  B: 2 balls, 2 runs.  C: run out without facing."""
    rows = [{"striker": "A", "runs_off_bat": r} for r in (1, 1, 4, 0)]
    rows[3] |= {"player_dismissed": "A", "wicket_type": "caught"}
    rows += [{"striker": "B", "runs_off_bat": 2}]
    rows += [{"striker": "B", "player_dismissed": "C", "wicket_type": "run out"}]
    return [{"ball": (i + 1) / 10, **r} for i, r in enumerate(rows)]


def test_leave_one_out(raw):
    got = by(bs.batting_season(bs.prepare_deliveries(raw(stratum()))), "player")
    assert set(got) == {"A", "B"}
    a, b = got["A"], got["B"]
    assert (a["runs_scored"], a["bf"], a["out"], a["expected_runs"], a["expected_outs"]) == (6, 4, 1, 4.0, 2.0)
    assert (a["ave"], a["sr"], a["expected_ave"], a["expected_sr"]) == (6.0, 150.0, 2.0, 100.0)
    assert (a["true_ave"], a["true_sr"], a["out_ratio"]) == (4.0, 50.0, 2.0)
    assert (b["expected_runs"], b["expected_outs"], b["ave"], b["expected_ave"]) == (3.0, 1.0, INF, 3.0)
    assert (b["true_ave"], b["true_sr"], b["out_ratio"]) == (INF, -50.0, INF)


@pytest.mark.parametrize("mode,runs,outs", [(CLAMP1, 0.0, 4.0), (IEEE, 0.0, INF)])
def test_empty_baseline(raw, mode, runs, outs):
    rows = stratum()[:4]
    rows[0] |= {"player_dismissed": "C", "wicket_type": "run out"}
    got = by(bs.batting_season(bs.prepare_deliveries(raw(rows)), empty_baseline=mode), "player")
    assert list(got) == ["A"]
    assert (got["A"]["expected_runs"], got["A"]["expected_outs"]) == (runs, outs)


def test_null_keys(raw):
    rows = stratum()
    rows.append({"striker": "A", "runs_off_bat": 6, "venue": None, "ball": 0.7})
    rows.append({"striker": None, "runs_off_bat": 3, "ball": 0.8})
    d = bs.prepare_deliveries(raw(rows))
    cells = by(batting_cells(d), "player")
    assert set(cells) == {"A", "B"}
    assert cells["A"]["total_runs_scored"] == 11 and cells["A"]["runs_scored"] == 6
    assert {r["player"] for r in rows_of(bs.batting_season(d))} == {"A", "B"}


def two_teams():
    """A plays matches 1-3 for T1 and 4-5 for T2, all in one year; B once for each."""
    rows = []
    for match, team in [(1, "T1"), (2, "T1"), (3, "T1"), (4, "T2"), (5, "T2")]:
        rows += [
            {"match_id": match, "batting_team": team, "striker": "A", "ball": 0.1 if team == "T1" else 2.1, "runs_off_bat": 1},
            {"match_id": match, "batting_team": team, "striker": "B", "ball": 0.2, "runs_off_bat": 2},
        ]
    return rows


def test_a_player_of_two_teams(raw):
    d = bs.prepare_deliveries(raw(two_teams()))
    rows = [r for r in rows_of(bs.batting_season(d)) if r["player"] == "A"]
    assert {(r["team"], r["median_entry_point"]) for r in rows} == {("T1", 0.1), ("T2", 2.1)}
    assert all(r["innings_count"] == 5 and r["runs_scored"] == 5 for r in rows)
    overall = by(bs.batting_overall(d), "player")["A"]
    assert (overall["innings_count"], overall["runs_scored"], overall["team"]) == (5, 5, "T1")


def test_under_keyed_joins_multiply(raw):
    d = bs.prepare_deliveries(raw(two_teams()))
    rows = [r for r in rows_of(bs.batting_season(d, compat=True)) if r["player"] == "A"]
    assert len(rows) == 4
    overall = by(bs.batting_overall(d, thresholds=None, compat=True), "player")["A"]
    assert (overall["innings_count"], overall["runs_scored"]) == (20, 20)
    # the multiplied total is above the largest career total, the upper bound of the default choice
    assert by(bs.batting_overall(d, compat=True), "player") == {}


def test_repeated_dismissal_in_an_over(raw):
    rows = stratum()
    rows[1] |= {"player_dismissed": "A", "wicket_type": "bowled"}
    d = bs.prepare_deliveries(raw(rows))
    plain = by(bs.batting_season(d), "player")["A"]
    joined = by(bs.batting_season(d, thresholds=None, compat=True), "player")["A"]
    assert (plain["runs_scored"], plain["bf"], plain["out"]) == (6, 4, 2)
    assert (joined["runs_scored"], joined["bf"], joined["out"]) == (7, 6, 2)


def test_main_team_tie_is_the_smallest_name(raw):
    rows = [{"start_date": "2022-01-01", "batting_team": "b", "runs_off_bat": 1}]
    rows += [{"match_id": 2, "start_date": "2023-01-01", "batting_team": "a", "runs_off_bat": 1}]
    assert by(bs.batting_overall(bs.prepare_deliveries(raw(rows))), "player")["A"]["team"] == "a"


def test_overall_adds_rounded_seasons(raw):
    """Three seasons of one third each are 0.33 * 3, not 1."""
    rows = []
    for year in (2021, 2022, 2023):
        day = f"{year}-05-05"
        rows += [{"start_date": day, "match_id": year, "striker": "A", "runs_off_bat": 1}]
        rows += [{"start_date": day, "match_id": year, "striker": "B", "ball": 0.2 + i / 10, "runs_off_bat": int(i == 0)} for i in range(3)]
    season = by(bs.batting_season(bs.prepare_deliveries(raw(rows))), "player", "year")
    assert season[("A", 2021)]["expected_runs"] == 0.33
    overall = by(bs.batting_overall(bs.prepare_deliveries(raw(rows))), "player")["A"]
    assert overall["expected_sr"] == 33.0


@pytest.mark.parametrize("accuracy", [5, 20, 10_000])
def test_entry_points_from_a_sketch(raw, accuracy):
    """The entry lies within n / accuracy ranks of the middle."""
    rng = random.Random(accuracy)
    balls = [over + rng.randint(1, 6) / 10 for over in (rng.randint(0, 19) for _ in range(3001))]
    d = bs.prepare_deliveries(raw([{"match_id": i, "ball": b} for i, b in enumerate(balls)]))
    got = by(entry_points(d, "striker", accuracy=accuracy), "player")["A"]["median_entry_point"]
    below, upto = sum(b < got - 1e-9 for b in balls), sum(b <= got + 1e-9 for b in balls)
    assert below <= 1501 + 3001 / accuracy and upto >= 1501 - 3001 / accuracy


def test_entry_points(raw):
    rows = [{"match_id": m, "ball": b, "runs_off_bat": 1} for m, b in [(1, 1.1), (2, 1.2)]]
    rows += [{"match_id": 1, "ball": 9.1, "runs_off_bat": 1}]
    d = bs.prepare_deliveries(raw(rows))
    assert by(entry_points(d, "striker"), "player")["A"]["median_entry_point"] == 1.2
    one = bs.prepare_deliveries(raw([{"ball": 1.2, "runs_off_bat": 1}]))
    assert by(entry_points(one, "striker"), "player")["A"]["median_entry_point"] == 1.2
    assert by(entry_points(one, "striker", compat=True), "player")["A"]["median_entry_point"] == 1.1


def test_first_ball_is_by_position_not_by_ball(raw):
    rows = [{"seq": 5, "ball": 3.1}, {"seq": 2, "ball": 7.1}]
    d = bs.prepare_deliveries(raw(rows))
    assert by(entry_points(d, "striker"), "player")["A"]["median_entry_point"] == 7.1


def test_super_over_only_batter_has_no_season(raw):
    rows = [*stratum(), {"innings": 3, "striker": "S", "runs_off_bat": 6}]
    d = bs.prepare_deliveries(raw(rows))
    assert "S" not in by(bs.batting_season(d, thresholds=None), "player")
    everyone = by(bs.batting_overall(d, thresholds=None), "player")
    assert everyone["S"]["runs_scored"] is None and everyone["S"]["innings_count"] is None
    assert everyone["S"]["median_entry_point"] == 0.1
    assert "S" not in by(bs.batting_overall(d), "player")


def test_thresholds_and_players(raw, spark):
    d = bs.prepare_deliveries(raw(stratum()))
    assert list(by(bs.batting_season(d, thresholds=bs.BattingThresholds(min_runs=3)), "player")) == ["A"]
    assert list(by(bs.batting_season(d, thresholds=bs.BattingThresholds(max_balls=3)), "player")) == ["B"]
    alone = by(bs.batting_season(d, players=["B"]), "player")
    assert list(alone) == ["B"] and alone["B"]["expected_runs"] == 3.0
    wanted = spark.createDataFrame([("B",), ("Z",)], "name string")
    assert list(by(bs.batting_season(d, players=wanted), "player")) == ["B"]
    assert [r["player"] for r in rows_of(bs.missing_players(bs.batting_season(d), wanted))] == ["Z"]


def test_sorted_by_runs(raw):
    d = bs.prepare_deliveries(raw(stratum() + [{"striker": "Z", "runs_off_bat": 6, "ball": 0.9}]))
    assert [r["player"] for r in rows_of(bs.batting_season(d))] == ["A", "Z", "B"]
    assert [r["player"] for r in rows_of(bs.batting_overall(d))] == ["A", "Z", "B"]


def test_filters_shape_the_baseline(raw):
    rows = stratum() + [{"striker": "D", "runs_off_bat": 6, "batting_team": "T9", "ball": 0.9}]
    d = bs.prepare_deliveries(raw(rows))
    only = by(bs.batting_season(d, bs.Filters(batting_teams=["T1"])), "player")
    both = by(bs.batting_season(d), "player")
    assert only["A"]["expected_runs"] == 4.0 and both["A"]["expected_runs"] == 4 * 8 / 3 // 0.01 * 0.01 + 0.01


def test_phase_split_includes_the_player(raw):
    got = by(bs.batting_phase_season(bs.prepare_deliveries(raw(stratum()))), "player", "phase")
    a = got[("A", "1 to 6")]
    assert (a["expected_runs"], a["expected_outs"]) == (round(4 * 8 / 6, 2), round(4 * 2 / 6, 2))


def test_phase_tables(raw):
    rows = stratum() + [{"striker": "A", "runs_off_bat": 3, "ball": 17.1}]
    d = bs.prepare_deliveries(raw(rows))
    sparse = by(bs.phase_table(d), "player", "phase")
    assert set(sparse) == {("A", "1 to 6"), ("B", "1 to 6"), ("A", "17 to 20")}
    assert (sparse[("A", "1 to 6")]["mean_runs"], sparse[("A", "1 to 6")]["mean_bf"]) == (8, 6)
    dense = by(bs.phase_table(d, dense=True), "player", "phase")
    assert len(dense) == 8
    assert dense[("B", "7 to 11")]["bf"] == 0 and dense[("B", "7 to 11")]["sr"] is None
    assert dense[("B", "17 to 20")]["mean_runs"] == 3
