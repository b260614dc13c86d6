"""Bowling and matchup against hand-worked tables."""

from conftest import by, rows_of

import ballstats as bs

INF = float("inf")


def spell(bowler, balls, runs, wickets, start=0, **extra):
    rows = []
    for i in range(balls):
        row = {"bowler": bowler, "ball": 0.1, "runs_off_bat": runs if i == 0 else 0, "match_id": 1 + i, "seq": start + i}
        if i < wickets:
            row |= {"player_dismissed": "A", "wicket_type": "bowled"}
        rows.append(row | extra)
    return rows


def test_bowling_against_the_others(raw):
    d = bs.prepare_deliveries(raw(spell("X", 12, 20, 1) + spell("Y", 6, 6, 1, 50)))
    x = by(bs.bowling_season(d), "player")["X"]
    assert (x["b"], x["runs_conceded"], x["wicket"]) == (12, 20, 1)
    assert (x["expected_runs_conceded"], x["expected_wickets"]) == (12.0, 2.0)
    assert (x["er"], x["expected_er"], x["true_er"], x["true_er_4_overs"]) == (10.0, 6.0, -4.0, -16.0)
    assert (x["true_wickets"], x["true_w_4_overs"]) == (-1.0, -2.0)
    overall = by(bs.bowling_overall(d), "player")["X"]
    assert overall["team"] == "T2" and overall["true_er"] == -4.0


def test_only_the_bowlers_wickets(raw):
    kinds = ["caught", "run out", "retired hurt", "retired out", "hit wicket", "obstructing the field", None]
    rows = [{"ball": 0.1, "match_id": i, "player_dismissed": "A", "wicket_type": k} for i, k in enumerate(kinds)]
    d = bs.prepare_deliveries(raw(rows + spell("Y", 1, 1, 0, 90)))
    assert by(bs.bowling_season(d), "player")["X"]["wicket"] == 2


def test_alone_in_a_stratum_divides_by_zero(raw):
    d = bs.prepare_deliveries(raw(spell("X", 6, 5, 1)))
    x = by(bs.bowling_season(d), "player")["X"]
    # nothing conceded by others over no balls is undefined and adds nothing
    assert (x["expected_runs_conceded"], x["expected_wickets"]) == (0.0, 0.0)


def test_super_overs_count(raw):
    d = bs.prepare_deliveries(raw([*spell("X", 3, 5, 1), {"innings": 3, "bowler": "X", "runs_off_bat": 6}]))
    assert by(bs.bowling_season(d), "player")["X"]["runs_conceded"] == 11


def tenth_ball(second_wicket):
    """Balls 3.1 to 3.9 and 3.10, which reads as 3.1; a wicket on the first, maybe on the tenth."""
    rows = [{"ball": 3.0 + (i % 9 + 1) / 10, "runs_off_bat": 0} for i in range(10)]
    rows[0] |= {"player_dismissed": "A", "wicket_type": "bowled"}
    if second_wicket:
        rows[9] |= {"player_dismissed": "B", "wicket_type": "bowled"}
    return rows


def test_tenth_ball_of_an_over(raw):
    for second, plain, joined in [(False, (10, 1), (10, 2)), (True, (10, 2), (12, 4))]:
        d = bs.prepare_deliveries(raw(tenth_ball(second)))
        got = by(bs.bowling_season(d), "player")["X"]
        assert (got["b"], got["wicket"]) == plain
        got = by(bs.bowling_season(d, compat=True), "player")["X"]
        assert (got["b"], got["wicket"]) == joined


def test_bowler_of_two_teams(raw):
    rows = spell("X", 2, 4, 1) + spell("X", 2, 4, 1, 20, bowling_team="T3", ball=0.2) + spell("Y", 2, 1, 0, 40)
    d = bs.prepare_deliveries(raw(rows))
    assert len([r for r in rows_of(bs.bowling_season(d)) if r["player"] == "X"]) == 2
    assert len([r for r in rows_of(bs.bowling_season(d, compat=True)) if r["player"] == "X"]) == 4
    assert by(bs.bowling_overall(d), "player")["X"]["wicket"] == 2
    assert by(bs.bowling_overall(d, compat=True), "player")["X"]["wicket"] == 8


def test_bowling_thresholds_and_phase(raw):
    rows = spell("X", 6, 20, 2) + spell("Y", 6, 6, 1, 50) + [{"bowler": "Y", "ball": 12.1, "runs_off_bat": 2}]
    d = bs.prepare_deliveries(raw(rows))
    assert list(by(bs.bowling_season(d, thresholds=bs.BowlingThresholds(min_wickets=2)), "player")) == ["X"]
    assert [r["player"] for r in rows_of(bs.bowling_overall(d))] == ["X", "Y"]
    phases = by(bs.bowling_phase(d), "player", "phase")
    assert set(phases) == {("X", "1 to 6"), ("Y", "1 to 6"), ("Y", "12 to 16")}
    assert phases[("X", "1 to 6")]["expected_runs_conceded"] == 6.0
    assert len(by(bs.bowling_phase(d, dense=True), "player", "phase")) == 8


def matchup_rows():
    return [
        {"Batter": "A", "Runs": 4, "BowlType": "RF"},
        {"Batter": "A", "Runs": 0, "BowlType": "RMF", "Notes": "X", "LongDis": "caught"},
        {"Batter": "A", "Runs": 1, "BowlType": "LB", "BowlCat": "S"},
        {"Batter": "B", "Runs": 2, "BowlType": "RM"},
        {"Batter": "B", "Runs": 0, "BowlType": "RM", "Notes": "X", "LongDis": "run out"},
        {"Batter": "B", "Runs": 0, "BowlType": "RM", "Notes": "W", "Extras": 1},
        {"Batter": "B", "Runs": 0, "BowlType": "RM", "Notes": "WX", "LongDis": "stumped"},
    ]


def test_matchup_by_style(raw_typed):
    t = bs.prepare_typed(raw_typed(matchup_rows()))
    got = by(bs.matchup_season(t, "types"), "player", "types")
    a, b = got[("A", "Right Arm Pace")], got[("B", "Right Arm Pace")]
    assert (a["runs_scored"], a["bf"], a["out"], a["innings_count"]) == (4, 2, 1, 1)
    assert (b["runs_scored"], b["bf"], b["out"]) == (2, 3, 1)  # W is no ball, WX is, a run out is no out
    assert (a["expected_runs"], b["expected_runs"]) == (round(2 * 2 / 3, 2), 6.0)
    alone = got[("A", "Right Arm Wrist Spin")]
    assert (alone["expected_runs"], alone["expected_outs"]) == (0.0, 0.0)
    overall = by(bs.matchup_overall(t, "types"), "player", "types")
    assert overall[("A", "Right Arm Pace")]["runs_scored"] == 4


def test_matchup_by_category_and_filters(raw_typed):
    t = bs.prepare_typed(raw_typed([*matchup_rows(), {"Batter": "A", "Runs": 9, "BowlCat": None}]))
    got = by(bs.matchup_season(t, "bowl_cat"), "player", "bowl_cat")
    assert set(got) == {("A", "Pace"), ("A", "Spin"), ("B", "Pace"), ("A", None)}
    unknown = got[("A", None)]
    assert unknown["runs_scored"] is None and unknown["innings_count"] is None
    assert set(by(bs.matchup_overall(t, "bowl_cat"), "player", "bowl_cat")) == {("A", "Pace"), ("A", "Spin"), ("B", "Pace")}
    spin = bs.matchup_season(t, "bowl_cat", bs.Filters(categories=["Spin"]))
    assert set(by(spin, "player", "bowl_cat")) == {("A", "Spin")}
    assert rows_of(bs.matchup_season(t, "types", bs.Filters(competitions=["none"]))) == []


def test_matchup_joins_notes_back(raw_typed):
    rows = [{"Runs": 1, "Notes": "X", "LongDis": "caught"}, {"Runs": 2, "Notes": "X", "LongDis": "bowled"}, {"Batter": "B"}]
    t = bs.prepare_typed(raw_typed(rows))
    plain = by(bs.matchup_season(t), "player")["A"]
    joined = by(bs.matchup_season(t, compat=True), "player")["A"]
    assert (plain["runs_scored"], plain["bf"], plain["out"]) == (3, 2, 2)
    assert (joined["runs_scored"], joined["bf"], joined["out"]) == (6, 4, 2)


def test_over_table(raw_typed):
    t = bs.prepare_typed(raw_typed(matchup_rows()))
    got = by(bs.over_table(t), "player", "over")
    a = got[("A", 1)]
    assert (a["runs_scored"], a["bf"], a["mean_runs"], a["mean_bf"], a["mean_outs"]) == (5, 3, 7, 6, 2)
