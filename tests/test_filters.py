"""Pre-filters, bounds and value lists."""

import datetime as dt

import pytest
from conftest import rows_of

import ballstats as bs


@pytest.mark.parametrize("kw", [{"overs": (5, 2)}, {"dates": ("2023-02-01", "2023-01-01")}, {"positions": (3, 1)}])
def test_reversed_ranges_are_errors(kw):
    with pytest.raises(ValueError):
        bs.Filters(**kw)


def games():
    sides = [("T1", "T2"), ("T2", "T1"), ("T1", "T3"), ("T3", "T4")]
    days = ["2022-12-31", "01/01/2023", "13/02/2023", "2023-06-01"]
    return [
        {"seq": i, "match_id": i, "batting_team": a, "bowling_team": b, "start_date": day, "ball": i * 5 + 0.1, "innings": 1 + i % 3}
        for i, ((a, b), day) in enumerate(zip(sides, days))
    ]


@pytest.mark.parametrize(
    "filters,want",
    [
        (bs.Filters(), {0, 1, 2, 3}),
        (bs.Filters(overs=(1, 6)), {0, 1}),
        (bs.Filters(dates=("2023-01-01", "2023-02-13")), {1, 2}),
        (bs.Filters(dates=(dt.date(2022, 1, 1), dt.date(2022, 12, 31))), {0}),
        (bs.Filters(batting_teams=["T1"]), {0, 2}),
        (bs.Filters(bowling_teams=["T1"]), {1}),
        (bs.Filters(batting_teams=["T1"], bowling_teams=["T3"]), {2}),
        (bs.Filters(batting_teams=["T1"], bowling_teams=["T3"], batting_first=True), {0, 2}),
        (bs.Filters(bowling_teams=["T3"], batting_first=True), {2}),
        (bs.Filters(between_teams=["T1", "T2"]), {0, 1}),
        (bs.Filters(innings=[1, 2]), {0, 1, 3}),
    ],
)
def test_each_filter(raw, filters, want):
    d = bs.prepare_deliveries(raw(games()))
    assert {r["seq"] for r in rows_of(filters.apply(d))} == want


def test_unknown_over_is_outside_the_default_range(raw):
    d = bs.prepare_deliveries(raw([{"ball": None}, {"ball": 25.1}, {"ball": 0.1}]))
    assert bs.Filters().apply(d).count() == 1
    assert bs.Filters(overs=None).apply(d).count() == 3


def test_empty_result_keeps_its_columns(raw):
    d = bs.prepare_deliveries(raw(games()))
    none = bs.batting_season(d, bs.Filters(batting_teams=["nobody"]))
    assert rows_of(none) == [] and "true_ave" in none.columns


def test_bounds_and_values(raw):
    rows = games() + [{"striker": None, "runs_off_bat": 500}, {"striker": "Q", "runs_off_bat": 6, "wides": 1}]
    d = bs.prepare_deliveries(raw(rows))
    got = rows_of(bs.bounds(d))[0]
    assert (got["max_runs"], got["max_balls"]) == (6, 4)
    assert (got["min_date"], got["max_date"]) == (dt.date(2022, 12, 31), dt.date(2023, 6, 1))
    values = {(r["field"], r["value"]) for r in rows_of(bs.distinct_values(d, ["batting_team", "year"]))}
    assert values == {("batting_team", t) for t in ("T1", "T2", "T3")} | {("year", "2022"), ("year", "2023")}


def test_display_names(raw):
    shown = bs.with_display_names(bs.batting_season(bs.prepare_deliveries(raw(games()))))
    assert shown.columns[:6] == ["Player", "Team", "Year", "I", "Runs Scored", "BF"]
    assert shown.columns[-1] == "Median Entry Point"
