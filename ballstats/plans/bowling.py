"""Bowling: true economy and wickets per season and per career.  Super overs count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.functions.metrics import BOWLING_METRICS, with_bowling_metrics
from ballstats.functions.numeric import exact_sum, over_ball, round2
from ballstats.operators.baseline import IEEE, loo_expected, roll_up
from ballstats.operators.entry_point import appearances, median_entry
from ballstats.operators.filters import Filters, chosen_players, main_innings, within
from ballstats.operators.phases import in_phases, phase_totals
from ballstats.operators.ranking import best_first

STRATA = ["year", "venue", "over"]
TOTALS = ["b", "runs_conceded", "wicket"]
EXPECTED = ["expected_runs_conceded", "expected_wickets"]
SEASON_ORDER = ("wicket", "player", "year", "team")


@dataclass(frozen=True)
class BowlingThresholds:
    """Inclusive bounds on the finished table; None leaves a side open."""

    min_wickets: int | None = 0
    max_wickets: int | None = None
    min_balls: int | None = 1
    max_balls: int | None = None

    def apply(self, table: DataFrame) -> DataFrame:
        table = within(table, "wicket", self.min_wickets, self.max_wickets)
        return within(table, "b", self.min_balls, self.max_balls)




def bowling_contributions(deliveries: DataFrame, compat: bool = False) -> DataFrame:
    """Runs, ball and wicket of each delivery, credited to the bowler.

    ``compat`` finds wickets again by (match, innings, bowler, ball).  A tenth ball reads as
    the first (3.10 = 3.1), so such an over repeats rows; the number of wickets per key
    stands for those repeats, which keeps the join one row to one.
    """
    wicket, times = F.col("bowler_wicket").cast("bigint"), F.lit(1)
    if compat:
        key = ["year", "match_id", "innings", "bowler", "ball"]
        found = deliveries.filter("bowler_wicket").groupBy(*key).agg(F.count("*").alias("_found"))
        deliveries = deliveries.join(found, key, "left")
        wicket = F.coalesce("_found", F.lit(0))
        times = F.greatest(wicket, F.lit(1))
    return deliveries.select(
        *STRATA,
        F.col("bowler").alias("player"),
        (F.col("b") * times).cast("bigint").alias("b"),
        (F.col("rc") * times).cast("bigint").alias("runs_conceded"),
        wicket.alias("wicket"),
    )


def bowling_cells(deliveries: DataFrame, empty_baseline: str = IEEE, compat: bool = False) -> DataFrame:
    return loo_expected(
        bowling_contributions(deliveries, compat),
        "player",
        STRATA,
        ["runs_conceded", "wicket"],
        "b",
        empty_baseline,
    ).withColumnRenamed("expected_wicket", "expected_wickets")


def bowling_roster(deliveries: DataFrame, compat: bool = False) -> DataFrame:
    """Every (player, year, team) with the median first ball of a spell in an innings."""
    key = ["player", "year"]
    roster = (
        appearances(deliveries, "bowler", ["bowling_team"])
        .withColumnRenamed("bowling_team", "team")
        .groupBy(*key, "team")
        .agg(median_entry(compat).alias("_median"))
        .select(*key, "team", F.when(F.col("team").isNotNull(), over_ball("_median")).alias("median_entry_point"))
    )
    if not compat:
        return roster
    entries = roster.dropna(subset=["team"]).select(*key, "median_entry_point")
    return roster.drop("median_entry_point").join(entries, key, "left")


def _season_metrics(main: DataFrame, empty_baseline: str, compat: bool) -> DataFrame:
    totals = roll_up(bowling_cells(main, empty_baseline, compat), ["year", "player"], TOTALS, EXPECTED)
    return with_bowling_metrics(totals).withColumns({c: round2(c) for c in [*EXPECTED, *BOWLING_METRICS]})


def _season_rows(main: DataFrame, empty_baseline: str, compat: bool) -> DataFrame:
    metrics = _season_metrics(main, empty_baseline, compat)
    return bowling_roster(main, compat).join(metrics, ["player", "year"], "left").select(
        "player", "team", "year", "median_entry_point", *TOTALS, *EXPECTED, *BOWLING_METRICS
    )


def bowling_season(
    deliveries: DataFrame,
    filters: Filters = Filters(),
    thresholds: BowlingThresholds | None = BowlingThresholds(),
    players=None,
    empty_baseline: str = IEEE,
    max_innings: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """One row per (player, team, year), most wickets first."""
    rows = _season_rows(main_innings(filters.apply(deliveries), max_innings), empty_baseline, compat)
    rows = thresholds.apply(rows) if thresholds else rows
    return chosen_players(rows, players).orderBy(*best_first(*SEASON_ORDER))


def bowling_overall(
    deliveries: DataFrame,
    filters: Filters = Filters(),
    thresholds: BowlingThresholds | None = BowlingThresholds(),
    players=None,
    empty_baseline: str = IEEE,
    max_innings: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """One row per player: rounded seasons added up, ratios formed again, most wickets first."""
    main = main_innings(filters.apply(deliveries), max_innings)
    sums = [F.sum(m).alias(m) for m in TOTALS] + [exact_sum(e).alias(e) for e in EXPECTED]
    team = F.mode("team", True).alias("team")
    if compat:
        careers = _season_rows(main, empty_baseline, compat).groupBy("player").agg(team, *sums)
    else:
        teams = (
            main.filter(F.col("bowler").isNotNull())
            .select(F.col("bowler").alias("player"), "year", F.col("bowling_team").alias("team"))
            .distinct()
        )
        careers = teams.groupBy("player").agg(team).join(
            _season_metrics(main, empty_baseline, compat).groupBy("player").agg(*sums), "player", "left"
        )
    table = with_bowling_metrics(careers).withColumns({c: round2(c) for c in [*EXPECTED, *BOWLING_METRICS]})
    table = table.select("player", "team", *TOTALS, *EXPECTED, *BOWLING_METRICS)
    table = thresholds.apply(table) if thresholds else table
    return chosen_players(table, players).orderBy(*best_first("wicket", "player"))


def bowling_phase(
    deliveries: DataFrame,
    filters: Filters = Filters(),
    empty_baseline: str = IEEE,
    dense: bool = False,
) -> DataFrame:
    """Totals and expected values per (year, player, phase)."""
    chosen = filters.apply(deliveries)
    chosen = chosen if dense else in_phases(chosen)
    sums = {m: F.sum(m) for m in TOTALS} | {e: exact_sum(e) for e in EXPECTED}
    return phase_totals(bowling_cells(chosen, empty_baseline), sums, dense)
