"""Batting: true values per season, per career and per phase of the innings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.functions.metrics import BATTING_METRICS, with_batting_metrics
from ballstats.functions.numeric import exact_sum, round2
from ballstats.operators.baseline import CLAMP1, IEEE, INCLUSIVE, cells_of, loo_expected, roll_up
from ballstats.operators.entry_point import career_profile, entry_points, season_roster
from ballstats.operators.filters import Filters, bounds, chosen_players, main_innings, within
from ballstats.operators.phases import in_phases, phase_totals, with_means, with_phase
from ballstats.operators.ranking import best_first

STRATA = ["year", "venue", "over"]
TOTALS = ["runs_scored", "bf", "out"]
EXPECTED = ["expected_runs", "expected_outs"]
SEASON_ORDER = ("runs_scored", "player", "year", "team")


@dataclass(frozen=True)
class BattingThresholds:
    """Inclusive bounds on the finished table; None leaves a side open."""

    min_runs: int | None = 1
    max_runs: int | None = None
    min_balls: int | None = 1
    max_balls: int | None = None

    def apply(self, table: DataFrame) -> DataFrame:
        table = within(table, "runs_scored", self.min_runs, self.max_runs)
        return within(table, "bf", self.min_balls, self.max_balls)


def repeat_weights(deliveries: DataFrame) -> DataFrame:
    """``weight`` of each delivery when dismissals are joined back on (match, innings, player, over).

    A player recorded out several times in one over multiplies those rows.  Only rows with a
    dismissed player can be affected; the others, nearly all, stay out of the join.
    """
    key = ["year", "match_id", "innings", "player_dismissed", "over"]
    dismissed = F.col("player_dismissed").isNotNull()
    outs = deliveries.filter(F.col("wicket")).groupBy(*key).agg(F.count("*").alias("weight"))
    plain = deliveries.filter(~dismissed).withColumn("weight", F.lit(1).cast("bigint"))
    joined = deliveries.filter(dismissed).join(outs, key, "left")
    return plain.unionByName(joined.withColumn("weight", F.coalesce("weight", F.lit(1))))


def batting_contributions(deliveries: DataFrame, compat: bool = False) -> DataFrame:
    """What each delivery adds to whom: the striker's runs and ball, the dismissed player's out.

    One row per delivery, and a second one when somebody other than the striker is out.  That
    row has no ball, so a player who never faced in a stratum is no member of it, while the
    out still counts in the stratum's totals.
    """
    times = F.lit(1)
    if compat:
        deliveries, times = repeat_weights(deliveries), F.col("weight")
    own = F.col("striker").eqNullSafe(F.col("player_dismissed"))
    extra = [c for c in ("phase",) if c in deliveries.columns]

    def adds(player, runs, balls, out):
        return F.struct(
            F.col(player).alias("player"),
            runs.cast("bigint").alias("runs_scored"),
            balls.cast("bigint").alias("bf"),
            out.cast("bigint").alias("out"),
        )

    faced = adds("striker", F.col("runs_off_bat") * times, F.col("b") * times, (F.col("wicket") & own).cast("int"))
    lost = adds("player_dismissed", F.lit(0), F.lit(None), F.lit(1))
    both = F.when(F.col("wicket") & ~own, F.array(faced, lost)).otherwise(F.array(faced))
    return deliveries.select(*STRATA, *extra, F.explode(both).alias("c")).select(*STRATA, *extra, "c.*")


def batting_cells(
    deliveries: DataFrame, empty_baseline: str = CLAMP1, baseline: str = "loo", by=(), compat: bool = False
) -> DataFrame:
    """Per (year, venue, over, *by, player): totals, stratum totals and expected values."""
    return loo_expected(
        batting_contributions(deliveries, compat),
        "player",
        [*STRATA, *by],
        ["runs_scored", "out"],
        "bf",
        empty_baseline,
        baseline,
    ).withColumnsRenamed({"expected_runs_scored": "expected_runs", "expected_out": "expected_outs"})


def _season_metrics(cells: DataFrame, by=()) -> DataFrame:
    totals = roll_up(cells, ["year", "player", *by], TOTALS, EXPECTED)
    return with_batting_metrics(totals).withColumns({c: round2(c) for c in [*EXPECTED, *BATTING_METRICS]})


def _season_rows(main: DataFrame, empty_baseline: str, compat: bool) -> DataFrame:
    roster = season_roster(main, "striker", "batting_team", compat=compat)
    metrics = _season_metrics(batting_cells(main, empty_baseline, compat=compat))
    return roster.join(metrics, ["player", "year"], "left").select(
        "player", "team", "year", "innings_count", *TOTALS, *EXPECTED, *BATTING_METRICS, "median_entry_point"
    )


def _apply_thresholds(table: DataFrame, thresholds, deliveries: DataFrame, compat: bool) -> DataFrame:
    """With ``compat`` an open upper side is the largest career total in the unfiltered data."""
    if thresholds is None:
        return table
    table = thresholds.apply(table)
    if compat:
        career = bounds(deliveries)
        if thresholds.max_runs is None:
            table = table.filter(F.col("runs_scored") <= career.select("max_runs").scalar())
        if thresholds.max_balls is None:
            table = table.filter(F.col("bf") <= career.select("max_balls").scalar())
    return table


def batting_season(
    deliveries: DataFrame,
    filters: Filters = Filters(),
    thresholds: BattingThresholds | None = BattingThresholds(),
    players=None,
    empty_baseline: str = CLAMP1,
    max_innings: int | None = 2,
    compat: bool = False,
) -> DataFrame:
    """One row per (player, team, year), most runs first.

    ``compat`` reproduces joins that leave the team or the ball out of their key.
    """
    main = main_innings(filters.apply(deliveries), max_innings)
    rows = _season_rows(main, empty_baseline, compat)
    rows = chosen_players(_apply_thresholds(rows, thresholds, deliveries, compat), players)
    return rows.orderBy(*best_first(*SEASON_ORDER))


def batting_overall(
    deliveries: DataFrame,
    filters: Filters = Filters(),
    thresholds: BattingThresholds | None = BattingThresholds(),
    players=None,
    empty_baseline: str = CLAMP1,
    max_innings: int | None = 2,
    compat: bool = False,
) -> DataFrame:
    """One row per player: rounded seasons added up, ratios formed again, most runs first."""
    chosen = filters.apply(deliveries)
    main = main_innings(chosen, max_innings)
    sums = [F.sum(m).alias(m) for m in TOTALS] + [exact_sum(e).alias(e) for e in EXPECTED]
    if compat:
        rows = _season_rows(main, empty_baseline, compat)
        careers = rows.groupBy("player").agg(
            *sums, F.sum("innings_count").alias("innings_count"), F.mode("team", True).alias("team")
        )
        careers = entry_points(chosen, "striker", compat=True).join(careers, "player", "left")
    else:
        seasons = _season_metrics(batting_cells(main, empty_baseline))
        careers = career_profile(chosen, "striker", "batting_team", max_innings).join(
            seasons.groupBy("player").agg(*sums), "player", "left"
        )
    metrics = [m for m in BATTING_METRICS if m != "out_ratio"]
    table = with_batting_metrics(careers).withColumns({m: round2(m) for m in metrics})
    table = table.select("player", "median_entry_point", "innings_count", *TOTALS, *metrics, "team")
    table = chosen_players(_apply_thresholds(table, thresholds, deliveries, compat), players)
    return table.orderBy(*best_first("runs_scored", "player"))


def batting_phase_season(
    deliveries: DataFrame, filters: Filters = Filters(), max_innings: int | None = 2
) -> DataFrame:
    """Season table split by phase, measured against everybody in the stratum, the player included."""
    main = with_phase(main_innings(filters.apply(deliveries), max_innings))
    cells = batting_cells(main, IEEE, INCLUSIVE, by=["phase"])
    roster = season_roster(main, "striker", "batting_team", by=["phase"])
    return roster.join(_season_metrics(cells, ["phase"]), ["player", "year", "phase"], "left").select(
        "player", "team", "year", "phase", "innings_count", *TOTALS, *EXPECTED, *BATTING_METRICS
    )


def phase_table(
    deliveries: DataFrame, filters: Filters = Filters(), max_innings: int | None = 2, dense: bool = False
) -> DataFrame:
    """Runs, balls and outs per (year, player, phase) beside those of all players in the phase."""
    main = main_innings(filters.apply(deliveries), max_innings)
    main = main if dense else in_phases(main)
    cells = cells_of(batting_contributions(main), "player", STRATA, ["runs_scored", "out"], "bf")
    members = cells.filter(F.col("player").isNotNull() & F.col("bf").isNotNull())
    return with_means(phase_totals(members, {m: F.sum(m) for m in TOTALS}, dense), ["year", "phase"])


