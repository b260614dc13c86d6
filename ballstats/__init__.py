"""Ball-by-ball cricket analytics on Spark DataFrames."""

from ballstats.operators.baseline import loo_expected
from ballstats.operators.filters import (
    Filters,
    bounds,
    chosen_players,
    distinct_values,
    missing_players,
)
from ballstats.operators.position import with_batting_position
from ballstats.operators.prepare import dedupe_first, prepare_deliveries, prepare_typed
from ballstats.operators.ranking import number_rows
from ballstats.plans.batting import (
    BattingThresholds,
    batting_overall,
    batting_phase_season,
    batting_season,
    phase_table,
)
from ballstats.plans.bowling import (
    BowlingThresholds,
    bowling_overall,
    bowling_phase,
    bowling_season,
)
from ballstats.plans.matchup import matchup_overall, matchup_season, over_table
from ballstats.plans.progression import (
    batter_progression,
    batter_running,
    bowler_progression,
    bowler_running,
    career_innings_no,
    pivot_by_ball,
    progression_by_ball,
)
from ballstats.schema import with_display_names

__all__ = [
    "BattingThresholds",
    "BowlingThresholds",
    "Filters",
    "batter_progression",
    "batter_running",
    "batting_overall",
    "batting_phase_season",
    "batting_season",
    "bounds",
    "bowler_progression",
    "bowler_running",
    "bowling_overall",
    "bowling_phase",
    "bowling_season",
    "career_innings_no",
    "chosen_players",
    "dedupe_first",
    "distinct_values",
    "loo_expected",
    "matchup_overall",
    "matchup_season",
    "missing_players",
    "number_rows",
    "over_table",
    "phase_table",
    "pivot_by_ball",
    "prepare_deliveries",
    "prepare_typed",
    "progression_by_ball",
    "with_batting_position",
    "with_display_names",
]
