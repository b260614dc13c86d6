"""Column contracts of the two delivery layouts and the names shown to a reader.

``DELIVERIES`` is the ball-by-ball layout used for batting and bowling,
``TYPED_DELIVERIES`` the one that also carries the bowler's style.  Files may hold
more columns; those are carried along as text and never read.
"""

from __future__ import annotations

from pyspark.sql import types as T

DELIVERIES = T.StructType(
    [
        T.StructField("match_id", T.LongType()),
        T.StructField("innings", T.IntegerType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("venue", T.StringType()),
        T.StructField("ball", T.DoubleType()),
        T.StructField("striker", T.StringType()),
        T.StructField("non_striker", T.StringType()),
        T.StructField("bowler", T.StringType()),
        T.StructField("batting_team", T.StringType()),
        T.StructField("bowling_team", T.StringType()),
        T.StructField("runs_off_bat", T.IntegerType()),
        T.StructField("wides", T.IntegerType()),
        T.StructField("noballs", T.IntegerType()),
        T.StructField("player_dismissed", T.StringType()),
        T.StructField("wicket_type", T.StringType()),
    ]
)

TYPED_DELIVERIES = T.StructType(
    [
        T.StructField("MatchNum", T.LongType()),
        T.StructField("MatchInn", T.IntegerType()),
        T.StructField("StartDate", T.StringType()),
        T.StructField("CompName", T.StringType()),
        T.StructField("Venue", T.StringType()),
        T.StructField("Over", T.DoubleType()),
        T.StructField("Batter", T.StringType()),
        T.StructField("Runs", T.IntegerType()),
        T.StructField("Extras", T.IntegerType()),
        T.StructField("Notes", T.StringType()),
        T.StructField("LongDis", T.StringType()),
        T.StructField("BowlType", T.StringType()),
        T.StructField("BowlCat", T.StringType()),
    ]
)

# The column headings a reader of the result tables knows.
DISPLAY_NAMES = {
    "player": "Player",
    "team": "Team",
    "year": "Year",
    "phase": "phase",
    "types": "Types",
    "bowl_cat": "BowlCat",
    "innings_count": "I",
    "runs_scored": "Runs Scored",
    "bf": "BF",
    "out": "Out",
    "expected_runs": "Expected Runs",
    "expected_outs": "Expected Outs",
    "ave": "Ave",
    "sr": "SR",
    "expected_ave": "Expected Ave",
    "expected_sr": "Expected SR",
    "true_ave": "True Ave",
    "true_sr": "True SR",
    "out_ratio": "Out Ratio",
    "median_entry_point": "Median Entry Point",
    "b": "B",
    "runs_conceded": "Runs Conceded",
    "wicket": "Wicket",
    "expected_runs_conceded": "Expected Runs Conceded",
    "expected_wickets": "Expected Wickets",
    "er": "ER",
    "expected_er": "Expected ER",
    "true_er": "True ER",
    "true_er_4_overs": "True ER/ 4 overs",
    "true_wickets": "True Wickets",
    "true_w_4_overs": "True W/ 4 overs",
}


def with_display_names(df):
    """Rename the result columns to their display headings; others stay."""
    return df.withColumnsRenamed({k: v for k, v in DISPLAY_NAMES.items() if k in df.columns})
