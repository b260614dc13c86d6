"""Ratio metrics on totals; every division through ``np_div``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.functions.numeric import np_div, np_sub

BATTING_METRICS = ["ave", "sr", "expected_ave", "expected_sr", "true_ave", "true_sr", "out_ratio"]
BOWLING_METRICS = ["er", "expected_er", "true_er", "true_er_4_overs", "true_wickets", "true_w_4_overs"]


def with_batting_metrics(df: DataFrame) -> DataFrame:
    """Averages, strike rates and their distance from expectation."""
    return df.withColumns(
        {
            "ave": np_div("runs_scored", "out"),
            "sr": np_div("runs_scored", "bf") * 100,
            "expected_ave": np_div("expected_runs", "expected_outs"),
            "expected_sr": np_div("expected_runs", "bf") * 100,
            "out_ratio": np_div("expected_outs", "out"),
        }
    ).withColumns(
        {"true_ave": np_sub("ave", "expected_ave"), "true_sr": np_sub("sr", "expected_sr")}
    )


def with_bowling_metrics(df: DataFrame) -> DataFrame:
    """Economy and wickets against expectation, also per four overs."""
    overs = F.col("b").cast("double") / 6
    return (
        df.withColumns(
            {
                "er": np_div("runs_conceded", overs),
                "expected_er": np_div("expected_runs_conceded", overs),
                "true_wickets": np_sub("wicket", "expected_wickets"),
            }
        )
        .withColumn("true_er", np_sub("expected_er", "er"))
        .withColumns(
            {
                "true_er_4_overs": F.col("true_er") * 4,
                "true_w_4_overs": np_div("true_wickets", F.col("b").cast("double") / 24),
            }
        )
    )
