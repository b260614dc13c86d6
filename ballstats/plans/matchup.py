"""Batting against each bowling style, or against pace and spin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.functions.metrics import BATTING_METRICS, with_batting_metrics
from ballstats.functions.numeric import exact_sum, over_ball, round2
from ballstats.operators.baseline import IEEE, loo_expected, roll_up
from ballstats.operators.entry_point import appearances, median_entry
from ballstats.operators.filters import Filters, chosen_players, main_innings
from ballstats.operators.phases import with_means

TYPES = "types"
CATEGORY = "bowl_cat"
TOTALS = ["runs_scored", "bf", "out"]
EXPECTED = ["expected_runs", "expected_outs"]


def _repeat_weights(deliveries: DataFrame) -> DataFrame:
    """How often a delivery repeats when outs are joined on (match, innings, batter, note, over)."""
    key = ["year", "match_id", "innings", "striker", "notes", "over"]
    outs = deliveries.filter("wicket").groupBy(*key).agg(F.count("*").alias("weight"))
    noted = F.col("notes").isNotNull()
    plain = deliveries.filter(~noted).withColumn("weight", F.lit(1).cast("bigint"))
    joined = deliveries.filter(noted).join(outs, key, "left")
    return plain.unionByName(joined.withColumn("weight", F.coalesce("weight", F.lit(1))))


def matchup_cells(
    deliveries: DataFrame, by: str = TYPES, empty_baseline: str = IEEE, compat: bool = False
) -> DataFrame:
    """Per (year, venue, over, style, batter): totals, stratum totals and expected values."""
    times = F.lit(1)
    if compat:
        deliveries, times = _repeat_weights(deliveries), F.col("weight")
    strata = ["year", "venue", "over", by]
    contributions = deliveries.select(
        *strata,
        F.col("striker").alias("player"),
        (F.col("runs_off_bat") * times).cast("bigint").alias("runs_scored"),
        (F.col("b") * times).cast("bigint").alias("bf"),
        F.col("wicket").cast("bigint").alias("out"),
    )
    return loo_expected(
        contributions, "player", strata, ["runs_scored", "out"], "bf", empty_baseline
    ).withColumnsRenamed({"expected_runs_scored": "expected_runs", "expected_out": "expected_outs"})


def _season_rows(deliveries: DataFrame, by: str, empty_baseline: str, compat: bool) -> DataFrame:
    known = F.col(by).isNotNull()
    roster = (
        appearances(deliveries, "striker", [by])
        .groupBy("player", "year", by)
        .agg(F.count_distinct("match_id").alias("_matches"), median_entry(compat).alias("_median"))
        .select(
            "player",
            "year",
            by,
            F.when(known, F.col("_matches")).alias("innings_count"),
            F.when(known, over_ball("_median")).alias("median_entry_point"),
        )
    )
    totals = roll_up(
        matchup_cells(deliveries, by, empty_baseline, compat), ["year", "player", by], TOTALS, EXPECTED
    )
    metrics = with_batting_metrics(totals).withColumns({c: round2(c) for c in [*EXPECTED, *BATTING_METRICS]})
    return roster.join(metrics, ["player", "year", by], "left").select(
        "player", "year", by, "innings_count", *TOTALS, *EXPECTED, *BATTING_METRICS, "median_entry_point"
    )


def matchup_season(
    deliveries: DataFrame,
    by: str = TYPES,
    filters: Filters = Filters(),
    players=None,
    empty_baseline: str = IEEE,
    max_innings: int | None = 2,
    compat: bool = False,
) -> DataFrame:
    """One row per (player, year, style), most runs first."""
    main = main_innings(filters.apply(deliveries), max_innings)
    rows = chosen_players(_season_rows(main, by, empty_baseline, compat), players)
    return rows.orderBy(F.desc_nulls_last("runs_scored"), "player", "year", by)


def matchup_overall(
    deliveries: DataFrame,
    by: str = TYPES,
    filters: Filters = Filters(),
    players=None,
    empty_baseline: str = IEEE,
    max_innings: int | None = 2,
    compat: bool = False,
) -> DataFrame:
    """One row per (player, style): rounded seasons added up, ratios formed again."""
    main = main_innings(filters.apply(deliveries), max_innings)
    rows = _season_rows(main.filter(F.col(by).isNotNull()), by, empty_baseline, compat)
    sums = [F.sum(m).alias(m) for m in ["innings_count", *TOTALS]]
    careers = rows.groupBy("player", by).agg(*sums, *[exact_sum(e).alias(e) for e in EXPECTED])
    table = with_batting_metrics(careers).withColumns({c: round2(c) for c in [*EXPECTED, *BATTING_METRICS]})
    table = table.select("player", by, "innings_count", *TOTALS, *EXPECTED, *BATTING_METRICS)
    return chosen_players(table, players).orderBy(F.desc_nulls_last("runs_scored"), "player", by)


def over_table(deliveries: DataFrame, filters: Filters = Filters(), max_innings: int | None = 2) -> DataFrame:
    """Runs, balls and outs per (year, player, over) beside those of all players in the over."""
    main = main_innings(filters.apply(deliveries), max_innings)
    rows = (
        main.dropna(subset=["year", "venue", "over"])
        .filter(F.col("striker").isNotNull())
        .groupBy("year", F.col("striker").alias("player"), "over")
        .agg(
            F.sum(F.col("runs_off_bat").cast("bigint")).alias("runs_scored"),
            F.sum(F.col("b").cast("bigint")).alias("bf"),
            F.sum(F.col("wicket").cast("bigint")).alias("out"),
        )
    )
    return with_means(rows, ["year", "over"])
