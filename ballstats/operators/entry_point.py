"""When a player comes in: the first ball of each innings, its median, and who played where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballstats.functions.numeric import delivery_number, over_ball


def appearances(
    deliveries: DataFrame, player: str, by: Sequence[str] = (), order: str = "seq"
) -> DataFrame:
    """One row per (year, match, innings, player, *by) with the ball first met in file order."""
    return (
        deliveries.filter(F.col(player).isNotNull())
        .groupBy("year", "match_id", "innings", F.col(player).alias("player"), *by)
        .agg(F.min_by("ball", order).alias("first_ball"))
    )


def median_entry(truncate: bool = False, accuracy: int | None = None) -> Column:
    """Aggregate: median first delivery.  Exact; the buffer holds one count per distinct delivery.

    With ``accuracy`` a mergeable quantile sketch of bounded size instead: an entry whose rank among n is
    off the middle by at most n / accuracy.  Of an even number it is the lower middle, not the mean of two.
    """
    number = delivery_number("first_ball", truncate)
    return F.median(number) if accuracy is None else F.percentile_approx(number, 0.5, accuracy)


def entry_points(
    deliveries: DataFrame, player: str, by: Sequence[str] = (), compat: bool = False, accuracy: int | None = None
) -> DataFrame:
    """Median entry point per (player, *by) as over.ball; rows with a NULL ``by`` are left out.

    ``compat`` cuts delivery numbers and, over whole careers, rounds the stored binary value.
    ``accuracy`` takes the median from a sketch, see :func:`median_entry`.
    """
    inner = [c for c in by if c != "year"]
    return (
        appearances(deliveries.dropna(subset=list(by)) if by else deliveries, player, inner)
        .groupBy("player", *by)
        .agg(median_entry(compat, accuracy).alias("_median"))
        .withColumn("median_entry_point", over_ball("_median", exact=compat and "year" not in by))
        .drop("_median")
    )


def _once_per_match(rows: DataFrame, key: Sequence[str]) -> Column:
    """1 on one appearance of each (*key, match), the earliest innings, and 0 on its others and without a match.

    Summing it counts matches without a distinct aggregation, whose groups per match would
    each carry a median's buffer.  The window sees the few innings of a player in a match.
    """
    match = Window.partitionBy(*key, "match_id").orderBy("innings", "team")
    return F.when(F.col("match_id").isNotNull() & (F.row_number().over(match) == 1), 1).otherwise(0)


def season_roster(
    deliveries: DataFrame, player: str, team: str, by: Sequence[str] = (), compat: bool = False
) -> DataFrame:
    """Every (player, year, *by, team) with matches played and median entry point.

    Matches are counted per (player, year, *by) over all teams, entry points per team; the
    window that adds the teams up sees the few teams of a player's season.  With ``compat``
    the entry points are matched without the team, so a player of n teams gets n * n rows.
    """
    key = ["player", "year", *by]
    rows = appearances(deliveries, player, [*by, team]).withColumnRenamed(team, "team")
    teams = (
        rows.withColumn("_match", _once_per_match(rows, key))
        .groupBy(*key, "team")
        .agg(F.sum("_match").alias("_matches"), median_entry(compat).alias("_median"))
    )
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    matches = F.sum("_matches").over(Window.partitionBy(*key))
    entry = F.when(F.col("team").isNotNull(), over_ball("_median"))
    roster = teams.select(
        *key, "team", F.when(known, matches).alias("innings_count"), entry.alias("median_entry_point")
    )
    if not compat:
        return roster
    entries = roster.filter(F.col("team").isNotNull()).select(*key, "median_entry_point")
    return roster.drop("median_entry_point").join(entries, key, "left")


def career_profile(deliveries: DataFrame, player: str, team: str, max_innings: int | None) -> DataFrame:
    """Per player: main team, matches summed over seasons, and median entry point.

    Team and matches look at innings up to ``max_innings``, the entry point at all.  Both
    grains are grouping sets of one pass over the appearances.
    """
    rows = appearances(deliveries, player, [team]).withColumnRenamed(team, "team")
    main = F.lit(True) if max_innings is None else F.col("innings") <= max_innings
    rows = rows.withColumn("_match", F.when(main, _once_per_match(rows, ["player", "year"])))
    levels = rows.groupingSets([["player", "year", "team"], ["player"]], "player", "year", "team").agg(
        F.sum("_match").alias("_matches"),
        median_entry().alias("_median"),
        F.grouping("year").alias("_career"),
    )
    # NULL matches: no appearance up to max_innings
    season = (F.col("_career") == 0) & F.col("_matches").isNotNull()
    return levels.groupBy("player").agg(
        over_ball(F.max(F.when(F.col("_career") == 1, F.col("_median")))).alias("median_entry_point"),
        F.max(F.when(F.col("_career") == 1, F.col("_matches"))).alias("innings_count"),
        F.mode(F.when(season, F.col("team")), True).alias("team"),
    )
