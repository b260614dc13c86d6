"""How an innings or a spell grows ball by ball."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.functions.numeric import np_div, round2
from ballstats.operators.filters import Filters, main_innings
from ballstats.operators.totals import CHUNK_ROWS, running_sums

INNINGS = ["match_id", "innings"]


PROGRESS = ["year", *INNINGS, "over"]


def _running(deliveries, player, measures, filters, max_innings, order, chunk_rows, columns) -> DataFrame:
    main = main_innings(filters.apply(deliveries), max_innings)
    if columns is not None:
        main = main.select(*dict.fromkeys([*columns, player, *INNINGS, order, *measures.values()]))
    sums = {new: F.col(c).cast("int") if new == "wickets" else F.col(c) for new, c in measures.items()}
    return running_sums(main, [player, *INNINGS], order, sums, chunk_rows)


def batter_running(
    deliveries: DataFrame,
    filters: Filters = Filters(),
    max_innings: int | None = 2,
    order: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every delivery with the striker's runs, balls and wickets so far in the innings.

    All columns stay, or ``columns`` and those the totals need: only these are read and shuffled.
    """
    measures = {"runs": "runs_off_bat", "balls": "b", "wickets": "wicket"}
    return _running(deliveries, "striker", measures, filters, max_innings, order, chunk_rows, columns)


def bowler_running(
    deliveries: DataFrame,
    filters: Filters = Filters(),
    max_innings: int | None = None,
    order: str = "seq",
    chunk_rows: int = CHUNK_ROWS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every delivery with the bowler's runs conceded, balls and wickets so far."""
    measures = {"runs": "rc", "balls": "b", "wickets": "bowler_wicket"}
    return _running(deliveries, "bowler", measures, filters, max_innings, order, chunk_rows, columns)


def progression_rows(running: DataFrame, player: str) -> DataFrame:
    """Distinct (match, innings, player, over, runs, balls): a wide adds a row only in a new over."""
    return running.select("year", *INNINGS, F.col(player).alias("player"), "over", "runs", "balls").distinct()


def batter_progression(deliveries: DataFrame, filters: Filters = Filters(), **options) -> DataFrame:
    return progression_rows(batter_running(deliveries, filters, columns=PROGRESS, **options), "striker")


def bowler_progression(deliveries: DataFrame, filters: Filters = Filters(), **options) -> DataFrame:
    return progression_rows(bowler_running(deliveries, filters, columns=PROGRESS, **options), "bowler")


def progression_by_ball(rows: DataFrame) -> DataFrame:
    """Mean runs and strike rate after n balls, per (year, player, balls)."""
    counted = F.when(F.col("balls") == 0, 0).otherwise(1)
    return (
        rows.dropna(subset=["player", "balls"])
        .groupBy("year", "player", "balls")
        .agg(F.sum("runs").alias("runs"), F.sum(counted).alias("count"))
        .withColumn("ave_runs", np_div("runs", "count"))
        .withColumn("sr", np_div("ave_runs", "balls") * 100)
    )


def pivot_by_ball(by_ball: DataFrame, value: str, players: Sequence[str] | None = None) -> DataFrame:
    """One row per (year, balls), one column per player, rounded to two decimals.

    Without ``players`` every player gets a column, as far as Spark's limit on pivot values goes
    (``spark.sql.pivotMaxValues``; more are an error).
    """
    known = by_ball.filter(F.col(value).isNotNull())
    if players is not None:
        known = known.filter(F.col("player").isin(list(players)))
    grouped = known.groupBy("year", "balls")
    pivoted = grouped.pivot("player") if players is None else grouped.pivot("player", list(players))
    return pivoted.agg(round2(F.avg(value)))


def wide_lines(by_ball: DataFrame, value: str, cells: int = 1 << 22) -> DataFrame:
    """The same table as lines of CSV text for each season: (year, part, place, line).

    The columns are the season's own players in name order, so a season of any number of players
    has one layout, and no name leaves Spark.  A season is cut by ``balls`` into parts of about
    ``cells`` cells, at least one line each, and every part begins with the header, at place -1.
    """
    quoted = F.when(F.col("player").rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace("player", F.lit('"'), F.lit('""')), F.lit('"')))
    known = by_ball.filter(F.col(value).isNotNull()).groupBy("year", "balls", "player").agg(round2(F.avg(value)).alias("v"))
    names = known.groupBy("year").agg(F.array_sort(F.collect_set("player")).alias("names"))
    titles = known.select("year", "player", F.coalesce(quoted, "player").alias("title")).distinct()
    header = titles.groupBy("year").agg(
        F.concat_ws(",", F.lit("balls"), F.expr("transform(array_sort(collect_list(struct(player, title))), x -> x.title)")).alias("line")
    )
    rows = known.groupBy("year", "balls").agg(F.map_from_entries(F.collect_list(F.struct("player", "v"))).alias("cells"))
    written = F.transform("names", lambda n: F.coalesce(F.try_element_at(F.col("cells"), n).cast("string"), F.lit("")))
    line = F.concat_ws(",", F.col("balls").cast("string"), F.array_join(written, ","))
    part = F.floor(F.col("balls") / F.greatest(F.lit(1), F.floor(F.lit(cells) / F.size("names")))).alias("part")
    body = rows.join(names, "year").select("year", part, F.col("balls").alias("place"), line.alias("line"))
    parts = known.select("year", "balls").join(names, "year").select("year", part).distinct()
    heads = parts.join(header, "year").select("year", "part", F.lit(-1).cast("bigint").alias("place"), "line")
    return heads.union(body)


def career_innings_no(
    deliveries: DataFrame,
    filters: Filters = Filters(),
    max_innings: int | None = 2,
    by: Sequence[str] = (),
    chunk_rows: int = 4096,
) -> DataFrame:
    """Number of each match among a player's (and style's) matches of the season, in match order."""
    main = main_innings(filters.apply(deliveries), max_innings)
    key = ["year", "player", *by]
    matches = (
        main.dropna(subset=["striker", "match_id", *by])
        .select("year", F.col("striker").alias("player"), *by, "match_id")
        .distinct()
    )
    return running_sums(matches, key, "match_id", {"ci": F.lit(1)}, chunk_rows)
