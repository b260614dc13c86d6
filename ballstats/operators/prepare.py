"""From raw delivery rows to the columns every analysis reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballstats.functions import deliveries as rules

# Index columns that a written-out table may carry.
INDEX_COLUMNS = ["Unnamed: 0", "_c0", ""]

# The typed layout's columns and their names here.
TYPED_NAMES = {
    "MatchNum": "match_id",
    "MatchInn": "innings",
    "CompName": "competition",
    "Venue": "venue",
    "Batter": "striker",
    "Runs": "runs_off_bat",
    "Over": "ball",
    "Extras": "extras",
    "Notes": "notes",
    "LongDis": "wicket_type",
    "BowlType": "bowl_type",
    "BowlCat": "bowl_cat",
}


def dedupe_first(df: DataFrame, order: str = "seq", ignore: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """One row per distinct content, keeping the first position.

    Copies meet in a hash aggregation that combines before the shuffle, so a row repeated
    any number of times costs no more than one row per task.
    """
    content = [c for c in df.columns if c != order and c not in ignore]
    return df.groupBy(*content).agg(F.min(order).alias(order)).select(*content, order)


def dedupe_by_digest(
    df: DataFrame, order: str = "seq", ignore: Sequence[str] = INDEX_COLUMNS, digest: Column | None = None
) -> DataFrame:
    """The same rows as :func:`dedupe_first`, for wide rows of which few repeat.

    First only digests are counted, so a row moves eight bytes.  Rows whose digest is met once stay where
    they are; the others meet by their whole content, so rows that merely share a digest both stay.
    The table is read three times, which pays where moving all of it would cost more.
    """
    content = [c for c in df.columns if c != order and c not in ignore]
    digest = F.xxhash64(*content) if digest is None else digest
    marked = df.select(*content, order, digest.alias("_digest"))
    again = marked.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_digest")
    alone = marked.join(again, "_digest", "left_anti").drop("_digest")
    met = marked.join(again, "_digest", "left_semi").drop("_digest")
    return alone.unionByName(dedupe_first(met, order, ignore))


def _dated(df: DataFrame, text: str) -> DataFrame:
    """Adds the date, in a step of its own, so that it is read once and everything else refers to it."""
    return df.withColumn("date", rules.match_date(F.col(text)))


def prepare_deliveries(raw: DataFrame) -> DataFrame:
    """Add balls counted, runs conceded, date, year, over and both wicket flags."""
    ball = F.col("ball").try_cast("double")
    dismissed, kind = F.col("player_dismissed"), F.col("wicket_type")
    return _dated(raw, "start_date").withColumns(
        {
            "b": rules.ball_counted(F.col("wides")),
            "rc": rules.runs_conceded(F.col("wides"), F.col("noballs"), F.col("runs_off_bat")),
            "wides": F.coalesce("wides", F.lit(0)),
            "noballs": F.coalesce("noballs", F.lit(0)),
            "year": F.year("date"),
            "ball": ball,
            "over": rules.over_number(ball),
            "wicket": rules.batter_out(dismissed, kind),
            "bowler_wicket": rules.bowler_wicket(dismissed, kind),
        }
    )


def prepare_typed(raw: DataFrame) -> DataFrame:
    """The typed layout under the same column names, with bowling style and category."""
    df = raw.withColumnsRenamed(TYPED_NAMES)
    ball = F.col("ball").try_cast("double")
    return _dated(df, "StartDate").withColumns(
        {
            "b": rules.ball_counted_by_note(F.col("notes")),
            "rc": rules.runs_conceded(F.col("runs_off_bat"), F.col("extras")),
            "year": F.year("date"),
            "ball": ball,
            "over": rules.over_number(ball),
            "types": rules.bowling_style(F.col("bowl_type")),
            "bowl_cat": rules.bowling_category(F.col("bowl_cat")),
            "wicket": rules.noted_wicket(F.col("notes"), F.col("wicket_type")),
        }
    )
