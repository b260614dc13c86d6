"""Delivery tables derived from the star schema's ``events``, and its supplier contributions.

Deliveries are plain arithmetic on event_id, user_id, event_type and value, so the derived
table grows with ``events`` and the same rows can be written in any SQL dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation.
STYLE_CODES = ["RF", "RFM", "RM", "RMF", "LF", "LF/LM", "LFM", "LM", "LMF", "OB", "RM/OB", "S", "SLA", "LB", "SLW", "XX"]
SPIN_CODES = ["OB", "RM/OB", "S", "SLA", "LB", "SLW"]
KINDS = ["caught", "bowled", "lbw", "retired hurt", "hit wicket"]


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events placed in a match: 246 to a match, 120 balls, 120 balls and a super over of 6.

    Short expressions on purpose: a filter on a derived column reaches the scan with the
    whole derivation written out in it.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    placed = events.selectExpr(
        "event_id",
        "user_id",
        "event_type = 'purchase' AND event_id % 4 = 0 AS is_out",
        "value",
        "event_id div 246 AS m",
        "CAST((event_id % 246) div 120 + 1 AS INT) AS inn",
        "(event_id % 246) % 120 AS s",
    ).selectExpr(
        "*",
        "(m * 3 + inn) % 6 AS tb",
        "(m * 3 + CASE inn WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 4 END) % 6 AS tw",
        "s div 11 + user_id % 2 AS pos",
        "s div 11 + (user_id + 1) % 2 AS pos2",
    )
    named = placed.selectExpr(
        "*",
        "if(pos = 3 AND m % 5 = 0, concat('PX', m % 4), concat('P', tb * 12 + pos)) AS striker",
        "if(pos2 = 3 AND m % 5 = 0, concat('PX', m % 4), concat('P', tb * 12 + pos2)) AS non_striker",
        "NOT is_out AND event_id % 37 = 0 AS is_run_out",
        "tw * 7 + (s div 6) % 6 AS bowler_no",
    )
    return named.selectExpr(
        "event_id AS seq",
        "m AS match_id",
        "inn AS innings",
        "concat(2021 + m % 4, '-0', 1 + m % 9, '-1', m % 10) AS start_date",
        "concat('V', m % 13) AS venue",
        "(s + 4 * (s div 6) + 1) / 10D AS ball",
        "striker",
        "non_striker",
        "bowler_no",
        "concat('T', tb) AS batting_team",
        "concat('T', tw) AS bowling_team",
        "if(event_id % 23 = 0, 0, CAST(floor(value) % 7 AS INT)) AS runs_off_bat",
        "if(event_id % 23 = 0, 1, NULL) AS wides",
        "if(event_id % 41 = 0, 1, NULL) AS noballs",
        "CASE WHEN is_out THEN striker WHEN is_run_out THEN non_striker END AS player_dismissed",
        f"CASE WHEN is_out THEN get(array({_sql_list(KINDS)}), CAST((event_id div 4) % 6 AS INT))"
        " WHEN is_run_out THEN 'run out' END AS wicket_type",
    )


def deliveries_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw deliveries, one per event, with ``seq`` = event_id as the file order."""
    balls = _balls(spark, sf_dir)
    columns = [c for c in balls.columns if c != "bowler_no"]
    columns.insert(columns.index("non_striker") + 1, "concat('B', bowler_no) AS bowler")
    return balls.selectExpr(*columns)


def varied_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries with what real files also hold.

    Every bowler has two teams in a year, some overs have a tenth ball (written 3.10 and read
    as 3.1), and some strikers, venues and balls are missing.
    """
    changed = {
        "bowling_team": "if(match_id % 8 < 4, bowling_team, concat('X', bowling_team))",
        "ball": "if(seq % 103 = 0, NULL, if(match_id % 5 < 2 AND CAST(round(ball * 10) AS BIGINT) % 10 = 6,"
        " (floor(ball) * 10 + 1) / 10D, ball))",
        "striker": "if(seq % 97 = 0, NULL, striker)",
        "venue": "if(seq % 101 = 0, NULL, venue)",
    }
    raw = deliveries_from_events(spark, sf_dir)
    return raw.selectExpr(*[f"{changed[c]} AS {c}" if c in changed else c for c in raw.columns])


def typed_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in the typed layout."""
    return (
        _balls(spark, sf_dir)
        .selectExpr(
            "*",
            f"get(array({_sql_list(STYLE_CODES)}), CAST(bowler_no % 16 AS INT)) AS code",
            "player_dismissed IS NOT NULL AS fell",
        )
        .selectExpr(
            "seq",
            "match_id AS MatchNum",
            "innings AS MatchInn",
            "start_date AS StartDate",
            "concat('C', match_id % 3) AS CompName",
            "venue AS Venue",
            "ball AS Over",
            "striker AS Batter",
            "runs_off_bat AS Runs",
            "coalesce(wides, 0) + coalesce(noballs, 0) AS Extras",
            "CASE WHEN wides > 0 AND fell THEN 'WX' WHEN wides > 0 THEN 'W' WHEN fell THEN 'X' END AS Notes",
            "wicket_type AS LongDis",
            "code AS BowlType",
            f"if(code IN ({_sql_list(SPIN_CODES)}), 'S', 'F') AS BowlCat",
        )
    )


def supplier_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: its supplier, stratum, quantity and whether it came back."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return (
        lines.join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.year("o_orderdate").alias("year"),
            "p_type",
            "l_linenumber",
            F.col("l_suppkey").alias("supplier"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("bigint").alias("returned"),
            F.lit(1).cast("bigint").alias("lines"),
        )
    )
