"""Registered queries: each reads the given tables and returns a DataFrame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import ballstats as bs
from ballstats.functions.deliveries import match_date, season_label
from ballstats.functions.numeric import np_div, np_sub, round2
from ballstats.operators.baseline import IEEE, LOO, loo_expected, roll_up
from ballstats.operators.entry_point import entry_points
from ballstats.operators.filters import main_innings
from ballstats.operators.prepare import dedupe_by_digest
from ballstats.operators.ranking import best_first, number_rows
from ballstats.plans import batting, bowling
from ballstats.plans.batting import batting_cells
from ballstats.schema import DELIVERIES
from ballstats.sinks.export import export_ball_by_ball, export_by_ball, export_pivots, export_progression
from ballstats.sources.csv import LEAGUES, load_deliveries, load_league, load_typed, merge_csv
from ballstats.sources.starschema import (
    deliveries_from_events,
    supplier_contributions,
    typed_from_events,
    varied_from_events,
)
from ballstats.sources.tables import ingest, read_table, scratch_path

# Every name the derivation of strikers can give; pivots have one column for each.
PIVOT_PLAYERS = [f"P{i}" for i in range(72)] + [f"PX{i}" for i in range(4)]


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    return bs.prepare_deliveries(deliveries_from_events(spark, sf))


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return bs.prepare_typed(typed_from_events(spark, sf))


def varied(spark: SparkSession, sf: str) -> DataFrame:
    return bs.prepare_deliveries(varied_from_events(spark, sf))


def _main(spark, sf):
    return main_innings(bs.Filters().apply(deliveries(spark, sf)), 2)


def _plain(df: DataFrame) -> DataFrame:
    """Dates as text and flags as numbers, so both engines print them alike."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "date":
            c = c.cast("string")
        elif kind == "boolean":
            c = c.cast("int")
        out.append(c.alias(name))
    return df.select(*out)


PREPARED = [
    "seq", "match_id", "innings", "date", "year", "venue", "ball", "over", "striker", "bowler",
    "runs_off_bat", "b", "rc", "wides", "noballs", "wicket", "bowler_wicket",
]

FILTERS = bs.Filters(
    overs=(3, 15),
    dates=(dt.date(2021, 6, 1), dt.date(2023, 8, 31)),
    batting_teams=["T0", "T1", "T2", "T3"],
    bowling_teams=["T1", "T3", "T4", "T5"],
    innings=[1, 2],
)


# --- preparation ---------------------------------------------------------------------------
def deliveries_prepared(spark, sf):
    return _plain(deliveries(spark, sf).select(*PREPARED))


def dedupe_first_seq(spark, sf):
    """A table merged with its own output: every row is there again, at a later place."""
    once = deliveries_from_events(spark, sf)
    again = once.withColumn("seq", F.col("seq") + 10_000_000_000)
    return bs.dedupe_first(once.unionByName(again))


def dedupe_by_digest_seq(spark, sf):
    """A table of which every tenth row is there again."""
    once = deliveries_from_events(spark, sf)
    again = once.filter("seq % 10 = 0").withColumn("seq", F.col("seq") + 10_000_000_000)
    return dedupe_by_digest(once.unionByName(again))


def typed_prepared(spark, sf):
    columns = ["seq", "match_id", "striker", "over", "b", "rc", "notes", "types", "bowl_cat", "competition", "wicket"]
    return _plain(typed(spark, sf).select(*columns))


def date_parse_mixed(spark, sf):
    """Order dates written in three formats and read back by the mixed-format rule."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    text = (
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )
    parsed = match_date(F.col("text"))
    return o.select("o_orderkey", text.alias("text")).select(
        "o_orderkey", "text", parsed.cast("string").alias("date"), F.year(parsed).alias("year")
    )


DATE_FORMS = ["yyyy/MM/dd", "yyyyMMdd", "MM/dd/yyyy HH:mm", "d MMM yyyy", "MMMM d, yyyy", "dd-MMM-yyyy", "yyyy-MM-dd HH:mm:ss"]


def date_forms(spark, sf):
    """Order dates written in further forms, each of which has one reading."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    day = F.col("o_orderdate").cast("timestamp")
    text = F.lit(None).cast("string")
    for i, form in enumerate(DATE_FORMS):
        text = F.when(F.col("o_orderkey") % len(DATE_FORMS) == i, F.date_format(day, form)).otherwise(text)
    return o.select("o_orderkey", match_date(text).cast("string").alias("date"))


# --- batting ---------------------------------------------------------------------------------
def batting_cells_q(spark, sf):
    cells = batting_cells(_main(spark, sf))
    return cells.select(
        "year", "venue", "over", "player", "runs_scored", "bf", "out", "total_runs_scored", "total_bf", "total_out"
    )


def batting_loo(spark, sf):
    cells = batting_cells(_main(spark, sf))
    return cells.select("year", "venue", "over", "player", "expected_runs", "expected_outs")


def batting_empty_baseline_ieee(spark, sf):
    return bs.batting_season(
        deliveries(spark, sf), bs.Filters(innings=[1]), thresholds=None, empty_baseline=IEEE
    )


def season_filtered(spark, sf):
    return bs.batting_season(deliveries(spark, sf), FILTERS)


def entry_point_season(spark, sf):
    return entry_points(_main(spark, sf), "striker", ["year", "batting_team"])


def entry_point_overall(spark, sf):
    return entry_points(bs.Filters().apply(deliveries(spark, sf)), "striker")


def entry_point_sketch(spark, sf):
    """The lower median from a sketch, which is exact for up to 10,000 innings of a player."""
    return entry_points(bs.Filters().apply(deliveries(spark, sf)), "striker", accuracy=10_000)


def entry_point_bowling(spark, sf):
    return entry_points(bs.Filters().apply(deliveries(spark, sf)), "bowler", ["year", "bowling_team"])


def entry_point_matchup(spark, sf):
    return entry_points(bs.Filters().apply(typed(spark, sf)), "striker", ["types"], compat=True)


def player_season_label(spark, sf):
    rows = bs.batting_season(deliveries(spark, sf))
    return rows.select("team", season_label(F.col("player"), F.col("year")).alias("player2"), "runs_scored")


# --- filters -----------------------------------------------------------------------------------
def filter_stack(spark, sf):
    columns = ["seq", "date", "over", "innings", "batting_team", "bowling_team"]
    return _plain(FILTERS.apply(deliveries(spark, sf)).select(*columns))


def filter_teams(spark, sf):
    """Both sides of one list, and bowling teams that give way to batting teams."""
    d = deliveries(spark, sf)
    both = bs.Filters(between_teams=["T0", "T2", "T4"]).apply(d)
    first = bs.Filters(batting_teams=["T1"], bowling_teams=["T2"], batting_first=True).apply(d)
    keep = ["seq", "batting_team", "bowling_team"]
    return both.select(*keep, F.lit("both").alias("rule")).unionByName(
        first.select(*keep, F.lit("first").alias("rule"))
    )


def _run_out_players(d):
    return d.filter(F.col("wicket_type") == "run out").select("player_dismissed").distinct()


def players_semi(spark, sf):
    d = deliveries(spark, sf)
    return bs.batting_overall(d, players=_run_out_players(d))


def players_anti(spark, sf):
    d = deliveries(spark, sf)
    wanted = d.select(F.explode(F.array("striker", "bowler")).alias("player"))
    return bs.missing_players(bs.batting_season(d, FILTERS), wanted)


def filter_bounds(spark, sf):
    return _plain(bs.bounds(deliveries(spark, sf)))


def distinct_values(spark, sf):
    return bs.distinct_values(
        deliveries(spark, sf), ["year", "date", "striker", "bowler", "batting_team", "bowling_team"]
    )


# --- finished tables ---------------------------------------------------------------------------
def _ranked(table: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The place of each row in a finished table's order."""
    measure, *ties = order
    return number_rows(table, best_first(*order), "rank").select("rank", *ties, measure)


def batting_ranked(spark, sf):
    return _ranked(bs.batting_season(deliveries(spark, sf)), batting.SEASON_ORDER)


def bowling_ranked(spark, sf):
    return _ranked(bs.bowling_season(deliveries(spark, sf)), bowling.SEASON_ORDER)


def bowling_thresholds(spark, sf):
    """Bounds that cut rows on both sides."""
    limits = bs.BowlingThresholds(min_wickets=3, max_wickets=9, min_balls=100, max_balls=240)
    return bs.bowling_season(deliveries(spark, sf), thresholds=limits)


def entry_point_bowling_career(spark, sf):
    return entry_points(bs.Filters().apply(deliveries(spark, sf)), "bowler")


def matchup_category(spark, sf):
    return bs.matchup_season(typed(spark, sf), "bowl_cat", bs.Filters(categories=["Spin"]))


# --- matchup -----------------------------------------------------------------------------------
MATCH_FILTERS = bs.Filters(competitions=["C0", "C2"], types=["Right Arm Pace", "Left Arm Finger Spin", "L"])


# --- order-dependent -----------------------------------------------------------------------------
def batter_running(spark, sf):
    return bs.batter_running(deliveries(spark, sf)).select(
        "seq", "striker", "match_id", "innings", "runs", "balls", "wickets"
    )


def bowler_running(spark, sf):
    return bs.bowler_running(deliveries(spark, sf)).select(
        "seq", "bowler", "match_id", "innings", "runs", "balls", "wickets"
    )


def _by_ball(spark, sf):
    return bs.progression_by_ball(bs.batter_progression(deliveries(spark, sf)))


def batting_position(spark, sf):
    return bs.with_batting_position(deliveries(spark, sf)).select("seq", "match_id", "striker", "batting_position")


def batting_position_filtered(spark, sf):
    placed = bs.with_batting_position(deliveries(spark, sf))
    return bs.batting_season(placed, bs.Filters(positions=(1, 3)))


# --- generic baseline ------------------------------------------------------------------------------
SUPPLIER_STRATA = ["year", "p_type", "l_linenumber"]


def _supplier_cells(spark, sf):
    return loo_expected(
        supplier_contributions(spark, sf), "supplier", SUPPLIER_STRATA, ["quantity", "returned"], "lines", IEEE, LOO
    )


def supplier_loo(spark, sf):
    return _supplier_cells(spark, sf)


def supplier_loo_season(spark, sf):
    totals = roll_up(
        _supplier_cells(spark, sf),
        ["year", "supplier"],
        ["quantity", "returned", "lines"],
        ["expected_quantity", "expected_returned"],
    )
    per_line, expected = np_div("quantity", "lines"), np_div("expected_quantity", "lines")
    return totals.withColumns(
        {
            "per_line": round2(per_line),
            "expected_per_line": round2(expected),
            "true_per_line": round2(np_sub(per_line, expected)),
            "return_ratio": round2(np_div("expected_returned", "returned")),
            "expected_quantity": round2("expected_quantity"),
            "expected_returned": round2("expected_returned"),
        }
    )


# --- sources and sinks -------------------------------------------------------------------------------
def _write_csv(df, path):
    df.write.option("header", True).option("escape", '"').csv(path)


def csv_roundtrip(spark, sf):
    """Raw rows written as CSV, twice the same file, and loaded: typed, deduplicated, prepared."""
    path = scratch_path(spark)
    raw = deliveries_from_events(spark, sf)
    _write_csv(raw.drop("seq"), f"{path}/a")
    _write_csv(raw.drop("seq"), f"{path}/b")
    loaded = load_deliveries(spark, [f"{path}/a", f"{path}/b"])
    return _plain(loaded.select(*[c for c in PREPARED if c != "seq"]))


def _rename_parts(spark, folder, to, ending):
    """Move the files of a written table into one folder under names of their own."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(to))
    for i, status in enumerate(fs.listStatus(path(folder))):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), path(f"{to}/{i}{ending}"))


def multi_file_merge(spark, sf):
    """Files of different columns, one with an index column, and info files to be skipped by their name."""
    path = scratch_path(spark)
    raw = deliveries_from_events(spark, sf)
    half = F.col("match_id") % 2 == 0
    plain = raw.filter(half).drop("seq", "noballs")
    indexed = raw.filter(~half).withColumnRenamed("seq", "_c0")
    turned = indexed.select("_c0", *reversed([c for c in indexed.columns if c != "_c0"]))
    for name, df in (("plain", plain), ("indexed", turned), ("match_info", raw.select("match_id", "venue"))):
        _write_csv(df, f"{path}/{name}")
        _rename_parts(spark, f"{path}/{name}", f"{path}/all", f"_{name}.csv")
    return merge_csv(spark, f"{path}/all", DELIVERIES).select(*DELIVERIES.fieldNames())


def league_registry(spark, sf):
    """Each league in its own registered file, all written at once, and loaded by name."""
    path = scratch_path(spark)
    raw = deliveries_from_events(spark, sf)
    names = F.array(*[F.lit(f) for f in LEAGUES.values()])
    file = F.element_at(names, (F.col("match_id") % len(LEAGUES) + 1).cast("int"))
    written = raw.drop("seq").withColumn("file", file)
    written.write.partitionBy("file").option("header", True).option("escape", '"').csv(path)
    there = {r.file for r in written.select("file").distinct().collect()}  # the smallest tables lack some leagues
    files = {league: f"file={name}" for league, name in LEAGUES.items() if name in there}
    tables = [load_league(spark, path, league, files).withColumn("league", F.lit(league)) for league in files]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.groupBy("league", "year").agg(
        F.count("*").alias("balls"),
        F.sum("runs_off_bat").alias("runs"),
        F.count_distinct("striker").alias("strikers"),
    )


def typed_union(spark, sf):
    """The two typed files, loaded one by one and united; then the matchup on all of it."""
    path = scratch_path(spark)
    raw = typed_from_events(spark, sf).drop("seq")
    leagues = F.col("MatchNum") % 3 == 0
    _write_csv(raw.filter(~leagues), f"{path}/T20Data.csv")
    _write_csv(raw.filter(leagues), f"{path}/T20Leagues.csv")
    rows = load_typed(spark, path)
    return rows.groupBy("competition", "types", "bowl_cat").agg(
        F.count("*").alias("n"),
        F.sum("runs_off_bat").alias("runs"),
        F.sum("rc").alias("rc"),
        F.sum("b").alias("balls"),
        F.sum(F.col("wicket").cast("int")).alias("wickets"),
    )


def table_ingest(spark, sf):
    """Ingested as a partitioned table whose ``seq`` follows the file order, then rated."""
    path = scratch_path(spark)
    raw = deliveries_from_events(spark, sf)
    ingest(raw.withColumn("league", F.concat(F.lit("L"), F.col("match_id") % 4)), path)
    return bs.batting_season(read_table(spark, path))


def export_running(spark, sf):
    path = scratch_path(spark)
    export_ball_by_ball(bs.batter_running(deliveries(spark, sf)), path)
    return spark.read.parquet(path).select("year", "seq", "striker", "runs", "balls", "wickets")


PROGRESSION_COLUMNS = "match_id BIGINT, innings INT, player STRING, over INT, runs BIGINT, balls BIGINT, year INT"


def export_batter_progression(spark, sf):
    path = scratch_path(spark)
    export_progression(bs.batter_progression(deliveries(spark, sf)), path)
    return spark.read.schema(PROGRESSION_COLUMNS).option("header", True).csv(path)


def export_bowler_progression(spark, sf):
    path = scratch_path(spark)
    export_progression(bs.bowler_progression(deliveries(spark, sf)), path)
    return spark.read.schema(PROGRESSION_COLUMNS).option("header", True).csv(path)


def export_progression_by_ball(spark, sf):
    path = scratch_path(spark)
    export_by_ball(_by_ball(spark, sf), path)
    columns = "player STRING, balls BIGINT, runs BIGINT, count BIGINT, ave_runs DOUBLE, sr DOUBLE, year INT"
    return spark.read.schema(columns).option("header", True).csv(path)


def export_pivot_files(spark, sf):
    """Both pivots per season written wide; read back as (value, year, balls, player, number)."""
    path = scratch_path(spark)
    by_ball = _by_ball(spark, sf)
    export_pivots(by_ball, path)
    out = None
    years = [r.year for r in by_ball.select("year").distinct().orderBy("year").collect()]
    for value in ("ave_runs", "sr"):
        for year in years:
            wide = spark.read.option("header", True).option("escape", '"').csv(f"{path}/value={value}/year={year}")
            long = wide.unpivot("balls", [c for c in wide.columns if c != "balls"], "player", "number")
            long = long.filter(F.col("number").isNotNull()).select(
                F.lit(value).alias("value"),
                F.lit(year).alias("year"),
                F.col("balls").cast("bigint").alias("balls"),
                "player",
                F.col("number").cast("double").alias("number"),
            )
            out = long if out is None else out.unionByName(long)
    return out


QUERIES = {
    "deliveries_prepared": deliveries_prepared,
    "typed_prepared": typed_prepared,
    "dedupe_first_seq": dedupe_first_seq,
    "dedupe_by_digest_seq": dedupe_by_digest_seq,
    "date_parse_mixed": date_parse_mixed,
    "date_forms": date_forms,
    "batting_cells": batting_cells_q,
    "batting_loo": batting_loo,
    "batting_season": lambda s, sf: bs.batting_season(deliveries(s, sf)),
    "batting_season_compat": lambda s, sf: bs.batting_season(deliveries(s, sf), compat=True),
    "batting_season_filtered": season_filtered,
    "batting_overall": lambda s, sf: bs.batting_overall(deliveries(s, sf)),
    "batting_overall_compat": lambda s, sf: bs.batting_overall(deliveries(s, sf), compat=True),
    "batting_empty_baseline_ieee": batting_empty_baseline_ieee,
    "matchup_season_types": lambda s, sf: bs.matchup_season(typed(s, sf), "types"),
    "matchup_season_cat": lambda s, sf: bs.matchup_season(typed(s, sf), "bowl_cat"),
    "matchup_season_compat": lambda s, sf: bs.matchup_season(typed(s, sf), "types", compat=True),
    "matchup_season_filtered": lambda s, sf: bs.matchup_season(typed(s, sf), "types", MATCH_FILTERS),
    "matchup_overall": lambda s, sf: bs.matchup_overall(typed(s, sf), "types"),
    "matchup_overall_cat": lambda s, sf: bs.matchup_overall(typed(s, sf), "bowl_cat"),
    "bowling_season": lambda s, sf: bs.bowling_season(deliveries(s, sf)),
    "bowling_season_compat": lambda s, sf: bs.bowling_season(deliveries(s, sf), compat=True),
    "bowling_overall": lambda s, sf: bs.bowling_overall(deliveries(s, sf)),
    "bowling_overall_compat": lambda s, sf: bs.bowling_overall(deliveries(s, sf), compat=True),
    "bowling_season_varied": lambda s, sf: bs.bowling_season(varied(s, sf)),
    "bowling_season_varied_compat": lambda s, sf: bs.bowling_season(varied(s, sf), compat=True),
    "bowling_overall_varied": lambda s, sf: bs.bowling_overall(varied(s, sf)),
    "bowling_overall_varied_compat": lambda s, sf: bs.bowling_overall(varied(s, sf), compat=True),
    "batting_season_varied": lambda s, sf: bs.batting_season(varied(s, sf)),
    "batting_ranked": batting_ranked,
    "bowling_ranked": bowling_ranked,
    "bowling_thresholds": bowling_thresholds,
    "matchup_category": matchup_category,
    "entry_point_bowling_career": entry_point_bowling_career,
    "entry_point_season": entry_point_season,
    "entry_point_overall": entry_point_overall,
    "entry_point_sketch": entry_point_sketch,
    "entry_point_bowling": entry_point_bowling,
    "entry_point_matchup": entry_point_matchup,
    "filter_stack": filter_stack,
    "filter_teams": filter_teams,
    "players_semi": players_semi,
    "players_anti": players_anti,
    "filter_bounds": filter_bounds,
    "distinct_values": distinct_values,
    "batter_running": batter_running,
    "bowler_running": bowler_running,
    "career_innings_no": lambda s, sf: bs.career_innings_no(deliveries(s, sf)),
    "career_innings_no_types": lambda s, sf: bs.career_innings_no(typed(s, sf), by=["types"]),
    "progression_by_ball": lambda s, sf: _by_ball(s, sf),
    "pivot_ave_runs": lambda s, sf: bs.pivot_by_ball(_by_ball(s, sf), "ave_runs", PIVOT_PLAYERS),
    "pivot_sr": lambda s, sf: bs.pivot_by_ball(_by_ball(s, sf), "sr", PIVOT_PLAYERS),
    "batter_progression": lambda s, sf: bs.batter_progression(deliveries(s, sf)),
    "bowler_progression": lambda s, sf: bs.bowler_progression(deliveries(s, sf)),
    "phase_table": lambda s, sf: bs.phase_table(deliveries(s, sf)),
    "phase_table_dense": lambda s, sf: bs.phase_table(deliveries(s, sf), dense=True),
    "over_table": lambda s, sf: bs.over_table(typed(s, sf)),
    "bowling_phase": lambda s, sf: bs.bowling_phase(deliveries(s, sf)),
    "batting_phase_season": lambda s, sf: bs.batting_phase_season(deliveries(s, sf)),
    "batting_position": batting_position,
    "batting_position_filtered": batting_position_filtered,
    "player_season_label": player_season_label,
    "csv_roundtrip": csv_roundtrip,
    "multi_file_merge": multi_file_merge,
    "league_registry": league_registry,
    "typed_union": typed_union,
    "table_ingest": table_ingest,
    "export_running": export_running,
    "export_batter_progression": export_batter_progression,
    "export_bowler_progression": export_bowler_progression,
    "export_progression_by_ball": export_progression_by_ball,
    "export_pivot_files": export_pivot_files,
    "supplier_loo": supplier_loo,
    "supplier_loo_season": supplier_loo_season,
}
