"""Files written for each season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballstats.functions.numeric import round2
from ballstats.operators.ranking import number_rows
from ballstats.plans.progression import wide_lines
from ballstats.sources.tables import keep


def rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: round2(f"`{c}`") for c in doubles})


def write_by_year(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One folder per year; a large year is split over several even files."""
    writer = df.hint("rebalance", F.col("year")).write.mode(mode).partitionBy("year")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def export_ball_by_ball(running: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Every delivery with its running totals; a CSV leaves out a position that is no number."""
    flat = [F.col(c) for c, kind in running.dtypes if fmt != "csv" or not kind.startswith("struct")]
    write_by_year(running.select(*flat), path, fmt)


def export_progression(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Progression rows of batters or bowlers."""
    write_by_year(rounded(rows), path, fmt)


def export_by_ball(by_ball: DataFrame, path: str, fmt: str = "csv") -> None:
    """Mean runs and strike rate after n balls."""
    write_by_year(rounded(by_ball), path, fmt)


def export_pivots(
    by_ball: DataFrame,
    path: str,
    values: Sequence[str] = ("ave_runs", "sr"),
    years: Sequence[int] | None = None,
    cells: int = 1 << 22,
) -> None:
    """One wide CSV per value and season, ``value=.../year=.../``: a row per balls, a column per player of that season.

    Lines are built in Spark from one long table and written as text.  A season of more than ``cells``
    cells becomes several files, each with the header and written by a task of its own; their names
    follow the order of ``balls``.
    """
    if years is not None:
        by_ball = by_ball.filter(F.col("year").isin(list(years)))
    by_ball = keep(by_ball)
    lines = None
    for value in values:
        part = wide_lines(by_ball, value, cells).select(F.lit(value).alias("value"), "year", "part", "place", "line")
        lines = part if lines is None else lines.union(part)
    file = ["value", "year", "part"]
    files = number_rows(lines.filter("place < 0").select(*file), [F.col(c) for c in file], "file")
    placed = lines.join(F.broadcast(files), file)  # a row for each file that is written
    ordered = placed.repartitionById(max(1, files.count()), (F.col("file") - 1).cast("int")).sortWithinPartitions("value", "year", "place")
    ordered.select("value", "year", "line").write.mode("overwrite").partitionBy("value", "year").text(path)
