"""A player's totals per phase (or over) beside the totals of everybody in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballstats.functions.deliveries import PHASES, in_a_phase, phase_of
from ballstats.functions.numeric import np_div
from ballstats.operators.totals import with_group_totals


def with_phase(df: DataFrame) -> DataFrame:
    return df.withColumn("phase", phase_of(F.col("over")))


def _all_phases(table: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Give each (*keys) a row for all four phases, zeros where there is none."""
    labels = F.array(*[F.lit(name) for name, _, _ in PHASES])
    zeros = table.select(*keys).distinct().withColumn("phase", F.explode(labels))
    zeros = zeros.select(*keys, "phase", *[F.lit(0).cast(table.schema[m].dataType).alias(m) for m in measures])
    rows = table.unionByName(zeros)
    return rows.groupBy(*keys, "phase").agg(*[F.sum(m).alias(m) for m in measures])


def phase_totals(
    cells: DataFrame, measures: dict[str, Column], dense: bool = False, keys: Sequence[str] = ("year", "player")
) -> DataFrame:
    """Aggregate cells per (*keys, phase); ``measures`` maps names to aggregate expressions.

    ``dense`` gives every player all four phases.  Otherwise the deliveries should be limited
    to the phases beforehand (:func:`in_phases`), which leaves other strata as they are and,
    unlike a filter on the finished cells, is the same for every use of the cells.
    """
    keys = list(keys)
    table = (
        with_phase(cells)
        .groupBy(*keys, "phase")
        .agg(*[expr.alias(name) for name, expr in measures.items()])
    )
    # players whose every over is outside the phases still get their four rows
    return _all_phases(table, keys, list(measures)).filter(F.col("phase").isNotNull()) if dense else table


def in_phases(deliveries: DataFrame) -> DataFrame:
    return deliveries.filter(in_a_phase(F.col("over")))


def with_means(table: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add the totals of everybody in the same group, and both strike rates."""
    means = {"mean_runs": "runs_scored", "mean_bf": "bf", "mean_outs": "out"}
    return with_group_totals(table, group, "player", means).withColumns(
        {"sr": np_div("runs_scored", "bf") * 100, "mean_sr": np_div("mean_runs", "mean_bf") * 100}
    )
