"""Batting position: opener 1, the opening partner 2 even without facing, then by first ball faced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.operators.totals import CHUNK_ROWS, chunk_of, no_amount, running_sums


SIDE = ["match_id", "batting_team"]


def _dealt(deliveries: DataFrame, order: str, chunk_rows: int) -> DataFrame:
    """Deliveries dealt by (match, team, striker, chunk), which is the struct ``_key``."""
    key = F.struct(*SIDE, "striker", chunk_of(deliveries, order, chunk_rows).alias("_chunk"))
    return deliveries.withColumn("_key", key).repartition("_key")


def _positions(dealt: DataFrame, read_all, order: str, chunk_rows: int) -> DataFrame:
    """(_key, batting_position) for every key without a NULL; ``read_all`` is added to the first amount taken."""
    # the non-striker is a key, not a carried value: only the position is aggregated, in a hash map
    pairs = dealt.groupBy("_key", "non_striker").agg(F.min(order).alias("_first"), F.max(read_all).alias("_zero"))
    # one sum, so that no part of the condition moves below the shuffle that is shared
    unknown = F.col("_zero")
    for c in (*SIDE, "striker"):
        unknown = unknown + F.col(f"_key.{c}").isNull().cast("int")
    side = F.struct(*[F.col(f"_key.{c}").alias(c) for c in SIDE]).alias("_side")  # never NULL, for the same reason
    pairs = pairs.filter(unknown == 0).select(side, "_key.striker", "_key._chunk", "non_striker", "_first")
    openers = pairs.groupBy("_side").agg(
        F.min_by("striker", "_first").alias("_opener"), F.min_by("non_striker", "_first").alias("_second")
    )
    strikers = pairs.groupBy("_side", "striker").agg(
        F.min("_first").alias("_first"), F.collect_set("_chunk").alias("_chunks")
    )
    alone = F.col("_opener").eqNullSafe(F.col("_second"))
    opening = (
        F.when(F.col("striker").eqNullSafe(F.col("_second")), 2)
        .when(F.col("striker") == F.col("_opener"), 1)
    )
    placed = strikers.join(openers, "_side").withColumn("_opening", opening)
    later = F.when(F.col("_opening").isNull(), 1).otherwise(0)
    placed = running_sums(
        placed.withColumn("_alone", alone), ["_side"], "_first", {"_rank": later}, chunk_rows
    )
    position = F.coalesce("_opening", F.col("_rank") + F.when(F.col("_alone"), 1).otherwise(2))
    each = placed.select("_side.*", "striker", position.cast("int").alias("batting_position"), F.explode("_chunks").alias("_chunk"))
    return each.select(F.struct(*SIDE, "striker", "_chunk").alias("_key"), "batting_position")


def batting_positions(deliveries: DataFrame, order: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per (match, batting team, striker, chunk of the file order) with the striker's batting position."""
    dealt = _dealt(deliveries, order, chunk_rows)
    return _positions(dealt, F.lit(0), order, chunk_rows).select("_key.*", "batting_position")


def with_batting_position(
    deliveries: DataFrame, order: str = "seq", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Deliveries with the striker's batting position; 0 where match, team or striker is unknown.

    One shuffle deals the rows by (match, team, striker, chunk), so that a striker of very many balls is
    many tasks.  First balls are found from it, and positions are attached to the same rows.
    """
    dealt, zero = _dealt(deliveries, order, chunk_rows), no_amount(deliveries)
    positions = _positions(dealt, zero, order, chunk_rows)
    position = (F.coalesce("batting_position", F.lit(0)) + zero).cast("int").alias("batting_position")
    return dealt.join(positions, "_key", "left").select(*deliveries.columns, position)
