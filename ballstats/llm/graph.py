"""Connected components by star contraction: joins and groupings only, one saved table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.llm.shared import save


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """For edges ``a``, ``b`` of whole numbers: ``node`` and ``component``, the least node it reaches.

    Rounds of large-star (each node hangs its larger neighbours on its least one) and small-star
    (each node hangs its smaller neighbours and itself on the least) shorten paths until every
    node points at its component.  A node's least neighbour is found by a grouping that folds
    within each task, so a node with many links needs no task of its own; it takes about
    log2(nodes) rounds.  Nodes without an edge are not listed.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = save(pairs.filter("a != b").distinct())
    state = _state(links)
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        links = save(small.filter("a != b").distinct())
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
