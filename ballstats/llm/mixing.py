"""Mixing sources to target weights: how many words each gives, and documents that fit them to the word.

A source's target is its share by weight, at most ``repeats`` times its size, what exceeds that going to the
others.  The target's whole multiples of the source take all its documents that often.  What is
left is a subset-sum problem over the documents' lengths, solved on a histogram with one row
for each (source, length): an even share of every length first, then documents of seeded lengths
until a bounded budget is left, and that by a bounded knapsack over the lengths still to be had.
The histogram says how many documents of a length are taken besides; which, says a seeded order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballstats.llm.shared import save
from ballstats.operators.ranking import number_rows

WEIGHTS, REPEATS, SEED = (1, 2, 3), 3, 2024
BUDGET = 1 << 16
"""Words that the knapsack fits at most; the array it needs has twice as many places."""


def word_count(text: Column) -> Column:
    """Words between ASCII white space, none for null; no list of them is built."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("bigint"), F.lit(0).cast("bigint"))


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, at most ``counts``, so that their sum is as near to the budget as can be.

    Of two sums equally near, the smaller.  A size's count is cut into powers of two, each taken once
    or not; for each sum the first such piece that made it is kept, which is enough to go back.
    """
    taken = np.zeros(len(sizes), np.int64)
    if budget <= 0:
        return taken
    top = 2 * budget  # beyond it, nothing at all is nearer
    usable = np.flatnonzero((sizes > 0) & (sizes <= top) & (counts > 0))
    if not len(usable):
        return taken
    by = np.full(top + 1, -1, np.int64)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    step = int(np.gcd.reduce(sizes[usable]))
    goal = min((s for s in (budget // step * step, budget // step * step + step) if s <= top), key=lambda s: (abs(s - budget), s))
    pieces: list[tuple[int, int]] = []
    for i in usable[np.argsort(-sizes[usable], kind="stable")]:
        left = min(int(counts[i]), top // int(sizes[i]))
        part = 1
        while left and not reached[goal]:
            n = min(part, left)
            left, part = left - n, part * 2
            weight = n * int(sizes[i])
            new = weight + np.flatnonzero(reached[: top + 1 - weight] & ~reached[weight:])
            by[new], reached[new] = len(pieces), True
            pieces.append((int(i), n))
        if reached[goal]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])  # the first of equals is the smaller
    while at:
        i, n = pieces[by[at]]
        taken[i] += n
        at -= n * int(sizes[i])
    return taken


def _order(sizes: np.ndarray, seed: int) -> np.ndarray:
    """Sizes in a seeded order that depends on nothing else."""
    x = (sizes.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.lexsort((sizes, x ^ (x >> np.uint64(29))))


def fit(
    sizes: np.ndarray, counts: np.ndarray, target: int, budget: int = BUDGET, seed: int = SEED, repeats: int = REPEATS
) -> tuple[int, np.ndarray]:
    """Times that all documents are taken, and how many of each size besides, for ``target`` words.

    ``sizes`` are different and positive.  Documents are taken once more at most; only where that misses the
    target, oftener, up to ``repeats`` times in all.  Python's whole numbers carry the sums.
    """
    total = sum(int(s) * int(c) for s, c in zip(sizes, counts, strict=True))
    extra = np.zeros(len(sizes), np.int64)
    if not total:
        return 0, extra
    whole, left = divmod(target, total)
    if not left:
        return whole, extra
    if left > budget:  # the same share of every size, rounded down
        share = left
        extra = np.array([int(c) * share // total for c in counts], np.int64)
        left -= sum(int(s) * int(e) for s, e in zip(sizes, extra, strict=True))
    spare = budget // 2  # the knapsack is to have something to choose from
    for i in _order(sizes, seed):  # one more of a size
        if left <= budget:
            break
        if extra[i] < counts[i] and sizes[i] <= left - spare:
            extra[i] += 1
            left -= int(sizes[i])
    for i in np.argsort(-sizes, kind="stable"):  # where sizes lack, as many as there are
        if left <= budget:
            break
        n = max(0, min(int(counts[i] - extra[i]), (left - spare) // int(sizes[i])))
        extra[i] += n
        left -= n * int(sizes[i])
    if left <= budget:
        best = knapsack(sizes, counts - extra, left)
        if int((best * sizes).sum()) != left and repeats - whole > 1:
            best = knapsack(sizes, counts * (repeats - whole) - extra, left)
        return whole, extra + best
    # only documents of more than left - spare words remain: one, or none
    open_ = np.flatnonzero(extra < counts)
    if len(open_):
        best = open_[np.argmin(np.abs(sizes[open_] - left))]
        extra[best] += abs(int(sizes[best]) - left) < left
    return whole, extra


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds weight and target to a table (source, source_size) with one row for each source.

    Weights repeat along the sources in code point order, null last.  A target is weight * level, cut at
    ``repeats`` times the size, with the level at which all targets make up all sizes; that is what
    handing the excess on by weight ends in.  Each step finds the sources cut at the level so far, which only rises.
    """
    numbered = save(number_rows(sources, [F.col("source").asc_nulls_last()], "_at"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_at") - 1) % len(weights) + 1).cast("int"))
    rows = numbered.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * repeats)
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, known = 0.0, -1
    while total:
        cut = F.col("_cap") <= F.col("weight") * F.lit(level)
        n, capped, rest = rows.agg(F.count_if(cut), F.sum(F.when(cut, F.col("_cap"))), F.sum(F.when(~cut, F.col("weight")))).first()
        if n == known or not rest:
            break
        known, level = n, (total - (capped or 0)) / rest
    target = F.least(F.col("_cap").cast("double"), F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    repeats: int = REPEATS,
    budget: int = BUDGET,
    seed: int = SEED,
) -> DataFrame:
    """For each row: doc_id, source, size, source_size, target, copies and taken (copies * size).

    A null or empty text has size 0 and is never taken.  Null is a source of its own, the last.  A source
    without words has target 0.  Rows that repeat an id, a text or both are rows like others; which of
    several equal ones is taken makes no difference to the result.  An empty table gives no row.  Other
    columns are not read.  Reruns agree: the order within a length is a hash of seed and id.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_order"),
    )
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()))  # tells equal rows apart, so that they can be spread
    lengths = save(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = save(source_targets(totals, weights, repeats))

    def plan(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("size", ignore_index=True)
        has = table["size"].to_numpy() > 0
        whole, extra = fit(table["size"].to_numpy()[has], table["n"].to_numpy()[has], math.floor(table["target"][0] + 0.5), budget, seed, repeats)
        table["whole"], table["extra"] = np.where(has, whole, 0), 0
        table.loc[has, "extra"] = extra
        return table

    kind = "source string, size bigint, n bigint, source_size bigint, target double, whole bigint, extra bigint"
    known = lengths.join(targets.drop("weight").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    planned = save(known.drop("_source").groupBy("source").applyInPandas(plan, kind))
    chosen = number_rows(rows, [F.col("source").asc_nulls_last(), *map(F.col, ("size", "_order", "doc_id", "_row"))], "_at")
    firsts = chosen.groupBy("source", "size").agg(F.min("_at").alias("_first"))
    planned = planned.withColumnsRenamed({"source": "_source", "size": "_size"})
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    planned = firsts.join(planned, same).select("_source", "_size", "n", "source_size", "target", "whole", "extra", "_first")
    more = F.expr("extra div n") + (F.col("_at") - F.col("_first") < F.expr("extra % n")).cast("bigint")
    copies = F.when(F.col("size") > 0, F.col("whole") + more).otherwise(0)
    return (
        chosen.join(planned, same)
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
