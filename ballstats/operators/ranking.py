"""Numbers of rows in an order over a whole table, found by sorted partitions instead of one window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballstats.sources.tables import keep

_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row within it below


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Each row with its number from 1 in ``order``; rows that tie in it get numbers in any order.

    The rows are range-partitioned and sorted by ``order`` and written once, each with its place in
    its partition; what is added to that is the number of rows in the partitions before, one figure
    for each partition.  No task sees more than its own range.  The written table pins the ranges,
    which sampling would draw anew each time.  A tie of very many rows needs one more
    order column that tells them apart, else all of it is one range.
    """
    if not order:
        raise ValueError("an order is needed")
    columns = list(df.columns)
    at, part, before = (free_name(columns, x) for x in ("_at", "_part", "_before"))
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = keep(ordered.withColumn(part, F.shiftright(at, _ROW_BITS)))
    starts = partition_starts(rows.groupBy(part).agg(F.count(F.lit(1)).alias(before)), part, [before])
    place = F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.join(F.broadcast(starts), part).select(*[F.col(f"`{c}`") for c in columns], (F.col(before) + place + 1).alias(name))


def best_first(measure: str, *ties: str) -> list[Column]:
    """The order of a finished table: most first, unknown last, then by what tells the rows apart."""
    return [F.desc_nulls_last(measure), *map(F.col, ties)]


def partition_starts(totals: DataFrame, part: str, sums: Sequence[str]) -> DataFrame:
    """For each partition, the sum of each total over the partitions before it.

    ``totals`` has a row for each partition, so one row can hold them all; it is also a safe broadcast.
    """
    rows = F.array_sort(F.collect_list(F.struct(part, *sums)))
    # walk through the sorted list once, carrying the sums so far
    zero = F.struct(*[F.lit(0).cast("bigint").alias(s) for s in sums])
    kind = f"array<struct<{part}:bigint,{','.join(f'{s}:bigint' for s in sums)}>>"

    def step(state, row):
        before = state["now"]
        now = F.struct(*[(before[s] + row[s]).cast("bigint").alias(s) for s in sums])
        entry = F.struct(row[part].cast("bigint").alias(part), *[before[s].alias(s) for s in sums])
        return F.struct(now.alias("now"), F.concat(state["done"], F.array(entry)).alias("done"))

    first = F.struct(zero.alias("now"), F.array().cast(kind).alias("done"))
    walked = totals.agg(rows.alias("rows")).select(F.aggregate("rows", first, step, lambda s: s["done"]).alias("done"))
    return walked.select(F.inline("done"))


def free_name(taken: Sequence[str], name: str) -> str:
    """A column name that the table does not have."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
