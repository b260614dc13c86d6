"""Group totals beside each row, and running sums, without putting a whole group in one task.

A window over a group runs in one task however large the group is.  Both operators here
cut a group into slices first, aggregate per slice (combined before the shuffle), and
bring the slice results back with an equi-join on (group, slice), so the rows of a hot
group are spread over many tasks and the answer is still exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICES = 32
CHUNK_ROWS = 1 << 20


def with_group_totals(
    cells: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    totals: Mapping[str, str],
    slices: int = SLICES,
) -> DataFrame:
    """Add the per-group sum of some columns to every row.

    ``totals`` maps the new column to the summed one.  ``cells`` must have no NULL in
    ``keys``.  Rows of a group are dealt over ``slices`` slices (a power of two) by the hash
    of ``spread_by``; the window then sees one row per slice, never the group's rows.

    The slice is a bit mask because that cannot be NULL: a join key that could be would get
    a not-null filter pushed into one use of ``cells`` and keep Spark from sharing them.
    """
    if slices < 1 or slices & (slices - 1):
        raise ValueError(f"slices must be a power of two, not {slices}")
    keys = list(keys)
    sliced = cells.withColumn("_slice", F.xxhash64(spread_by).bitwiseAND(F.lit(slices - 1)))
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[F.sum(src).alias(new) for new, src in totals.items()])
    group = Window.partitionBy(*keys)
    per_group = per_slice.select(
        *keys, "_slice", *[F.sum(new).over(group).alias(new) for new in totals]
    )
    return sliced.join(per_group, [*keys, "_slice"]).drop("_slice")


def chunk_of(df: DataFrame, order: str, chunk_rows: int = CHUNK_ROWS) -> Column:
    """A non-decreasing function of the order column that holds a bounded number of rows.

    A whole-number order that is unique gives ``order div chunk_rows``; a (file, block,
    row) position gives its (file, block), which one scan task read.
    """
    kind = df.schema[order].dataType
    if isinstance(kind, T.StructType):
        return F.struct(*[F.col(f"{order}.{f}").alias(f) for f in kind.fieldNames()[:-1]])
    return F.floor(F.col(order) / F.lit(chunk_rows))


def no_amount(df: DataFrame) -> Column:
    """Zero, read from every column of a row.

    Spark shares one shuffle between two uses only if both read the same columns of it.  A use whose
    result this is added to reads them all, whatever is selected from the result later.
    """
    return F.xxhash64(*df.columns).bitwiseAND(F.lit(0).cast("bigint"))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inclusive running sum of each expression per key in ``order``.

    ``order`` must be unique within a key.  One shuffle deals the rows by (key, chunk).  From it come the
    chunks' totals, whose sums over earlier chunks are carried forward, and the rows themselves,
    with a window over their chunk: the table is read once and no task sees more than a chunk of a key.
    Only chunks after a key's first have anything before them, so that side of the join is small
    unless there are very large groups.  All columns of ``df`` take part; select those needed before.
    Rows with a NULL key keep NULL sums.
    """
    keys = list(keys)
    values = list(sums.values())
    parts, befores = ([f"{x}{i}" for i in range(len(values))] for x in ("_v", "_before"))
    # one struct, which is never NULL itself: a key that could be would get a not-null filter in one use only
    key = F.struct(*keys, chunk_of(df, order, chunk_rows).alias("_chunk"))
    rows = df.withColumn("_key", key).repartition("_key")
    zero = no_amount(df)

    chunk_totals = rows.groupBy("_key").agg(*[F.sum(x + zero).alias(v) for v, x in zip(parts, values)])
    earlier = (
        Window.partitionBy(*[f"_key.{k}" for k in keys])
        .orderBy("_key._chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = chunk_totals.select(
        "_key",
        *[F.sum(v).over(earlier).alias(b) for v, b in zip(parts, befores)],
    ).filter(F.coalesce(*befores).isNotNull())

    within = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({v: F.sum(x).over(within) for v, x in zip(parts, values)})
    kinds = dict(local.dtypes)
    joined = local.join(offsets, "_key", "left")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    names = {
        new: F.when(known, F.col(v) + F.coalesce(b, F.lit(0)) + zero).cast(kinds[v])
        for new, v, b in zip(sums, parts, befores)
    }
    return joined.select(*df.columns, *[c.alias(new) for new, c in names.items()])
