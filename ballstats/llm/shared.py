"""Helpers of several operators: reading, tables in the shared folder, row keys, bounded filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballstats.sources.tables import scratch_path

FILTER_BITS = 1 << 22
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs no earlier stage.

    What was shuffled for it is of no further use and goes at once; the file system removes the
    folder when the session ends.  ``by`` names a column whose values get a folder each.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column, text: Column) -> Column:
    """A digest of id and text, null apart from empty. Rows that agree in both are interchangeable."""
    tagged = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit(":"), text), F.lit("")))
    return F.unhex(F.sha2(tagged, 256))


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes, none for null."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def bit_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> bytes:
    """A bitmap over hashed keys for dropping rows early; whatever the table's size it has ``bits`` bits.

    It has no false negatives; an exact join follows every use of it.
    """
    slot = F.pmod(F.col(key), F.lit(bits))
    words = (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 5).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("mask"))
    )
    out = bytearray(bits // 8)
    for word, mask in words.collect():  # at most bits / 32 rows
        out[word * 4 : word * 4 + 4] = mask.to_bytes(4, "little")
    return bytes(out)


def passes(filter_: bytes, keys):
    """Which of the numpy keys (int64 bit patterns) may be in the filter."""
    import numpy as np

    have = np.frombuffer(filter_, np.uint8)
    slot = keys.view(np.int64) % (len(filter_) * 8)
    return (have[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
