"""Delivery tables kept as Parquet, laid out for the filters every analysis starts with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballstats.operators.prepare import dedupe_first, prepare_deliveries


def scratch_path(spark: SparkSession) -> str:
    """A new path for intermediate tables, in the shared folder the session names.

    Without ``spark.checkpoint.dir`` only a local session may use the machine's own folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="ballstats-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back; the file system removes them when the session ends."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def ingest(raw: DataFrame, path: str, partition_by: Sequence[str] = ("league", "year"), mode: str = "overwrite") -> None:
    """Write raw rows once as a prepared table with a whole-number ``seq`` in file order.

    Sorting by file position range-partitions the rows, so the row ids that follow rise over
    the whole table.  The write balances its files within each partition value, splitting a
    value that holds a large share of the rows.
    """
    ordered = dedupe_first(raw).orderBy("seq").withColumn("seq", F.monotonically_increasing_id())
    prepared = prepare_deliveries(ordered)
    by = [c for c in partition_by if c in prepared.columns]
    prepared.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)


def read_table(spark: SparkSession, path: str, leagues: Sequence[str] = ()) -> DataFrame:
    """An ingested table; choosing leagues reads only their folders."""
    table = spark.read.parquet(path)
    return table.filter(F.col("league").isin(list(leagues))) if leagues else table
