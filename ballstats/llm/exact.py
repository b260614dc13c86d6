"""Exact duplicates through an extendible-hash index kept in shared files.

Copies met in one task are folded, the directory doubles until no bucket holds too many keys, the folds go to
the tasks that own their buckets, and there the chain of a key tells its texts apart by their bytes.  Rows
then look their decision up in the bucket that the directory names for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballstats.llm.shared import save
from ballstats.operators.ranking import free_name

BUCKET_ENTRIES, FOLDS = 1 << 16, 16
MAX_DEPTH = 20


def _prefix(column: str, bits: int, of: int):
    """The leading ``bits`` of a number of ``of`` bits."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(column, of - bits).cast("long")


def text_hash(text, bits: int = 64):
    """The index's key. Fewer bits than 64 keep only the leading ones, which makes keys collide."""
    hashed = F.xxhash64(text)
    return hashed if bits == 64 else F.shiftleft(F.shiftrightunsigned(hashed, 64 - bits), 64 - bits)


def folds(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_bits: int = 64, parts: int = FOLDS) -> DataFrame:
    """Hash, text, rows and largest id of equal texts met together; up to ``parts`` rows for one text.

    Copies are folded within each task before anything moves, so a text that fills a third of the table
    reaches its bucket as a few rows.  What is equal in the whole table, only the index decides.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part"))
    return (
        rows.groupBy(text_hash(F.col("text"), hash_bits).alias("hash"), "text", "part")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("largest"))
        .select("hash", "text", "rows", "largest")
    )


def directory(keys: DataFrame, capacity: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """The directory over the hashes' leading bits and its depth: slot, bucket, local depth.

    It starts as one bucket.  While a bucket holds more than ``capacity`` entries the directory
    doubles and that bucket splits by one more bit; the others are shared by two slots.  The
    counts it works on are made once, by the leading ``max_depth`` bits, so there are at most
    2**max_depth of them, whatever the number of entries.  A bucket of that depth may hold more.
    """
    fine = save(keys.groupBy(_prefix("hash", max_depth, 64).alias("fine")).agg(F.count(F.lit(1)).alias("n")))
    leaves, unsplit, depth = [], fine, 0
    while True:
        level = unsplit.groupBy(_prefix("fine", depth, max_depth).alias("prefix")).agg(F.sum("n").alias("n"))
        if depth:  # a half that got no entry is a bucket, too
            halves = overfull.select(F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
            level = halves.join(level, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"))
        full = (F.col("n") > capacity) & F.lit(depth < max_depth)
        leaves.append(level.filter(~full).select("prefix", F.lit(depth).alias("depth")))
        overfull = level.filter(full).select("prefix")
        if overfull.isEmpty():
            break
        unsplit = (
            unsplit.withColumn("prefix", _prefix("fine", depth, max_depth))
            .join(overfull, "prefix", "left_semi")
            .select("fine", "n")
        )
        depth += 1
    found = leaves[0]
    for leaf in leaves[1:]:
        found = found.union(leaf)
    first, width = F.expr(f"shiftleft(prefix, {depth} - depth)"), F.expr(f"shiftleft(1L, {depth} - depth)")
    slots = F.explode(F.sequence(first, first + width - 1)).alias("slot")
    return save(found.select(slots, first.alias("bucket"), F.col("depth").alias("local_depth"))), depth


def placed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The rows with the bucket that the directory names for their hash; it has at most 2**MAX_DEPTH slots."""
    own = slots.select("slot", "bucket")
    return rows.withColumn("slot", _prefix("hash", depth, 64)).join(F.broadcast(own), "slot").drop("slot")


def build_index(folded: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """The index files: bucket, hash, chain, digest, group_size and keep_id of each different text.

    Each owner task holds a range of buckets, in order.  Within a bucket the texts of one key are told apart by
    their bytes, equal ones counted, and different ones chained, numbered by ``chain``.
    """
    owned = placed(folded, slots, depth).repartitionByRange("bucket", "hash")
    entries = owned.groupBy("bucket", "hash", "text").agg(F.sum("rows").alias("group_size"), F.max("largest").alias("keep_id"))
    entries = entries.select("bucket", "hash", F.unhex(F.sha2("text", 256)).alias("digest"), "group_size", "keep_id")
    chain = Window.partitionBy("bucket", "hash").orderBy("digest")
    return save(entries.withColumn("chain", F.row_number().over(chain) - 1))


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = BUCKET_ENTRIES,
    hash_bits: int = 64,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256, and its bucket and chain place.

    Of equal texts the row with the largest id stays.  A null text counts as empty.  A null id
    is smaller than any other; a group of null ids only has a null keep_id and stays.  Rows that
    repeat an id together with its text are one document: all of them carry the same decision.
    An empty table gives no rows; other columns are not read.
    """
    folded = save(folds(docs, doc_id, text, hash_bits))
    slots, depth = directory(folded.select("hash").distinct(), capacity, max_depth)
    index = build_index(folded, slots, depth)
    body = F.coalesce(F.col(text), F.lit(""))
    probes = docs.select(
        F.col(doc_id).alias("doc_id"),
        text_hash(body, hash_bits).alias("hash"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
    )
    return placed(probes, slots, depth).join(index, ["bucket", "hash", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "bucket",
        "chain",
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their columns; a row repeated with its id stays as often as it came.

    Null and empty texts are equal, and the row with the largest id stays.  A null id stays only if no other
    row has the text.  An empty table stays empty.  Extra columns are handed on, whatever their names.
    """
    one, two = (free_name(docs.columns, x) for x in ("_keep_id", "_keep_digest"))
    kept = exact_duplicates(docs, doc_id, text).filter("kept").select(
        F.col("doc_id").alias(one), F.unhex("text_sha256").alias(two)
    )
    same = F.col(doc_id).eqNullSafe(F.col(one)) & (
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)) == F.col(two)
    )
    return docs.join(kept, same, "left_semi")
