"""Importance resampling towards a target: hashed n-gram models of both sides, and a seeded draw by score.

An n-gram's bucket is the CRC-32 of its bytes.  A bucket's gain says how much more frequent it is
in the target than in the table, in thousandths of a natural logarithm and rounded down, so that a
document's weight is a sum of whole numbers and the same in any order.  The draw without
replacement keeps the highest scores of weight plus Gumbel noise from the document's id.

Every batch interns its n-grams in an open-addressed table (see ``intern``): slots hold an n-gram's
bucket and count, and the occurrences' slot numbers gather the gains.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.llm.intern import intern
from ballstats.llm.shared import bytes_of, save
from ballstats.llm.tokens import ALNUM, LOWER, blocks, spaced, words
from ballstats.operators.ranking import number_rows

BUCKETS, LONGEST = 10_000, 1
SEED, LEAST_WORDS, SHARE = 2024, 20, (10, 100)


def _slots(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int):
    """Of one block: each occurrence's row and slot, each slot's bucket and count, each row's words."""
    found = words(data, offsets, ALNUM)
    text, starts, ends = spaced(data, found)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(found.rows))
    begin, close, row = [], [], []
    for n in range(1, longest + 1):
        first = np.arange(max(0, len(starts) - n + 1))
        first = first[row_of[first] == row_of[first + n - 1]]
        begin.append(starts[first])
        close.append(ends[first + n - 1])
        row.append(row_of[first])
    begin, close, row = (np.concatenate(x) for x in (begin, close, row))
    table = intern(text, begin, close)
    raw = text.tobytes()
    spans = zip(begin[table.firsts].tolist(), close[table.firsts].tolist(), strict=True)
    bucket = np.fromiter((zlib.crc32(raw[a:b]) % buckets for a, b in spans), np.int64, len(table.firsts))
    return row, table.slots, bucket, table.counts, np.diff(found.rows)


def feature_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole table; at most ``buckets`` rows reach the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                _, _, bucket, count, _ = _slots(LOWER[block.data], block.offsets, longest, buckets)
                np.add.at(total, bucket, count)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = texts.select(bytes_of(F.col(text)).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source), for each bucket."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in pairs], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for block in blocks(batch.column("text")):
                row, slot, bucket, _, sizes = _slots(LOWER[block.data], block.offsets, longest, buckets)
                here = slice(block.first, block.first + len(sizes))
                n_words[here] = sizes
                np.add.at(n_features[here], row, 1)
                np.add.at(weight[here], row, gain[bucket][slot])
            arrays = [batch.column("doc_id"), *(pa.array(x) for x in (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), bytes_of(F.col(text)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    share: tuple[int, int] = SHARE,
) -> DataFrame:
    """For each row: doc_id, n_words, n_features, weight, score, and rank where the row is drawn.

    Features are all runs of 1 to ``longest`` words, A-Z in lower case.  Of the N rows with at least
    ``least_words`` words, ``share[0] * N // share[1]`` are drawn.  A null or empty text has no word and
    weight 0.  A null id is written as no character in the noise and comes last among equal scores; rows
    that repeat an id share its noise and each count.  Empty tables give no row, an empty target
    leaves the noise and the smoothing.  Other columns are not read.
    """
    gain = gains(feature_counts(docs, text, longest, buckets), feature_counts(target, target_text, longest, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = save(weights(docs, gain, doc_id, text, longest).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * share[0] // share[1]
    ranked = number_rows(scored.filter(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint")))
