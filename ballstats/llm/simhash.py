"""Near duplicates by SimHash, found with covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.llm.graph import components
from ballstats.llm.shared import bytes_of, row_key, save
from ballstats.llm.tokens import blocks
from ballstats.operators.ranking import free_name

SHINGLE, RADIUS, BITS = 4, 4, 64
BUCKET = 128


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles' XXH64 hashes with seed 42; no word at all gives 0."""
    from xxhash import xxh64_digest

    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < shingle:
        hashes = [xxh64_digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = [xxh64_digest(joined[a:b], 42) for a, b in spans]
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(votes).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row key and fingerprint (64 bits as a long) of each row."""

    def run(batches):
        for batch in batches:
            prints = []
            for block in blocks(batch.column("text")):
                data, at = block.data.tobytes(), block.offsets.tolist()
                prints += [fingerprint(data[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(prints, pa.int64())], ["doc_id", "key", "print"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), bytes_of(F.col(text)).alias("text")
    )
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, print bigint")


def cover_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2**(radius+1) - 1 masks such that any ``radius`` bits lie outside one of them.

    Bit i gets a non-zero vector of radius+1 bits, and mask v holds the bits whose vector has an
    odd product with v.  The vectors of ``radius`` bits span at most radius dimensions, so some
    non-zero v is orthogonal to all of them.
    """
    full = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, full + 1):
        mask = sum(1 << i for i in range(bits) if ((i % full + 1) & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the members of one bucket as all pairs within the radius would."""
    words = members.view(np.uint64)  # the count of a signed number is that of its absolute value
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= radius
    parent = list(range(len(members)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(members[i]), int(members[j])))
    return links


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            members = batch.column("members")
            ends, flat = members.offsets.to_numpy(), members.values.to_numpy()
            links = [x for a, b in zip(ends[:-1], ends[1:], strict=True) for x in _forest(flat[a:b], radius)]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.select("members").mapInArrow(run, "a bigint, b bigint")


def _ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """Exact links for fingerprints of crowded buckets, without pairs.

    Two fingerprints are within the (even) radius if and only if some value lies within half of
    it from both.  Each fingerprint lists the values of its half ball; those who list a value
    are all within the radius of each other, so hanging them on the least of them is enough.
    """
    flips = [sum(1 << i for i in c) for n in range(radius // 2 + 1) for c in combinations(range(BITS), n)]
    flips = np.array(flips, np.uint64).view(np.int64)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                own = batch.column("print")[start : start + 256].to_numpy()
                values = (own[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(np.repeat(own, len(flips)))], ["value", "print"]
                )

    balls = prints.mapInArrow(run, "value bigint, print bigint")
    least = balls.groupBy("value").agg(F.min("print").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return balls.join(least, "value").filter("print != a").select("a", F.col("print").alias("b")).distinct()


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges that connect the different values of ``print`` as all pairs within ``radius`` bits would.

    Every fingerprint enters one table for each covering mask, under its bits in the mask; a pair
    within the radius meets in at least one.  Buckets of up to ``bucket`` values are compared as
    they are; the values of larger ones are linked through their half balls.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    cells = [
        F.struct(F.lit(i).alias("no"), F.col("print").bitwiseAND(F.lit(m)).alias("cell"))
        for i, m in enumerate(cover_masks(radius))
    ]
    keys = prints.select("print", F.explode(F.array(*cells)).alias("c")).select("print", "c.no", "c.cell")
    sizes = save(keys.groupBy("no", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = save(keys.join(sizes, ["no", "cell"]))
    buckets = met.filter(F.col("n") <= bucket).groupBy("no", "cell").agg(F.collect_list("print").alias("members"))
    crowded = met.filter(F.col("n") > bucket).select("print").distinct()
    return _bucket_links(buckets, radius).union(_ball_links(crowded, radius))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    bucket: int = BUCKET,
) -> DataFrame:
    """For each row: doc_id, fingerprint (16 hex digits), component_id, and the row's key.

    Rows link if their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest doc_id that links lead to, the row's own included.  Rows without a word (null,
    empty, white space) have fingerprint 0 and link like any other.  A null id takes part in
    links but is never the smallest unless all ids are null.  Repeated rows each get their row;
    an empty table gives none; other columns are not read.
    """
    rows = save(fingerprints(docs, doc_id, text, shingle))
    classes = save(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    linked = components(near_links(classes.select("print"), radius, bucket))
    joined = save(classes.join(linked.withColumnRenamed("node", "print"), "print"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("smallest"))
    known = joined.join(smallest, "component").select("print", "smallest")
    labels = classes.join(known, "print", "left").select("print", F.coalesce("smallest", "least").alias("component_id"))
    return rows.join(labels, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "key"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id is their component's smallest, with their columns.

    Of texts without a word (null, empty, white space) the smallest id stays.  Rows that repeat an id and its
    text stay as often as they came, and so do different texts of one id that is the smallest.  An empty
    table stays empty.  Extra columns are handed on, whatever their names.
    """
    found = near_duplicates(docs, doc_id, text)
    name = free_name(docs.columns, "_kept")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("key").alias(name))
    return docs.join(kept, row_key(F.col(doc_id), F.col(text)) == F.col(name), "left_semi")
