"""Shards of even size that keep linked rows together: balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballstats.llm.shared import save

SHARDS, ROUNDS, BUCKET_ROWS = 16, 24, 20_000


def _quotas(spark: SparkSession, wishes: list, held: dict[int, int], room: int) -> tuple[DataFrame, int]:
    """What share of each wish (from, to, gain class) may move: the highest gains first.

    First as far as the room goes, then in exchange: as many rows as want to go from one shard to another
    may, if as many want to come back, at once or by way of a third shard.  At most shards * shards *
    128 wishes, whatever the number of rows.
    """
    order = sorted(wishes, key=lambda w: (-w.gain, w.shard, w.target))
    left, ways = {w: w.n for w in order}, {}
    for w in order:
        ways.setdefault((w.shard, w.target), []).append(w)

    def grant(shard: int, target: int, n: int) -> None:
        for w in ways[shard, target]:
            x = min(n, left[w])
            left[w] -= x
            n -= x

    free = {s: max(0, room - n) for s, n in held.items()}
    for w in order:
        x = min(left[w], free[w.target])
        left[w] -= x
        free[w.target] -= x
        free[w.shard] += x
    rings = [(s, t) for s, t in ways if s < t and (t, s) in ways]
    rings += [(s, t, u) for s, t in ways for u in held if s < min(t, u) and (t, u) in ways and (u, s) in ways]
    for ring in rings:
        steps = list(zip(ring, (*ring[1:], ring[0]), strict=True))
        x = min(sum(left[w] for w in ways[step]) for step in steps)
        for shard, target in steps:
            grant(shard, target, x)
    granted = [(w.shard, w.target, w.gain, (w.n - left[w]) / w.n) for w in order if left[w] < w.n]
    table = spark.createDataFrame(granted, "shard int, target int, gain int, share double")
    return table, len(granted)


def propagate(linked: DataFrame, room: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Move rows (rid, group, shard) towards the shard that holds most of their group.

    Each round counts every group's rows by shard.  Among the shards that have room, the fullest of a
    group (of equals one that its hash chooses) is the target of those with fewer of its rows, and moves are admitted
    by gain as far as the target's ``room`` goes, or in exchange for as many rows that leave it; every other round
    groups that fit into a shard may choose a full one, too.  A group that fills a shard goes on
    gathering in the next.  The unit of a round is the (group, shard) count, so a group of any size is a few rows, and
    which of its rows move is decided by each row's own hash.  It ends when nothing
    may move in two rounds.
    """
    spark, idle = linked.sparkSession, 0
    for turn in range(rounds):
        counts = save(linked.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n")))
        by_shard = counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()
        held = dict.fromkeys(range(shards), 0) | {r.shard: r.n for r in by_shard}
        roomy = [s for s, n in held.items() if n < room]
        tie = F.xxhash64("group", "shard").alias("tie")  # else equals would all choose the same shards
        place = F.struct("n", tie, F.col("shard").alias("s"))
        in_room = F.col("shard").isin(roomy)
        best = counts.groupBy("group").agg(
            F.max(F.when(in_room, place)).alias("roomy"), F.max(place).alias("any"), F.sum("n").alias("group_rows")
        )
        wide = F.lit(turn % 2 == 1) & (F.col("group_rows") <= room)
        best = best.select("group", "group_rows", F.when(wide, F.col("any")).otherwise(F.col("roomy")).alias("best"))
        whole = F.when(F.col("group_rows") <= room, 64).otherwise(0)  # groups that fit into a shard go first
        gain = F.log2(F.col("best.n") - F.col("n") + 2).cast("int") + whole
        wishes = save(
            counts.join(best, "group")
            .filter(F.col("best") > place)
            .select("group", "shard", F.col("best.s").alias("target"), gain.alias("gain"), "n")
        )
        asked = wishes.groupBy("shard", "target", "gain").agg(F.sum("n").alias("n")).collect()
        shares, moves = _quotas(spark, asked, held, room)
        idle = 0 if moves else idle + 1
        if idle == 2:
            break
        if not moves:
            continue
        granted = wishes.join(shares, ["shard", "target", "gain"]).select("group", "shard", "target", "share")
        draw = F.pmod(F.xxhash64("rid", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        moved = F.when(draw < F.col("share"), F.col("target")).otherwise(F.col("shard"))
        after = linked.join(granted, ["group", "shard"], "left").select("rid", "group", moved.alias("to"))
        linked = save(after.withColumnRenamed("to", "shard"))
    return linked


def _ranks(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Add ``rank``: a gapless number within each shard, linked rows before single ones, groups in a row.

    Rows are numbered within small buckets and the buckets' counts summed up before them.  A
    bucket is a range of group hashes; a group larger than a bucket has several of its own.
    """
    total = rows.count()
    parts = max(1, total // bucket_rows)
    own = F.col("group_rows") > bucket_rows
    pieces = F.ceil(F.col("group_rows") / bucket_rows)
    keyed = rows.withColumns(
        {
            "b": F.pmod(F.xxhash64("group"), F.lit(parts)),
            "g": F.when(own, F.xxhash64("group")).otherwise(F.lit(0).cast("long")),
            "p": F.when(own, F.pmod(F.xxhash64("rid"), pieces.cast("long"))).otherwise(F.lit(-1).cast("long")),
        }
    )
    place = ["shard", "single", "b", "g", "p"]
    counts = save(keyed.groupBy(*place).agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("shard").orderBy("single", "b", "g", "p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(*place).orderBy("group", "rid"))
    numbered = keyed.withColumn("within", within).join(starts, place)
    return numbered.withColumn("rank", F.col("start") + F.col("within") - 1).drop("b", "g", "p", "start", "within")


def balanced_shards(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    rounds: int = ROUNDS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """For each row: doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null).

    Rows with equal texts (null counts as empty) are linked.  They start in shards by hash, label
    propagation brings them together, and then shards are made even: of a shard with too many
    rows the last ranks, single rows first, fill the ones with too few.  So counts differ by at
    most one and slots are gapless; a group that no shard can hold is spread over as few as its
    quotas allow.  Repeated rows and null ids count like any other; an empty table gives none.
    Only id and text are read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("group"),
    )
    rows = save(raw.withColumn("start", F.pmod(F.xxhash64("doc_id", "group"), F.lit(shards)).cast("int")))
    sizes = save(rows.groupBy("group").agg(F.count(F.lit(1)).alias("group_rows")))
    total = rows.count()
    joined = save(rows.select("rid", "group", "start").join(sizes.filter("group_rows > 1"), "group"))
    linked = propagate(joined.select("rid", "group", F.col("start").alias("shard")), total // shards, shards, rounds)
    labels = linked.select("rid", "shard").join(joined.select("rid", "group_rows"), "rid")
    placed = save(
        rows.join(labels, "rid", "left").select(
            "rid", "doc_id", "size", "text_crc32", "group",
            F.coalesce("shard", "start").alias("shard"),
            F.coalesce("group_rows", F.lit(1)).alias("group_rows"),
            F.col("shard").isNull().cast("int").alias("single"),
        )
    )
    ranked = _ranks(placed, bucket_rows)
    have = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _even(ranked, [have.get(s, 0) for s in range(shards)])


def _even(ranked: DataFrame, have: list[int]) -> DataFrame:
    """Send ranks beyond a shard's quota to the gaps of the others, in order."""
    shards, total = len(have), sum(have)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over = [max(0, n - q) for n, q in zip(have, quota, strict=True)]
    gaps = [max(0, q - n) for n, q in zip(have, quota, strict=True)]
    spill_before = [sum(over[:s]) for s in range(shards)]
    gap_before = [sum(gaps[:s]) for s in range(shards)]

    def of(values):
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)

    extra = F.col("rank") - of(quota) + of(spill_before)
    to = F.lit(None).cast("int")
    slot = F.lit(None).cast("long")
    for s in range(shards):
        if gaps[s]:
            inside = (F.col("extra") >= gap_before[s]) & (F.col("extra") < gap_before[s] + gaps[s])
            to = F.when(inside, F.lit(s)).otherwise(to)
            slot = F.when(inside, F.col("extra") - gap_before[s] + have[s]).otherwise(slot)
    stays = F.col("rank") < of(quota)
    moved = ranked.withColumn("stays", stays).withColumn("extra", F.when(~F.col("stays"), extra))
    return moved.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(F.col("stays"), F.col("shard")).otherwise(to).cast("int").alias("shard"),
        F.when(F.col("stays"), F.col("rank")).otherwise(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
