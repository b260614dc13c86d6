"""Substring deduplication: recurring phrases, confirmed and then located by Aho-Corasick automata.

Hashes only choose phrases and shards; what is equal is told by keyed 128-bit digests of the words, and
windows shared by different stretches by the words themselves.

A phrase is the run of ``gram`` words with the least hash in a window of ``window`` words, so equal
windows choose equal phrases.  Consecutive windows that choose the same phrase form its stretch:

1. Every document is cut into stretches.  Stretches of equal words form a class; its first
   document is the one with the smallest id, and all others repeat it whole.
2. A phrase with classes from different documents may still share single windows.  Their
   stretches are read again, windows that recur are confirmed, and each shard compiles automata
   of its phrases' recurring windows and streams its stretches through them.

So every document's text is streamed, each part to the one shard that holds its phrase, and a
text that recurs whole is streamed once, for its first document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.llm.shared import bytes_of, row_key, save
from ballstats.llm.tokens import SPACES, blocks, sequence_hashes, spaced, window_minima, word_hashes, words

WINDOW, GRAM = 50, 12
SHARD_STRETCHES, AUTOMATON_WINDOWS = 4000, 4000


def _digest(words_: bytes) -> bytes:
    """Stands for the words themselves where they are compared."""
    return hashlib.blake2b(words_, digest_size=16, key=b"phrases").digest()


def _stretches(hashes: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Phrase hash, first and last window of each stretch."""
    starts = np.arange(max(0, len(hashes) - gram + 1))
    grams = sequence_hashes(hashes, starts, starts + gram)
    least = window_minima(grams, window - gram + 1)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    inside = np.arange(len(least)) + window <= bounds[1:][row]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])
    first = at[new]
    last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])
    return grams[least[first]].view(np.int64), first, last


def _scan(batches, window: int, gram: int):
    """A row for each document (its words' count and digest), and one for each stretch."""
    for batch in batches:
        for block in blocks(batch.column("text")):
            found = words(block.data, block.offsets, SPACES)
            hashes, bounds = word_hashes(block.data, found), found.rows
            phrase, first, last = _stretches(hashes, bounds, window, gram)
            counts = np.diff(bounds)
            row = np.searchsorted(bounds, first, "right") - 1
            text, starts, ends = spaced(block.data, found)
            text, begin, close = text.tobytes(), [*starts.tolist(), len(text)], [0, *ends.tolist()]
            content = [_digest(text[begin[a] : close[b + window]]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            edges = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
            digests = [hashlib.sha256(text[begin[a] : close[b]]).digest() for a, b in edges]
            docs = pa.array(block.first + np.arange(len(counts)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(docs) for c in ("rid", "doc_id", "key")),
                    pa.array(counts.astype(np.int64)),
                    pa.array(digests, pa.binary()),
                    *(pa.nulls(len(counts), kind) for kind in (pa.int64(), pa.binary(), pa.int64(), pa.int64())),
                ],
                _SCANNED,
            )
            own = pa.array(block.first + row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").take(own),
                    batch.column("doc_id").take(own),
                    pa.nulls(len(row), pa.binary()),
                    pa.nulls(len(row), pa.int64()),
                    pa.nulls(len(row), pa.binary()),
                    pa.array(phrase),
                    pa.array(content, pa.binary()),
                    pa.array(first - bounds[row]),
                    pa.array(last - bounds[row]),
                ],
                _SCANNED,
            )


_SCANNED = ["rid", "doc_id", "key", "n_words", "digest", "phrase", "content", "first", "last"]


def _contexts(batches, window: int):
    """The words of the wanted stretches, and the digests of their windows."""
    for batch in batches:
        wanted = batch.column("stretches").to_pylist()
        for block in blocks(batch.column("text")):
            found = words(block.data, block.offsets, SPACES)
            text, begin, close = spaced(block.data, found)
            text, begin, close = text.tobytes(), begin.tolist(), close.tolist()
            out, marks, counts = [], [], []
            for row, base in enumerate(found.rows[:-1].tolist()):
                for x in wanted[block.first + row]:
                    a, b = base + x["first"], base + x["last"]
                    out.append((block.first + row, x["phrase"], x["first"], text[begin[a] : close[b + window - 1]].decode()))
                    marks += [_digest(text[begin[p] : close[p + window - 1]]) for p in range(a, b + 1)]
                    counts.append(b + 1 - a)
            if not out:
                continue
            rows, phrase, first, context = zip(*out, strict=True)
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid").take(own),
                    batch.column("doc_id").take(own),
                    pa.array(phrase, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(context, pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]).astype(np.int32)), pa.array(marks, pa.binary())),
                ],
                ["rid", "doc_id", "phrase", "first", "context", "windows"],
            )


def _merged(places: Iterable[int], width: int) -> list[tuple[int, int]]:
    """The spans that windows at these places cover."""
    out: list[list[int]] = []
    for p in sorted(places):
        if out and p <= out[-1][1]:
            out[-1][1] = p + width
        else:
            out.append([p, p + width])
    return [(a, b) for a, b in out]


def locate(patterns: pa.Table, streams: pa.Table, window: int) -> list[tuple[int, int, int]]:
    """(rid, start, stop) of the windows of ``streams`` that also stand in a ``patterns`` row of a smaller id.

    Words become numbers, and windows are compiled into automata of a bounded number of windows,
    each part of a phrase in one; a stretch runs through the automata of its phrase's part.
    """
    import ahocorasick

    numbers: dict[str, int] = {}
    code = lambda text: tuple([numbers.setdefault(w, len(numbers) + 1) for w in text.split(" ")])
    by_part: dict[tuple[int, int], list] = {}
    for row in streams.to_pylist():
        by_part.setdefault((row["phrase"], row["part"]), []).append((row["rid"], row["doc_id"], row["first"], code(row["context"])))
    known: dict[tuple[int, int], dict[tuple, object]] = {}
    for row in patterns.to_pylist():
        line, own = code(row["context"]), known.setdefault((row["phrase"], row["part"]), {})
        for offset in row["offsets"]:
            key = line[offset : offset + window]
            have = own.get(key)
            if have is None or row["doc_id"] < have:
                own[key] = row["doc_id"]
    hits: dict[int, set[int]] = {}
    block: dict[tuple, object] = {}
    readers: list = []

    def run() -> None:
        if not block or not readers:
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owner in block.items():
            automaton.add_word(key, owner)
        automaton.make_automaton()
        for rid, doc_id, first, line in readers:
            found = [first + end - window + 1 for end, owner in automaton.iter(line) if owner < doc_id]
            if found:
                hits.setdefault(rid, set()).update(found)

    for group, own in known.items():
        items = list(own.items())
        for at in range(0, len(items), AUTOMATON_WINDOWS):
            part = items[at : at + AUTOMATON_WINDOWS]
            if len(block) + len(part) > AUTOMATON_WINDOWS:
                run()
                block, readers = {}, []
            block.update(part)
            readers += by_part.get(group, [])
    run()
    return [(rid, a, b) for rid, places in hits.items() for a, b in _merged(places, window)]


def _dealt(contexts: DataFrame, shard_stretches: int) -> tuple[DataFrame, DataFrame]:
    """By shard the stretches that own recurring windows, with these windows' offsets, and those that read them.

    The recurring windows of a phrase with many are divided into parts by hash, and a stretch goes to
    the parts of its own windows only.  The readers of a part are divided among as many shards as they
    fill, each with that part's windows, so neither windows nor readers of a group grow with the phrase.
    """
    single = contexts.select("phrase", "rid", "doc_id", "first", F.posexplode("windows").alias("offset", "mark"))
    first = single.groupBy("phrase", "mark").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last_owner"))
    recurring = save(first.filter("owner < last_owner").select("phrase", "mark", "owner"))

    def shares(n):
        return F.ceil(n / shard_stretches).cast("int")

    many = save(recurring.groupBy("phrase").agg(shares(F.count(F.lit(1))).alias("parts")).filter("parts > 1"))
    part = F.pmod(F.xxhash64("mark"), F.coalesce("parts", F.lit(1))).cast("int")
    divided = recurring.join(many, "phrase", "left").select("phrase", "mark", "owner", part.alias("part"))
    placed = single.join(divided, ["phrase", "mark"])
    roles = save(
        placed.groupBy("phrase", "part", "rid", "first").agg(
            F.sort_array(F.collect_list(F.when(F.col("owner") == F.col("doc_id"), F.col("offset")))).alias("offsets"),
            F.max(F.when(F.col("owner") < F.col("doc_id"), F.lit(1)).otherwise(F.lit(0))).alias("reads"),
        )
    )
    chosen = contexts.drop("windows").join(roles, ["phrase", "rid", "first"])
    readers = roles.filter("reads = 1").groupBy("phrase", "part").agg(shares(F.count(F.lit(1))).alias("salts"))
    salted = chosen.join(save(readers.filter("salts > 1")), ["phrase", "part"], "left")
    salted = salted.withColumn("salts", F.coalesce("salts", F.lit(1)))
    shards = max(1, roles.count() // shard_stretches)

    def shard(salt):
        return F.pmod(F.xxhash64("phrase", "part", salt.cast("long")), F.lit(shards)).alias("shard")

    streams = salted.filter("reads = 1").select(
        shard(F.pmod(F.xxhash64("rid"), F.col("salts"))), "phrase", "part", "rid", "doc_id", "first", "context"
    )
    patterns = (
        salted.filter(F.size("offsets") > 0)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select(shard(F.col("salt")), *[F.col(c).alias(c) for c in ("phrase", "part", "doc_id", "offsets", "context")])
    )
    return patterns, streams


def _located(contexts: DataFrame, window: int, shard_stretches: int) -> DataFrame:
    """(rid, start, stop): windows of different stretches of one phrase that a smaller id has, too."""
    patterns, streams = _dealt(contexts, shard_stretches)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rid, start, stop = zip(*(locate(left, right, window) or [(None, None, None)]), strict=True)
        out = pa.table([pa.array(x, pa.int64()) for x in (rid, start, stop)], ["rid", "start", "stop"])
        return out.filter(pa.compute.is_valid(out["rid"]))

    return patterns.groupBy("shard").cogroup(streams.groupBy("shard")).applyInArrow(run, "rid bigint, start bigint, stop bigint")


def _covered(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((x["start"], x["stop"]) for x in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _lengths(batches):
    for batch in batches:
        merged = [_covered(x) for x in batch.column("spans").to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("rid"),
                pa.array([[{"start": a, "stop": b} for a, b in x] for x in merged], kind),
                pa.array([sum(b - a for a, b in x) for x in merged], pa.int64()),
            ],
            ["rid", "spans", "n_removed"],
        )


def _kept(batches):
    for batch in batches:
        texts, out, kept = batch.column("text"), [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            found = texts[i].as_py().split()
            left, at = [], 0
            for x in spans:
                left += found[at : x["start"]]
                at = x["stop"]
            left = b" ".join(left + found[at:])
            kept.append(left.decode())
            out.append(hashlib.sha256(left).digest())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "left"])


_SPANS = "array<struct<start:bigint,stop:bigint>>"


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
    shard_stretches: int = SHARD_STRETCHES,
) -> tuple[DataFrame, DataFrame]:
    """Per row rid, doc_id, key, n_words and digest; and per document with repeated words rid, spans, n_removed.

    ``spans`` are the merged runs of words that lie in a window which also starts in a document
    with a smaller id.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(doc_id).alias("doc_id"),
        row_key(F.col(doc_id), F.col(text)).alias("key"),
        bytes_of(F.col(text)).alias("text"),
    )
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches):
        yield from _scan(batches, window, gram)

    scanned = save(
        rows.mapInArrow(
            scan,
            f"rid bigint, doc_id {kind}, key binary, n_words bigint, digest binary, "
            "phrase bigint, content binary, first bigint, last bigint",
        )
    )
    whole = scanned.filter("n_words is not null").select("rid", "doc_id", "key", "n_words", "digest")
    stretches = scanned.filter("phrase is not null and doc_id is not null").select(
        "rid", "doc_id", "phrase", "content", "first", "last"
    )
    classes = save(
        stretches.groupBy("phrase", "content").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last_owner"))
    )
    shared = (
        classes.groupBy("phrase")
        .agg(F.min("owner").alias("a"), F.max("owner").alias("b"))
        .filter("a < b")
        .select("phrase", F.lit(True).alias("shared"))
    )
    matter = classes.join(shared, "phrase", "left").filter("owner < last_owner or shared")
    marked = save(
        stretches.join(matter, ["phrase", "content"])
        .select("rid", "phrase", "first", "last", (F.col("owner") < F.col("doc_id")).alias("repeats"), "shared")
        .filter("repeats or shared")
    )
    one_row = whole.groupBy("key").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("rows"))
    several = save(one_row.filter("rows > 1").select("key", F.col("rid").alias("first_rid")))
    copies = save(whole.join(several, "key").filter("rid > first_rid").select("first_rid", F.col("rid").alias("copy")))
    wanted = (
        marked.filter("not repeats")
        .groupBy("rid")
        .agg(F.collect_list(F.struct("phrase", "first", "last")).alias("stretches"))
        .join(one_row.select("key", "rid"), "rid")
    )
    texts = docs.select(
        row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"), bytes_of(F.col(text)).alias("text")
    )

    def read(batches):
        yield from _contexts(batches, window)

    contexts = save(
        texts.join(wanted, "key")
        .dropDuplicates(["key"])  # rows that repeat id and text are read once
        .select("rid", "doc_id", "text", "stretches")
        .mapInArrow(read, f"rid bigint, doc_id {kind}, phrase bigint, first bigint, context string, windows array<binary>")
    )
    located = save(_located(contexts, window, shard_stretches))
    also = located.join(copies, located["rid"] == copies["first_rid"]).select(F.col("copy").alias("rid"), "start", "stop")
    repeated = marked.filter("repeats").select("rid", F.col("first").alias("start"), (F.col("last") + window).alias("stop"))
    spans = (
        repeated.union(located)
        .union(also)
        .groupBy("rid")
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
        .mapInArrow(_lengths, f"rid bigint, spans {_SPANS}, n_removed bigint")
    )
    return whole, save(spans)


def repeated_phrases(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
    shard_stretches: int = SHARD_STRETCHES,
) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document
    with a smaller id; windows are judged on the input.  A null text has no words.  Rows with a null
    id neither lose words nor make others lose them; rows that repeat an id do not repeat each
    other.  Repeated rows each get their row; an empty table gives none; other columns are not
    read.
    """
    whole, spans = repeated_spans(docs, doc_id, text, window, gram, shard_stretches)
    touched = whole.join(spans, "rid")
    partly = touched.filter("n_removed < n_words").groupBy("key").agg(F.min_by("spans", "rid").alias("spans"))
    texts = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), bytes_of(F.col(text)).alias("text"))
    left = texts.join(partly, "key").mapInArrow(_kept, "key binary, left binary").dropDuplicates(["key"])
    out = whole.join(spans.select("rid", "n_removed"), "rid", "left").join(save(left), "key", "left")
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    gone = F.col("n_removed") == F.col("n_words")
    digest = F.when(gone, nothing).otherwise(F.coalesce("left", "digest"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.lower(F.hex(digest)).alias("kept_sha256"),
    )
