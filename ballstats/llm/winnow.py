"""Benchmark decontamination: winnowed k-gram fingerprints, joined and extended to whole spans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.llm.shared import bit_filter, bytes_of, passes, row_key, save
from ballstats.llm.tokens import ALNUM, LOWER, blocks, sequence_hashes, window_minima, word_hashes, words
from ballstats.operators.ranking import free_name

WINDOW, GRAM = 10, 5
_ROWS = "rid bigint, id {}, key binary, n_words bigint, kind int, hash bigint, at bigint, first bigint, context string"


def _marks(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    starts = np.arange(max(0, len(hashes) - n + 1))
    return sequence_hashes(hashes, starts, starts + n)


def _kinds(counts: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Which run of ``window`` words, by its first word, lies within one row."""
    inside = np.ones(max(0, bounds[-1] - window + 1), bool)
    for back in range(1, window):  # a run that starts up to window-1 words before a row's end leaves it
        at = bounds[1:] - back
        at = at[(at >= 0) & (at < len(inside)) & (back <= counts)]
        inside[at] = False
    return inside


def _fingerprint_rows(batches, window: int, gram: int, lengths: Sequence[int], wanted: bytes | None, whole: bool):
    """Per row a count (kind 0) and its fingerprints with the words around them.

    Kind ``window``: of each ``window`` - ``gram`` + 1 consecutive gram hashes the least, the rightmost
    of equals.  Smaller kinds: all runs of so many words; with ``whole`` only those that are
    a whole row.  ``wanted`` drops fingerprints that no row of the other side has.
    """
    for batch in batches:
        for block in blocks(batch.column("text")):
            data = LOWER[block.data]
            found = words(data, block.offsets, ALNUM)
            hashes, bounds = word_hashes(data, found), found.rows
            counts = np.diff(bounds)
            row_of = np.repeat(np.arange(len(counts)), counts)
            nothing = np.zeros(len(counts), np.int64)
            out = [(nothing, nothing, bounds[:-1], np.arange(len(counts)))]
            for n in (window, *lengths):
                marks = _marks(_grams(hashes, gram if n == window else n), n)
                if n == window:
                    least = window_minima(marks.view(np.uint64), window - gram + 1)
                    at = np.unique(least[_kinds(counts, bounds, window)]) if len(least) else least
                elif whole:
                    at = bounds[:-1][counts == n]
                else:
                    at = np.flatnonzero(_kinds(counts, bounds, n))
                if wanted is not None:
                    at = at[passes(wanted, marks[at])]
                out.append((np.full(len(at), n), marks[at], at, row_of[at]))
            kind, mark, at, row = (np.concatenate(x) for x in zip(*out, strict=True))
            left = np.where(kind == window, window - gram, 0)
            right = np.where(kind == window, window, kind)
            lo = np.maximum(at - left, bounds[row])
            hi = np.minimum(at + right, bounds[row + 1])
            text = data.tobytes()
            context = [
                b" ".join([text[s:e] for s, e in zip(found.starts[a:b], found.ends[a:b], strict=True)]).decode() if k else None
                for k, a, b in zip(kind.tolist(), lo.tolist(), hi.tolist(), strict=True)
            ]
            first, source = bounds[row], pa.array(block.first + row)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(source) for c in ("rid", "id", "key")),
                    pa.array(counts[row], pa.int64()),
                    pa.array(kind, pa.int32()),
                    pa.array(mark, pa.int64()),
                    pa.array(at - first, pa.int64()),
                    pa.array(lo - first, pa.int64()),
                    pa.array(context, pa.string()),
                ],
                ["rid", "id", "key", "n_words", "kind", "hash", "at", "first", "context"],
            )


def _extend(batches, window: int, gram: int):
    """From a shared fingerprint to the longest equal run of words around it; the words, not hashes, decide."""
    for batch in batches:
        rows = batch.to_pydict()
        out: list[tuple] = []
        for rid, item, kind, at, first, doc, item_at, item_first, bench in zip(
            *(rows[c] for c in ("rid", "item", "kind", "at", "first", "context", "item_at", "item_first", "item_context")),
            strict=True,
        ):
            a, b = doc.split(" "), bench.split(" ")
            i, j = at - first, item_at - item_first
            size = gram if kind == window else kind
            if a[i : i + size] != b[j : j + size]:
                continue
            lo = hi = 0
            while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            while i + size + hi < len(a) and j + size + hi < len(b) and a[i + size + hi] == b[j + size + hi]:
                hi += 1
            if lo + size + hi >= kind:
                out.append((rid, item, at - lo, at + size + hi))
        rid, item, start, stop = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid, pa.int64()), pa.array(item, pa.string()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())],
            ["rid", "item", "start", "stop"],
        )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """For each row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the row's key.

    A window is ``window`` consecutive words of an item, or all words of an item with fewer.  A
    shared window has ``window`` - ``gram`` + 1 consecutive grams, whose least hash both sides choose, so
    joining the chosen ones finds every occurrence; each is then extended word by word.  The
    join is an equi-join that Spark broadcasts only if the benchmark's table is small; before
    it, documents drop what a bitmap of fixed size excludes.
    A null or empty text, on either side, has no words.  An item without an id counts as
    one with an empty id; rows that repeat an id are one item.  Repeated documents each get their row;
    without items nothing is contaminated.  Other columns are not read.
    """

    def item_rows(batches):
        yield from _fingerprint_rows(batches, window, gram, range(1, window), None, True)

    items = benchmark.select(
        F.lit(0).cast("long").alias("rid"),
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"),
        F.lit(None).cast("binary").alias("key"),
        bytes_of(F.col(item_text)).alias("text"),
    )
    chosen = save(items.mapInArrow(item_rows, _ROWS.format("string")).filter("kind > 0").distinct())
    short = [r.kind for r in chosen.filter(F.col("kind") < window).select("kind").distinct().collect()]  # below the window
    wanted = bit_filter(chosen, "hash")

    def doc_rows(batches):
        yield from _fingerprint_rows(batches, window, gram, short, wanted, False)

    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(doc_id).alias("id"),
        row_key(F.col(doc_id), F.col(text)).alias("key"),
        bytes_of(F.col(text)).alias("text"),
    )
    scanned = save(rows.mapInArrow(doc_rows, _ROWS.format(docs.schema[doc_id].dataType.simpleString())))
    bench = chosen.select(
        "kind",
        "hash",
        F.col("id").alias("item"),
        F.col("at").alias("item_at"),
        F.col("first").alias("item_first"),
        F.col("context").alias("item_context"),
    )
    met = scanned.filter("kind > 0").join(bench, ["kind", "hash"])

    def extend(batches):
        yield from _extend(batches, window, gram)

    spans = save(
        met.select("rid", "item", "kind", "at", "first", "context", "item_at", "item_first", "item_context")
        .mapInArrow(extend, "rid bigint, item string, start bigint, stop bigint")
        .distinct()
    )
    hit = (
        spans.select("rid", F.explode(F.sequence("start", F.col("stop") - 1)).alias("at"))
        .distinct()
        .groupBy("rid")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    names = spans.select("rid", "item").distinct().groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = hit.join(names, "rid")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        scanned.filter("kind = 0")
        .select("rid", "id", "key", "n_words")
        .join(found, "rid", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
            "key",
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that share no window with the benchmark, with their columns.

    Null and empty texts share nothing and stay.  Rows that repeat others share their fate.  Without items every
    row stays; an empty table stays empty.  Extra columns are handed on, whatever their names.
    """
    name = free_name(docs.columns, "_hit")
    hit = contamination(docs, benchmark, doc_id, text).filter("contaminated").select(F.col("key").alias(name))
    return docs.join(hit.distinct(), row_key(F.col(doc_id), F.col(text)) == F.col(name), "left_anti")
