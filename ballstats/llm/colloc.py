"""Phrase collocations, counted by vertical partitioning of truncated suffix trees.

A phrase of up to five words is a path from the root of the suffix tree of all pieces, and its
count the sum of the leaves below.  That tree is never built whole:

1. Words are counted; a piece is cut where a word is too rare for any phrase.  Two-word prefixes of
   what is left are counted by a hash, which can only make a prefix seem more frequent.
2. Prefixes frequent enough are grouped: consecutive ranges of their hashes, each with as many
   suffixes as memory is meant for.  A prefix with more than that by itself is divided by the rest of its suffixes.
3. Every word where a frequent prefix begins sends its suffix, cut at five words or where the next
   two words are no frequent prefix, to its group.  A task folds equal suffixes and sends a group its own as one row.
4. Each group sorts its suffixes, which lays out its subtrees, and reads every node's count from the
   leaves in its range.

Filters are bitmaps of a fixed number of bits: they let too much through, never too little, and the
counts that decide are of words and phrases themselves.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballstats.llm.shared import bytes_of, save
from ballstats.llm.tokens import LOWER, blocks, folded, words

LONGEST, LEAST, TOP = 5, 100, 2000
UNKNOWN = "und"
SEGMENT = 1 << 20  # word occurrences taken at a time; a word's number must fit 21 bits
SUFFIXES = 1 << 19  # suffixes that a group may hold
FILTER_BITS, PAGE_BITS = 1 << 26, 1 << 19
RANGES = 1 << 12

ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
"""Bytes that end a piece."""
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False
"""Bytes of words."""


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Segment:
    """Consecutive words of some rows: numbers from 1 into ``vocabulary``, languages, and where a piece goes on.

    ``own`` words are the segment's; those behind are the next one's, seen only as what follows.
    """

    def __init__(self, vocabulary: pa.Array, ids: np.ndarray, langs: np.ndarray, joined: np.ndarray, own: int):
        self.vocabulary, self.ids, self.langs, self.joined, self.own = vocabulary, ids, langs, joined, own


def _segments(batches, limit: int):
    """Cut the words of all batches into segments; yields (language names, segment)."""
    names: dict[str, int] = {}
    waiting: list[tuple] = []
    held = 0
    for batch in batches:
        langs = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.int32)
        for block in blocks(batch.column("text")):
            data = LOWER[block.data]
            found = words(data, block.offsets, INSIDE)
            if not len(found.starts):
                continue
            breaks = np.concatenate([[0], np.cumsum(ENDS[data])])
            joined = np.zeros(len(found.starts), bool)  # with the word before
            joined[1:] = breaks[found.starts[1:]] == breaks[found.starts[:-1]]
            joined[found.rows[:-1][found.rows[:-1] < len(joined)]] = False
            sizes = (found.ends - found.starts).astype(np.int32)
            lang = np.repeat(langs[block.first : block.first + len(block.offsets) - 1], np.diff(found.rows))
            letters = data[INSIDE[data]]  # every byte of a word, in order, belongs to one of the words
            waiting.append((letters, sizes, lang, joined))
            held += len(sizes)
            if held >= limit:
                yield from _cut(names, waiting, limit)
                waiting, held = [], 0
    if waiting:
        yield from _cut(names, waiting, limit)


def _cut(names, waiting, limit: int):
    letters, sizes, lang, joined = (np.concatenate(x) for x in zip(*waiting, strict=True))
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for a in range(0, len(sizes), limit):
        b = min(a + limit, len(sizes))
        end = min(b + LONGEST - 1, len(sizes))
        offsets = at[a : end + 1] - at[a]
        column = pa.Array.from_buffers(pa.large_binary(), end - a, [None, pa.py_buffer(offsets), pa.py_buffer(letters[at[a] : at[end]])])
        coded = column.dictionary_encode()
        ids = coded.indices.to_numpy() + np.int32(1)
        yield list(names), Segment(coded.dictionary, ids, lang[a:end], joined[a:end], b - a)


def _unique_words(names: list[str], part: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (language, word): languages, words, hashes, and which of them each place has."""
    from xxhash import xxh64_intdigest

    pair, place = np.unique(part.langs.astype(np.int64) << 32 | part.ids, return_inverse=True)
    langs, ids = pair >> 32, pair & 0xFFFFFFFF
    tags = [n.encode() + b"\t" for n in names]
    spelled = part.vocabulary.take(pa.array(ids - 1)).to_pylist()
    hashes = np.fromiter((xxh64_intdigest(tags[k] + w) for k, w in zip(langs.tolist(), spelled, strict=True)), np.uint64, len(pair))
    return langs, ids, hashes, place


def _strings(names: list[str], langs: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(langs))


def _count_words(batches, limit: int):
    for names, part in _segments(batches, limit):
        langs, ids, hashes, place = _unique_words(names, part)
        n = np.bincount(place[: part.own], minlength=len(ids))
        spelled = part.vocabulary.take(pa.array(ids - 1)).cast(pa.binary())
        columns = [_strings(names, langs), spelled, pa.array(hashes.view(np.int64)), pa.array(n)]
        yield pa.table(columns, ["lang", "word", "hash", "n"]).filter(pa.array(n > 0))


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a hash may be in the bitmap."""
    slot = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pairs(names, part: Segment, frequent: np.ndarray):
    """Word hashes, and for each place the hash of it and the next word, if both may be frequent and adjoin."""
    langs, ids, hashes, place = _unique_words(names, part)
    good, own = _passes(frequent, hashes)[place], hashes[place]
    pair = _mix(own[:-1] * np.uint64(0xD6E8FEB86659FD93) + own[1:])
    return own, pair, good[:-1] & good[1:] & part.joined[1:]


def _count_pairs(batches, frequent: np.ndarray, limit: int):
    for names, part in _segments(batches, limit):
        _, pair, good = _pairs(names, part, frequent)
        hashes, n = np.unique(pair[: part.own][good[: part.own]], return_counts=True)
        yield pa.table([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])


def _send(batches, frequent: np.ndarray, prefixes: np.ndarray, first: np.ndarray, split: np.ndarray, limit: int):
    """The different suffixes of each segment with their numbers, and the group each belongs to."""
    for names, part in _segments(batches, limit):
        own, pair, good = _pairs(names, part, frequent)
        good &= _passes(prefixes, pair)
        start = np.flatnonzero(good[: part.own])
        if not len(start):
            continue
        columns, rest, going = [part.ids[start]], np.zeros(len(start), np.uint64), np.ones(len(start), bool)
        for k in range(1, LONGEST):
            link = start + k - 1
            going &= link < len(good)
            going[going] = good[link[going]]
            word = np.zeros(len(start), np.int32)
            word[going] = part.ids[start[going] + k]
            if k > 1:
                rest[going] = _mix(rest[going] + own[start[going] + k])
            columns.append(word)
        bits = np.uint64(21)
        high = (part.langs[start].astype(np.uint64) << bits | columns[0].astype(np.uint64)) << bits | columns[1].astype(np.uint64)
        low = (columns[2].astype(np.uint64) << bits | columns[3].astype(np.uint64)) << bits | columns[4].astype(np.uint64)
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        heads = np.flatnonzero(new)
        n, at = np.diff(np.append(heads, len(order))), order[heads]
        bucket = (pair[start[at]] >> np.uint64(52)).astype(np.int64)
        group = first[bucket] + (rest[at] % split[bucket].astype(np.uint64)).astype(np.int64)
        spelled = [part.vocabulary.take(pa.array(c[at] - 1, mask=c[at] == 0)) for c in columns]
        phrase = pc.binary_join_element_wise(*spelled, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
        columns = [pa.array(group), _strings(names, part.langs[start[at]]), phrase.cast(pa.binary()), pa.array(n)]
        yield pa.table(columns, ["group", "lang", "phrase", "n"])


def _packed(batches, divided: np.ndarray):
    """Rows of (group, lang, phrase, n) as one row a group, of lists; ``whole`` says that the group is not a divided prefix's."""
    for batch in batches:
        order = np.argsort(batch.column("group").to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        group = batch.column("group").to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        offsets = pa.array(np.append(heads, len(group)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("lang", "phrase", "n")]
        columns = [pa.array(group[heads]), pa.array(~divided[group[heads]]), *lists]
        yield pa.RecordBatch.from_arrays(columns, ["group", "whole", "lang", "phrase", "n"])


_PACKED = "group bigint, whole boolean, lang array<string>, phrase array<binary>, n array<bigint>"


def subtrees(table: pa.Table, least: int, whole: bool) -> pa.Table:
    """All nodes of two words or more of one group's suffixes: lang, phrase, words, n.

    ``whole`` groups have all suffixes of their prefixes, so that nodes with less than ``least`` leaves can go at once.
    """
    table = table.combine_chunks()
    parts = pc.split_pattern(table["phrase"].combine_chunks(), b" ")
    sizes = np.diff(parts.offsets.to_numpy())
    coded = parts.flatten().dictionary_encode()
    ids = np.full((len(sizes), LONGEST), -1, np.int64)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids[np.repeat(np.arange(len(sizes)), sizes), at] = coded.indices.to_numpy()
    tongue = table["lang"].combine_chunks().dictionary_encode()
    lang = tongue.indices.to_numpy().astype(np.int64)
    order = np.lexsort((*ids.T[::-1], lang))
    ids, lang, sizes, n = ids[order], lang[order], sizes[order], table["n"].to_numpy()[order]
    out = []
    for depth in range(2, LONGEST + 1):
        deep = np.flatnonzero(sizes >= depth)
        if not len(deep):
            break
        new = np.ones(len(deep), bool)
        own = ids[deep, :depth]
        new[1:] = (own[1:] != own[:-1]).any(axis=1) | (lang[deep][1:] != lang[deep][:-1])
        heads = np.flatnonzero(new)
        count = np.add.reduceat(n[deep], heads)
        if whole:
            heads, count = heads[count >= least], count[count >= least]
        node = own[heads]
        spelled = [coded.dictionary.take(pa.array(node[:, k])) for k in range(depth)]
        phrase = pc.binary_join_element_wise(*spelled, pa.scalar(b" ", pa.binary()))
        out.append(pa.table([tongue.dictionary.take(pa.array(lang[deep][heads])), phrase, pa.array(count)], ["lang", "phrase", "n"]))
    return pa.concat_tables(out)


def _pages(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap over the hashes; it reaches the driver as at most bits / PAGE_BITS rows of one page each."""

    def page(table: pa.Table) -> pa.Table:
        slot = table["hash"].to_numpy().view(np.uint64) & np.uint64(bits - 1)
        marks = np.zeros(PAGE_BITS // 8, np.uint8)
        within = (slot & np.uint64(PAGE_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(marks, within >> 3, (1 << (within & 7)).astype(np.uint8))
        return pa.table([pa.array([int(slot[0]) // PAGE_BITS]), pa.array([marks.tobytes()], pa.binary())], ["page", "marks"])

    number = F.shiftright(F.col("hash").bitwiseAND(F.lit(bits - 1)), PAGE_BITS.bit_length() - 1)
    slots = hashes.select(number.alias("page"), F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("hash")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for at, marks in slots.groupBy("page").applyInArrow(page, "page bigint, marks binary").collect():
        out[at * PAGE_BITS // 8 : (at + 1) * PAGE_BITS // 8] = np.frombuffer(marks, np.uint8)
    return out


def pack(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each range of prefixes its first group, and over how many groups it is divided.

    Consecutive ranges share a group while they fit in ``budget``; a larger one is divided.
    """
    first, split = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    group, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if n > budget:
            group += held > 0
            first[i], split[i], held = group, -(-n // budget), 0
            group += int(split[i])
            continue
        if held + n > budget:
            group, held = group + 1, 0
        first[i], held = group, held + n
    return first, split


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    budget: int = SUFFIXES,
    segment: int = SEGMENT,
    bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """Word counts (lang, word, n) of the table, and (lang, phrase, a) of the phrases of 2 to LONGEST words with a >= ``least``."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), bytes_of(F.col(text)).alias("text"))

    def count_words(batches):
        yield from folded(_count_words(batches, segment), ["lang", "word", "hash"])

    single = rows.mapInArrow(count_words, "lang string, word binary, hash bigint, n bigint")
    single = save(single.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")))
    frequent = _pages(single.filter(F.col("n") >= least).select("hash"), bits)

    def count_pairs(batches):
        yield from folded(_count_pairs(batches, frequent, segment), ["hash"])

    pairs = rows.mapInArrow(count_pairs, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    pairs = save(pairs.filter(F.col("n") >= least))
    prefixes = _pages(pairs.select("hash"), bits)
    shift = 64 - (RANGES.bit_length() - 1)
    sizes = np.zeros(RANGES, np.int64)
    for at, n in pairs.groupBy(F.shiftrightunsigned("hash", shift).alias("at")).agg(F.sum("n")).collect():  # at most RANGES rows
        sizes[at] = n
    first, split = pack(sizes, budget)
    divided = np.zeros(int((first + split).max()) + 1, bool)
    for i in np.flatnonzero(split > 1):
        divided[first[i] : first[i] + split[i]] = True

    def send(batches):
        leaves = folded(_send(batches, frequent, prefixes, first, split, segment), ["group", "lang", "phrase"])
        yield from _packed(leaves, divided)

    def build(table: pa.Table) -> pa.Table:
        lists = {c: pa.chunked_array([x.flatten() for x in table[c].chunks]) for c in ("lang", "phrase", "n")}
        return subtrees(pa.table(lists), least, True)

    def build_part(table: pa.Table) -> pa.Table:
        return subtrees(table, least, False)

    kind = "lang string, phrase binary, n bigint"
    leaves = rows.mapInArrow(send, _PACKED)
    if divided.any():  # the same suffix may come from every task; such copies are folded on their way
        leaves = save(leaves)
        single_leaves = leaves.filter("not whole").select("group", F.inline(F.arrays_zip("lang", "phrase", "n")))
        parts = single_leaves.groupBy("group", "lang", "phrase").agg(F.sum("n").alias("n")).groupBy("group")
        nodes = parts.applyInArrow(build_part, kind).union(leaves.filter("whole").groupBy("group").applyInArrow(build, kind))
    else:
        nodes = leaves.groupBy("group").applyInArrow(build, kind)
    phrases = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    phrases = save(phrases.select("lang", F.col("phrase").cast("string").alias("phrase"), "a"))
    return single.select("lang", F.col("word").cast("string").alias("word"), "n"), phrases


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score, as the best cut of a phrase rates it.

    Words end at a space or tab, pieces at ``.,;:!?`` and line ends; A-Z in lower case.  A phrase of 2 to 5
    words within a piece that occurs ``least`` times is a candidate, and goes if it lies in a longer one that
    occurs as often.  A null text has no word; a null language is ``und``, along with rows that say so.  Repeated rows
    count as often as they come.  Languages without a candidate, and empty tables, give no row.  Ties go to the more frequent
    phrase, then to the first in byte order.  Other columns are not read.
    """
    single, phrases = phrase_counts(docs, text, lang, least, **options)
    total = single.groupBy("lang").agg(F.sum("n").alias("n"))
    known = phrases.select("lang", "phrase", F.col("a").alias("f"))
    known = known.union(single.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    parts = F.split("phrase", " ")
    cuts = phrases.withColumn("w", parts).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"),
    )
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(total, "lang")
    exact = "(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    # a phrase inside a much longer one lies in one that is a word longer, too, and at least as frequent
    longer = phrases.withColumn("w", parts).filter(F.size("w") > 2)
    ends = [F.slice("w", F.lit(a), F.size("w") - 1) for a in (1, 2)]
    inner = longer.select("lang", F.explode(F.array(*[F.array_join(e, " ") for e in ends])).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer"), F.lit(0)) < F.col("a"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_PIECE, _WORD = re.compile(r"[.,;:!?\x0a-\x0d]"), re.compile(r"[^\x20\x09]+")


def pieces_of(text: str) -> list[list[str]]:
    """The same pieces and words of one text, one after the other; for reading and for tests."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [_WORD.findall(p) for p in _PIECE.split(low)]
