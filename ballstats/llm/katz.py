"""Katz backoff scores of texts: bigram counts discounted after Good and Turing, exact backoff weights.

P(w | v) = d(c) c / C(v) if the pair occurs c > 0 times in training, else alpha(v) P(w); P(w) is the same
on words, and what its discounts leave is the probability of an unknown word.

Words are 64-bit hashes.  All different words are met once before, and those that share a hash get
numbers of their own, so a number stands for one word.  A scan cuts the table into chunks of documents, folds each chunk's
tokens to its different pairs, and sends each pair, with the documents it stands in, to the task that
owns its first word.  That task sees all counts of its words, so it returns, besides the model's
tables, each document's sum over seen pairs.  The discounts are known only at the end, so sums keep
the number of pairs that occur 1 to 5 times.  Unseen pairs are listed, and joined with the
weights later.  The scan is done once for each slice of the first words, which divides what is
on disk at a time.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.llm.shared import bytes_of, row_key, save
from ballstats.llm.tokens import LOWER, SPACES, Words, blocks, other_hashes, word_hashes, words

CUTOFF = 5
TAIL = 0.01  # counts above the cutoff lose this much, so that any context has something left
CHUNK_TOKENS = 2_500_000
SLICES, PARTS, OWNER_BYTES = 3, 12, 16 << 20
HOT_SAMPLE, HOT_SHARE = 2000, 1 / 64
BEGIN, END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
_BLOBS = "kind string, chunk bigint, a binary, b binary, c binary, d binary"


class Scale(NamedTuple):
    """What all of the training tokens say: discounts, tokens, different words."""

    pairs: tuple[float, ...]
    words: tuple[float, ...]
    tokens: int
    types: int
    unknown: float


def discounts(counts: list[int]) -> tuple[float, ...]:
    """d(1) to d(CUTOFF) from how many events occur 1, 2, ... CUTOFF + 1 times.

    Good-Turing with the largest cutoff whose factors all lie between 0 and 1; if there is none
    (too few or too regular events), a constant is taken off each count.
    """
    tail = [(r - TAIL) / r for r in range(1, CUTOFF + 1)]
    for k in range(CUTOFF, 0, -1):
        if any(n <= 0 for n in counts[: k + 1]):
            continue
        common = (k + 1) * counts[k] / counts[0]
        if common >= 1:
            continue
        found = [((r + 1) * counts[r] / (r * counts[r - 1]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in found):
            return tuple(found + tail[k:])
    off = min(0.9, max(0.1, counts[0] / (counts[0] + 2 * counts[1]))) if counts[0] else 0.5
    return tuple((r - off) / r for r in range(1, CUTOFF + 1))


def discounted(counts: np.ndarray, factors: tuple[float, ...]) -> np.ndarray:
    """d(c) c."""
    factor = np.array([0.0, *factors])[np.minimum(counts, CUTOFF)]
    return np.where(counts > CUTOFF, counts - TAIL, factor * counts)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Apart(NamedTuple):
    """Hashes that stand for several words, and the numbers of those words that do not keep theirs."""

    shared: np.ndarray
    numbers: dict[bytes, int]


NO_WORDS = Apart(np.zeros(0, np.uint64), {})


def _different_words(block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A block's different words, their hashes, and hashes of another kind."""
    data = LOWER[block.data]
    found = words(data, block.offsets, SPACES)
    ends = np.cumsum(found.ends - found.starts)
    buffers = [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data[SPACES[data]])]
    spelled = pa.Array.from_buffers(pa.large_binary(), len(ends), buffers).unique()
    at = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1)
    own = Words(at[:-1], at[1:], at)
    letters = np.frombuffer(spelled.buffers()[2] or b"", np.uint8)
    return spelled, word_hashes(letters, own), other_hashes(letters, own)


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    heads = _runs(one, two)
    return one[heads], two[heads]


def _marks(batches, parts: int):
    """Both hashes of a task's different words, sent to the owner of the first: (part, first, second)."""

    def send():
        one, two = _distinct(*(np.concatenate(x) for x in zip(*kept, strict=True)))
        part = (_mix(one) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, one[order[a:b]].tobytes(), two[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.binary(), pa.binary()], strict=True)], ["part", "a", "b"])

    kept, held = [], 0
    for batch in batches:
        for block in blocks(batch.column("text")):
            one, two = _different_words(block)[1:]
            kept.append((one, two))
            held += len(one)
            if held > 1 << 20:
                kept = [_distinct(*(np.concatenate(x) for x in zip(*kept, strict=True)))]
                held = len(kept[0][0])
                if held > 1 << 19:
                    yield send()
                    kept, held = [], 0
    if held:
        yield send()
    pa.default_memory_pool().release_unused()


def _clashes(table: pa.Table) -> pa.Table:
    """First hashes that stand with several second ones, or for the beginning or the end."""
    one, two = (np.concatenate([np.frombuffer(x, np.uint64) for x in table[c].to_pylist()]) for c in ("a", "b"))
    one, _ = _distinct(one, two)
    several = np.concatenate((one[1:][one[1:] == one[:-1]], one[np.isin(one, [BEGIN, END])]))
    return pa.table([pa.array(np.unique(several).view(np.int64))], ["hash"])


def words_apart(rows: DataFrame, parts: int) -> Apart:
    """The words whose hash is not theirs alone.

    All different words are met by two independent hashes of 64 bits.  Where one value of the first comes with
    several of the second, the words are read again and told apart by their letters.  Only those reach
    the driver: in a table of a billion different words that is one pair in forty tables.
    """

    def run(batches):
        yield from _marks(batches, parts)

    marks = [int(x.view(np.int64)) for x in (BEGIN, END)]
    sent = rows.select("text").mapInArrow(run, "part int, a binary, b binary")
    shared = [r.hash for r in save(sent.groupBy("part").applyInArrow(_clashes, "hash bigint")).collect()]
    if not shared:
        return NO_WORDS
    wanted = np.array(shared, np.int64).view(np.uint64)

    def spell(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                spelled, hashes, _ = _different_words(block)
                own = np.flatnonzero(np.isin(hashes, wanted))
                columns = [pa.array(hashes[own].view(np.int64)), spelled.take(pa.array(own)).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "word"])

    found: dict[int, list[bytes]] = {}
    for h, word in rows.select("text").mapInArrow(spell, "hash bigint, word binary").distinct().collect():
        found.setdefault(h, []).append(bytes(word))
    move = sorted(w for h, own in found.items() for w in sorted(own)[h not in marks :])
    numbers = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8, key=b"apart").digest(), "little") for w in move}
    return Apart(wanted, numbers)


def _pairs(data: np.ndarray, offsets: np.ndarray, apart: Apart = NO_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's words and its end: the word before (or the beginning), the word, the row."""
    found = words(data, offsets, SPACES)
    hashes, counts = word_hashes(data, found), np.diff(found.rows)
    if len(apart.shared):
        for i in np.flatnonzero(np.isin(hashes, apart.shared)):
            hashes[i] = apart.numbers.get(data[found.starts[i] : found.ends[i]].tobytes(), hashes[i])
    rows = np.repeat(np.arange(len(counts)), counts + 1)
    lasts = np.cumsum(counts + 1) - 1
    token = np.empty(len(rows), np.uint64)
    plain = np.ones(len(rows), bool)
    plain[lasts] = False
    token[plain], token[lasts] = hashes, END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[lasts - counts] = BEGIN
    return before, token, rows


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sizes(begins: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(begins, total))


def _emit(chunk: int, before, token, doc, keys: list[bytes], train: list[bool], hot: np.ndarray, parts: int):
    """Rows (part, kind, chunk, blobs) of one chunk: its pairs by owner, and its documents' keys."""
    trained = np.array(train, bool)
    owner = _mix(before)
    crowded = np.isin(before, hot) if len(hot) else np.zeros(len(before), bool)
    owner[crowded] = _mix(owner[crowded] ^ token[crowded])  # a frequent first word is shared out by the second
    part = (owner % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((token, before, part))
    before, token, doc, part = before[order], token[order], doc[order].astype(np.uint32), part[order]
    pair = _runs(part, before, token)
    totals = np.array([int((trained[doc] & (before == h)).sum()) for h in hot], np.int64)
    edges = np.searchsorted(part, np.arange(parts + 1))
    out = []
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        own = pair[np.searchsorted(pair, a) : np.searchsorted(pair, b)]
        heads = _runs(before[own]) if len(own) else own
        out.append(
            (
                p,
                "pairs",
                chunk,
                before[own][heads].tobytes() + _sizes(heads, len(own)).astype(np.uint32).tobytes(),
                token[own].tobytes(),
                _sizes(own, b).astype(np.uint32).tobytes() + doc[a:b].tobytes(),
                np.packbits(trained).tobytes() + totals.tobytes(),
                len(heads),
                len(trained),
            )
        )
    out.append((chunk % parts, "keys", chunk, b"".join(keys), None, None, None, 0, len(keys)))
    columns = list(zip(*out, strict=True))
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["part", "kind", "chunk", "a", "b", "c", "d", "heads", "docs"])


_SENT = "part int, kind string, chunk bigint, a binary, b binary, c binary, d binary, heads bigint, docs bigint"


def _scan(batches, part_of: int, slices: int, hot: np.ndarray, parts: int, limit: int, apart: Apart):
    """The chunks of one slice of first words."""
    kept: list = []
    keys: list[bytes] = []
    train: list[bool] = []
    seen, number = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        key, flag = batch.column("key").to_pylist(), batch.column("train").to_pylist()
        for block in blocks(batch.column("text")):
            before, token, rows = _pairs(LOWER[block.data], block.offsets, apart)
            n, mine = len(block.offsets) - 1, (_mix(before) >> np.uint64(40)) % np.uint64(slices) == part_of
            kept.append((before[mine], token[mine], rows[mine] + len(keys)))
            keys += key[block.first : block.first + n]
            train += flag[block.first : block.first + n]
            seen += len(token)
            if seen >= limit:
                yield _emit(number, *(np.concatenate(x) for x in zip(*kept, strict=True)), keys, train, hot, parts)
                kept, keys, train, seen, number = [], [], [], 0, number + 1
    if keys:
        yield _emit(number, *(np.concatenate(x) for x in zip(*kept, strict=True)), keys, train, hot, parts)
    pa.default_memory_pool().release_unused()


class _Chunk(NamedTuple):
    number: int
    before: np.ndarray
    token: np.ndarray
    uses: np.ndarray
    docs: np.ndarray
    trained: np.ndarray
    totals: np.ndarray


def _unpack(row: dict) -> _Chunk:
    n, docs = row["heads"], row["docs"]
    firsts = np.frombuffer(row["a"], np.uint64, n)
    before = np.repeat(firsts, np.frombuffer(row["a"], np.uint32, n, n * 8))
    token = np.frombuffer(row["b"], np.uint64)
    rest = np.frombuffer(row["c"], np.uint32)
    flags = -(-docs // 8)
    trained = np.unpackbits(np.frombuffer(row["d"], np.uint8, flags), count=docs).astype(bool)
    totals = np.frombuffer(row["d"][flags:], np.int64)
    return _Chunk(row["chunk"], before, token, rest[: len(token)], rest[len(token) :], trained, totals)


def _count(table: pa.Table, hot: np.ndarray) -> pa.Table:
    """One owner's tables and sums from the chunks' pairs."""
    out, chunks = [], []
    for batch in table.to_batches(max_chunksize=1):
        (row,) = batch.to_pylist()
        if row["kind"] == "keys":
            out.append(("keys", row["chunk"], row["a"], None, None, None))
        else:
            chunks.append(_unpack(row))
    if chunks:
        out += _count_chunks(chunks, hot)
    pa.default_memory_pool().release_unused()
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = [pa.string(), pa.int64(), *[pa.large_binary()] * 4]
    arrays = [pa.array(c, k).cast(pa.binary()) if k == pa.large_binary() else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.Table.from_arrays(arrays, ["kind", "chunk", "a", "b", "c", "d"])


def _count_chunks(chunks: list[_Chunk], hot: np.ndarray) -> list[tuple]:
    out: list[tuple] = []
    before, token = (np.concatenate([getattr(c, n) for c in chunks]) for n in ("before", "token"))
    place = [np.repeat(np.arange(len(c.token), dtype=np.int32), c.uses) for c in chunks]
    counts = np.concatenate(
        [np.bincount(p, c.trained[c.docs], len(c.token)).astype(np.int64) for p, c in zip(place, chunks, strict=True)]
    )
    order = np.lexsort((token, before))
    begins = _runs(before[order], token[order])
    of_pair = np.empty(len(order), np.int32)
    of_pair[order] = np.repeat(np.arange(len(begins), dtype=np.int32), _sizes(begins, len(order)))
    count = np.add.reduceat(counts[order], begins) if len(begins) else counts
    before, token = before[order[begins]], token[order[begins]]
    del order, counts
    heads = _runs(before) if len(before) else begins
    of_head = np.repeat(np.arange(len(heads), dtype=np.int32), _sizes(heads, len(before)))
    context = before[heads]
    total = np.add.reduceat(count, heads) if len(heads) else count
    if len(hot):  # of a shared first word this task sees a part; the chunks sent its whole count
        whole = np.sum([c.totals for c in chunks], axis=0)
        for h, n in zip(hot, whole, strict=True):
            total[context == h] = n
    capped = np.minimum(count, CUTOFF + 2)
    classes = [np.bincount(of_head, capped == r, len(heads)).astype(np.int64) for r in range(1, CUTOFF + 2)]
    large = np.bincount(of_head, np.where(count > CUTOFF, count - TAIL, 0.0), len(heads))
    for a in range(0, len(heads), 1 << 16):
        s = slice(a, a + (1 << 16))
        out.append(("contexts", 0, context[s].tobytes(), total[s].tobytes(), np.stack([c[s] for c in classes]).tobytes(), large[s].tobytes()))
    seen = count > 0
    seen_before, seen_token = before[seen], token[seen]
    for a in range(0, len(seen_token), 1 << 17):
        s = slice(a, a + (1 << 17))
        begin = _runs(seen_before[s])
        sizes = _sizes(begin, len(seen_token[s])).astype(np.uint32)
        out.append(("seen", 0, seen_before[s][begin].tobytes(), sizes.tobytes(), seen_token[s].tobytes(), None))
    own_total = total[of_head]
    with np.errstate(divide="ignore", invalid="ignore"):  # of unseen pairs, set to 0 below
        value = np.log10(np.where(count > CUTOFF, count - TAIL, count)) - np.log10(own_total)
        base = np.log10(total + 1.0)
    value[~seen] = 0
    known_word = (context != BEGIN) & (total > 0)
    base[context == BEGIN] = 0
    at = 0
    for c, p in zip(chunks, place, strict=True):
        pair = of_pair[at : at + len(c.token)][p]
        at += len(c.token)
        head, k = of_head[pair], count[pair]
        own, doc = np.unique(c.docs, return_inverse=True)
        n = len(own)
        sums = np.stack([np.bincount(doc, x, n) for x in (value[pair], base[head])])
        tallies = [np.bincount(doc, minlength=n), np.bincount(doc, known_word[head], n)]
        tallies += [np.bincount(doc, k == r, n) for r in range(1, CUTOFF + 1)]
        tallies = np.stack(tallies)
        tallies = tallies.astype(np.uint8 if tallies.max(initial=0) < 256 else np.uint32)  # every owner has a few of a document's pairs
        out.append(("sums", c.number, own.tobytes(), sums.tobytes(), tallies.tobytes(), None))
        new = np.flatnonzero(k == 0)
        if len(new):
            lone = own_total[pair[new]] == 0
            first = np.where(lone, BEGIN, before[pair[new]])
            out.append(
                ("unseen", c.number, c.docs[new].tobytes(), first.tobytes(), token[pair[new]].tobytes(), np.packbits(lone).tobytes())
            )
    return out


def _documents(table: pa.Table) -> pa.Table:
    """The keys of a chunk with the sums of all its owners."""
    rows = table.to_pylist()
    keys = next(r["a"] for r in rows if r["kind"] == "keys")
    n = len(keys) // 32
    sums, tallies = np.zeros((2, n)), np.zeros((2 + CUTOFF, n), np.int64)
    for r in rows:
        if r["kind"] == "sums":
            own = np.frombuffer(r["a"], np.uint32)
            sums[:, own] += np.frombuffer(r["b"], np.float64).reshape(2, -1)
            narrow = len(r["c"]) == len(own) * (2 + CUTOFF)
            tallies[:, own] += np.frombuffer(r["c"], np.uint8 if narrow else np.uint32).reshape(2 + CUTOFF, -1)
    columns = [
        pa.array([table["chunk"][0].as_py()] * n, pa.int64()),
        pa.array(np.arange(n)),
        pa.array([keys[i * 32 : i * 32 + 32] for i in range(n)], pa.binary()),
        *(pa.array(x) for x in sums),
        *(pa.array(x) for x in tallies),
    ]
    return pa.table(columns, ["chunk", "doc", "key", "seen_log", "base_log", "n_tokens", "n_known", *_CLASSES])


_CLASSES = [f"k{r}" for r in range(1, CUTOFF + 1)]
_DOCUMENTS = "chunk bigint, doc bigint, key binary, seen_log double, base_log double, n_tokens bigint, n_known bigint, " + ", ".join(
    f"{c} bigint" for c in _CLASSES
)


def _contexts(batches):
    for batch in batches:
        for r in batch.to_pylist():
            n = len(r["a"]) // 8
            classes = np.frombuffer(r["c"], np.int64).reshape(CUTOFF + 1, n)
            arrays = [np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64), *classes, np.frombuffer(r["d"], np.float64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["word", "total", *_CLASSES, f"k{CUTOFF + 1}", "large"])


_CONTEXTS = "word bigint, total bigint, " + ", ".join(f"k{r} bigint" for r in range(1, CUTOFF + 2)) + ", large double"


def _by_second(batches, parts: int):
    """Seen pairs sent to the owner of their second word: (part, first words, second words)."""
    for batch in batches:
        for r in batch.to_pylist():
            first = np.repeat(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint32))
            second = np.frombuffer(r["c"], np.uint64)
            part = (_mix(second) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((second, part))
            first, second, part = first[order], second[order], part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in range(parts):
                s = slice(edges[p], edges[p + 1])
                begin = _runs(second[s]) if edges[p] < edges[p + 1] else np.zeros(0, np.int64)
                sizes = _sizes(begin, edges[p + 1] - edges[p]).astype(np.uint32)
                rows.append((p, second[s][begin].tobytes(), sizes.tobytes(), first[s].tobytes()))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "a", "b", "c"])


def _lower_sums(pairs: pa.Table, known: pa.Table, scale: Scale) -> pa.Table:
    """For each first word the sum of P(second word) over its seen pairs of this part."""
    order = np.argsort(known["word"].to_numpy().view(np.uint64))
    word, total = known["word"].to_numpy().view(np.uint64)[order], known["total"].to_numpy()[order]
    chance = discounted(total, scale.words) / max(scale.tokens, 1)
    firsts, values = [], []
    for r in pairs.to_pylist():
        second = np.frombuffer(r["a"], np.uint64)
        if len(second):
            firsts.append(np.frombuffer(r["c"], np.uint64))
            values.append(np.repeat(chance[np.searchsorted(word, second)], np.frombuffer(r["b"], np.uint32)))
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
    value = np.concatenate(values) if values else np.zeros(0)
    distinct, place = np.unique(first, return_inverse=True)
    sums = np.bincount(place, value, len(distinct)).astype(np.float64)  # over nothing it would be whole numbers
    return pa.table([pa.array(distinct.view(np.int64)), pa.array(sums)], ["word", "lower"])


def _unseen(batches):
    for batch in batches:
        for r in batch.to_pylist():
            docs = np.frombuffer(r["a"], np.uint32).astype(np.int64)
            lone = np.unpackbits(np.frombuffer(r["d"], np.uint8), count=len(docs)).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(docs), r["chunk"])),
                    pa.array(docs),
                    pa.array(np.frombuffer(r["b"], np.int64), mask=lone),
                    pa.array(np.frombuffer(r["c"], np.int64)),
                ],
                ["chunk", "doc", "first", "second"],
            )


def _frequent(rows: DataFrame, total: int, apart: Apart, sample: int = HOT_SAMPLE, share: float = HOT_SHARE) -> np.ndarray:
    """Words so frequent in a sample of about ``sample`` of the ``total`` rows that their pairs need several owners.

    This only decides where pairs are counted, not what is counted.  They are at most 1 / share words; the
    sample itself stays in the executors.
    """

    def count(batches):
        for batch in batches:
            for block in blocks(batch.column("text")):
                word, n = np.unique(_pairs(LOWER[block.data], block.offsets, apart)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    part = min(1.0, sample / max(total, 1))
    chosen = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < F.lit(int(part * (1 << 40)))).select("text")
    counts = save(chosen.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    return np.array([r.word for r in counts.filter(F.col("n") > share * tokens).collect()], np.int64).view(np.uint64)


def held_out(doc_id, parts: int = 7, part: int = 2):
    """Whether a row is kept for testing; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def score(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    slices: int = SLICES,
    parts: int = PARTS,
    chunk_tokens: int = CHUNK_TOKENS,
    hot_share: float = HOT_SHARE,
    owner_bytes: int = OWNER_BYTES,
) -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model learns from the rows that are not held out and scores all.  Tokens are the text's words,
    A-Z in lower case, and one end.  ``base_score`` adds one to each word's count.  A null or empty
    text is its end alone.  Repeated rows count as often as they come, and each gets its row; an
    empty table gives none.  Without a training row every word is unknown.  Other columns are not read.
    """
    rows = docs.select(
        row_key(F.col(doc_id), F.col(text)).alias("key"), bytes_of(F.col(text)).alias("text"), (~held_out(F.col(doc_id))).alias("train")
    )
    spark = docs.sparkSession
    total, trained, size = rows.agg(
        F.count(F.lit(1)), F.count_if("train"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))
    ).first()
    # an owner holds the pairs of so much text, however large the table is
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-size // owner_bytes))
    apart = words_apart(rows, parts)
    hot = _frequent(rows, total, apart, share=hot_share)

    def counted(number: int) -> DataFrame:
        def scan(batches):
            yield from _scan(batches, number, slices, hot, parts, chunk_tokens, apart)

        def count(table: pa.Table) -> pa.Table:
            return _count(table, hot)

        return save(rows.mapInArrow(scan, _SENT).groupBy("part").applyInArrow(count, _BLOBS), by="kind")

    found = [counted(i) for i in range(slices)]
    contexts = save(_contexts_of(found))
    scale = _scale(contexts, trained)
    known = contexts.filter((F.col("word") != int(BEGIN.view(np.int64))) & (F.col("total") > 0)).select("word", "total")
    ending = spark.range(1).select(F.lit(int(END.view(np.int64))).alias("word"), F.lit(trained).cast("long").alias("total"))
    known = save(known.union(ending.filter("total > 0")))
    weights = save(_weights(found, contexts, known, scale, parts))
    total = _document_scores(found, known, weights, scale, trained)
    return (
        docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"))
        .join(total, "key")
        .select(
            "doc_id",
            held_out(F.col("doc_id")).alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(scale.tokens).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
    )


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _contexts_of(found: list[DataFrame]) -> DataFrame:
    parts = _all([f.filter("kind = 'contexts'").select("a", "b", "c", "d").mapInArrow(_contexts, _CONTEXTS) for f in found])
    sums = [F.sum(c).alias(c) for c in (*_CLASSES, f"k{CUTOFF + 1}", "large")]
    return parts.groupBy("word").agg(F.max("total").alias("total"), *sums)


def _scale(contexts: DataFrame, trained: int) -> Scale:
    real = (F.col("word") != int(BEGIN.view(np.int64))) & (F.col("total") > 0)
    names = [f"k{r}" for r in range(1, CUTOFF + 2)]
    word_classes = [F.count_if(real & (F.col("total") == r)).alias(f"w{r}") for r in range(1, CUTOFF + 2)]
    got = contexts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names],
        *word_classes,
        F.coalesce(F.sum(F.when(real, F.col("total"))), F.lit(0)).alias("tokens"),
        F.count_if(real).alias("types"),
        F.coalesce(F.sum(F.when(real & (F.col("total") > CUTOFF), F.col("total") - TAIL)), F.lit(0.0)).alias("large"),
    ).first()
    by_count = [got[f"w{r}"] + (trained == r) for r in range(1, CUTOFF + 2)]
    tokens, types = got.tokens + trained, got.types + (trained > 0)
    word_factors = discounts(by_count)
    kept = got.large + sum(d * r * got[f"w{r}"] for r, d in enumerate(word_factors, 1))
    kept += float(discounted(np.array([trained]), word_factors)[0])
    unknown = 1 - kept / tokens if tokens else 1.0
    return Scale(discounts([got[c] for c in names]), word_factors, tokens, types, unknown)


def _weights(found: list[DataFrame], contexts: DataFrame, known: DataFrame, scale: Scale, parts: int) -> DataFrame:
    """alpha of each first word: what its pairs leave, over what their second words leave of P."""

    def send(batches):
        yield from _by_second(batches, parts)

    def lower(pairs: pa.Table, table: pa.Table) -> pa.Table:
        return _lower_sums(pairs, table, scale)

    def owner(batches):
        for batch in batches:
            part = _mix(batch.column("word").to_numpy().view(np.uint64)) % np.uint64(parts)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], ["part", "word", "total"])

    owned = known.mapInArrow(owner, "part int, word bigint, total bigint")
    sums = []
    for f in found:  # one slice of first words after the other
        sent = f.filter("kind = 'seen'").select("a", "b", "c").mapInArrow(send, "part int, a binary, b binary, c binary")
        pairs = sent.groupBy("part").cogroup(owned.groupBy("part")).applyInArrow(lower, "word bigint, lower double")
        sums.append(save(pairs.groupBy("word").agg(F.sum("lower").alias("lower"))))
    kept = F.col("large") + sum(F.col(f"k{r}") * (r * d) for r, d in enumerate(scale.pairs, 1))
    left, rest = 1 - kept / F.col("total"), 1 - F.coalesce("lower", F.lit(0.0))
    return contexts.filter("total > 0").join(_all(sums), "word", "left").select("word", (left / rest).alias("alpha"))


def _document_scores(found: list[DataFrame], known: DataFrame, weights: DataFrame, scale: Scale, trained: int) -> DataFrame:
    """Per key: n_tokens, n_known, base_score, score."""
    owned = []
    for number, f in enumerate(found):
        docs = f.filter("kind in ('keys', 'sums')").groupBy("chunk").applyInArrow(_documents, _DOCUMENTS)
        new = f.filter("kind = 'unseen'").select("chunk", "a", "b", "c", "d")
        new = new.mapInArrow(_unseen, "chunk bigint, doc bigint, first bigint, second bigint")
        n = F.col("total")
        factor = F.element_at(F.array(*[F.lit(d) for d in scale.words]), F.least(n, F.lit(CUTOFF)).cast("int"))
        chance = F.when(n.isNull(), F.lit(scale.unknown)).otherwise(
            F.when(n > CUTOFF, n - TAIL).otherwise(factor * n) / max(scale.tokens, 1)
        )
        backed = (
            new.join(weights.withColumnRenamed("word", "first"), "first", "left")
            .join(known.withColumnRenamed("word", "second"), "second", "left")
            .groupBy("chunk", "doc")
            .agg(F.sum(F.log10(F.coalesce("alpha", F.lit(1.0)) * chance)).alias("unseen_log"))
        )
        owned.append(save(docs.join(backed, ["chunk", "doc"], "left").drop("chunk", "doc").withColumn("slice", F.lit(number))))
    names = ["seen_log", "base_log", "n_tokens", "n_known", *_CLASSES]
    per_row = F.count(F.lit(1)) / len(found)  # rows that repeat a key each bring all slices
    total = _all(owned).groupBy("key").agg(
        *[(F.sum(c) / per_row).alias(c) for c in names], (F.sum(F.coalesce("unseen_log", F.lit(0.0))) / per_row).alias("unseen_log")
    )
    weight = sum(F.col(f"k{r}") * math.log10(d) for r, d in enumerate(scale.pairs, 1))
    tokens = F.round("n_tokens").cast("long")
    base = F.col("base_log") + math.log10(trained + 1) - tokens * math.log10(scale.tokens + scale.types + 1)
    return total.select(
        "key",
        tokens.alias("n_tokens"),
        (F.round("n_known").cast("long") + int(trained > 0)).alias("n_known"),
        base.alias("base_score"),
        (F.col("seen_log") + weight + F.col("unseen_log")).alias("score"),
    )
