"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
HELD_ROWS = 1 << 19  # rows that a task folds together before they move
LANES = 256  # words up to here are hashed side by side
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

SPACES = np.ones(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
"""Bytes of words that end at ASCII white space."""

ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = True
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
"""Bytes of words of lower-case letters, digits and everything beyond ASCII."""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
"""A-Z to a-z."""


class Block(NamedTuple):
    """Some consecutive rows: first row, their bytes, and each row's start in them (and the end)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole rows of a binary column without nulls, about ``limit`` bytes at a time."""
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Block(first, data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first])
        first = stop


def folded(tables, keys: list[str], hold: int = HELD_ROWS):
    """The tables' rows with ``n`` added up over equal keys, as far as about ``hold`` rows in memory allow."""

    def fold():
        sums = pa.concat_tables(kept).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return sums.rename_columns({"n_sum": "n"}).select(schema.names).cast(schema)

    kept, rows, schema = [], 0, None
    for table in tables:
        kept, rows, schema = [*kept, table], rows + table.num_rows, table.schema
        if rows > hold:
            one = fold()
            kept, rows = [one], one.num_rows
            if rows > hold // 2:
                yield from one.to_batches(max_chunksize=1 << 17)
                kept, rows = [], 0
    if rows:
        yield from fold().to_batches(max_chunksize=1 << 17)
    pa.default_memory_pool().release_unused()


class Words(NamedTuple):
    """Byte spans of words, and the first word of each row (and the end)."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> Words:
    """Maximal runs of the bytes that ``kinds`` marks; no word reaches over a row's end."""
    inside = kinds[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def spaced(data: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, each with one space behind, and their new starts and ends."""
    sizes = found.ends - found.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    before = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    letter = np.arange(int(sizes.sum()))
    out[letter + np.repeat(starts - before, sizes)] = data[letter + np.repeat(found.starts - before, sizes)]
    return out, starts, ends


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, for the places of one part."""
    if base not in _powers:
        up, down = np.full(BLOCK_BYTES, base, np.uint64), np.full(BLOCK_BYTES, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down)
    return _powers[base]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, part: int = BLOCK_BYTES) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of values[starts:ends], the same wherever the values stand.

    The values are gone over ``part`` at a time, so that a very long text needs no further wide copy; the
    answer does not depend on ``part``.  Long runs of two values in certain orders collide, so
    this is for short runs of hashed words, and for what is compared afterwards.
    """
    up, down = _tables(base)
    inverse = pow(base, -1, 1 << 64)
    low, high, back = (np.zeros(len(starts), np.uint64) for _ in range(3))
    before = np.uint64(0)
    for first in range(0, len(values) + 1, part):
        wide = values[first : first + part].astype(np.uint64)
        sums = np.zeros(len(wide) + 1, np.uint64)
        np.cumsum(wide * up[: len(wide)], out=sums[1:])
        if first:
            sums = sums * np.uint64(pow(base, first, 1 << 64)) + before
        before = sums[-1]
        begin, end = (slice(None) if len(values) < part else np.flatnonzero(x // part == first // part) for x in (starts, ends))
        low[begin], high[end] = sums[starts[begin] - first], sums[ends[end] - first]
        back[begin] = down[starts[begin] - first] * np.uint64(pow(inverse, first, 1 << 64))
    return _mix((high - low) * back + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _mixed(data: np.ndarray, found: Words, seed: int, factor: int) -> np.ndarray:
    size = found.ends - found.starts
    out = _mix(size.astype(np.uint64) * np.uint64(factor) + np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    now = np.flatnonzero(size <= LANES)
    for done in range(0, LANES, 8):
        now = now[size[now] > done]
        if not len(now):
            break
        left = np.minimum(size[now] - done, 8).astype(np.uint64)
        lane = wide[found.starts[now] + done] << ((8 - left) * np.uint64(8))
        out[now] = _mix((out[now] ^ lane) * np.uint64(factor))
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LANES):
        digest = hashlib.blake2b(data[found.starts[i] : found.ends[i]], digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    """A 64-bit hash for each word, its bytes mixed in eight at a time; different words may share one."""
    return _mixed(data, found, _WORD_BASE, _BASE)


def other_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    """Hashes that have nothing to do with ``word_hashes``."""
    return _mixed(data, found, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25)


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of words."""
    return _spans(hashes, starts, ends, _WORD_BASE)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least one, the rightmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def least(a, b):
        return np.where(values[b] <= values[a], b, a)

    best, reach = np.arange(len(values)), 1
    while reach * 2 <= width:
        best, reach = least(best[:-reach], best[reach:]), reach * 2
    return least(best[:n], best[width - reach : width - reach + n]) if reach < width else best[:n]
