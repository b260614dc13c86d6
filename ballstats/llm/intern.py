"""Interning byte spans by an open-addressed table in numpy: equal spans get one number."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SHORT = 64  # spans up to here are compared eight bytes at a time, for all spans at once


class Interned(NamedTuple):
    """``slots``: each span's slot number from 0; ``firsts``: for each slot one of its spans; ``counts``: its spans."""

    slots: np.ndarray
    firsts: np.ndarray
    counts: np.ndarray


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The XXH64 of each span."""
    from xxhash import xxh64_intdigest

    raw = data.tobytes()
    return np.fromiter((xxh64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether span ``one[i]`` holds the bytes of span ``two[i]``."""
    size = ends[one] - starts[one]
    same = size == ends[two] - starts[two]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    short = np.flatnonzero(same & (size <= SHORT) & (one != two))
    for done in range(0, SHORT, 8):
        short = short[size[short] > done]
        if not len(short):
            break
        left = np.minimum(size[short] - done, 8).astype(np.uint64)
        differs = (wide[starts[one[short]] + done] ^ wide[starts[two[short]] + done]) << ((8 - left) * np.uint64(8))
        same[short[differs != 0]] = False
        short = short[differs == 0]
    for i in np.flatnonzero(same & (size > SHORT) & (one != two)):
        a, b, n = starts[one[i]], starts[two[i]], size[i]
        same[i] = np.array_equal(data[a : a + n], data[b : b + n])
    return same


def intern(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None) -> Interned:
    """Number the spans; those of one key are told apart by their bytes.

    Every span probes the table from its key's slot on: it claims an empty slot, stays with a slot
    whose owner has its key and bytes, and else goes on to the next.  The table is at most half full.
    """
    if keys is None:
        keys = span_keys(data, starts, ends)
    n = len(starts)
    mask = (1 << max(4, (2 * n).bit_length())) - 1
    owner = np.full(mask + 1, -1, np.int64)
    slot = (keys & np.uint64(mask)).astype(np.int64)
    waiting = np.arange(n)
    while len(waiting):
        at = slot[waiting]
        free = owner[at] < 0
        owner[at[free]] = waiting[free]  # of several claims the last holds
        held = owner[at]
        found = keys[held] == keys[waiting]
        found[found] = same_bytes(data, starts, ends, held[found], waiting[found])
        waiting = waiting[~found]
        slot[waiting] = (slot[waiting] + 1) & mask
    used = np.flatnonzero(owner >= 0)
    dense = np.empty(mask + 1, np.int64)
    dense[used] = np.arange(len(used))
    slots = dense[slot]
    return Interned(slots, owner[used], np.bincount(slots, minlength=len(used)))
