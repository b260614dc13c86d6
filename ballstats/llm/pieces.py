"""N best segmentations into the pieces of a SentencePiece vocabulary, and back."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from sys import getsizeof
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.llm.tokens import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
MEMO_BYTES, MEMO_LENGTH = 256 << 20, 64  # bytes of remembered segments, and the longest that is remembered
ENTRY_BYTES = 400  # what an entry of the memo takes besides its text and ids
BLOCK_BYTES = 4 << 20  # text written at a time
LONG, LONG_ARCS = 4096, 1 << 20  # longer segments are solved by themselves, and their arcs found so many at a time
SPACE = "▁"
LITERAL = "\ud800"  # stands for a ``▁`` of the text: a lone surrogate, which no text holds


class Vocabulary(NamedTuple):
    """Pieces by their text (a space is ``▁``) with their ids and scores."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    byte_score: float
    texts: list[bytes]
    longest: int


def load(model: str = MODEL) -> Vocabulary:
    """Read a model with byte pieces; a character without a piece costs ten more than the worst piece."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    ids, scores, byte_ids, texts = {}, {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append(b"")
        else:
            ids[piece], scores[piece] = i, sp.get_score(i)
            texts.append(piece.replace(SPACE, " ").encode())
    if any(SPACE in piece.lstrip(SPACE) for piece in ids):
        raise ValueError("a piece with a space inside: segments would not be independent")
    worst = min(scores.values(), default=0.0)
    return Vocabulary(ids, scores, byte_ids, worst - 10, texts, max(map(len, ids), default=1))


def _raw(character: str) -> bytes:
    return (" " if character == SPACE else SPACE if character == LITERAL else character).encode()


def n_best(segment: str, vocabulary: Vocabulary, n: int = N_BEST) -> list[tuple[float, list[int]]]:
    """The n best ways to write a segment as pieces, best first, with their scores.

    ``segment`` has ``▁`` for spaces and ``LITERAL`` for a literal ``▁``, which only bytes can write.
    The forward Viterbi pass gives the best score from the start to every place; an A* search from
    the end then extends the path of highest score so far plus that best remainder.  The
    remainder is exact, so paths are completed in the order of their scores, and every open path
    stands for one complete path of just its value: as many open ones as are still wanted are
    enough.  Arcs are found where a path is extended, so a segment of any length takes eight bytes a
    place and the paths themselves.
    """
    size, longest, scores = len(segment), vocabulary.longest, vocabulary.scores
    best = array("d", [-np.inf]) * (size + 1)
    best[0] = 0.0
    for at in range(size):
        here = best[at]
        for end in range(at + 1, min(size, at + longest) + 1):
            score = scores.get(segment[at:end])
            if score is None:
                if end > at + 1:
                    continue
                score = vocabulary.byte_score
            if here + score > best[end]:
                best[end] = here + score
    found: list[tuple[float, list[int]]] = []
    turn = 0
    open_paths: list[tuple] = [(-best[size], 0, size, 0.0, None)]
    while open_paths and len(found) < n:
        _, _, at, score, tail = heapq.heappop(open_paths)
        if at == 0:
            ids: list[int] = []
            while tail is not None:
                ids.extend(tail[0])
                tail = tail[1]
            found.append((score, ids))
            continue
        for before in range(max(0, at - longest), at):
            piece = segment[before:at]
            known = vocabulary.ids.get(piece)
            if known is not None:
                gain, own = scores[piece], (known,)
            elif before == at - 1:
                gain, own = vocabulary.byte_score, tuple(vocabulary.byte_ids[b] for b in _raw(piece))
            else:
                continue
            turn += 1
            heapq.heappush(open_paths, (-(score + gain + best[before]), turn, before, score + gain, (own, tail)))
        if len(open_paths) > n - len(found):
            open_paths = heapq.nsmallest(n - len(found), open_paths)  # sorted, and so a heap
    return found


def combine(options: list[list[tuple[float, list[int]]]], n: int = N_BEST) -> list[tuple[float, dict[int, int]]]:
    """The n best choices of one option for each segment: score, and the segments that don't take their first.

    Options are listed best first.  Only the n - 1 segments with the least loss of a second option
    can differ from their first one in any of the n best, so only those are searched: a choice
    is extended by the next option of a later segment, least loss first.
    """
    base = sum(o[0][0] for o in options)
    losses = [(o[0][0] - o[1][0], i) for i, o in enumerate(options) if len(o) > 1]
    open_to = [i for _, i in heapq.nsmallest(max(0, n - 1), losses)]
    found = []
    queue: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    while queue and len(found) < n:
        loss, changes = heapq.heappop(queue)
        found.append((base - loss, dict(changes)))
        last = changes[-1][0] if changes else -1
        for rank, i in enumerate(open_to):
            if rank > last:
                heapq.heappush(queue, (loss + options[i][0][0] - options[i][1][0], (*changes, (rank, 1))))
        if changes:
            rank, option = changes[-1]
            o = options[open_to[rank]]
            if option + 1 < len(o):
                heapq.heappush(queue, (loss + o[option][0] - o[option + 1][0], (*changes[:-1], (rank, option + 1))))
    return [(score, {open_to[rank]: option for rank, option in changes.items()}) for score, changes in found]


_SEGMENT = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")


def segments(text: str) -> list[str]:
    """Parts that no piece reaches over: spaces with the word after them, and line ends."""
    return _SEGMENT.findall((SPACE if text else "") + text.replace(SPACE, LITERAL).replace(" ", SPACE))


class Solved(NamedTuple):
    """Of some segments the best ids (as bytes of int32), their score, and what the second best path loses (inf: none)."""

    ids: list[bytes]
    scores: np.ndarray
    losses: np.ndarray


class Viterbi:
    """Best paths of many segments at once, those of one length side by side in arrays."""

    BASE, SIDE = 0x9E3779B97F4A7C15, 16
    MIXERS = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.powers = np.array([pow(self.BASE, i, 1 << 64) for i in range(vocabulary.longest + 1)], np.uint64)
        pieces = list(vocabulary.ids)
        self.keys = np.array([*map(self._hash, pieces), 0], np.uint64)
        self.ids = np.array([*vocabulary.ids.values(), -1], np.int64)
        self.scores = np.array([*vocabulary.scores.values(), -np.inf])
        self.tables = np.full((2, 1 << self.SIDE), len(pieces), np.int32)
        places = np.stack([self._slots(self.keys, way) for way in (0, 1)])
        for start in range(len(pieces)):  # each key has one place in either table; the newcomer sends the old one to its other
            i, way = start, 0
            for _ in range(1000):
                place = places[way, i]
                self.tables[way, place], i = i, int(self.tables[way, place])
                if i == len(pieces):
                    break
                way = 1 - way
            else:
                raise ValueError("the piece tables are too small")

    def _hash(self, piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * self.BASE + ord(c) + 1) & ((1 << 64) - 1)
        return out

    def _slots(self, keys: np.ndarray, way: int) -> np.ndarray:
        return ((keys * np.uint64(self.MIXERS[way])) >> np.uint64(64 - self.SIDE)).view(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; of one that is no piece's, the last."""
        one, two = (self.tables[way].take(self._slots(keys, way)) for way in (0, 1))
        two[self.keys.take(two) != keys] = len(self.keys) - 1
        return np.where(self.keys.take(one) == keys, one, two).astype(np.int64)

    def solve(self, found: list[str]) -> Solved:
        out: list[bytes] = [b""] * len(found)
        scores, losses = np.zeros(len(found)), np.zeros(len(found))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        order = np.argsort(sizes, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if not len(rows):
                continue
            size = int(sizes[rows[0]])
            if size > LONG:
                for i in rows.tolist():
                    out[i], scores[i], losses[i] = self._solve_long(found[i])
                continue
            step = max(1, (1 << 18) // (size * min(size, self.vocabulary.longest)))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                ids, scores[part], losses[part] = self._solve([found[i] for i in part.tolist()], size)
                for i, x in zip(part.tolist(), ids, strict=True):
                    out[i] = x
        return Solved(out, scores, losses)

    def _solve(self, found: list[str], size: int) -> Solved:
        n, longest = len(found), self.vocabulary.longest
        codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T
        sums = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            sums[j + 1] = sums[j] * np.uint64(self.BASE) + (codes[j].astype(np.uint64) + np.uint64(1))
        fore, back = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        fore[0] = back[size] = 0
        chosen = np.zeros((size + 1, n), np.int64)  # the arc that fore comes by: its piece's place, and its length
        bits, arcs = longest.bit_length(), {}
        for j in range(1, size + 1):
            for length in range(1, min(j, longest) + 1):
                place = self._find(sums[j] - sums[j - length] * self.powers[length])
                score = self.scores[place]
                if length == 1:
                    score[place == len(self.keys) - 1] = self.vocabulary.byte_score
                arcs[j, length] = score
                total = fore[j - length] + score
                better = total > fore[j]
                np.copyto(fore[j], total, where=better)
                np.copyto(chosen[j], place << bits | length, where=better)
        came, piece = chosen & ((1 << bits) - 1), chosen >> bits
        for (j, length), score in reversed(arcs.items()):
            np.maximum(back[j - length], back[j] + score, out=back[j - length])
        on_path = np.zeros((size + 1, n), bool)
        at, lanes = np.full(n, size), np.arange(n)
        while (live := at > 0).any():
            on_path[at[live], lanes[live]] = True
            at = np.where(live, at - came[at, lanes], 0)
        second = np.full(n, -np.inf)
        for (j, length), score in arcs.items():
            other = fore[j - length] + score + back[j]
            other[on_path[j] & (came[j] == length)] = -np.inf
            np.maximum(second, other, out=second)
        lane, place = np.nonzero(on_path.T)
        ids = self.ids[piece[place, lane]].astype(np.int32)
        bounds = np.searchsorted(lane, np.arange(n + 1))
        flat, ends = ids.tobytes(), (bounds * 4).tolist()
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for k in np.unique(lane[ids < 0]).tolist():
            own = []
            for p, end in zip(ids[bounds[k] : bounds[k + 1]].tolist(), place[bounds[k] : bounds[k + 1]].tolist(), strict=True):
                own += [p] if p >= 0 else [self.vocabulary.byte_ids[c] for c in _raw(found[k][end - 1])]
            out[k] = np.array(own, np.int32).tobytes()
        return Solved(out, fore[size], fore[size] - second)


    def _arcs(self, sums: np.ndarray, first: int, stop: int):
        """End, length, score and id of the arcs that end at first + 1 to stop, by end and then length."""
        longest = self.vocabulary.longest
        score, ids = np.full((stop - first, longest), -np.inf), np.full((stop - first, longest), -1, np.int64)
        for length in range(1, longest + 1):
            ends = np.arange(max(first + 1, length), stop + 1)
            place = self._find(sums[ends] - sums[ends - length] * self.powers[length])
            score[ends - first - 1, length - 1], ids[ends - first - 1, length - 1] = self.scores[place], self.ids[place]
        score[:, 0][ids[:, 0] < 0] = self.vocabulary.byte_score
        row, column = np.nonzero(score > -np.inf)
        return row + first + 1, column + 1, score[row, column], ids[row, column]

    def _solve_long(self, segment: str) -> tuple[bytes, float, float]:
        """As ``_solve`` for one long segment: a few numbers a place; arcs are found again, some places at a time."""
        size = len(segment)
        codes, total, sums = segment.encode("utf-32-le", "surrogatepass"), 0, array("Q", [0])
        for code in np.frombuffer(codes, np.uint32).tolist():
            total = (total * self.BASE + code + 1) & ((1 << 64) - 1)
            sums.append(total)
        sums = np.frombuffer(sums, np.uint64)
        step = max(1, LONG_ARCS // self.vocabulary.longest)
        parts = [(a, min(a + step, size)) for a in range(0, size, step)]
        fore, back = (array("d", [-np.inf]) * (size + 1) for _ in range(2))
        fore[0] = back[size] = 0.0
        came, piece = array("i", [0]) * (size + 1), array("i", [0]) * (size + 1)
        for part in parts:
            for j, length, score, known in zip(*(x.tolist() for x in self._arcs(sums, *part)), strict=True):
                if fore[j - length] + score > fore[j]:
                    fore[j], came[j], piece[j] = fore[j - length] + score, length, known
        for part in reversed(parts):
            ends, lengths, scores, _ = (x[::-1].tolist() for x in self._arcs(sums, *part))
            for j, length, score in zip(ends, lengths, scores, strict=True):
                if back[j] + score > back[j - length]:
                    back[j - length] = back[j] + score
        taken, own, at = np.zeros(size + 1, np.int64), array("i"), size
        while at:
            taken[at] = came[at]
            if piece[at] >= 0:
                own.append(piece[at])
            else:
                own.extend([self.vocabulary.byte_ids[c] for c in reversed(_raw(segment[at - 1]))])
            at -= came[at]
        second, before, after = -np.inf, np.frombuffer(fore), np.frombuffer(back)
        for part in parts:
            ends, lengths, scores, _ = self._arcs(sums, *part)
            other = (before[ends - lengths] + scores + after[ends])[taken[ends] != lengths]
            second = max(second, float(other.max(initial=-np.inf)))
        return np.array(own[::-1], np.int32).tobytes(), fore[size], fore[size] - second


class Encoded(NamedTuple):
    """Some texts as pieces: all their ids, the bounds of each text's in them, scores of the n best, and edits.

    An edit says what differs in the second best and later ones: (rank, first place, places, ids put there instead).
    """

    ids: np.ndarray
    bounds: np.ndarray
    scores: list[list[float]]
    edits: list[list[tuple[int, int, int, list[int]]]]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of consecutive runs, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Encoder:
    """Writes texts as pieces; it remembers segments of ordinary length, as many as fit in ``MEMO_BYTES``."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST):
        self.vocabulary, self.n, self.viterbi = vocabulary, n, Viterbi(vocabulary)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.scores, self.losses = np.zeros(0), np.zeros(0)
        self.lists: dict[str, list] = {}
        self.held = 0

    def learn(self, new: list[str]) -> None:
        ids, scores, losses = self.viterbi.solve(new)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        flat = b"".join(ids)
        self.ids = np.concatenate((self.ids, np.frombuffer(flat, np.int32)))
        self.sizes = np.concatenate((self.sizes, np.fromiter((len(x) // 4 for x in ids), np.int64, len(new))))
        self.scores, self.losses = np.concatenate((self.scores, scores)), np.concatenate((self.losses, losses))
        self.held += len(flat) + sum(map(getsizeof, new)) + ENTRY_BYTES * len(new)

    def leave(self, kept: int) -> None:
        """Forget the segments that were learned last and are too long to be met again."""
        for segment in list(self.index)[kept:]:
            del self.index[segment]
            self.lists.pop(segment, None)
        self.ids, self.sizes = self.ids[: int(self.sizes[:kept].sum())], self.sizes[:kept]
        self.scores, self.losses = self.scores[:kept], self.losses[:kept]

    def options(self, segment: str) -> list[tuple[float, list[int]]]:
        """The n best of a segment; of equal scores the one already chosen comes first."""
        have = self.lists.get(segment)
        if have is None:
            own = self.index[segment]
            first = int(self.sizes[:own].sum())
            best = self.ids[first : first + int(self.sizes[own])].tolist()
            have = n_best(segment, self.vocabulary, self.n)
            same = next((i for i, o in enumerate(have) if o[1] == best), len(have) - 1)
            have = [(float(self.scores[own]), best), *have[:same], *have[same + 1 :]]
            self.lists[segment] = have
            if len(segment) <= MEMO_LENGTH:
                self.held += sum(ENTRY_BYTES + 36 * len(ids) for _, ids in have)
        return have

    def __call__(self, texts: list[str]) -> Encoded:
        parts = [segments(t) for t in texts]
        found = list(chain.from_iterable(parts))
        new = set(found).difference(self.index)
        long = [s for s in new if len(s) > MEMO_LENGTH]
        self.learn(list(new.difference(long)))
        kept, held = len(self.index), self.held
        if long:
            self.learn(long)
            self.held = held
        out = self._finish(found, np.fromiter(map(len, parts), np.int64, len(parts)))
        if long:
            self.leave(kept)
        if self.held > MEMO_BYTES:
            self.forget()
        return out

    def _finish(self, found: list[str], counts: np.ndarray) -> Encoded:
        """Put the segments of each text together; ``counts`` says how many are whose."""
        own = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        text = np.repeat(np.arange(len(counts)), counts)
        sizes, losses, scores = self.sizes[own], self.losses[own], self.scores[own]
        ids = self.ids[_spans((np.cumsum(self.sizes) - self.sizes)[own], sizes)]
        place = np.concatenate(([0], np.cumsum(sizes)))
        bounds = place[np.concatenate(([0], np.cumsum(counts)))]
        total = np.bincount(text, scores, len(counts))
        able = np.flatnonzero(losses < np.inf)
        able = able[np.lexsort((losses[able], text[able]))]  # of each text, and of equals, the first first
        begins = np.searchsorted(text[able], np.arange(len(counts) + 1))
        all_scores, all_edits = [], []
        for i in range(len(counts)):
            chosen = sorted(able[begins[i] : min(begins[i] + self.n - 1, begins[i + 1])].tolist())
            ranked = combine([self.options(found[k]) for k in chosen], self.n)
            base = total[i] - scores[chosen].sum()
            edits = []
            for rank, (_, change) in enumerate(ranked[1:], 2):
                for k, option in sorted(change.items()):
                    at = chosen[k]
                    edits.append((rank, int(place[at] - bounds[i]), int(sizes[at]), self.options(found[at])[option][1]))
            all_scores.append([float(base + score) for score, _ in ranked])
            all_edits.append(edits)
        return Encoded(ids, bounds, all_scores, all_edits)


class Decoder:
    """Bytes of many ids at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.sizes = np.array([len(x) for x in vocabulary.texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(vocabulary.texts), np.uint8)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """The text that each run of ids stands for; the first piece's leading space was added by the encoder."""
        sizes = self.sizes[ids]
        data = self.data[_spans(self.starts[ids], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[bounds].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield data[a + 1 : b]


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text that was encoded; the first piece's leading space was added by the encoder."""
    return b"".join([vocabulary.texts[i] for i in ids]).decode()[1:]


_ENCODED = "ids array<int>, scores array<double>, edits array<struct<rank:int,at:int,removed:int,ids:array<int>>>"
_EDIT = pa.struct([("rank", pa.int32()), ("at", pa.int32()), ("removed", pa.int32()), ("ids", pa.list_(pa.int32()))])


def _lists(sizes, values: pa.Array) -> pa.ListArray:
    """Consecutive values as lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _edits(found: list[tuple]) -> pa.StructArray:
    rank, at, removed, ids = zip(*found, strict=True) if found else ((), (), (), ())
    flat = _lists([len(x) for x in ids], pa.array([i for x in ids for i in x], pa.int32()))
    return pa.StructArray.from_arrays([*(pa.array(x, pa.int32()) for x in (rank, at, removed)), flat], fields=[*_EDIT])


def encode(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, n: int = N_BEST
) -> DataFrame:
    """For each row: doc_id, n_pieces, ids, scores, edits, decoded_sha256.

    ``ids`` is the best segmentation of the whole text, ``scores`` the scores of the ``n`` best (fewer
    if there are fewer), ``edits`` how ranks 2 on differ from it, and ``decoded_sha256`` the digest of
    the text that ``ids`` decode to.  Decoding gives back every text exactly: what no piece can
    write goes in bytes.  Null and empty texts have no ids and one score of 0.  Between equal
    scores the order is fixed for a given text.  Repeated rows each get their row; an empty
    table gives none; other columns are not read.  ``model`` is a path on every machine.
    """

    def run(batches):
        import hashlib

        vocabulary = load(model)
        write, read = Encoder(vocabulary, n), Decoder(vocabulary)
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                data, offsets = block.data.tobytes(), block.offsets.tolist()
                out = write([data[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                digests = [hashlib.sha256(x).hexdigest() for x in read(out.ids, out.bounds)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, len(digests)),
                        pa.array(np.diff(out.bounds)),
                        _lists(np.diff(out.bounds), pa.array(out.ids)),
                        _lists([len(x) for x in out.scores], pa.array([y for x in out.scores for y in x], pa.float64())),
                        _lists([len(x) for x in out.edits], _edits([e for x in out.edits for e in x])),
                        pa.array(digests, pa.string()),
                    ],
                    ["doc_id", "n_pieces", "ids", "scores", "edits", "decoded_sha256"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces bigint, {_ENCODED}, decoded_sha256 string")


def decode_ids(rows: DataFrame, ids: str = "ids", model: str = MODEL, name: str = "decoded") -> DataFrame:
    """The rows with their decoded text added under ``name``, which must be free.

    A null list gives a null text, an empty one an empty text; repeated rows each get theirs.
    """
    names = rows.columns
    if name.lower() in (c.lower() for c in names):
        raise ValueError(f"there is a column {name!r} already; choose another name")

    def run(batches):
        vocabulary = load(model)
        for batch in batches:
            texts = [None if x is None else decode(x, vocabulary) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{name}` string")
