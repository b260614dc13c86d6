"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballstats.llm.tokens import blocks
from ballstats.operators.ranking import free_name

UNDETERMINED = "und"
HIDDEN, SPAN = 8, 64
SAMPLE_TEXTS, SAMPLE_CHARS = 1600, 512
LANES = 2048


class Net(NamedTuple):
    """Weights of both directions and of the layer that labels positions."""

    languages: tuple[str, ...]
    embed: np.ndarray  # direction, byte, (reset gate, update gate, candidate) of each unit
    recur: np.ndarray  # direction, (reset gate, update gate, candidate) of each unit, hidden
    label: np.ndarray  # language, hidden of both directions
    bias: np.ndarray


def _states(net: Net, bytes_at: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (position, hidden of both directions, lane) of byte spans (position, lane).

    Each direction is a layer of gated recurrent units: with u = U h and the byte's row e, the gates are
    r = sigmoid(e_r + u_r) and z = sigmoid(e_z + u_z), the candidate is c = tanh(e_c + r u_c), and
    h += z (c - h).
    """
    length, lanes = bytes_at.shape
    h, kind = net.recur.shape[2], net.recur.dtype
    out = np.empty((length, 2 * h, lanes), kind)
    u = np.empty((3 * h, lanes), kind)
    g = np.empty((lanes, 3 * h), kind)
    gates, c = np.empty((2 * h, lanes), kind), np.empty((h, lanes), kind)
    r, z = gates[:h], gates[h:]
    for way in (0, 1):
        state = np.zeros((h, lanes), kind)
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            np.matmul(net.recur[way], state, out=u)
            np.take(net.embed[way], bytes_at[t], axis=0, out=g, mode="clip")
            np.add(u[: 2 * h], g[:, : 2 * h].T, out=gates)
            gates *= 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            np.multiply(r, u[2 * h :], out=c)
            c += g[:, 2 * h :].T
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((way, t, state.copy(), u[2 * h :].copy(), gates.copy(), c.copy()))
            c -= state
            c *= z
            state += c
            out[t, way * h : way * h + h] = state
    return out


def _probabilities(net: Net, states: np.ndarray) -> np.ndarray:
    """For each position and lane a distribution over the languages (position, language, lane)."""
    scores = np.matmul(net.label, states)
    scores += net.bias[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def train(
    texts: list[bytes],
    labels: list[str],
    hidden: int = HIDDEN,
    span: int = SPAN,
    epochs: int = 12,
    least_steps: int = 500,
    batch: int = 256,
    rate: float = 0.01,
    seed: int = 7,
) -> Net:
    """Fit by backpropagation through time: every position of a span learns its text's language.

    A text is cut into spans as ``pooled`` cuts it, the last one filled with zero bytes that are read
    but not learned from.  Few texts are gone over more often, so that there are ``least_steps`` steps.
    """
    languages = tuple(sorted(set(labels)))
    pieces, truth, held = [], [], []
    for text, label in zip(texts, labels, strict=True):
        for at in range(0, len(text), span):
            part = text[at : at + span]
            pieces.append(part.ljust(span, b"\0"))
            truth.append(languages.index(label))
            held.append(len(part))
    rng, h, n = np.random.default_rng(seed), hidden, len(languages)
    net = Net(
        languages,
        rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
        rng.normal(0, 0.3, (2, 3 * h, h)).astype(np.float32),
        rng.normal(0, 0.3, (n, 2 * h)).astype(np.float32),
        np.zeros(n, np.float32),
    )
    if not pieces or n < 2:
        return net
    data = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, span).T
    target, real = np.array(truth), np.arange(span)[:, None] < np.array(held)
    weights = list(net[1:])
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    each = -(-len(target) // batch)
    epochs = max(epochs, -(-least_steps // each))
    total = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            slopes = _gradient(net, np.ascontiguousarray(data[:, pick]), target[pick], real[:, pick])
            step += 1
            now = rate * (1 - step / (total + 1))
            for w, m, v, s in zip(weights, first, second, slopes, strict=True):
                m += 0.1 * (s - m)
                v += 0.01 * (s * s - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def _gradient(net: Net, bytes_at: np.ndarray, target: np.ndarray, real: np.ndarray | None = None) -> list[np.ndarray]:
    """Slopes of the mean loss over the positions that ``real`` marks (all without it)."""
    length, lanes = bytes_at.shape
    h, trail = net.recur.shape[2], []
    states = _states(net, bytes_at, trail)
    d_scores = _probabilities(net, states)
    d_scores[:, target, np.arange(lanes)] -= 1
    if real is None:
        d_scores /= length * lanes
    else:
        d_scores *= real[:, None, :]
        d_scores /= real.sum()
    d_label = np.einsum("tnl,thl->nh", d_scores, states, optimize=True)
    d_states = np.matmul(net.label.T, d_scores)
    d_embed, d_recur = np.zeros_like(net.embed), np.zeros_like(net.recur)
    d_inner = np.empty((2, 3 * h, length, lanes), net.recur.dtype)
    carry, last = None, None
    for way, t, state, u, gates, c in reversed(trail):
        if way != last:
            carry, last = np.zeros((h, lanes), net.recur.dtype), way
        d = d_states[t, way * h : way * h + h] + carry
        r, z = gates[:h], gates[h:]
        d_c = d * z * (1 - c * c)
        d_r, d_z = d_c * u * r * (1 - r), d * (c - state) * z * (1 - z)
        d_inner[way, :, t] = np.concatenate((d_r, d_z, d_c))
        d_u = np.concatenate((d_r, d_z, d_c * r))
        d_recur[way] += d_u @ state.T
        carry = d * (1 - z) + net.recur[way].T @ d_u
    flat = bytes_at.ravel()
    for way in (0, 1):
        for unit in range(3 * h):
            d_embed[way, :, unit] = np.bincount(flat, d_inner[way, unit].ravel(), 256)
    return [d_embed, d_recur, d_label, d_scores.sum(axis=(0, 2))]


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Mean over all of a row's positions of their language distributions (row, language).

    A row is cut into spans, each read in both directions; the last is filled with zero bytes,
    which are read but not counted.
    """
    sizes = np.diff(offsets)
    parts = -(-sizes // span)
    owner = np.repeat(np.arange(len(sizes)), parts)
    begin = offsets[:-1][owner] + span * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    held = np.minimum(span, offsets[1:][owner] - begin)
    out = np.zeros((len(sizes), len(net.languages)))
    padded = np.concatenate((data, np.zeros(span, np.uint8)))
    steps = np.arange(span)
    lanes = max(16, min(LANES, LANES * 128 // max(len(net.languages), 1)))  # a block of bounded size, whatever their number
    for at in range(0, len(owner), lanes):
        part = slice(at, at + lanes)
        bytes_at = padded[begin[part][None, :] + steps[:, None]]
        real = steps[:, None] < held[part][None, :]
        bytes_at = np.where(real, bytes_at, 0)
        shares = _probabilities(net, _states(net, bytes_at))
        if not real.all():
            shares *= real[:, None, :]
        sums = shares.sum(axis=0)
        first, last = owner[at], owner[part][-1] + 1
        for n in range(len(net.languages)):
            out[first:last, n] += np.bincount(owner[part] - first, sums[n], last - first)
    return out / np.maximum(sizes, 1)[:, None]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_texts: int = SAMPLE_TEXTS) -> Net:
    """Train on a bounded sample: ``sample_texts`` pieces of ``SAMPLE_CHARS`` characters, shared evenly by the languages.

    Of each language the rows with the least key hashes below a bound are taken, each with a piece
    from a place that its hash chooses, one at least.  Every value of the column is learned, however
    many there are; only the sample and one count a language reach the driver.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    counts = rows.groupBy(F.col(lang).cast("string").alias("lang")).count().collect()
    if not counts:
        return train([], [])
    each = max(1, sample_texts // len(counts))
    # about twice as many rows as are wanted, so that ranking them is little work whatever the table's size
    limits = [(r[0], int(min(1.0, 2 * each / r[1] if each > 4 else 32 / r[1]) * (1 << 40))) for r in counts]
    limit = docs.sparkSession.createDataFrame(limits, "lang string, limit bigint")
    order = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    start = F.pmod(order, F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1)).cast("long")).cast("int") + 1
    chosen = rows.select(
        F.col(lang).cast("string").alias("lang"), order.alias("order"), F.substring(F.col(text), start, F.lit(SAMPLE_CHARS)).alias("piece")
    )
    chosen = chosen.join(F.broadcast(limit), "lang")  # as many rows as the driver has just held
    chosen = chosen.filter(F.pmod("order", F.lit(1 << 40)) < F.col("limit")).drop("limit")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "piece"))
    sample = chosen.withColumn("rank", rank).filter(F.col("rank") <= each)
    got = sample.orderBy("lang", "rank").collect()
    return train([r.piece.encode() for r in got], [r.lang for r in got])


def with_language(
    docs: DataFrame, net: Net, text: str = "text", keep: tuple[str, ...] | None = None, lang: str = "_lang", score: str = "_score"
) -> DataFrame:
    """The rows with the language found and its probability added under the given names; ``keep`` names the columns to hand on."""
    names = list(keep if keep is not None else docs.columns)
    given, spelled = (free_name([*names, lang, score], x) for x in ("_bytes", "_letters"))
    read = docs.select(
        *[F.col(f"`{c}`") for c in names],
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(given),
        F.coalesce(has_letter(F.col(text)), F.lit(False)).alias(spelled),
    )

    def run(batches):
        for batch in batches:
            letters = batch.column(spelled).to_numpy(zero_copy_only=False)
            best, sure = np.zeros(len(letters), np.int64), np.zeros(len(letters))
            for block in blocks(batch.column(given)) if net.languages else ():
                shares = pooled(net, block.data, block.offsets)
                rows = slice(block.first, block.first + len(shares))
                best[rows], sure[rows] = shares.argmax(axis=1), shares.max(axis=1)
            known = letters & bool(net.languages)
            found = [net.languages[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found, pa.string()), pa.array(np.where(known, np.clip(sure, 0, 1), 0.0))],
                [*names, lang, score],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return read.mapInArrow(run, f"{schema}, `{lang}` string, `{score}` double")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept for testing; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """For each row: doc_id, held_out, lang_pred and score, the pooled probability of that language.

    The network learns from rows with an id that is not held out, a text and a language; the
    prediction sees only the whole text.  A null text or one without a letter is ``und`` with
    score 0, and so is every text if there is nothing to learn from.  Ties go to the language
    first in name order.  Repeated rows each get their row; an empty table gives none; other
    columns are not read.
    """
    net = fit(docs.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))), text, lang, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = with_language(rows, net, keep=("doc_id",))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


def drop_undetermined(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.3
) -> DataFrame:
    """The rows whose language is found with at least ``min_score``, with their columns.

    Texts that are null or empty or have no letter go.  Rows that repeat others share their fate and stay as
    often as they came; a text between two languages stays if the likelier reaches ``min_score``.  With
    nothing to learn from every row goes; an empty table stays empty.  Extra columns are handed on, whatever their names.
    """
    net = fit(docs.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))), text, lang, doc_id)
    one = free_name(docs.columns, "_lang")
    two = free_name([*docs.columns, one], "_score")
    found = with_language(docs, net, text, lang=one, score=two)
    certain = (F.col(one) != UNDETERMINED) & (F.col(two) >= min_score)
    return found.filter(certain).select(*[f"`{c}`" for c in docs.columns])
