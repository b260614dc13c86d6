"""SimHash with covering masks, components, winnowing and repeated phrases, against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from fixtures_llm import docs  # noqa: F401
import xxhash

from ballstats.llm import graph, phrases, simhash, winnow
from ballstats.llm.tokens import ALNUM, SPACES, Block, _spans, blocks, sequence_hashes, window_minima, word_hashes, words


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def test_words_and_hashes():
    import pyarrow as pa

    texts = [b"", b"a bb\tccc", b"x", b" \n ", b"bb ccc a", b"no\x0bgap"]
    for block in blocks(pa.array(texts, pa.binary()), 6):
        assert isinstance(block, Block)
        found = words(block.data, block.offsets, SPACES)
        data = block.data.tobytes()
        for i in range(len(block.offsets) - 1):
            own = slice(found.rows[i], found.rows[i + 1])
            cut = [data[a:b] for a, b in zip(found.starts[own], found.ends[own], strict=True)]
            assert cut == texts[block.first + i].split()
    data = np.frombuffer(b"one two one two one", np.uint8)
    found = words(data, np.array([0, len(data)]), ALNUM)
    h = word_hashes(data, found)
    assert h[0] == h[2] == h[4] and h[0] != h[1]
    pairs = sequence_hashes(h, np.arange(4), np.arange(4) + 2)
    assert pairs[0] == pairs[2] and pairs[0] != pairs[1]


@pytest.mark.parametrize("part", [1, 7, 64, 300])
def test_hashes_do_not_depend_on_the_part(part):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 256, 300).astype(np.uint8)
    starts = rng.integers(0, 300, 500)
    ends = starts + rng.integers(0, 301 - starts)
    want = _spans(values, starts, ends, 0x9E3779B97F4A7C15)
    assert (_spans(values, starts, ends, 0x9E3779B97F4A7C15, part) == want).all()
    again = _spans(np.concatenate((values[:9], values)), starts + 9, ends + 9, 0x9E3779B97F4A7C15, part)
    assert (again == want).all()


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 39])
def test_window_minima(width):
    values = np.random.default_rng(3).integers(0, 9, 80).astype(np.uint64)
    want = [max(range(i, i + width), key=lambda j: (-int(values[j]), j)) for i in range(80 - width + 1)]
    assert window_minima(values, width).tolist() == want


def test_masks_cover_every_pair_of_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.cover_masks(4)]
    assert len(masks) == 31
    rng = random.Random(5)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & m == 0 for m in masks)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(100, i) for i in range(101, 140)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}


def simple_print(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    grams = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("bucket", [128, 1])
def test_near_duplicates(docs, bucket):
    rng, vocab = random.Random(4), vocabulary(300)
    base = [" ".join(rng.choice(vocab) for _ in range(200)) for _ in range(6)]
    rows = []
    for i in range(60):
        found = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            found[rng.randrange(len(found))] = rng.choice(vocab)
        rows.append((1000 - i, " ".join(found)))
    rows += [(7, None), (3, ""), (9, " \n"), (8, "one two"), (8, "one two"), (2, "ONE two"), (None, "one two"), (None, "lonely é"), (5, "w " * 60_000)]
    got = simhash.near_duplicates(docs(rows), bucket=bucket).collect()
    prints = [simple_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[i] = label[j] = min(label[i], label[j])
    want = []
    for (i, _), p, at in zip(rows, prints, label, strict=True):
        ids = [r[0] for r, b in zip(rows, label, strict=True) if b == at and r[0] is not None]
        want.append((i, f"{p:016x}", min(ids, default=None)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in got)


def test_near_duplicates_of_nothing(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    df = docs([(1, "a b c d e"), (2, "a b c d e"), (3, "x")])
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.createDataFrame([(1,)], "print bigint"), 3)


def item_words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(rows, items):
    out = []
    for i, t in rows:
        found, hit, names = item_words(t), set(), set()
        for item, u in items:
            own = item_words(u)
            n = min(10, len(own))
            grams = {tuple(own[p : p + n]) for p in range(len(own) - n + 1)} if n else set()
            for p in range(len(found) - n + 1 if n else 0):
                if tuple(found[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    names.add("" if item is None else str(item))
        listed = ",".join(sorted(names))
        out.append((i, len(found), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark, docs):
    rng, vocab = random.Random(8), vocabulary(40)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 25, 60]))) for i in range(25)]
    items += [(30, "Tiny"), (31, "two words"), (32, ""), (33, None), (None, text(12)), (3, items[3][1]), (34, "é ü 9a")]
    rows = [(i, text(80)) for i in range(10)]
    for i in range(10, 50):
        own = items[rng.randrange(25)][1].split()
        a = rng.randrange(max(1, len(own) - 8))
        rows.append((i, f"{text(20)}, {'  '.join(own[a:]).upper()}! {text(rng.randrange(30))}"))
    rows += [(60, None), (61, ""), (62, "tiny"), (63, "x two-Words y É ü 9A"), (63, "tiny"), (None, items[0][1]), (64, items[1][1] * 50)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r)[:6] for r in winnow.contamination(docs(rows), bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_contamination(rows, items)))
    assert winnow.contamination(docs([]), bench).count() == 0
    assert not any(r.contaminated for r in winnow.contamination(docs(rows), bench.limit(0)).collect())
    clean = winnow.drop_contaminated(docs(rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in brute_contamination(rows, items) if not r[5])


def brute_repeats(rows, window):
    starts = {}
    for i, t in rows:
        found = (t or "").encode().split()
        for p in range(len(found) - window + 1):
            if i is not None:
                key = tuple(found[p : p + window])
                starts[key] = min(starts.get(key, i), i)
    out = []
    for i, t in rows:
        found, hit = (t or "").encode().split(), set()
        for p in range(len(found) - window + 1):
            if i is not None and starts[tuple(found[p : p + window])] < i:
                hit.update(range(p, p + window))
        kept = b" ".join(w for p, w in enumerate(found) if p not in hit)
        out.append((i, len(found), len(hit), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_phrases(docs):
    rng, vocab = random.Random(6), vocabulary(400)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(rng.randint(9, 40)) for _ in range(6)]
    rows = []
    for i in range(70):
        own = text(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            own += p[a:] + text(rng.randint(0, 6))
        rows.append((rng.randrange(60), " ".join(own)))
    rows += [(90, rows[3][1]), (91, rows[3][1].replace(" ", "\n")), (None, rows[4][1]), (92, None), (93, ""), (94, "x " * 30_000), (95, "x " * 30_000), (94, "x " * 30_000)]
    got = [tuple(r) for r in phrases.repeated_phrases(docs(rows), window=10, gram=3, shard_stretches=5).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows, 10)))


def test_repeated_rows_with_a_partly_shared_passage(docs):
    rng, vocab = random.Random(11), vocabulary(400, 2)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = text(60)
    one, two = f"{text(20)} {shared} {text(20)}", f"{text(25)} {shared} {text(15)}"
    rows = [(1, one), (2, two), (2, two), (2, two), (3, f"{text(5)} {shared}"), (3, f"{text(5)} {shared}"), (1, one)]
    got = [tuple(r) for r in phrases.repeated_phrases(docs(rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows, 50)))
    assert {r[2] for r in got if r[0] == 2} == {60}


def test_a_hot_phrase_is_divided_by_window(spark):
    rows = [(2 * g + k, 2 * g + k, 1, 0, "w", [g]) for g in range(300) for k in (0, 1)]
    kinds = "rid bigint, doc_id bigint, phrase bigint, first bigint, context string, windows array<bigint>"
    patterns, streams = phrases._dealt(spark.createDataFrame(rows, kinds), 20)
    assert streams.count() == 300 and patterns.count() <= 900  # not 300 for each of 15 shards
    assert max(r["count"] for r in patterns.groupBy("part").count().collect()) <= 50
    one = [(i, i, 1, 0, "w", [7]) for i in range(300)]  # one window with many readers still takes many shards
    patterns, streams = phrases._dealt(spark.createDataFrame(one, kinds), 20)
    assert patterns.count() == 15 and streams.count() == 299 and streams.select("shard").distinct().count() > 3


def test_repeated_phrases_of_nothing(docs):
    assert phrases.repeated_phrases(docs([])).count() == 0
    got = phrases.repeated_phrases(docs([(1, None), (2, "a b")])).collect()
    assert {tuple(r)[:3] for r in got} == {(1, 0, 0), (2, 2, 0)}


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_cannot_tell_apart(docs):
    """A sequence and its complement have one polynomial hash modulo 2**64, whatever its odd base."""
    rng, vocab = random.Random(12), vocabulary(400, 3)
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    before, behind = (" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(2))
    rows = [(1, f"{before} {one} {behind}"), (2, f"{before} {two} {behind}"), (3, f"{before} {one} {behind}")]
    got = [tuple(r) for r in phrases.repeated_phrases(docs(rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows, 50)))
    assert {r[0]: r[2] for r in got} == {1: 0, 2: 0, 3: 61}
    data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    first, second = word_hashes(data, words(data, np.array([0, len(data)]), SPACES))
    assert first != second


def test_phrases_of_words_that_share_hashes(docs, monkeypatch):
    """Hashes of one bit: everything is one phrase, and only the words decide."""
    monkeypatch.setattr(phrases, "word_hashes", lambda data, found: word_hashes(data, found) % np.uint64(2))
    rng, vocab = random.Random(13), vocabulary(30, 4)
    passage = [rng.choice(vocab) for _ in range(14)]
    rows = [(i % 20, " ".join([*(rng.choice(vocab) for _ in range(rng.randint(0, 25))), *passage[rng.randrange(5) :]])) for i in range(30)]
    got = [tuple(r) for r in phrases.repeated_phrases(docs(rows), window=10, gram=3, shard_stretches=5).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows, 10)))


@pytest.mark.parametrize("size", [1, 7, 8, 9, 255, 256, 257, 1000])
def test_word_hashes_of_any_length(size):
    rng = random.Random(size)
    found = [bytes(rng.choices(b"xyz", k=size)) for _ in range(200)]
    found += [f[:-1] + b"w" for f in found] + [b"w" + f[1:] for f in found] + found[:50]
    data = np.frombuffer(b" ".join(found), np.uint8)
    got = word_hashes(data, words(data, np.array([0, len(data)]), SPACES))
    assert len({*got.tolist()}) == len({*found}) and dict(zip(found, got.tolist(), strict=True)) == {
        w: h for w, h in zip(found[::-1], got.tolist()[::-1], strict=True)
    }


# names that the stages use inside, as extra columns
CLASHING = ["_lang", "_score", "_bytes", "_letters", "_keep_id", "_keep_digest", "_kept", "_hit", "key", "rid", "decoded", "odd name"]


def test_stages_with_columns_of_their_own_names(spark):
    import corpus_pipeline

    rng = random.Random(14)
    word = lambda lang: "".join(rng.choice({"aa": "abcde", "bb": "vwxyz"}[lang]) for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word(lang) for _ in range(40)), lang, "s", 9) for i, lang in enumerate(["aa", "bb"] * 30)]
    rows += [(100, rows[0][1], "aa", "s", 9), (101, None, "aa", "s", 9), (102, "", None, None, None)] + [rows[5]] * 2
    plain = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    extra = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], plain + "".join(f", `{c}` string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs_ = spark.createDataFrame(rows, plain)
        got, want = stage(spark, extra, ""), stage(spark, docs_, "")
        assert got.columns == extra.columns, name
        assert sorted(map(str, got.select(*docs_.columns).collect())) == sorted(map(str, want.collect())), name
    items = spark.createDataFrame([(1, rows[7][1])], "item_id bigint, text string")
    got = winnow.drop_contaminated(extra, items)
    assert got.columns == extra.columns and got.count() == len(rows) - 1
