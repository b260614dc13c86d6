"""Source mixing, importance resampling and collocations against plain counting."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures_llm import SF, docs  # noqa: F401

from ballstats.llm import colloc, mixing, queries, resample
from ballstats.llm.intern import intern, same_bytes
from ballstats.llm.shared import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SOURCED = "doc_id bigint, text string, source string, lang string, _at int, _row string, size string, n int, copies int, _order int, target int"


@pytest.fixture(scope="session")
def sourced(spark):
    """Documents from (doc_id, text, source), with columns of names that operators use inside."""
    return lambda rows: spark.createDataFrame([(i, t, s, "x", 1, "r", "z", 2, 3, 4, 5) for i, t, s in rows], SOURCED)


# --- mixing ---------------------------------------------------------------------------------------
def brute_targets(sizes, weights=(1, 2, 3), repeats=3):
    """Hand the excess on by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > repeats * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed |= {s: repeats * sizes[s] for s in above}


def test_mix_of_sources(sourced):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 8 + ["a", "é", "", "\U0001f600", "tiny", None])
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)), source))
    rows += [(2000, None, "nothing"), (2001, "", "a"), (2002, " \t\n ", "a"), (None, "x y", "a"), (2003, "long " * 50_000, "b")]
    rows += [(7, rows[7][1], rows[7][2])] * 5
    frame = sourced(rows)
    got = mixing.mix(frame).collect()
    assert sorted((str(r.doc_id), r.source or "-", r.size) for r in got) == sorted((str(i), s or "-", len((t or "").split())) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] <= 3 * sizes[s]
        # one document holds nearly all of b, and only whole documents can be taken
        assert abs(taken[s] - want[s]) <= (25_000 if s == "b" else 1), s
    again = mixing.mix(frame.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_little(sourced):
    assert mixing.mix(sourced([])).collect() == []
    assert [tuple(r)[2:] for r in mixing.mix(sourced([(1, None, None), (2, "", "a")])).collect()] == [(0, 0, 0.0, 0, 0)] * 2
    (row,) = mixing.mix(sourced([(1, "a b c", None)])).collect()
    assert (row.size, row.source_size, row.target, row.taken) == (3, 3, 3.0, 3)


def test_mix_in_the_registered_query(spark):
    got = queries.op11_mixing(spark, SF).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in table(spark, SF, "documents").select("doc_id", "text", "source").collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    source = dict(table(spark, SF, "documents").select("doc_id", "source").collect())
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size and r.source_size == sizes[source[r.doc_id]]
    want = brute_targets(sizes)
    largest = {s: max(r.size for r in got if source[r.doc_id] == s) for s in sizes}  # ten documents or so fit roughly
    assert all(abs(taken[s] - want[s]) <= 0.5 + largest[s] / 20 and target[s] == pytest.approx(want[s]) for s in sizes)


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_is_exact(seed):
    rng = random.Random(seed)
    sizes = np.array(sorted(rng.sample(range(1, 40), 6)))
    if seed == 5:
        sizes = sizes * 4
    counts = np.array([rng.randint(0, 3) for _ in sizes])
    sums = {sum(int(k) * int(s) for k, s in zip(c, sizes, strict=True)) for c in itertools.product(*[range(n + 1) for n in counts])}
    for budget in (0, 1, 7, 33, 100, 1000):
        taken = mixing.knapsack(sizes, counts, budget)
        assert ((taken >= 0) & (taken <= counts)).all()
        assert (taken * sizes).sum() == min(sums, key=lambda s: (abs(s - budget), s))


@pytest.mark.parametrize("budget", [16, 200, 1 << 16])
def test_fit_beyond_the_budget(budget):
    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(1, 400, 120))
    counts = rng.integers(1, 50, len(sizes))
    total = int((sizes * counts).sum())
    for target in (0, 1, total // 3, total - 1, total, 2 * total + 12_345, 3 * total):
        whole, extra = mixing.fit(sizes, counts, target, budget)
        assert whole == target // total and ((extra >= 0) & (extra <= counts * (3 - whole))).all()
        assert abs(whole * total + int((sizes * extra).sum()) - target) <= (0 if budget > 400 and target != 1 else 4)
    # three documents of one size, and a target that one more of each cannot meet
    assert mixing.fit(np.array([7, 10]), np.array([1, 1]), 31)[0] == 1
    whole, extra = mixing.fit(np.array([7, 10]), np.array([1, 1]), 31)
    assert extra.tolist() == [2, 0]
    # only documents far above the budget: the nearest sum of one or none
    whole, extra = mixing.fit(np.array([1000, 5000]), np.array([1, 1]), 4700, 16)
    assert whole == 0 and extra.tolist() in ([0, 1], [1, 1])


# --- interning --------------------------------------------------------------------------------------
@pytest.mark.parametrize("bits", [64, 2, 0])
def test_interning_tells_colliding_words_apart(bits):
    rng = random.Random(bits)
    found = [bytes(rng.choices(b"ab", k=rng.choice([1, 2, 7, 8, 9, 16, 17]))) for _ in range(400)]
    found += [b"x" * 64, b"x" * 64, b"x" * 63 + b"y", b"x" * 500, b"x" * 500, b"x" * 499 + b"z", b""]
    data = np.frombuffer(b"".join(found), np.uint8)
    ends = np.cumsum([len(x) for x in found])
    starts = ends - [len(x) for x in found]
    keys = None if bits == 64 else np.array([hash(x) % (1 << bits) for x in found], np.uint64)
    got = intern(data, starts, ends, keys)
    assert len(got.firsts) == len(set(found)) and got.counts.sum() == len(found)
    for i, x in enumerate(found):
        assert found[got.firsts[got.slots[i]]] == x and got.counts[got.slots[i]] == found.count(x)
    one, two = (np.array(x) for x in zip(*itertools.product(range(380, 407), repeat=2), strict=True))
    assert same_bytes(data, starts, ends, one, two).tolist() == [found[a] == found[b] for a, b in zip(one, two, strict=True)]


def test_interning_nothing():
    got = intern(np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 2)
    assert len(got.slots) == len(got.firsts) == len(got.counts) == 0


# --- resampling -----------------------------------------------------------------------------------------
def grams(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, longest=1, buckets=10_000, least=20, share=(10, 100)):
    of = lambda g: zlib.crc32(g.encode()) % buckets
    found = [grams(t, longest) for _, t in rows]
    s = Counter(of(g) for _, gs in found for g in gs)
    t = Counter(of(g) for x in target for g in grams(x, longest)[1])
    s_all, t_all = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, gs) in zip(rows, found, strict=True):
        weight = sum(gain[of(g)] for g in gs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: share[0] * len(able) // share[1]]
    return out, [(r[0], r[4]) for r in drawn]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 50)])
def test_resampling_against_brute_force(spark, docs, longest, buckets):
    rng = random.Random(longest)
    vocab = ["the", "Of", "naïve", "漢字", *[f"w{i}" for i in range(300)], "y" * 90]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "\n", "-", ", "]) for _ in range(n))
    rows = [(i, text(rng.choice([5, 19, 20, 60, 200]))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "... !"), (None, text(40)), (903, "the " * 60_000), (904, "z" * 200_000)]
    rows += [rows[3]] * 3
    target = [text(30) for _ in range(20)] + [None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = resample.resample(docs(rows), items, longest=longest, buckets=buckets).collect()
    want, drawn = brute_resample(rows, target, longest, buckets)
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    ranked = sorted((r.rank, r.doc_id, r.score) for r in got if r["rank"] is not None)
    assert [(i, s) for _, i, s in ranked] == drawn and [k for k, _, _ in ranked] == list(range(1, len(drawn) + 1))


def test_resampling_of_nothing(spark, docs):
    items = spark.createDataFrame([], "item_id int, text string")
    assert resample.resample(docs([]), items).collect() == []
    got = resample.resample(docs([(i, "a b " * 10) for i in range(20)]), items).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len({r.weight for r in got}) == 1


# --- collocations ---------------------------------------------------------------------------------------
def brute_collocations(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            counts[lang or "und"].update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        rated = []
        for p, a in found.items():
            if longer[p] < a:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        ordered = enumerate(sorted(rated)[:top], 1)
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in ordered]
    return sorted(out)


SAMPLE = [
    "the quick brown fox. the quick brown dog, and THE QUICK\tbrown fox! The quick brown fox jumps over it",
    "a a a a a a a\nb b b. a b a b a b; a b c d e f g a b c d e f g",
    "naïve 漢字 \x00odd \x01word    x y naïve 漢字 \x00odd",
]


@pytest.mark.parametrize("budget,segment,bits", [(1 << 19, colloc.SEGMENT, 1 << 20), (4, 7, 1 << 19), (1, 1 << 10, 1 << 19)])
def test_collocations_against_brute_force(docs, budget, segment, bits):
    rng = random.Random(budget)
    vocab = [f"w{i}" for i in range(12)]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocab) + rng.choice("     .\n") for _ in range(80))) for _ in range(40)]
    rows += [(lang, t) for t in SAMPLE for lang in ("en", "en", None)] + [("en", None), ("en", ""), ("fr", "once only"), ("de", " .,; ")]
    rows += [("hot", "x y z " * 3000)]
    frame = docs([(i, t, lang) for i, (lang, t) in enumerate(rows)])
    got = colloc.collocations(frame, least=3, top=50, budget=budget, segment=segment, bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 3, 50)


def test_collocations_of_nothing(docs):
    assert colloc.collocations(docs([])).collect() == []
    assert colloc.collocations(docs([(1, None), (2, "one two"), (None, "...")])).collect() == []


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of a corpus of 10**13 words; the product of three has 30 digits and more."""
    a, left, right, n = 999_999_999_999, 7_777_777_777_777, 5_555_555_555_553, 98_765_432_109_876
    single = spark.createDataFrame([("en", "p", left), ("en", "q", right), ("en", "rest", n - left - right)], "lang string, word string, n bigint")
    phrases = spark.createDataFrame([("en", "p q", a)], "lang string, phrase string, a bigint")
    monkeypatch.setattr(colloc, "phrase_counts", lambda *x, **y: (single, phrases))
    (row,) = colloc.collocations(None).collect()
    assert tuple(row) == ("en", 1, "p q", a, left, right, n, 1000 * a * n // (left * right))


def test_packing_by_budget():
    first, split = colloc.pack(np.array([3, 3, 5, 0, 25, 1, 9]), 10)
    assert first.tolist() == [0, 0, 1, 1, 2, 5, 5] and split.tolist() == [1, 1, 1, 1, 3, 1, 1]
