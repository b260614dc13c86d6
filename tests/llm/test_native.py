"""Exact duplicates, licences and URL rules, which run on DataFrame functions only."""

import hashlib
import textwrap
from pathlib import Path

import duckdb
import pytest
from fixtures_llm import docs  # noqa: F401

from ballstats.llm import exact, licenses, urls
from ballstats.llm.oracle import ORACLE


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


LONG = "word " * 40_000
ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, LONG), (7, LONG), (7, LONG), (None, "a"), (None, "z"), (9, "A")]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(docs, bits):
    got = exact.exact_duplicates(docs(ROWS), capacity=2, hash_bits=bits, max_depth=4).collect()
    want = []
    for i, t in ROWS:
        group = [j for j, u in ROWS if (u or "") == (t or "")]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, sha(t)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    if bits == 3:  # keys collide, so some bucket chains different texts
        assert max(r.chain for r in got) > 0


def test_the_bucket_decides(docs):
    """Copies in different tasks meet in their bucket's chain, and only there."""
    rows = [(i, f"text {i % 7}") for i in range(70)]
    df = docs(rows).repartition(6)
    folded = exact.folds(df, hash_bits=3)
    assert folded.count() > 7  # not yet one row for each text
    slots, depth = exact.directory(folded.select("hash").distinct(), capacity=1, max_depth=4)
    assert depth >= 2 and slots.select("bucket").distinct().count() > 1  # split buckets
    index = exact.build_index(folded, slots, depth)
    assert sorted((r.group_size, r.keep_id) for r in index.collect()) == [(10, 63 + k) for k in range(7)]
    names = {r.slot: r.bucket for r in slots.collect()}
    chains = {}
    for r in index.collect():
        assert r.bucket == names[(r.hash & (1 << 64) - 1) >> (64 - depth)]
        chains.setdefault((r.bucket, r.hash), []).append(r.chain)
    assert all(sorted(c) == list(range(len(c))) for c in chains.values()) and max(map(len, chains.values())) > 1


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(h << 60,) for h in [0, 0, 0, 1, 4]] + [(-(1 << 63),)], "hash bigint")
    slots, depth = exact.directory(keys, capacity=3, max_depth=6)
    rows = sorted(map(tuple, slots.collect()))
    assert [r[0] for r in rows] == list(range(1 << depth))
    for slot, bucket, local in rows:
        assert bucket == slot >> (depth - local) << (depth - local)
    assert {r[2] for r in rows if r[0] >> (depth - 1)} == {1}  # the upper half is one bucket


def test_a_bucket_of_one_key_stops_at_the_greatest_depth(spark):
    slots, depth = exact.directory(spark.createDataFrame([(5,)] * 9, "hash bigint"), capacity=2, max_depth=3)
    assert depth == 3 and slots.count() == 8


def test_empty_exact(docs):
    assert exact.exact_duplicates(docs([])).count() == 0
    assert exact.drop_exact_duplicates(docs([])).count() == 0


def test_drop_exact_keeps_columns_and_largest_ids(docs):
    df = docs([r for r in ROWS if r[0] is not None])
    out = exact.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 5, 7, 7, 9]


def test_licenses(docs):
    isc = licenses.LICENSES["ISC"][1]
    altered = "Copyright (c) 2020 Some One\n" + isc.replace("modify", "MODIFY,").upper()
    rows = [
        (1, isc), (2, altered), (3, "prose\nReleased under the MIT License!\nLicensed under CC BY 4.0"), (4, None), (5, ""),
        (6, "This work is LICENCED under the GNU General Public Licence, version 3."), (6, "..."), (None, "x " * 50_000),
        (7, "(c) me\ncopyright you\nReleased under the MIT Licence"),
    ]
    got = {}
    for r in licenses.scan_licenses(docs(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license_id, r.notices, r.n_notice_lines))
    assert got[1] == [("ISC", "ISC", 1)] and got[2] == [("ISC", "ISC", 1)]
    assert got[3] == [(None, "CC-BY-4.0,MIT", 2)]
    assert got[4] == got[5] == [(None, None, 0)]
    assert sorted(got[6], key=str) == sorted([("GPL-3.0-only", "GPL-3.0-only", 1), (None, None, 0)], key=str)
    assert got[7] == [("MIT", "MIT", 1)] and got[None] == [(None, None, 0)]
    assert licenses.scan_licenses(docs([])).count() == 0


def test_license_of_repeated_rows(docs):
    rows = licenses.scan_licenses(docs([(1, "Released under the MIT License.")] * 3)).collect()
    assert len(rows) == 3 and {(r.license_id, r.n_notice_lines) for r in rows} == {("MIT", 1)}


OWNER = "Copyright (c) 2020 Some One and Others"
FILES = [
    ("MIT", "MIT", "MIT License\n\n{owner}\n\n{text}"),
    ("MIT", "MIT", "{owner}\n\n{text}"),
    ("ISC", "ISC", "The ISC License\n\n{owner}\n\n{text}"),
    ("BSD-3-Clause", "BSD-3-Clause", "BSD 3-Clause License\n\n{owner}\nAll rights reserved.\n\n{text}"),
    ("BSD-2-Clause", "BSD-2-Clause", "{owner}\n\n{text}"),
    *((name, name, "{text}") for name in sorted({*licenses.TEXTS} - {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"})),
]


def test_whole_license_files(docs, tmp_path):
    folder = Path(licenses.__file__).with_name("license_texts")
    rows, want = [], {}
    for i, (name, license_id, form) in enumerate(FILES):
        text = (folder / f"{name}.txt").read_text()
        rows.append((i, form.format(owner=OWNER, text=text)))
        want[i] = license_id
    rows += [(100, rows[0][1] + "\nand one more condition"), (101, rows[0][1].replace("free of charge", "for a fee"))]
    found = licenses.scan_licenses(docs(rows)).collect()
    assert {r.doc_id: r.license_id for r in found} == {**want, 100: None, 101: None}
    assert sorted(map(str, in_sql(tmp_path, "op10_licenses", documents=docs(rows)))) == sorted(str(tuple(r)) for r in found)


def test_mit_file_wrapped_elsewhere(docs):
    text = (Path(licenses.__file__).with_name("license_texts") / "MIT.txt").read_text()
    words = "\n\n".join(textwrap.fill(" ".join(p.split()), 72) for p in text.split("\n\n"))
    one = "MIT License\n\nCopyright (c) 1999-2020 Some One\n\n" + words
    rows = licenses.scan_licenses(docs([(1, one), (2, one.replace("\n", "\r\n"))])).collect()
    assert [r.license_id for r in rows] == ["MIT", "MIT"]


def test_no_text_is_two_licenses(spark):
    known = licenses.known_digests(spark, licenses.KNOWN)
    assert known.groupBy("digest").count().filter("count > 1").count() == 0


def judge(url):
    sep = (url or "").find("://")
    if sep < 0:
        return "", "", None, "allow"
    rest = url[sep + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


URLS = [
    "http://a.net?u=http://x.org/p", "http://a.net#http://x.org/p", "http://x.org?u=https://example.net/en/", "http://a.net:80?u=://b/",
    "http://a.net/p?u=http://x.org/fr/", "http://a.net://b.org/fr/", "://?u=http://x.org/fr/", "a?u=http://x.org?v=http://y.net/",
]


def in_sql(tmp_path, name, **frames):
    """What a query's SQL gives over small tables."""
    con = duckdb.connect()
    for table, frame in frames.items():
        frame.write.parquet(str(tmp_path / table))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}/*.parquet')")
    return con.execute(ORACLE[name]).fetchall()


def test_url_rules(spark):
    given = [
        "http://a.net/x", "http://NET/", "http://net", "http://net?x", "https://m.Example.NET/en/25#t", "http://example.net/EN/",
        "http://badexample.net/en/", "ftp://example.com/de/1?u=http://x.net/", "http://example.com/de", "http://x.org/fr/",
        "http://x.orgs/fr/", "net/x", None, "", "://net/", "http://a.net:80/", "http://u@b.net/", "http://x/\nnet/", "http://" + "a." * 9000 + "net/",
        "http://a.net/x", "http://é.net/é",
    ]
    rows = [(i % 19, u, "z", "h") for i, u in enumerate(given)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, host string")
    got = sorted(map(str, (tuple(r) for r in urls.judge_urls(pages).collect())))
    assert got == sorted(str((i, *judge(u))) for i, u, _, _ in rows)
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_a_later_scheme_starts_no_host(spark, tmp_path):
    pages = spark.createDataFrame([*enumerate([*URLS, None, "", "x"])], "page_id bigint, url string")
    want = sorted(str((i, *judge(u))) for i, u in enumerate([*URLS, None, "", "x"]))
    assert sorted(map(str, (tuple(r) for r in urls.judge_urls(pages).collect()))) == want
    assert sorted(map(str, in_sql(tmp_path, "op7_url_rules", pages=pages))) == want
    assert judge(URLS[0]) == ("a.net", "", None, "allow")


def test_rules_without_a_token_run_on_every_url(spark):
    rules = [*urls.RULES, urls.Rule("no path", "block", r"\x00$", ()), urls.Rule("x", "block", "^[^\x00]*\\.museum\x00", ("museum",))]
    given = ["http://a.com", "http://a.com/", "http://b.museum/", "http://a.net/", "http://???", "no scheme"]
    pages = spark.createDataFrame([*enumerate(given)], "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, rules=rules).collect()}
    assert got == {0: ("no path", "block"), 1: (None, "allow"), 2: ("x", "block"), 3: ("net/", "block"), 4: (None, "allow"), 5: (None, "allow")}


def test_rules_stand_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([(["a", "net"],), (["b", "net", "example"],), (["c", "net"],)], "tokens array<string>")
    index = {r.rule: r.token for r in urls.rule_index(tokens, urls.RULES).collect()}
    assert index["net/"] == "net" and index["example.net/en/"] == "en" and index["org/fr/"] == "fr"
