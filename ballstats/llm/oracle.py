"""DuckDB counterparts of those queries that SQL can express."""

from __future__ import annotations

import hashlib
import re

from ballstats.llm.licenses import LICENSES, SPELLINGS, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SUBSTRING_DEDUP = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
    SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50
), windows AS (
    SELECT r, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM starts
), firsts AS (
    SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h
), hit AS (
    SELECT DISTINCT r, p + o AS pos
    FROM (SELECT r, p FROM windows JOIN firsts USING (h) WHERE first_id < doc_id) x, range(50) t(o)
), words AS (
    SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d
), kept AS (
    SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN hit USING (r, pos) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

DECONTAMINATION = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM b WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM windows
), grams AS (
    SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
    FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), met AS (
    SELECT r, p, n, item_id FROM grams JOIN windows USING (n, gram)
), hit AS (
    SELECT r, count(DISTINCT p + o) AS n_hit FROM met, range(10) t(o) WHERE o < n GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM met) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

URL_RULES = rf"""
WITH parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1, 's') AS path
    FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rules(rule, verdict, host, path) AS (
    VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
        ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), judged AS (
    SELECT page_id, p.host, p.path,
        (SELECT min(struct_pack(o := -length(r.rule), rule := r.rule, verdict := r.verdict)) FROM rules r
         WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS best
    FROM parts p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _canonical(text: str) -> str:
    out = rf"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*', '\1', 'g')"
    out = rf"' ' || regexp_replace({out}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', '  ', 'g') || ' '"
    for other, usual in SPELLINGS.items():
        out = f"replace({out}, ' {other} ', ' {usual} ')"
    return f"trim(replace({out}, '  ', ' '))"


def canonical_text(text: str) -> str:
    """The canonical form by plain string work."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    lines = [x for x in text.split("\n") if not x.lstrip(" \t").startswith(("copyright", "(c)", "©"))]
    found = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "\n".join(lines))
    return " ".join(SPELLINGS.get(w, w) for w in found)


def _licenses() -> str:
    notices = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, texts in LICENSES.items() for text in texts)
    digests = {(name, hashlib.sha256(canonical_text(text).encode()).hexdigest()) for name, texts in TEXTS.items() for text in texts}
    whole = ", ".join(f"({_quoted(name)}, '{digest}')" for name, digest in sorted(digests))
    return f"""
WITH known AS (
    SELECT license_id, sha256({_canonical("text")}) AS digest FROM (VALUES {notices}) v(license_id, text)
    UNION SELECT license_id, digest FROM (VALUES {whole}) t(license_id, digest)
), d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
    SELECT r, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM d
), hits AS (
    SELECT r, pos, license_id FROM lines JOIN known ON sha256({_canonical("line")}) = digest
), notices AS (
    SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(DISTINCT pos) AS n FROM hits GROUP BY r
), whole AS (
    SELECT r, doc_id, sha256({_canonical("text")}) AS canonical_sha256 FROM d
)
SELECT doc_id, canonical_sha256, license_id, notices, coalesce(n, 0) AS n_notice_lines
FROM whole LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN notices USING (r)
"""


RESAMPLING = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), ours AS (
    SELECT r, unnest(w) AS word FROM d
), theirs AS (
    SELECT unnest(w) AS word FROM b
), spelled AS (
    SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM ours UNION SELECT word FROM theirs)
), bits AS (
    SELECT word, list_transform(range(4 * length(h)), lambda i: CASE WHEN i % 8 = 0 THEN (
        16 * (strpos('0123456789ABCDEF', substr(h, (i // 4 + 1)::INT, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, (i // 4 + 2)::INT, 1)) - 1
    ) ELSE 0 END::UBIGINT) AS entering
    FROM spelled
), buckets AS (
    SELECT word, (xor(list_reduce(list_prepend(4294967295::UBIGINT, entering),
        lambda c, e: xor(xor(c, e) >> 1, 3988292384::UBIGINT * (xor(c, e) & 1::UBIGINT))), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
    FROM bits
), s AS (
    SELECT bucket, count(*) AS s FROM ours JOIN buckets USING (word) GROUP BY bucket
), t AS (
    SELECT bucket, count(*) AS t FROM theirs JOIN buckets USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM s) + 10000.0::DOUBLE)
        / ((s + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000.0::DOUBLE))))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket)
), weights AS (
    SELECT r, sum(gain)::BIGINT AS weight FROM ours JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r
), noise AS (
    SELECT r, list_reduce(list_transform(range(8), lambda i: (strpos('0123456789abcdef', substr(h, (i + 1)::INT, 1)) - 1)::BIGINT),
        lambda a, b: 16 * a + b) AS h
    FROM (SELECT r, sha256('2024:' || coalesce(doc_id::VARCHAR, '')) AS h FROM d)
), scored AS (
    SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM d LEFT JOIN weights USING (r) JOIN noise USING (r)
), able AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT r, rank FROM able WHERE rank <= 10 * n // 100) USING (r)
"""

COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 6) t(m) WHERE len(w) >= m)
), f AS (
    SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY lang, phrase, m
), total AS (
    SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang
), found AS (
    SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 100
), cuts AS (
    SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part
    FROM (SELECT *, unnest(range(1, m)) AS k FROM found)
), rated AS (
    SELECT c.lang, c.phrase, c.m, c.a, k, x.a AS l, y.a AS r, n,
        (1000::HUGEINT * c.a * n::HUGEINT) // (x.a::HUGEINT * y.a) AS score
    FROM cuts c JOIN f x ON c.lang = x.lang AND left_part = x.phrase JOIN f y ON c.lang = y.lang AND right_part = y.phrase
        JOIN total t ON c.lang = t.lang
), best AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM rated
), kept AS (
    SELECT * FROM best b WHERE cut = 1 AND NOT EXISTS (
        SELECT 1 FROM found o WHERE o.lang = b.lang AND o.m > b.m AND o.a >= b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


ORACLE = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op5_decontamination": DECONTAMINATION,
    "op7_url_rules": URL_RULES,
    "op9_exact_dedup": EXACT_DEDUP,
    "op10_licenses": _licenses(),
    "op12_resampling": RESAMPLING,
    "op13_collocations": COLLOCATIONS,
}
