"""Licence scans: the digest of a canonical text looked up among those of known licences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballstats.llm.license_texts import whole_texts
from ballstats.llm.shared import row_key

# The notices that name public licences, and short texts on one line.
LICENSES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License."],
    "ISC": [
        "Released under the ISC License.",
        "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC0-1.0": ["Released under CC0 1.0."],
}

TEXTS = whole_texts()
KNOWN = {name: [*LICENSES.get(name, []), *TEXTS.get(name, [])] for name in {**LICENSES, **TEXTS}}

# Spellings that licence matching treats as the same word.
SPELLINGS = {
    "licence": "license",
    "licenced": "licensed",
    "organisation": "organization",
    "merchantibility": "merchantability",
    "whilst": "while",
    "wilful": "willful",
    "analogue": "analog",
    "favour": "favor",
    "judgement": "judgment",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEADING = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words set apart by one space, one spelling for each word."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), HEADING, "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, PUNCTUATION, "  "), F.lit(" "))  # each word has its own spaces
    for other, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, licenses: Mapping[str, list[str]] = KNOWN) -> DataFrame:
    """License id and canonical digest of each known text."""
    rows = [(name, text) for name, texts in licenses.items() for text in texts]
    known = spark.createDataFrame(rows, "license_id string, text string")
    return known.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def scan_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    licenses: Mapping[str, list[str]] = KNOWN,
) -> DataFrame:
    """For each row: doc_id, canonical_sha256, license_id, and the notices among its lines.

    ``license_id`` names the licence whose canonical text the whole text equals, else null; what
    is known are the whole texts of ``license_texts`` and the notices.
    ``notices`` lists, sorted and comma-joined, the licences that a single line equals, else
    null; ``n_notice_lines`` counts those lines.  A null text counts as empty and fits nothing.
    Rows that repeat id and text each get their row; an empty table gives none.  A text that
    canonises to nothing is no licence.  Only id and text are read.
    """
    known = known_digests(docs.sparkSession, licenses)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text"))
    whole = known.select(F.col("license_id"), F.col("digest").alias("canonical_sha256"))
    lines = rows.select(
        row_key(F.col("doc_id"), F.col("_text")).alias("_key"),
        F.posexplode(F.split("_text", "\n")).alias("at", "line"),
    )
    hits = (
        lines.select("_key", "at", F.sha2(canonical(F.col("line")), 256).alias("digest"))
        .join(known, "digest")
        .distinct()
        .groupBy("_key")
        .agg(
            F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"),
            F.count_distinct("at").alias("n_notice_lines"),
        )
    )
    return (
        rows.select(
            "doc_id",
            row_key(F.col("doc_id"), F.col("_text")).alias("_key"),
            F.sha2(canonical(F.col("_text")), 256).alias("canonical_sha256"),
        )
        .join(whole, "canonical_sha256", "left")
        .join(hits, "_key", "left")
        .select(
            "doc_id",
            "canonical_sha256",
            "license_id",
            "notices",
            F.coalesce("n_notice_lines", F.lit(0).cast("long")).alias("n_notice_lines"),
        )
    )
