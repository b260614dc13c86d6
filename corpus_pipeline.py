"""From raw documents to encoded training text, in five stages, each a written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ballstats.llm import exact, langid, pieces, simhash, winnow
from ballstats.llm.shared import save, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with enough certainty.

    Texts that are null, empty, without a letter or of no language learned go, and so does everything if no row
    has a language to learn.  Rows that repeat others share their fate.  An empty table stays empty.
    """
    return langid.drop_undetermined(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null and empty texts are equal.  Rows that repeat the id and text that stay are all kept; a null id stays only
    where no other row has the text.  An empty table stays empty.
    """
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Near copies are those whose fingerprints of four-word shingles are linked by steps of at most 4 bits.  That is
    found exactly, but a copy with more words changed is further away and stays.  Texts without a word
    have fingerprint 0 and are one group.  Ties need no rule: ids that are equal stay together.  An empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark.

    Null and empty texts, on either side, share nothing.  Rows that repeat others share their fate.  Without items
    all stay; an empty table stays empty.
    """
    return winnow.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' best segmentations, and how the next best differ.

    One row each, repeated rows too; null and empty texts have no ids.  Between equal scores the order is
    fixed.  An empty table gives no row.
    """
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pieces", encoding),
]

# A recurrent network, components and lattice search: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
