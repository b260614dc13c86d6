"""Registered queries against their SQL, and the pipeline."""

import pytest
from fixtures_llm import SF

import __spark_entry__ as entry
import corpus_pipeline
from ballstats.llm.oracle import ORACLE
from ballstats.llm.shared import table
from check import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    con = connect(SF)
    assert compare(spark, con, SF, name).startswith("ok")
    con.close()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns, name
        assert docs.exceptAll(before).isEmpty()
        docs = corpus_pipeline.save(docs)
        seen.append(docs.count())
    assert seen[0] >= 0.99 * table(spark, SF, "documents").count() and seen[0] > seen[1] > seen[3] > 0
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.count() == seen[3]


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
