"""Documents for the tests, and the folder of the smallest tables."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "lang string, doc_id bigint, text string, source string, n_chars bigint, hash string, shard int, key string, a int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with further columns whose names operators use inside."""

    def make(rows):
        full = [(r[2] if len(r) > 2 else None, r[0], r[1], "s", None, "h", 3, "k", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
