"""Numbers of rows in an order over a whole table."""

import random

import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from ballstats.operators.ranking import number_rows, partition_starts
from catalog.queries import QUERIES


def test_numbers_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(9)]), i) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b long").repartition(7)
    got = {r["no"]: (r["a"], r["b"]) for r in rows_of(number_rows(df, [F.col("a").desc_nulls_last(), F.col("b").asc()], "no"))}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [got[i] for i in range(1, 401)] == want


def test_ties_and_repeats_get_different_numbers(spark):
    df = spark.range(100).select(F.lit(1).alias("a"))
    assert sorted(r["n"] for r in rows_of(number_rows(df, [F.col("a")], "n"))) == list(range(1, 101))


def test_names_that_are_used_inside(spark):
    df = spark.createDataFrame([(3, 1, 2), (1, 5, 6)], "_at int, _PART int, _before int")
    got = number_rows(df, [F.col("_at")], "n")
    assert got.columns == ["_at", "_PART", "_before", "n"]
    assert {tuple(r) for r in got.collect()} == {(3, 1, 2, 2), (1, 5, 6, 1)}


def test_nothing_to_number(spark):
    assert number_rows(spark.createDataFrame([], "a int"), [F.col("a")]).collect() == []
    with pytest.raises(ValueError):
        number_rows(spark.range(3), [])


def test_sums_before_each_partition(spark):
    totals = spark.createDataFrame([(4, 10, 1), (0, 5, 2), (2, 7, 3)], "p int, x long, y long")
    assert {tuple(r) for r in partition_starts(totals, "p", ["x", "y"]).collect()} == {(0, 0, 0), (2, 5, 2), (4, 12, 5)}


@pytest.mark.parametrize("name", ["batting_ranked", "bowling_ranked"])
def test_finished_tables_are_ranked_without_a_window(spark, name):
    df = QUERIES[name](spark, SF)
    assert "row_number" not in df._jdf.queryExecution().toString()
    assert sorted(r["rank"] for r in rows_of(df)) == list(range(1, df.count() + 1))
