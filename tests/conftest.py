import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from ballstats.schema import DELIVERIES, TYPED_DELIVERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("ballstats-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _frame(spark, schema, rows, defaults):
    from pyspark.sql import types as T

    fields = [T.StructField("seq", T.LongType()), *schema.fields]
    data = []
    for i, row in enumerate(rows):
        full = {"seq": i, **defaults, **row}
        data.append(tuple(full.get(f.name) for f in fields))
    return spark.createDataFrame(data, T.StructType(fields))


@pytest.fixture(scope="session")
def raw(spark):
    """Raw deliveries from short dicts; unnamed columns get plain values."""
    defaults = {
        "match_id": 1, "innings": 1, "start_date": "2023-04-01", "venue": "V1", "ball": 0.1, "striker": "A",
        "non_striker": "B", "bowler": "X", "batting_team": "T1", "bowling_team": "T2", "runs_off_bat": 0,
    }
    return lambda rows: _frame(spark, DELIVERIES, rows, defaults)


@pytest.fixture(scope="session")
def raw_typed(spark):
    defaults = {
        "MatchNum": 1, "MatchInn": 1, "StartDate": "2023-04-01", "CompName": "C1", "Venue": "V1", "Over": 0.1,
        "Batter": "A", "Runs": 0, "Extras": 0, "BowlType": "RF", "BowlCat": "F",
    }
    return lambda rows: _frame(spark, TYPED_DELIVERIES, rows, defaults)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows_of(df)}
