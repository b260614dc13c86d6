"""CSV in, tables and exports out."""

import csv
import random
import re
from pathlib import Path

import pytest
from conftest import SF, by, rows_of
from pyspark.sql import functions as F

import ballstats as bs
from ballstats.operators.prepare import dedupe_by_digest, dedupe_first
from ballstats.schema import DELIVERIES
from ballstats.sinks.export import export_ball_by_ball, export_pivots, write_by_year
from ballstats.sources.csv import load_deliveries, load_league, merge_csv, read_layout, union_sources
from ballstats.sources.starschema import deliveries_from_events
from ballstats.sources.tables import ingest, read_table, scratch_path

HEADER = DELIVERIES.fieldNames()


def ball(**kw):
    row = dict(
        match_id=1, innings=1, start_date="2023-04-01", venue="V1", ball=0.1, striker="A", non_striker="B", bowler="X",
        batting_team="T1", bowling_team="T2", runs_off_bat=1, wides="", noballs="", player_dismissed="", wicket_type="",
    )
    return row | kw


def write(path, rows, header=None):
    header = header or list(rows[0])
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows([[r.get(h, "") for h in header] for r in rows])


def test_scan_types_and_gaps(spark, tmp_path):
    rows = [ball(wides="1.0", venue="Ground, the \"Old\" one"), ball(ball="x", venue="NA", striker="nan"), ball(noballs=2, extra="kept")]
    write(tmp_path / "a.csv", rows, [*HEADER, "extra"])
    got = rows_of(read_layout(spark, str(tmp_path / "a.csv"), DELIVERIES).orderBy("seq"))
    assert (got[0]["wides"], got[0]["venue"], got[0]["noballs"]) == (1, 'Ground, the "Old" one', None)
    assert (got[1]["ball"], got[1]["venue"], got[1]["striker"]) == (None, None, None)
    assert (got[2]["noballs"], got[2]["extra"]) == (2, "kept")


def test_position_is_file_order(spark, tmp_path):
    for name, start in [("a", 0), ("b", 2000)]:
        write(tmp_path / f"{name}.csv", [ball(match_id=start + i) for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = read_layout(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], DELIVERIES)
        assert df.rdd.getNumPartitions() > 4
        ids = [r["match_id"] for r in df.repartition(3).orderBy("seq").select("match_id").collect()]
        assert ids == list(range(4000))
        ingest(df, str(tmp_path / "table"), ["year"])
        table = read_table(spark, str(tmp_path / "table"))
        assert dict(table.dtypes)["seq"] == "bigint"
        assert [r["match_id"] for r in table.orderBy("seq").select("match_id").collect()] == ids
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_another_header_is_an_error(spark, tmp_path):
    write(tmp_path / "a.csv", [ball()])
    write(tmp_path / "b.csv", [ball()], list(reversed(HEADER)))
    with pytest.raises(Exception, match="(?i)header"):
        read_layout(spark, str(tmp_path), DELIVERIES).collect()


def test_merge_by_name(spark, tmp_path):
    write(tmp_path / "a one.csv", [ball(striker="A")])
    write(tmp_path / "b.csv", [ball(striker="B", wides=1)], list(reversed(HEADER)))
    write(tmp_path / "c.csv", [{"": 0, **ball(striker="C")}])
    write(tmp_path / "d.csv", [ball(striker="D", season="x")])
    write(tmp_path / "d_info.csv", [ball(striker="INFO")])
    write(tmp_path / "e.csv", [ball(striker="E")])
    Path(tmp_path / "notes.txt").write_text("match_id\n1\n")
    merged = merge_csv(spark, str(tmp_path))
    got = by(merged, "striker")
    assert set(got) == set("ABCDE")
    assert got["B"]["wides"] == 1 and got["B"]["start_date"] == "2023-04-01"
    assert got["D"]["season"] == "x" and got["A"]["season"] is None
    assert "_c0" not in merged.columns
    with pytest.raises(FileNotFoundError):
        merge_csv(spark, str(tmp_path), pattern="*.none")


def test_repeated_rows_keep_the_first_place(spark, raw):
    rows = [{"seq": s, "ball": b} for s, b in [(4, 0.1), (2, 0.1), (9, 0.2), (7, 0.1), (1, None), (3, None)]]
    got = {(r["seq"], r["ball"]) for r in rows_of(dedupe_first(raw(rows)))}
    assert got == {(2, 0.1), (9, 0.2), (1, None)}
    marked = raw(rows).withColumn("Unnamed: 0", F.col("seq"))
    assert dedupe_first(marked).count() == 3


@pytest.mark.parametrize("digest", [None, "all alike", "three"])
def test_rows_whose_digest_repeats(spark, raw, digest):
    """Colliding digests only move more rows; NULLs in different columns share a digest anyway."""
    rows = [{"seq": s, "ball": b} for s, b in [(4, 0.1), (2, 0.1), (9, 0.2), (7, 0.1), (1, None), (3, None), (5, 0.3)]]
    rows += [{"seq": 11, "striker": None, "non_striker": "A"}, {"seq": 12, "striker": "A", "non_striker": None}]
    df = raw(rows)
    given = {None: None, "all alike": F.lit(7).cast("bigint"), "three": F.col("seq") * 0 + F.coalesce(F.col("ball") * 10, F.lit(0)).cast("bigint") % 3}[digest]
    got = sorted((tuple(r) for r in dedupe_by_digest(df, digest=given).collect()), key=str)
    assert got == sorted((tuple(r) for r in dedupe_first(df).collect()), key=str) and len(got) == 6
    assert dedupe_by_digest(df.limit(0)).collect() == []


def test_a_re_merged_file_changes_nothing(spark, tmp_path):
    rows = [ball(ball=b / 10, runs_off_bat=b) for b in range(1, 7)] + [ball(striker="B", ball=1.1)]
    write(tmp_path / "a.csv", rows)
    write(tmp_path / "b.csv", rows)
    once = by(bs.batting_season(load_deliveries(spark, str(tmp_path / "a.csv"))), "player")
    twice = by(bs.batting_season(load_deliveries(spark, str(tmp_path))), "player")
    assert once == twice and once["A"]["runs_scored"] == 21 and once["A"]["median_entry_point"] == 0.1


def test_leagues(spark, tmp_path):
    write(tmp_path / "PSL.csv", [ball(striker="P")])
    write(tmp_path / "The 100.csv", [ball(striker="H")])
    assert list(by(load_league(spark, str(tmp_path), "PSL"), "striker")) == ["P"]
    assert list(by(load_league(spark, str(tmp_path), "The 100"), "striker")) == ["H"]
    with pytest.raises(KeyError):
        load_league(spark, str(tmp_path), "nowhere")


def test_union_of_different_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, "y")], "k int, b string")
    assert {tuple(r) for r in union_sources(a, b).collect()} == {(1, "x", None), (2, None, "y")}


def test_partitioned_table_prunes(spark, tmp_path):
    raw = deliveries_from_events(spark, SF).withColumn("league", F.concat(F.lit("L"), F.col("match_id") % 2))
    ingest(raw, str(tmp_path / "t"))
    assert (tmp_path / "t" / "league=L0").is_dir()
    chosen = bs.Filters(dates=("2022-01-01", "2022-12-31")).apply(read_table(spark, str(tmp_path / "t"), ["L1"]))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "league" in filters and "year" in filters
    assert chosen.count() == raw.filter("league = 'L1' AND start_date LIKE '2022%'").count()


def test_exports(spark, raw, tmp_path):
    rows = [{"striker": s, "ball": b / 10, "runs_off_bat": b, "start_date": f"{y}-05-01", "match_id": y} for y in (2022, 2023) for s in "ABC" for b in (1, 2)]
    d = bs.prepare_deliveries(raw(rows))
    running = bs.batter_running(d)
    export_ball_by_ball(running, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 12
    export_ball_by_ball(running, str(tmp_path / "text"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "text")).count() == 12
    by_ball = bs.progression_by_ball(bs.batter_progression(d))
    write_by_year(by_ball, str(tmp_path / "balls"))
    assert sorted(p.name for p in (tmp_path / "balls").glob("year=*")) == ["year=2022", "year=2023"]
    export_pivots(by_ball, str(tmp_path / "pivot"))
    for year in (2022, 2023):
        first = spark.read.option("header", True).csv(str(tmp_path / f"pivot/value=ave_runs/year={year}"))
        assert first.columns == ["balls", "A", "B", "C"]
        assert [tuple(r) for r in first.collect()] == [("1", "1.0", "1.0", "1.0"), ("2", "3.0", "3.0", "3.0")]
    assert bs.pivot_by_ball(by_ball, "sr").columns == ["year", "balls", "A", "B", "C"]


def test_pivot_files_keep_gaps_and_odd_names(spark, tmp_path):
    rows = [(2022, 'Q, "Z"', 1, 1.0, 5.0), (2022, "A", 2, 2.0, 6.0), (2022, "A", 10, None, 7.0)]
    by_ball = spark.createDataFrame(rows, "year int, player string, balls bigint, ave_runs double, sr double")
    export_pivots(by_ball, str(tmp_path / "p"))
    lines = [p.read_text().splitlines() for v in ("ave_runs", "sr") for p in (tmp_path / f"p/value={v}/year=2022").glob("part-*")]
    assert lines[0] == ['balls,A,"Q, ""Z"""', "1,,1.0", "2,2.0,"]
    assert lines[1] == ['balls,A,"Q, ""Z"""', "1,,5.0", "2,6.0,", "10,7.0,"]


def test_blank_headings_are_compared_too(spark, tmp_path):
    one, other = ["", *HEADER], ["", *HEADER]
    i, j = other.index("striker"), other.index("non_striker")
    other[i], other[j] = other[j], other[i]
    write(tmp_path / "a.csv", [ball()], one)
    write(tmp_path / "b.csv", [ball()], other)
    with pytest.raises(ValueError, match="header"):
        read_layout(spark, str(tmp_path), DELIVERIES)
    assert {r["striker"] for r in rows_of(merge_csv(spark, str(tmp_path)))} == {"A"}


def test_rows_of_another_length_are_errors(spark, tmp_path):
    write(tmp_path / "a.csv", [ball(), ball(striker="B")])
    text = (tmp_path / "a.csv").read_text()
    (tmp_path / "a.csv").write_text(text + "1,2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_layout(spark, str(tmp_path / "a.csv"), DELIVERIES).select("striker").collect()
    assert read_layout(spark, str(tmp_path / "a.csv"), DELIVERIES, bad_rows="null").count() == 3


def test_line_breaks_in_quotes(spark, tmp_path):
    write(tmp_path / "a.csv", [ball(venue="Old\nGround"), ball(striker="B")])
    with pytest.raises(Exception, match="(?i)malformed"):
        read_layout(spark, str(tmp_path / "a.csv"), DELIVERIES).collect()
    got = by(read_layout(spark, str(tmp_path / "a.csv"), DELIVERIES, multiline=True), "striker")
    assert got["A"]["venue"] == "Old\nGround" and set(got) == {"A", "B"}


def test_a_date_in_another_form_loses_no_ball(spark, tmp_path):
    rows = [ball(ball=b / 10, match_id=m, start_date=d) for m, d in ((1, "2023-04-01"), (2, "2023/04/01")) for b in range(1, 7)]
    write(tmp_path / "a.csv", rows)
    assert by(bs.batting_season(load_deliveries(spark, str(tmp_path / "a.csv"))), "player")["A"]["bf"] == 12


def test_a_ball_without_a_match_is_no_innings(spark, raw):
    d = bs.prepare_deliveries(raw([{"match_id": 1}, {"match_id": None}, {"match_id": None, "innings": 2}]))
    assert by(bs.batting_season(d, thresholds=None), "player")["A"]["innings_count"] == 1


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark) != scratch_path(spark)
    assert scratch_path(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_header_lines_are_read_side_by_side(spark, tmp_path, monkeypatch):
    """Ten thousand sequential opens would take as many round trips; here many wait at once."""
    import threading
    import time

    from ballstats.sources import csv as source

    for i in range(60):
        write(tmp_path / f"{i:02}.csv", [ball(match_id=i)], HEADER if i % 2 else list(reversed(HEADER)))
    one, open_now, most, lock = source._first_line, [0], [0], threading.Lock()

    def slow(session, path):
        with lock:
            open_now[0] += 1
            most[0] = max(most[0], open_now[0])
        time.sleep(0.05)
        try:
            return one(session, path)
        finally:
            with lock:
                open_now[0] -= 1

    monkeypatch.setattr(source, "_first_line", slow)
    merged = merge_csv(spark, str(tmp_path))
    assert 8 < most[0] <= source.HEADER_READERS
    assert sorted(r["match_id"] for r in rows_of(merged)) == list(range(60))


def test_pivot_of_a_large_season_is_many_files(spark, tmp_path):
    rows = [(y, f"P{p}", b, float(b), 2.0 * b) for y in (2021, 2022) for p in range(4) for b in range(1, 31)]
    by_ball = spark.createDataFrame(rows, "year int, player string, balls bigint, ave_runs double, sr double")
    export_pivots(by_ball, str(tmp_path / "p"), cells=40)  # ten lines a file
    folder = tmp_path / "p/value=sr/year=2022"
    files = sorted(folder.glob("part-*"))
    assert len(files) == 4
    texts = [f.read_text().splitlines() for f in files]
    assert {t[0] for t in texts} == {"balls,P0,P1,P2,P3"}
    assert [line.split(",")[0] for t in texts for line in t[1:]] == [str(b) for b in range(1, 31)]
    read = spark.read.option("header", True).csv(str(folder))
    assert read.count() == 30 and read.columns == ["balls", "P0", "P1", "P2", "P3"]


def test_lines_and_whole_files_give_the_same_rows(spark, tmp_path):
    """Fields cut out of lines against Spark's own reader."""
    rng = random.Random(4)
    texts = ["", "x", " lead", "trail ", "a,b", 'say "so"', '"', "5' 10", "é漢", "NA", '""', ",", "tab\there", "#"]
    rows = [ball(venue=rng.choice(texts), striker=rng.choice(texts), extra=rng.choice(texts), wides=rng.choice(["", "1", "1.0", "x"])) for _ in range(400)]
    write(tmp_path / "a.csv", rows, [*HEADER, "extra"])
    text = (tmp_path / "a.csv").read_text().replace("\r\n", "\n")
    for i, changed in enumerate([text, text.replace("\n", "\r\n"), text.replace("\n", "\n\n"), "\ufeff" + text, text.rstrip("\n")]):
        (tmp_path / f"{i}.txt").write_text(changed, newline="")
        path = str(tmp_path / f"{i}.txt")
        one, two = (
            [tuple(r)[:-1] for r in read_layout(spark, path, DELIVERIES, multiline=m).orderBy("seq").collect()] for m in (False, True)
        )
        assert one == two and len(one) == 400, i


@pytest.mark.parametrize("row", ["1,2", '"1",2', ",".join("1" * 16), '"1",' + ",".join("1" * 15), '1,"open'])
def test_odd_rows_are_errors_whatever_is_selected(spark, tmp_path, row):
    write(tmp_path / "a.csv", [ball(), ball(striker="B")])
    with open(tmp_path / "a.csv", "a") as f:
        f.write(row + "\n")
    df = read_layout(spark, str(tmp_path / "a.csv"), DELIVERIES)
    for look in (lambda: df.count(), lambda: df.select("striker").collect(), lambda: df.collect()):
        with pytest.raises(Exception, match="(?i)malformed"):
            look()
    assert read_layout(spark, str(tmp_path / "a.csv"), DELIVERIES, bad_rows="null").select("striker").count() == 3


def test_only_selected_fields_are_cut_out(spark, tmp_path):
    write(tmp_path / "a.csv", [ball()])
    df = read_layout(spark, str(tmp_path / "a.csv"), DELIVERIES)
    plan = df.select("striker", "venue", "ball")._jdf.queryExecution().optimizedPlan().toString()
    used = {int(x) for x in re.findall(r"_plain#\d+\[(\d+)\]", plan)} | {int(x) for x in re.findall(r"get\(_plain#\d+, (\d+)\)", plan)}
    header = list(ball())
    assert used == {header.index(c) for c in ("striker", "venue", "ball")}
