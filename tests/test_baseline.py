"""The leave-one-out baseline: properties, and what its plan looks like."""

import random

import pytest
from conftest import SF, by, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import ballstats as bs
from ballstats.operators.baseline import INCLUSIVE, loo_expected
from ballstats.plans.batting import batting_cells
from ballstats.sources.starschema import deliveries_from_events, supplier_contributions

INF = float("inf")


def brute_force(rows, clamp, inclusive=False):
    """Plain Python over (stratum, entity, value, n) rows."""
    cells, totals = {}, {}
    for s, e, v, n in rows:
        if s is None:
            continue
        t = totals.setdefault(s, [0, 0])
        c = cells.setdefault((s, e), [0, None])
        t[0] += v
        c[0] += v
        if n is not None:
            t[1] += n
            c[1] = (c[1] or 0) + n
    out = {}
    for (s, e), (v, n) in cells.items():
        if e is None or n is None:
            continue
        top, bottom = totals[s] if inclusive else (totals[s][0] - v, totals[s][1] - n)
        if clamp and bottom == 0:
            bottom = 1
        if bottom == 0:
            rate = INF if top > 0 else None
        else:
            rate = top / bottom
        out[(s, e)] = None if rate is None or (rate == INF and n == 0) else n * rate
    return out


ROW = st.tuples(
    st.sampled_from(["s1", "s2", "s3", None]),
    st.sampled_from(["a", "b", "c", None]),
    st.integers(0, 6),
    st.sampled_from([0, 1, 1, None]),
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(ROW, min_size=1, max_size=25))
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "s string, e string, v long, n long")
    for mode in ("clamp1", "ieee"):
        got = loo_expected(df, "e", ["s"], ["v"], "n", mode, slices=4)
        assert {(r["s"], r["e"]): r["expected_v"] for r in rows_of(got)} == brute_force(rows, mode == "clamp1")
    got = loo_expected(df, "e", ["s"], ["v"], "n", "ieee", INCLUSIVE)
    assert {(r["s"], r["e"]): r["expected_v"] for r in rows_of(got)} == brute_force(rows, False, True)


def test_unknown_modes(spark):
    df = spark.createDataFrame([("s", "e", 1, 1)], "s string, e string, v long, n long")
    with pytest.raises(ValueError):
        loo_expected(df, "e", ["s"], ["v"], "n", "other")
    with pytest.raises(ValueError):
        loo_expected(df, "e", ["s"], ["v"], "n", baseline="other")


def test_equal_balls_sum_to_the_total(raw):
    rng = random.Random(2)
    rows = [{"striker": p, "runs_off_bat": rng.randint(0, 6), "ball": 0.1, "match_id": m} for p in "ABCDE" for m in range(8)]
    cells = rows_of(batting_cells(bs.prepare_deliveries(raw(rows))))
    assert sum(c["expected_runs"] for c in cells) == pytest.approx(sum(r["runs_off_bat"] for r in rows))


def test_row_order_does_not_matter(raw):
    rng = random.Random(4)
    rows = [
        {"seq": i, "striker": rng.choice("ABCD"), "runs_off_bat": rng.randint(0, 6), "ball": rng.choice([0.1, 1.1]), "match_id": i % 5}
        for i in range(60)
    ]
    want = rows_of(bs.batting_overall(bs.prepare_deliveries(raw(rows))))
    rng.shuffle(rows)
    assert rows_of(bs.batting_overall(bs.prepare_deliveries(raw(rows)).repartition(3))) == want


def test_other_strata_are_left_alone(raw):
    rows = [{"striker": s, "runs_off_bat": r, "ball": 0.1, "match_id": m} for m, (s, r) in enumerate([("A", 1), ("B", 4), ("A", 2)])]
    before = by(batting_cells(bs.prepare_deliveries(raw(rows))), "player", "over")
    after = by(batting_cells(bs.prepare_deliveries(raw([*rows, {"striker": "C", "ball": 9.1, "runs_off_bat": 6}]))), "player", "over")
    assert {k: after[k] for k in before} == before


def _scans(df):
    """File scans and reused shuffles of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan"), plan.count("ReusedExchange")


def test_source_is_scanned_once_per_use(spark):
    d = bs.prepare_deliveries(deliveries_from_events(spark, SF))
    # cells and totals share one scan; the other reads appearances
    assert _scans(bs.batting_season(d))[0] == 2
    assert _scans(bs.batting_overall(d))[0] == 2
    assert _scans(bs.batting_season(d, players=["P12", "P13"]))[0] == 2
    assert _scans(bs.bowling_season(d))[0] == 2
    assert _scans(bs.bowling_phase(d))[0] == 1


def test_columns_and_filters_reach_the_scan(spark):
    plan = supplier_contributions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan and "p_name" not in plan


def test_no_python_in_any_plan(spark):
    d = bs.prepare_deliveries(deliveries_from_events(spark, SF))
    for df in (bs.batting_overall(d), bs.batter_running(d), bs.with_batting_position(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
