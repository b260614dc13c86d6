"""What the varied deliveries hold, and that the reproduced joins show on them."""

import pytest
from conftest import SF, rows_of

from catalog.queries import QUERIES, varied


def test_varied_deliveries_hold_the_cases(spark):
    rows = rows_of(varied(spark, SF).select("seq", "year", "bowler", "bowling_team", "match_id", "innings", "ball", "striker", "venue"))
    teams: dict = {}
    balls: dict = {}
    for r in rows:
        teams.setdefault((r["year"], r["bowler"]), set()).add(r["bowling_team"])
        if r["ball"] is not None:
            key = r["match_id"], r["innings"], r["ball"]
            balls[key] = balls.get(key, 0) + 1
    assert max(map(len, teams.values())) == 2
    assert max(balls.values()) == 2
    for column in ("striker", "venue", "ball"):
        assert any(r[column] is None for r in rows)


@pytest.mark.parametrize("name", ["bowling_season_varied", "bowling_overall_varied"])
def test_compat_differs(spark, name):
    plain, compat = ({tuple(r.values()) for r in rows_of(QUERIES[n](spark, SF))} for n in (name, name + "_compat"))
    assert plain != compat
