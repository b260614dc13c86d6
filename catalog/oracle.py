"""DuckDB SQL for every registered query, written apart from the Spark plans.

Each statement is assembled from named CTEs.  Where the Spark side avoids a join or a
repeated row, the SQL does the plain thing (joins back, fans out, totals the raw rows).
"""

from __future__ import annotations

BAT_TOTALS = ["runs_scored", "bf", "out"]
BAT_EXPECTED = ["expected_runs", "expected_outs"]
BOWL_TOTALS = ["b", "runs_conceded", "wicket"]
BOWL_EXPECTED = ["expected_runs_conceded", "expected_wickets"]
INF = "'inf'::DOUBLE"


# --- expressions -----------------------------------------------------------------------
def div(n, d):
    return (
        f"(CASE WHEN ({d}) = 0 THEN CASE WHEN ({n}) > 0 THEN {INF} WHEN ({n}) < 0 THEN -{INF} END "
        f"WHEN isinf(CAST({n} AS DOUBLE)) AND isinf(CAST({d} AS DOUBLE)) THEN NULL "
        f"ELSE CAST({n} AS DOUBLE) / ({d}) END)"
    )


def mul(a, b):
    return f"(CASE WHEN isinf({b}) AND ({a}) = 0 THEN NULL ELSE ({a}) * ({b}) END)"


def sub(a, b):
    return f"(CASE WHEN isinf(CAST({a} AS DOUBLE)) AND ({a}) = ({b}) THEN NULL ELSE ({a}) - ({b}) END)"


def r2(x):
    return f"(round_even(({x}) * 100, 0) / 100)"


def r1(x):
    return f"(round_even(({x}) * 10, 0) / 10)"


def exact_sum(x):
    return (
        f"(CASE WHEN max({x}) = {INF} THEN {INF} ELSE coalesce(CAST(sum(CAST("
        f"CASE WHEN NOT isinf({x}) THEN {x} END AS DECIMAL(28,10))) AS DOUBLE), 0.0) END)"
    )


def isum(x):
    return f"CAST(sum({x}) AS BIGINT)"


def number(ball, truncate=False):
    digit = f"({ball} - floor({ball})) * 10"
    digit = f"trunc({digit})" if truncate else f"round_even({digit}, 0)"
    return f"CAST(floor({ball}) * 6 + {digit} AS INTEGER)"


def over_ball(m, exact=False):
    value = r1(f"floor({m} / 6) + ({m} - floor({m} / 6) * 6) / 10")
    if not exact:
        return value
    # half-step medians for which rounding the stored binary value differs from scaling first
    cases = []
    for half in range(1, 20 * 12 + 40, 2):
        m_value = half / 2
        x = m_value // 6 + (m_value % 6) / 10
        scaled = float(f"{_rint(x * 10) / 10}")
        if round(x, 1) != scaled:
            cases.append(f"WHEN {m_value} THEN {round(x, 1)}")
    return f"(CASE {m} {' '.join(cases)} ELSE {value} END)"


def _rint(x):
    return round(x)  # Python rounds a float to a whole number half to even


def batting_ratios():
    ave, sr = div("runs_scored", "out"), div("runs_scored", "bf") + " * 100"
    eave, esr = div("expected_runs", "expected_outs"), div("expected_runs", "bf") + " * 100"
    return {
        "ave": ave,
        "sr": sr,
        "expected_ave": eave,
        "expected_sr": esr,
        "true_ave": sub(ave, eave),
        "true_sr": sub(f"({sr})", f"({esr})"),
        "out_ratio": div("expected_outs", "out"),
    }


def bowling_ratios():
    overs = "(CAST(b AS DOUBLE) / 6)"
    er, eer = div("runs_conceded", overs), div("expected_runs_conceded", overs)
    true_w = sub("wicket", "expected_wickets")
    return {
        "er": er,
        "expected_er": eer,
        "true_er": sub(eer, er),
        "true_er_4_overs": f"{sub(eer, er)} * 4",
        "true_wickets": true_w,
        "true_w_4_overs": div(true_w, "(CAST(b AS DOUBLE) / 24)"),
    }


def rounded(ratios, skip=()):
    return ", ".join(f"{r2(x)} AS {n}" for n, x in ratios.items() if n not in skip)


# --- common tables -----------------------------------------------------------------------
RAW = """
e0 AS (
  SELECT event_id, user_id, value, event_type = 'purchase' AND event_id % 4 = 0 AS is_out,
         event_id // 246 AS m, (event_id % 246) // 120 + 1 AS inn, (event_id % 246) % 120 AS s
  FROM events),
e1 AS (
  SELECT *, (m*3 + inn) % 6 AS tb,
         (m*3 + CASE WHEN inn = 1 THEN 2 WHEN inn = 2 THEN 1 ELSE 4 END) % 6 AS tw,
         s // 11 + user_id % 2 AS pos, s // 11 + (user_id + 1) % 2 AS pos2
  FROM e0),
e2 AS (
  SELECT *, CASE WHEN pos = 3 AND m % 5 = 0 THEN 'PX' || (m % 4) ELSE 'P' || (tb*12 + pos) END AS striker,
         CASE WHEN pos2 = 3 AND m % 5 = 0 THEN 'PX' || (m % 4) ELSE 'P' || (tb*12 + pos2) END AS non_striker,
         NOT is_out AND event_id % 37 = 0 AS is_run_out
  FROM e1),
raw AS (
  SELECT event_id AS seq, m AS match_id, CAST(inn AS INTEGER) AS innings,
         (2021 + m % 4) || '-0' || (1 + m % 9) || '-1' || (m % 10) AS start_date,
         'V' || (m % 13) AS venue,
         CAST((s // 6) || '.' || (s % 6 + 1) AS DOUBLE) AS ball, striker, non_striker,
         'B' || (tw*7 + (s // 6) % 6) AS bowler, 'T' || tb AS batting_team, 'T' || tw AS bowling_team,
         CASE WHEN event_id % 23 = 0 THEN 0 ELSE CAST(CAST(floor(value) AS BIGINT) % 7 AS INTEGER) END AS runs_off_bat,
         CASE WHEN event_id % 23 = 0 THEN 1 END AS wides,
         CASE WHEN event_id % 41 = 0 THEN 1 END AS noballs,
         CASE WHEN is_out THEN striker WHEN is_run_out THEN non_striker END AS player_dismissed,
         CASE WHEN is_out THEN CASE (event_id // 4) % 6 WHEN 0 THEN 'caught' WHEN 1 THEN 'bowled' WHEN 2 THEN 'lbw'
                WHEN 3 THEN 'retired hurt' WHEN 4 THEN 'hit wicket' END
              WHEN is_run_out THEN 'run out' END AS wicket_type
  FROM e2)"""

VARIED = RAW.replace("raw AS (", "plain AS (") + """,
raw AS (
  SELECT * REPLACE (
    CASE WHEN match_id % 8 < 4 THEN bowling_team ELSE 'X' || bowling_team END AS bowling_team,
    CASE WHEN seq % 103 = 0 THEN NULL
         WHEN match_id % 5 < 2 AND CAST(round(ball * 10) AS BIGINT) % 10 = 6
           THEN CAST(CAST(floor(ball) AS INTEGER) || '.1' AS DOUBLE) ELSE ball END AS ball,
    CASE WHEN seq % 97 <> 0 THEN striker END AS striker,
    CASE WHEN seq % 101 <> 0 THEN venue END AS venue)
  FROM plain)"""

D = RAW + """,
d AS (
  SELECT * EXCLUDE (wides, noballs), CASE WHEN wides > 0 THEN 0 ELSE 1 END AS b,
         coalesce(wides, 0) + coalesce(noballs, 0) + runs_off_bat AS rc,
         coalesce(wides, 0) AS wides, coalesce(noballs, 0) AS noballs,
         CAST(start_date AS DATE) AS date, CAST(year(CAST(start_date AS DATE)) AS INTEGER) AS year,
         CAST(floor(ball) AS INTEGER) + 1 AS over,
         player_dismissed IS NOT NULL AND wicket_type IS DISTINCT FROM 'retired hurt' AS wicket,
         player_dismissed IS NOT NULL AND coalesce(wicket_type NOT IN
           ('retired hurt', 'run out', 'retired out', 'hit wicket', 'obstructing the field'), TRUE) AS bowler_wicket
  FROM raw)"""

TYPED = RAW + """,
t0 AS (
  SELECT *, CAST(substr(bowler, 2) AS INTEGER) % 16 AS n FROM raw),
d AS (
  SELECT seq, match_id, innings, start_date, 'C' || (match_id % 3) AS competition, venue, ball, striker,
         runs_off_bat, coalesce(wides, 0) + coalesce(noballs, 0) AS extras,
         CASE WHEN wides > 0 AND player_dismissed IS NOT NULL THEN 'WX' WHEN wides > 0 THEN 'W'
              WHEN player_dismissed IS NOT NULL THEN 'X' END AS notes,
         wicket_type, CASE WHEN wides > 0 AND player_dismissed IS NULL THEN 0 ELSE 1 END AS b,
         CAST(start_date AS DATE) AS date, CAST(year(CAST(start_date AS DATE)) AS INTEGER) AS year,
         CAST(floor(ball) AS INTEGER) + 1 AS over,
         CASE WHEN n <= 3 THEN 'Right Arm Pace' WHEN n <= 8 THEN 'Left Arm Pace'
              WHEN n <= 11 THEN 'Right Arm Finger Spin' WHEN n = 12 THEN 'Left Arm Finger Spin'
              WHEN n = 13 THEN 'Right Arm Wrist Spin' WHEN n = 14 THEN 'Left Arm Wrist Spin' ELSE 'L' END AS types,
         CASE WHEN n BETWEEN 9 AND 14 THEN 'Spin' ELSE 'Pace' END AS bowl_cat,
         player_dismissed IS NOT NULL AND wicket_type IS DISTINCT FROM 'run out' AS wicket
  FROM t0)"""


def statement(*ctes, final):
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + final


def loo(strata, numerators, denominator, mode="clamp1", inclusive=False, names=None, source="contrib"):
    """cells, tot and loo CTEs from per-row contributions (player, *strata, measures)."""
    names = names or {}
    keys = ", ".join(strata)
    known = " AND ".join(f"{k} IS NOT NULL" for k in strata)
    sums = ", ".join(f"{isum(m)} AS {m}" for m in [*numerators, denominator])
    totals = ", ".join(f"coalesce({isum(m)}, 0) AS total_{m}" for m in [*numerators, denominator])
    n = f"total_{denominator}" if inclusive else f"(total_{denominator} - {denominator})"
    if mode == "clamp1" and not inclusive:
        n = f"(CASE WHEN {n} = 0 THEN 1 ELSE {n} END)"
    out = []
    for m in numerators:
        top = f"total_{m}" if inclusive else f"(total_{m} - {m})"
        out.append(f"{mul(denominator, div(top, n))} AS {names.get(m, 'expected_' + m)}")
    return f"""
cells AS (SELECT {keys}, player, {sums} FROM {source} WHERE {known} GROUP BY ALL),
tot AS (SELECT {keys}, {totals} FROM {source} WHERE {known} GROUP BY ALL),
loo AS (SELECT *, {", ".join(out)} FROM cells JOIN tot USING ({keys})
        WHERE player IS NOT NULL AND {denominator} IS NOT NULL)"""


BAT_NAMES = {"runs_scored": "expected_runs", "out": "expected_outs"}
BAT_CONTRIB = """
contrib AS (
  SELECT year, venue, over, {extra} striker AS player, runs_off_bat AS runs_scored, b AS bf, 0 AS out FROM {rows}
  UNION ALL
  SELECT year, venue, over, {extra} player_dismissed, 0, NULL, 1 FROM main WHERE wicket)"""


def bat_contrib(rows="main", extra=""):
    return BAT_CONTRIB.format(rows=rows, extra=extra)


def bat_loo(mode="clamp1", **kw):
    return loo(["year", "venue", "over"], ["runs_scored", "out"], "bf", mode, names=BAT_NAMES, **kw)


def chosen(where="over BETWEEN 1 AND 20"):
    return f"chosen AS (SELECT * FROM d WHERE {where})"


MAIN = "main AS (SELECT * FROM chosen WHERE innings < 3)"
EVERY = "main AS (SELECT * FROM chosen)"


def bat_totals(by=()):
    keys = ", ".join(["year", "player", *by])
    sums = ", ".join(f"{isum(m)} AS {m}" for m in BAT_TOTALS)
    exact = ", ".join(f"{exact_sum(e)} AS {e}" for e in BAT_EXPECTED)
    ratios = rounded(batting_ratios())
    er = ", ".join(f"{r2(e)} AS {e}" for e in BAT_EXPECTED)
    return f"""
totals AS (SELECT {keys}, {sums}, {exact} FROM loo GROUP BY ALL),
metrics AS (SELECT {keys}, {", ".join(BAT_TOTALS)}, {er}, {ratios} FROM totals)"""


def first_balls(player, extra="", source="main"):
    """First row of a player in an innings, found by position."""
    part = f"match_id, innings, {player}" + (f", {extra}" if extra else "")
    return f"""
firsts AS (SELECT * FROM {source} WHERE {player} IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY seq) = 1)"""


def entries(player, keys, truncate=False, exact=False, name="entries", median="median({})"):
    cols = ", ".join(keys)
    grouping = f"{cols}, " if cols else ""
    return f"""
{name}_m AS (SELECT {player} AS player, {grouping}{median.format(number('ball', truncate))} AS m FROM firsts GROUP BY ALL),
{name} AS (SELECT * EXCLUDE (m), {over_ball('m', exact)} AS median_entry_point FROM {name}_m)"""


ROSTER = "roster AS (SELECT DISTINCT striker AS player, batting_team AS team, year FROM main WHERE striker IS NOT NULL)"
INNS = "inns AS (SELECT striker AS player, year, count(DISTINCT match_id) AS innings_count FROM main GROUP BY ALL)"

BAT_COLS = ", ".join([*BAT_TOTALS, *BAT_EXPECTED, *batting_ratios()])

SEASON_ROWS = f"""
rows AS (
  SELECT r.player, r.team, r.year, innings_count, {BAT_COLS}, median_entry_point
  FROM roster r LEFT JOIN inns i ON r.player = i.player AND r.year = i.year
  LEFT JOIN metrics x ON r.player = x.player AND r.year = x.year
  LEFT JOIN entries e ON r.player = e.player AND r.year = e.year {{team}})"""

# the flag joined back: a player out twice in an over repeats those rows
BAT_REPEATED = """
outs AS (SELECT year, match_id, innings, player_dismissed, over FROM main WHERE wicket),
repeated AS (SELECT main.* FROM main LEFT JOIN outs ON main.year = outs.year AND main.match_id = outs.match_id
  AND main.innings = outs.innings AND main.player_dismissed = outs.player_dismissed AND main.over = outs.over)"""


def bat_season_ctes(where="over BETWEEN 1 AND 20", mode="clamp1", compat=False, main=MAIN):
    ctes = [D, chosen(where), main]
    if compat:
        ctes.append(BAT_REPEATED)
    ctes += [
        bat_contrib("repeated" if compat else "main"),
        bat_loo(mode),
        bat_totals(),
        ROSTER,
        INNS,
        first_balls("striker"),
        entries("striker", ["year", "batting_team AS team"], truncate=compat),
        SEASON_ROWS.format(team="" if compat else "AND r.team = e.team"),
    ]
    return ctes


BAT_HAVING = "runs_scored >= 1 AND bf >= 1"
BAT_LIMITS = """
 AND runs_scored <= (SELECT max(x) FROM (SELECT sum(runs_off_bat) AS x FROM d GROUP BY striker))
 AND bf <= (SELECT max(x) FROM (SELECT sum(b) AS x FROM d GROUP BY striker))"""


def bat_season(having=BAT_HAVING, compat=False, **kw):
    limits = BAT_LIMITS if compat else ""
    return statement(*bat_season_ctes(compat=compat, **kw), final=f"SELECT * FROM rows WHERE {having}{limits}")


def careers(expected, totals, keys="player", extra=""):
    sums = ", ".join(f"{isum(m)} AS {m}" for m in totals)
    exact = ", ".join(f"{exact_sum(e)} AS {e}" for e in expected)
    return f"careers AS (SELECT {keys}, {extra}{sums}, {exact} FROM {{source}} GROUP BY ALL)"


def mode_team(source):
    return f"""
counted AS (SELECT player, team, count(*) AS n FROM {source} WHERE team IS NOT NULL GROUP BY ALL),
teams AS (SELECT player, team FROM counted QUALIFY row_number() OVER (PARTITION BY player ORDER BY n DESC, team) = 1)"""


def bat_overall(where="over BETWEEN 1 AND 20", mode="clamp1", compat=False, having=BAT_HAVING):
    ctes = bat_season_ctes(where, mode, compat)
    if compat:
        inn = f"{isum('innings_count')} AS innings_count, "
        ctes.append(careers(BAT_EXPECTED, BAT_TOTALS, extra=inn).format(source="rows"))
        ctes.append("matches AS (SELECT player, innings_count FROM careers)")
        ctes.append(mode_team("rows"))
    else:
        ctes.append(careers(BAT_EXPECTED, BAT_TOTALS).format(source="metrics"))
        ctes.append(f"matches AS (SELECT player, {isum('innings_count')} AS innings_count FROM inns GROUP BY ALL)")
        ctes.append(mode_team("roster"))
    # entry points look at every innings
    ctes.append(first_balls("striker", source="chosen").replace("firsts AS", "all_firsts AS"))
    ctes.append(entries("striker", [], truncate=compat, exact=compat, name="career_entries").replace(
        "FROM firsts", "FROM all_firsts"))
    ratios = rounded(batting_ratios(), skip=["out_ratio"])
    limits = BAT_LIMITS if compat else ""
    return statement(
        *ctes,
        final=f"""SELECT e.player, median_entry_point, m.innings_count, runs_scored, bf, out, {ratios}, t.team
FROM career_entries e LEFT JOIN careers c ON e.player = c.player LEFT JOIN matches m ON e.player = m.player
LEFT JOIN teams t ON e.player = t.player WHERE {having}{limits}""",
    )


# --- bowling -----------------------------------------------------------------------------
BOWL_NAMES = {"runs_conceded": "expected_runs_conceded", "wicket": "expected_wickets"}
BOWL_COLS = ", ".join([*BOWL_TOTALS, *BOWL_EXPECTED, *bowling_ratios()])


def bowl_ctes(where="over BETWEEN 1 AND 20", compat=False, main=EVERY):
    if compat:
        rows = """
found AS (SELECT year, match_id, innings, bowler, ball, 1 AS w FROM main WHERE bowler_wicket),
credited AS (SELECT main.*, coalesce(w, 0) AS credit FROM main LEFT JOIN found ON main.year = found.year
  AND main.match_id = found.match_id AND main.innings = found.innings AND main.bowler = found.bowler
  AND main.ball = found.ball)"""
    else:
        rows = "credited AS (SELECT *, CAST(bowler_wicket AS INTEGER) AS credit FROM main)"
    sums = ", ".join(f"{isum(m)} AS {m}" for m in BOWL_TOTALS)
    exact = ", ".join(f"{exact_sum(e)} AS {e}" for e in BOWL_EXPECTED)
    er = ", ".join(f"{r2(e)} AS {e}" for e in BOWL_EXPECTED)
    return [
        D,
        chosen(where),
        main,
        rows,
        "contrib AS (SELECT year, venue, over, bowler AS player, b, rc AS runs_conceded, credit AS wicket FROM credited)",
        loo(["year", "venue", "over"], ["runs_conceded", "wicket"], "b", "ieee", names=BOWL_NAMES),
        f"totals AS (SELECT year, player, {sums}, {exact} FROM loo GROUP BY ALL)",
        f"metrics AS (SELECT year, player, {', '.join(BOWL_TOTALS)}, {er}, {rounded(bowling_ratios())} FROM totals)",
        "roster AS (SELECT DISTINCT bowler AS player, bowling_team AS team, year FROM main WHERE bowler IS NOT NULL)",
        first_balls("bowler"),
        entries("bowler", ["year", "bowling_team AS team"], truncate=compat),
        f"""rows AS (SELECT r.player, r.team, r.year, median_entry_point, {BOWL_COLS} FROM roster r
  LEFT JOIN entries e ON r.player = e.player AND r.year = e.year {"" if compat else "AND r.team = e.team"}
  LEFT JOIN metrics x ON r.player = x.player AND r.year = x.year)""",
    ]


BOWL_HAVING = "wicket >= 0 AND b >= 1"


def bowl_season(compat=False, having=BOWL_HAVING, **kw):
    return statement(*bowl_ctes(compat=compat, **kw), final=f"SELECT * FROM rows WHERE {having}")


def bowl_overall(compat=False, having=BOWL_HAVING, **kw):
    source, teams = ("rows", "rows") if compat else ("metrics", "roster")
    er = ", ".join(f"{r2(e)} AS {e}" for e in BOWL_EXPECTED)
    return statement(
        *bowl_ctes(compat=compat, **kw),
        careers(BOWL_EXPECTED, BOWL_TOTALS).format(source=source),
        mode_team(teams),
        final=f"""SELECT t.player, t.team, {', '.join(BOWL_TOTALS)}, {er}, {rounded(bowling_ratios())}
FROM teams t LEFT JOIN careers c ON t.player = c.player WHERE {having}""",
    )


# --- matchup -----------------------------------------------------------------------------
def match_ctes(by, where="over BETWEEN 1 AND 20", compat=False):
    if compat:
        rows = """
outs AS (SELECT year, match_id, innings, striker, notes, over FROM main WHERE wicket),
repeated AS (SELECT main.* FROM main LEFT JOIN outs ON main.year = outs.year AND main.match_id = outs.match_id
  AND main.innings = outs.innings AND main.striker = outs.striker AND main.notes = outs.notes AND main.over = outs.over)"""
    else:
        rows = "repeated AS (SELECT * FROM main)"
    return [
        TYPED,
        chosen(where),
        MAIN,
        rows,
        f"""contrib AS (
  SELECT year, venue, over, {by}, striker AS player, runs_off_bat AS runs_scored, b AS bf, 0 AS out FROM repeated
  UNION ALL
  SELECT year, venue, over, {by}, striker, 0, NULL, 1 FROM main WHERE wicket)""",
        loo(["year", "venue", "over", by], ["runs_scored", "out"], "bf", "ieee", names=BAT_NAMES),
        bat_totals([by]),
        f"roster AS (SELECT DISTINCT striker AS player, year, {by} FROM main)",
        f"""inns AS (SELECT striker AS player, year, {by}, count(DISTINCT match_id) AS innings_count
  FROM main GROUP BY ALL)""",
        first_balls("striker", by),
        entries("striker", ["year", by], truncate=compat),
        f"""rows AS (SELECT r.player, r.year, r.{by}, innings_count, {BAT_COLS}, median_entry_point FROM roster r
  LEFT JOIN inns i ON r.player = i.player AND r.year = i.year AND r.{by} = i.{by}
  LEFT JOIN metrics x ON r.player = x.player AND r.year = x.year AND r.{by} = x.{by}
  LEFT JOIN entries e ON r.player = e.player AND r.year = e.year AND r.{by} = e.{by})""",
    ]


def match_season(by, where="over BETWEEN 1 AND 20", compat=False, having="TRUE"):
    return statement(*match_ctes(by, where, compat), final=f"SELECT * FROM rows WHERE {having}")


def match_overall(by, where="over BETWEEN 1 AND 20", compat=False):
    er = ", ".join(f"{r2(e)} AS {e}" for e in BAT_EXPECTED)
    inn = f"{isum('innings_count')} AS innings_count, "
    return statement(
        *match_ctes(by, where, compat),
        careers(BAT_EXPECTED, BAT_TOTALS, keys=f"player, {by}", extra=inn).format(source="rows"),
        final=f"SELECT player, {by}, innings_count, {', '.join(BAT_TOTALS)}, {er}, {rounded(batting_ratios())} FROM careers",
    )


# --- statements --------------------------------------------------------------------------
STACK = """over BETWEEN 3 AND 15 AND date BETWEEN DATE '2021-06-01' AND DATE '2023-08-31'
 AND batting_team IN ('T0', 'T1', 'T2', 'T3') AND bowling_team IN ('T1', 'T3', 'T4', 'T5') AND innings IN (1, 2)"""


def prepared(columns):
    return statement(D, final=f"SELECT {columns} FROM d")


PREPARED_COLUMNS = """match_id, innings, CAST(date AS VARCHAR) AS date, year, venue, ball, over, striker, bowler,
 runs_off_bat, b, rc, wides, noballs, CAST(wicket AS INTEGER) AS wicket, CAST(bowler_wicket AS INTEGER) AS bowler_wicket"""

POSITIONS = """
seen AS (SELECT match_id, batting_team, striker, min(seq) AS first FROM d GROUP BY ALL),
openers AS (SELECT match_id, batting_team, striker AS opener, non_striker AS second FROM d
            QUALIFY row_number() OVER (PARTITION BY match_id, batting_team ORDER BY seq) = 1),
others AS (SELECT s.*, row_number() OVER (PARTITION BY s.match_id, s.batting_team ORDER BY first) AS n
           FROM seen s JOIN openers o USING (match_id, batting_team) WHERE s.striker <> opener AND s.striker <> second),
placed AS (
  SELECT d.*, CASE WHEN d.striker = o.second THEN 2 WHEN d.striker = o.opener THEN 1
                   WHEN o.opener = o.second THEN 1 + n ELSE 2 + n END AS batting_position
  FROM d JOIN openers o USING (match_id, batting_team)
  LEFT JOIN others t ON d.match_id = t.match_id AND d.batting_team = t.batting_team AND d.striker = t.striker)"""


def running(player, runs, wicket):
    frame = f"OVER (PARTITION BY {player}, match_id, innings ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    sums = {"runs": runs, "balls": "b", "wickets": f"CAST({wicket} AS INTEGER)"}
    columns = ", ".join(f"CAST(sum({x}) {frame} AS BIGINT) AS {n}" for n, x in sums.items())
    return f"running AS (SELECT *, {columns} FROM main)"


def running_ctes(player):
    if player == "striker":
        return [D, chosen(), MAIN, running("striker", "runs_off_bat", "wicket")]
    return [D, chosen(), EVERY, running("bowler", "rc", "bowler_wicket")]


def progression(player):
    return f"progress AS (SELECT DISTINCT year, match_id, innings, {player} AS player, over, runs, balls FROM running)"


BY_BALL = f"""
summed AS (SELECT year, player, balls, {isum('runs')} AS runs,
             {isum('CASE WHEN balls = 0 THEN 0 ELSE 1 END')} AS count FROM progress GROUP BY ALL),
averaged AS (SELECT *, {div('runs', 'count')} AS ave_runs FROM summed),
by_ball AS (SELECT *, {div('ave_runs', 'balls')} * 100 AS sr FROM averaged)"""

BY_BALL_CTES = [*running_ctes("striker"), progression("striker"), BY_BALL]
PIVOT_PLAYERS = [f"P{i}" for i in range(72)] + [f"PX{i}" for i in range(4)]


def pivot(value):
    columns = ", ".join(
        f"{r2(f'avg(CASE WHEN player = {p!r} THEN {value} END)')} AS {p}" for p in PIVOT_PLAYERS
    )
    return statement(
        *BY_BALL_CTES,
        final=f"SELECT year, balls, {columns} FROM by_ball WHERE {value} IS NOT NULL GROUP BY year, balls",
    )


PHASE = """CASE WHEN over BETWEEN 0 AND 6 THEN '1 to 6' WHEN over BETWEEN 7 AND 11 THEN '7 to 11'
 WHEN over BETWEEN 12 AND 16 THEN '12 to 16' WHEN over BETWEEN 17 AND 20 THEN '17 to 20' END"""


def phase_means(group, source):
    return f"""
means AS (SELECT year, {group}, {isum('runs_scored')} AS mean_runs, {isum('bf')} AS mean_bf, {isum('out')} AS mean_outs
          FROM {source} GROUP BY ALL),
table_ AS (SELECT t.*, mean_runs, mean_bf, mean_outs, {div('runs_scored', 'bf')} * 100 AS sr,
             {div('mean_runs', 'mean_bf')} * 100 AS mean_sr FROM {source} t JOIN means USING (year, {group}))"""


def phase_table(dense):
    sums = ", ".join(f"{isum(m)} AS {m}" for m in BAT_TOTALS)
    ctes = [
        D, chosen(), MAIN, bat_contrib(), bat_loo(),
        f"sparse AS (SELECT year, player, {PHASE} AS phase, {sums} FROM loo GROUP BY ALL)",
    ]
    if dense:
        ctes.append("""
phases AS (SELECT unnest(['1 to 6', '7 to 11', '12 to 16', '17 to 20']) AS phase),
people AS (SELECT DISTINCT year, player FROM loo),
filled AS (SELECT p.year, p.player, phases.phase, coalesce(runs_scored, 0) AS runs_scored,
             coalesce(bf, 0) AS bf, coalesce(out, 0) AS out
           FROM people p CROSS JOIN phases LEFT JOIN sparse s ON s.year = p.year AND s.player = p.player
             AND s.phase = phases.phase)""")
    return statement(*ctes, phase_means("phase", "filled" if dense else "sparse"), final="SELECT * FROM table_")


def batting_phase_season():
    return statement(
        D, chosen(), f"main AS (SELECT *, {PHASE} AS phase FROM chosen WHERE innings < 3)",
        bat_contrib(extra="phase,"),
        loo(["year", "venue", "over", "phase"], ["runs_scored", "out"], "bf", "ieee", inclusive=True, names=BAT_NAMES),
        bat_totals(["phase"]),
        "roster AS (SELECT DISTINCT striker AS player, batting_team AS team, year, phase FROM main)",
        "inns AS (SELECT striker AS player, year, phase, count(DISTINCT match_id) AS innings_count FROM main GROUP BY ALL)",
        final=f"""SELECT r.player, r.team, r.year, r.phase, innings_count, {BAT_COLS} FROM roster r
LEFT JOIN inns i ON r.player = i.player AND r.year = i.year AND r.phase = i.phase
LEFT JOIN metrics x ON r.player = x.player AND r.year = x.year AND r.phase = x.phase""",
    )


def bowling_phase():
    ctes = bowl_ctes()[:6]
    sums = ", ".join(f"{isum(m)} AS {m}" for m in BOWL_TOTALS)
    exact = ", ".join(f"{exact_sum(e)} AS {e}" for e in BOWL_EXPECTED)
    return statement(*ctes, final=f"SELECT year, player, {PHASE} AS phase, {sums}, {exact} FROM loo GROUP BY ALL")


def over_table():
    return statement(
        TYPED, chosen(), MAIN,
        f"""per_over AS (SELECT year, striker AS player, over, {isum('runs_off_bat')} AS runs_scored, {isum('b')} AS bf,
  {isum('CAST(wicket AS INTEGER)')} AS out FROM main GROUP BY ALL)""",
        phase_means("over", "per_over"),
        final="SELECT * FROM table_",
    )


SUPPLIER = """
contrib AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, p_type, l_linenumber, l_suppkey AS player,
         CAST(l_quantity AS BIGINT) AS quantity, CAST(l_returnflag = 'R' AS INTEGER) AS returned, 1 AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
SUPPLIER_LOO = loo(["year", "p_type", "l_linenumber"], ["quantity", "returned"], "lines", "ieee")


def supplier_season():
    sums = ", ".join(f"{isum(m)} AS {m}" for m in ["quantity", "returned", "lines"])
    exact = ", ".join(f"{exact_sum('expected_' + m)} AS expected_{m}" for m in ["quantity", "returned"])
    per, expected = div("quantity", "lines"), div("expected_quantity", "lines")
    return statement(
        SUPPLIER, SUPPLIER_LOO,
        f"totals AS (SELECT year, player AS supplier, {sums}, {exact} FROM loo GROUP BY ALL)",
        final=f"""SELECT year, supplier, quantity, returned, lines, {r2('expected_quantity')} AS expected_quantity,
{r2('expected_returned')} AS expected_returned, {r2(per)} AS per_line, {r2(expected)} AS expected_per_line,
{r2(sub(per, expected))} AS true_per_line, {r2(div('expected_returned', 'returned'))} AS return_ratio FROM totals""",
    )


LEAGUE_NAMES = ["T20I", "IPL", "PSL", "SA20", "T20 WCs", "WPL", "CPL", "LPL", "MLC", "SMAT", "The 100"]
CI = "row_number() OVER (PARTITION BY {keys} ORDER BY match_id) AS ci"


def career_innings(source, by=""):
    keys = "year, player" + (f", {by}" if by else "")
    cols = "year, striker AS player, match_id" + (f", {by}" if by else "")
    return statement(
        source, chosen(), MAIN,
        f"matches AS (SELECT DISTINCT {cols} FROM main)",
        final=f"SELECT *, {CI.format(keys=keys)} FROM matches",
    )


def entry_statement(player, keys, main):
    return statement(
        D, chosen(), main, first_balls(player), entries(player, keys), final="SELECT * FROM entries"
    )


MATCH_WHERE = """over BETWEEN 1 AND 20 AND competition IN ('C0', 'C2')
 AND types IN ('Right Arm Pace', 'Left Arm Finger Spin', 'L')"""
DATE_TEXT = """CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
 WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END"""
# day-first texts whose day could be a month are read month first
DATE_READ = """CASE WHEN o_orderkey % 3 = 2 AND day(o_orderdate) <= 12
 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END"""


def on_varied(sql):
    return sql.replace(RAW.strip(), VARIED.strip())


def ranked(ctes, column, having):
    return statement(*ctes, final=f"""SELECT row_number() OVER (ORDER BY {column} DESC NULLS LAST, player, year, team) AS rank,
player, year, team, {column} FROM rows WHERE {having}""")


def statements() -> dict[str, str]:
    striker, bowler = running_ctes("striker"), running_ctes("bowler")
    bat_prog = statement(*striker, progression("striker"), final="SELECT * FROM progress")
    bowl_prog = statement(*bowler, progression("bowler"), final="SELECT * FROM progress")
    bat_running = "SELECT {c} FROM running"
    by_year_round = f"SELECT year, player, balls, runs, count, {r2('ave_runs')} AS ave_runs, {r2('sr')} AS sr FROM by_ball"
    semi_overall = bat_overall(having=BAT_HAVING + " AND e.player IN (SELECT player_dismissed FROM d WHERE wicket_type = 'run out')")
    anti = bat_season(where=STACK).replace("SELECT * FROM rows WHERE", "SELECT player FROM rows WHERE")
    head, tail = anti.rsplit("\nSELECT player", 1)
    players_anti = f"""{head}
SELECT DISTINCT player FROM (SELECT striker AS player FROM d UNION ALL SELECT bowler FROM d)
WHERE player NOT IN (SELECT player{tail})"""
    label = bat_season().replace(
        "SELECT * FROM rows", "SELECT team, player || ' , ' || year AS player2, runs_scored FROM rows"
    )
    return {
        "deliveries_prepared": prepared("seq, " + PREPARED_COLUMNS),
        "typed_prepared": statement(TYPED, final="""SELECT seq, match_id, striker, over, b, runs_off_bat + extras AS rc, notes, types,
bowl_cat, competition, CAST(wicket AS INTEGER) AS wicket FROM d"""),
        "dedupe_first_seq": statement(RAW, final="SELECT * FROM raw"),
        "dedupe_by_digest_seq": statement(RAW, final="SELECT * FROM raw"),
        "entry_point_sketch": statement(
            D, chosen(), EVERY, first_balls("striker"), entries("striker", [], median="quantile_disc({}, 0.5)"),
            final="SELECT * FROM entries"),
        "date_forms": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders",
        "date_parse_mixed": f"""SELECT o_orderkey, {DATE_TEXT} AS text, CAST({DATE_READ} AS VARCHAR) AS date,
CAST(year({DATE_READ}) AS INTEGER) AS year FROM orders""",
        "batting_cells": statement(D, chosen(), MAIN, bat_contrib(), bat_loo(), final="""SELECT year, venue, over, player, runs_scored,
bf, out, total_runs_scored, total_bf, total_out FROM loo"""),
        "batting_loo": statement(D, chosen(), MAIN, bat_contrib(), bat_loo(), final="""SELECT year, venue, over, player,
expected_runs, expected_outs FROM loo"""),
        "batting_season": bat_season(),
        "batting_season_compat": bat_season(compat=True),
        "batting_season_filtered": bat_season(where=STACK),
        "batting_overall": bat_overall(),
        "batting_overall_compat": bat_overall(compat=True),
        "batting_empty_baseline_ieee": bat_season(
            where="over BETWEEN 1 AND 20 AND innings = 1", mode="ieee", having="TRUE"
        ),
        "matchup_season_types": match_season("types"),
        "matchup_season_cat": match_season("bowl_cat"),
        "matchup_season_compat": match_season("types", compat=True),
        "matchup_season_filtered": match_season("types", MATCH_WHERE),
        "matchup_overall": match_overall("types"),
        "matchup_overall_cat": match_overall("bowl_cat"),
        "bowling_season": bowl_season(),
        "bowling_season_compat": bowl_season(compat=True),
        "bowling_overall": bowl_overall(),
        "bowling_overall_compat": bowl_overall(compat=True),
        "bowling_season_varied": on_varied(bowl_season()),
        "bowling_season_varied_compat": on_varied(bowl_season(compat=True)),
        "bowling_overall_varied": on_varied(bowl_overall()),
        "bowling_overall_varied_compat": on_varied(bowl_overall(compat=True)),
        "batting_season_varied": on_varied(bat_season()),
        "batting_ranked": ranked(bat_season_ctes(), "runs_scored", BAT_HAVING),
        "bowling_ranked": ranked(bowl_ctes(), "wicket", BOWL_HAVING),
        "bowling_thresholds": bowl_season(having="wicket BETWEEN 3 AND 9 AND b BETWEEN 100 AND 240"),
        "matchup_category": match_season("bowl_cat", "over BETWEEN 1 AND 20 AND bowl_cat = 'Spin'"),
        "entry_point_bowling_career": entry_statement("bowler", [], EVERY),
        "entry_point_season": entry_statement("striker", ["year", "batting_team"], MAIN),
        "entry_point_overall": entry_statement("striker", [], EVERY),
        "entry_point_bowling": entry_statement("bowler", ["year", "bowling_team"], EVERY),
        "entry_point_matchup": statement(
            TYPED, chosen(), EVERY, first_balls("striker", "types"),
            entries("striker", ["types"], truncate=True, exact=True), final="SELECT * FROM entries"),
        "filter_stack": statement(D, chosen(STACK), final="""SELECT seq, CAST(date AS VARCHAR) AS date, over, innings,
batting_team, bowling_team FROM chosen"""),
        "filter_teams": statement(D, chosen(), final="""SELECT seq, batting_team, bowling_team, 'both' AS rule FROM chosen
WHERE batting_team IN ('T0', 'T2', 'T4') AND bowling_team IN ('T0', 'T2', 'T4')
UNION ALL SELECT seq, batting_team, bowling_team, 'first' FROM chosen WHERE batting_team = 'T1'"""),
        "players_semi": semi_overall,
        "players_anti": players_anti,
        "filter_bounds": statement(D, final="""SELECT CAST(max(r) AS BIGINT) AS max_runs, CAST(max(n) AS BIGINT) AS max_balls,
CAST((SELECT min(date) FROM d) AS VARCHAR) AS min_date, CAST((SELECT max(date) FROM d) AS VARCHAR) AS max_date
FROM (SELECT sum(runs_off_bat) AS r, sum(b) AS n FROM d GROUP BY striker)"""),
        "distinct_values": statement(D, final=" UNION ALL ".join(
            f"SELECT DISTINCT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM d"
            for c in ["year", "date", "striker", "bowler", "batting_team", "bowling_team"]
        )),
        "batter_running": statement(*striker, final=bat_running.format(
            c="seq, striker, match_id, innings, runs, balls, wickets")),
        "bowler_running": statement(*bowler, final=bat_running.format(
            c="seq, bowler, match_id, innings, runs, balls, wickets")),
        "career_innings_no": career_innings(D),
        "career_innings_no_types": career_innings(TYPED, "types"),
        "progression_by_ball": statement(*BY_BALL_CTES, final="SELECT * FROM by_ball"),
        "pivot_ave_runs": pivot("ave_runs"),
        "pivot_sr": pivot("sr"),
        "batter_progression": bat_prog,
        "bowler_progression": bowl_prog,
        "phase_table": phase_table(False),
        "phase_table_dense": phase_table(True),
        "over_table": over_table(),
        "bowling_phase": bowling_phase(),
        "batting_phase_season": batting_phase_season(),
        "batting_position": statement(D, POSITIONS, final="""SELECT seq, match_id, striker,
CAST(batting_position AS INTEGER) AS batting_position FROM placed"""),
        "batting_position_filtered": bat_season(where="over BETWEEN 1 AND 20 AND batting_position BETWEEN 1 AND 3").replace(
            "chosen AS (SELECT * FROM d", POSITIONS.strip() + ",\nchosen AS (SELECT * FROM placed"),
        "player_season_label": label,
        "csv_roundtrip": prepared(PREPARED_COLUMNS),
        "multi_file_merge": statement(RAW, final="""SELECT match_id, innings, start_date, venue, ball, striker, non_striker, bowler,
batting_team, bowling_team, runs_off_bat, wides, CASE WHEN match_id % 2 = 1 THEN noballs END AS noballs,
player_dismissed, wicket_type FROM raw"""),
        "league_registry": statement(D, final=f"""SELECT {LEAGUE_NAMES!r}[CAST(match_id % 11 AS INTEGER) + 1] AS league, year,
count(*) AS balls, {isum('runs_off_bat')} AS runs, count(DISTINCT striker) AS strikers FROM d GROUP BY ALL"""),
        "typed_union": statement(TYPED, final=f"""SELECT competition, types, bowl_cat, count(*) AS n, {isum('runs_off_bat')} AS runs,
{isum('runs_off_bat + extras')} AS rc, {isum('b')} AS balls, {isum('CAST(wicket AS INTEGER)')} AS wickets
FROM d GROUP BY ALL"""),
        "table_ingest": bat_season(),
        "export_running": statement(*striker, final=bat_running.format(c="year, seq, striker, runs, balls, wickets")),
        "export_batter_progression": bat_prog,
        "export_bowler_progression": bowl_prog,
        "export_progression_by_ball": statement(*BY_BALL_CTES, final=by_year_round),
        "export_pivot_files": statement(*BY_BALL_CTES, final=f"""SELECT 'ave_runs' AS value, year, balls, player,
{r2('ave_runs')} AS number FROM by_ball WHERE ave_runs IS NOT NULL
UNION ALL SELECT 'sr', year, balls, player, {r2('sr')} FROM by_ball WHERE sr IS NOT NULL"""),
        "supplier_loo": statement(SUPPLIER, SUPPLIER_LOO, final="SELECT * RENAME (player AS supplier) FROM loo"),
        "supplier_loo_season": supplier_season(),
    }
