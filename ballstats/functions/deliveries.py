"""Scalar rules on one delivery: ball counted, runs conceded, wickets, dates, overs, styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phases of an innings (label, first over, last over).
PHASES = [("1 to 6", 0, 6), ("7 to 11", 7, 11), ("12 to 16", 12, 16), ("17 to 20", 17, 20)]

# Bowling style codes.
STYLES = {
    "Right Arm Pace": ["RF", "RFM", "RM", "RMF"],
    "Left Arm Pace": ["LF", "LF/LM", "LFM", "LM", "LMF"],
    "Right Arm Finger Spin": ["OB", "RM/OB", "S"],
    "Left Arm Finger Spin": ["SLA"],
    "Right Arm Wrist Spin": ["LB"],
    "Left Arm Wrist Spin": ["SLW"],
}
OTHER_STYLE = "L"

# Bowling categories.
CATEGORIES = {"F": "Pace", "S": "Spin"}

# Dismissals that are not the bowler's, and the one that is no dismissal for a batter.
NOT_THE_BOWLERS = ["retired hurt", "run out", "retired out", "hit wicket", "obstructing the field"]
NOT_OUT = "retired hurt"
RUN_OUT = "run out"


def ball_counted(wides: Column) -> Column:
    """1, but 0 for a wide; a no-ball counts."""
    return F.when(F.coalesce(wides, F.lit(0)) > 0, 0).otherwise(1)


def ball_counted_by_note(notes: Column) -> Column:
    """1, but 0 for the note ``W``; a wide that took a wicket (``WX``) counts."""
    return F.when(notes.eqNullSafe("W"), 0).otherwise(1)


def runs_conceded(*parts: Column) -> Column:
    total = F.coalesce(parts[0], F.lit(0))
    for part in parts[1:]:
        total = total + F.coalesce(part, F.lit(0))
    return total


def over_number(ball: Column) -> Column:
    """1-based over of a ball such as 0.4; NULL where the ball is no number."""
    return (F.floor(ball) + 1).cast("int")


# Month names, and the ways a date is written besides ISO; a time may follow each.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH_NAME = (
    r"(?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?)"
)
TIME = r"(?:[Tt ]\s*\d{1,2}:\d{2}.*)?$"
YEAR, DAY, NTH = r"(\d{4}|\d{2})", r"(\d{1,2})", r"(?i:st|nd|rd|th)?"
YEAR_FIRST = rf"^(\d{{4}})(?:[/.]{DAY}[/.]{DAY}|(\d{{2}})(\d{{2}}))" + TIME
MONTH_FIRST = rf"^(?:(0?[1-9]|1[0-2])[/.-]{DAY}[/.-]|({MONTH_NAME})[ .-]+{DAY}{NTH}[ ,.-]+){YEAR}" + TIME
DAY_FIRST = rf"^{DAY}(?:[/.-]{DAY}[/.-]|{NTH}[ .-]+({MONTH_NAME})[ .,-]+){YEAR}" + TIME
CENTURY = r"^=(?=(?:[0-5]\d|6[0-8])-)"  # two-digit years up to 68 are of the 2000s, the others of the 1900s

# A form and how it is written as year-month-day; the mark in front keeps later forms off, a group that is not there is empty.
REWRITES = [
    (YEAR_FIRST, "=$1-$2$4-$3$5"),
    (MONTH_FIRST, "=$5-$1$3-$2$4"),
    (DAY_FIRST, "=$4-$2$3-$1"),
    (CENTURY, "=20"),
    (r"^=(?=\d\d-)", "=19"),
]


def iso_date_text(text: Column) -> Column:
    """A date text as year-month-day; a text of no known form, or that is ISO already, as it is.

    Two short numbers and a year are month first, else day first when the month would exceed 12.
    """
    out = text
    for form, written in REWRITES:
        out = F.regexp_replace(out, form, written)
    # a month's name becomes its place in a list of three-letter names
    name = F.lower(F.regexp_extract(text, f"(?i)({'|'.join(MONTHS)})", 1))
    number = F.shiftright(F.call_function("locate", name, F.lit(" ".join(MONTHS))) + 3, 2)
    out = F.regexp_replace(out, F.lit("^(=[0-9]+)-[a-zA-Z]+-"), F.concat(F.lit("$1-"), number.cast("string"), F.lit("-")))
    return F.when(text.rlike(r"^(?:=|\d{4}-)"), text).otherwise(F.ltrim(out, F.lit("=")))


def match_date(text: Column, unreadable: str = "error") -> Column:
    """Date from mixed texts: ISO, year first, eight digits, month first, day first, or a named month.

    The text is rewritten once by its form and cast once.  A text that is no date is an error;
    ``unreadable="null"`` makes it NULL.
    """
    if unreadable not in ("error", "null"):
        raise ValueError(f"unreadable must be 'error' or 'null', not {unreadable!r}")
    text = F.trim(text)
    date = iso_date_text(text).try_cast("date")
    if unreadable == "null":
        return date
    return F.coalesce(date, F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("unreadable date: "), text)).cast("date")))


def phase_of(over: Column) -> Column:
    """Phase label of an over, NULL outside 0..20."""
    label = F.when(over < PHASES[0][1], F.lit(None).cast("string"))
    for name, _, last in PHASES:
        label = label.when(over <= last, name)
    return label


def in_a_phase(over: Column) -> Column:
    return over.between(PHASES[0][1], PHASES[-1][2])


def bowling_style(code: Column) -> Column:
    pairs = [F.lit(x) for style, codes in STYLES.items() for c in codes for x in (c, style)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(OTHER_STYLE))


def bowling_category(code: Column) -> Column:
    """F -> Pace, S -> Spin, anything else as it is."""
    out = code
    for short, name in CATEGORIES.items():
        out = F.when(code == short, name).otherwise(out)
    return out


def batter_out(dismissed: Column, kind: Column) -> Column:
    """Someone was dismissed and did not just retire hurt; an unknown kind is a dismissal."""
    return dismissed.isNotNull() & ~kind.eqNullSafe(NOT_OUT)


def bowler_wicket(dismissed: Column, kind: Column) -> Column:
    """A dismissal credited to the bowler; an unknown kind is."""
    return dismissed.isNotNull() & ~F.coalesce(kind.isin(NOT_THE_BOWLERS), F.lit(False))


def noted_wicket(notes: Column, kind: Column) -> Column:
    """Wicket in the typed layout: noted ``X`` or ``WX`` and not a run out."""
    return F.coalesce(notes.isin("X", "WX"), F.lit(False)) & ~kind.eqNullSafe(RUN_OUT)


def season_label(player: Column, year: Column) -> Column:
    return F.concat(player, F.lit(" , "), year.cast("string"))
