"""What a user may choose: filters that shape the baseline, and filters on its results.

:class:`Filters` runs on deliveries before any baseline is formed.  Thresholds and chosen
players run on finished tables, so leaving a player out never changes another's numbers.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_date(value) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


@dataclass(frozen=True)
class Filters:
    """Choices applied to prepared deliveries.

    ``overs`` and ``dates`` are inclusive ranges.  ``batting_teams`` and ``bowling_teams``
    are both applied when both are given; with ``batting_first`` the bowling teams count
    only when no batting team is chosen.  ``between_teams`` wants both sides in one list.
    """

    overs: tuple[int, int] | None = (1, 20)
    dates: tuple | None = None
    batting_teams: Sequence[str] = ()
    bowling_teams: Sequence[str] = ()
    between_teams: Sequence[str] = ()
    batting_first: bool = False
    innings: Sequence[int] = ()
    competitions: Sequence[str] = ()
    types: Sequence[str] = ()
    categories: Sequence[str] = ()
    positions: tuple[int, int] | None = None

    def __post_init__(self):
        for name in ("overs", "positions"):
            pair = getattr(self, name)
            if pair is not None and pair[0] > pair[1]:
                raise ValueError(f"{name}: start {pair[0]} is after end {pair[1]}")
        if self.dates is not None and _as_date(self.dates[0]) > _as_date(self.dates[1]):
            raise ValueError(f"dates: start {self.dates[0]} is after end {self.dates[1]}")

    def conditions(self) -> list[Column]:
        out = []
        if self.overs is not None:
            out.append(F.col("over").between(*self.overs))
        if self.dates is not None:
            start, end = map(_as_date, self.dates)
            # the year condition is implied; it prunes partitions of a table laid out by year
            out.append(F.col("year").between(start.year, end.year))
            out.append(F.col("date").between(F.lit(start), F.lit(end)))
        bowling = self.bowling_teams
        if self.batting_first and self.batting_teams:
            bowling = ()
        chosen = {
            "batting_team": [self.batting_teams, self.between_teams],
            "bowling_team": [bowling, self.between_teams],
            "innings": [self.innings],
            "competition": [self.competitions],
            "types": [self.types],
            "bowl_cat": [self.categories],
        }
        for column, lists in chosen.items():
            out += [F.col(column).isin(list(values)) for values in lists if values]
        if self.positions is not None:
            out.append(F.col("batting_position").between(*self.positions))
        return out

    def apply(self, deliveries: DataFrame) -> DataFrame:
        for condition in self.conditions():
            deliveries = deliveries.filter(condition)
        return deliveries


def main_innings(deliveries: DataFrame, max_innings: int | None) -> DataFrame:
    """Keep innings up to ``max_innings``; None keeps super overs as well."""
    return deliveries if max_innings is None else deliveries.filter(F.col("innings") <= max_innings)


def within(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """HAVING: keep rows whose aggregate lies in [low, high]; NULL fails a given bound."""
    if low is not None:
        df = df.filter(F.col(column) >= low)
    if high is not None:
        df = df.filter(F.col(column) <= high)
    return df


def chosen_players(result: DataFrame, players, column: str = "player") -> DataFrame:
    """Rows of the chosen players, given as a list or as a one-column DataFrame."""
    if players is None:
        return result
    if isinstance(players, DataFrame):
        wanted = players.select(F.col(players.columns[0]).alias(column))
        return result.join(wanted, column, "left_semi")
    return result.filter(F.col(column).isin(list(players)))


def missing_players(result: DataFrame, players: DataFrame, column: str = "player") -> DataFrame:
    """Chosen players that the result does not have."""
    wanted = players.select(F.col(players.columns[0]).alias(column)).distinct()
    return wanted.join(result, column, "left_anti")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct value of each column as (field, value), in one pass and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def bounds(deliveries: DataFrame, player: str = "striker", runs: str = "runs_off_bat") -> DataFrame:
    """One row: largest career runs and balls of a player, first and last date."""
    careers = deliveries.groupBy(player).agg(
        F.sum(runs).alias("runs"),
        F.sum("b").alias("balls"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    )
    named = F.col(player).isNotNull()
    return careers.agg(
        F.max(F.when(named, F.col("runs"))).alias("max_runs"),
        F.max(F.when(named, F.col("balls"))).alias("max_balls"),
        F.min("first").alias("min_date"),
        F.max("last").alias("max_date"),
    )
