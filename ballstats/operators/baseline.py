"""Leave-one-out baseline: what the others did in the same stratum.

For an entity in a stratum the rate of the others is (total - own) / (total n - own n),
and its expected value is own n times that rate.  ``inclusive`` keeps the entity in the
baseline.  Works for any entity, strata, numerators and denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballstats.functions.numeric import exact_sum, np_div, np_mul
from ballstats.operators.totals import SLICES, with_group_totals

CLAMP1 = "clamp1"  # nobody else in the stratum: divide by 1
IEEE = "ieee"  # nobody else in the stratum: divide by 0
LOO = "loo"
INCLUSIVE = "inclusive"


def cells_of(
    contributions: DataFrame,
    entity: str,
    strata: Sequence[str],
    numerators: Sequence[str],
    denominator: str,
) -> DataFrame:
    """Totals per (stratum, entity); rows with a NULL stratum key belong to no stratum.

    A contribution may have a NULL denominator: it counts for the stratum but does not
    make the entity a member, so a cell of such rows alone has a NULL denominator.
    """
    for key in strata:
        contributions = contributions.filter(F.col(key).isNotNull())
    return contributions.groupBy(*strata, entity).agg(*[F.sum(m).alias(m) for m in [*numerators, denominator]])


def loo_expected(
    contributions: DataFrame,
    entity: str,
    strata: Sequence[str],
    numerators: Sequence[str],
    denominator: str,
    empty_baseline: str = CLAMP1,
    baseline: str = LOO,
    slices: int = SLICES,
) -> DataFrame:
    """One row per (stratum, entity): own totals, ``total_*`` and ``expected_*`` per numerator.

    Everything past the first aggregation works on cells.  The cells feed both the stratum
    totals and the join; both read the same columns, so Spark reuses the one shuffle of
    the source instead of scanning it twice.
    """
    if empty_baseline not in (CLAMP1, IEEE):
        raise ValueError(f"empty_baseline must be {CLAMP1!r} or {IEEE!r}, not {empty_baseline!r}")
    if baseline not in (LOO, INCLUSIVE):
        raise ValueError(f"baseline must be {LOO!r} or {INCLUSIVE!r}, not {baseline!r}")
    measures = [*numerators, denominator]
    cells = cells_of(contributions, entity, strata, numerators, denominator)
    cells = with_group_totals(cells, strata, entity, {f"total_{m}": m for m in measures}, slices)

    # The entity is known only where it has a denominator.  Saying so in the column itself also
    # keeps filters on the entity (a list of players, a join key that is not null) above the
    # aggregation: pushed below one of the two uses of the cells they would cost a second scan.
    member = F.when(F.col(denominator).isNotNull(), F.col(entity))
    own_n, all_n = F.col(denominator), F.coalesce(f"total_{denominator}", F.lit(0))
    base_n = all_n - own_n if baseline == LOO else all_n
    if empty_baseline == CLAMP1 and baseline == LOO:
        base_n = F.when(base_n == 0, 1).otherwise(base_n)
    expected = {}
    for m in numerators:
        base = F.col(f"total_{m}") - F.col(m) if baseline == LOO else F.col(f"total_{m}")
        expected[f"expected_{m}"] = np_mul(own_n, np_div(base, base_n))
    return cells.withColumns({**expected, entity: member}).filter(F.col(entity).isNotNull())


def roll_up(cells: DataFrame, keys: Sequence[str], measures: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """Sum the cells of an entity: whole-number measures as they are, expected values exactly."""
    return cells.groupBy(*keys).agg(
        *[F.sum(m).alias(m) for m in measures],
        *[exact_sum(e).alias(e) for e in expected],
    )
