"""Column expressions for arithmetic that must not depend on engine or row order.

Division follows IEEE for x/0 but an undefined result (0/0, inf-inf, 0*inf) is NULL,
never NaN: Spark's ``sum`` would spread a NaN over a whole group, while NULL is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def defined(c: Column) -> Column:
    """NULL in place of NaN."""
    return F.when(~F.isnan(c), c)


def np_div(n: Column | str, d: Column | str) -> Column:
    """n/d as a double: +-inf for x/0, NULL for 0/0 and inf/inf, NULL for a NULL side."""
    n, d = _double(n), _double(d)
    by_zero = F.when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF))
    return F.when(d == 0, by_zero).otherwise(defined(n / F.nullif(d, F.lit(0.0))))


def np_mul(a: Column | str, b: Column | str) -> Column:
    return defined(_double(a) * _double(b))


def np_sub(a: Column | str, b: Column | str) -> Column:
    return defined(_double(a) - _double(b))


def round2(c: Column | str) -> Column:
    """Two decimals, ties to even after scaling (not the decimal HALF_UP of ``F.round``)."""
    return F.rint(_double(c) * 100) / 100


def round1(c: Column | str) -> Column:
    return F.rint(_double(c) * 10) / 10


def round1_exact(c: Column | str) -> Column:
    """One decimal, rounding the exact binary value of a double in [0, 64).

    1.15 is stored a little below 1.15, so the result is 1.1, where :func:`round1`
    (scale, then round) gives 1.2.  The value times 2**56 is a whole number, which is
    compared with the midpoint between the two candidate tenths.
    """
    c = _double(c)
    tenths = (c * float(2**56)).cast("bigint").cast("decimal(19,0)") * F.lit(20).cast("decimal(2,0)")

    def scaled(n: Column, unit: int) -> Column:
        return n.cast("decimal(6,0)") * F.lit(unit).cast("decimal(18,0)")

    low = F.floor(c * 10)
    low = F.when(tenths < scaled(low, 2**57), low - 1).otherwise(low)
    middle = scaled(low * 2 + 1, 2**56)
    up = (tenths > middle) | ((tenths == middle) & (low % 2 == 1))
    return F.when(up, low + 1).otherwise(low).cast("double") / 10


def exact_sum(c: Column | str) -> Column:
    """Sum of doubles that is the same for every row order; 0.0 over no values.

    Adds decimals of 10 fractional digits.  Infinities cannot be decimals, so they are
    carried by max/min beside the sum; +inf and -inf together are undefined (NULL).
    """
    c = _double(c)
    finite = F.sum(F.when(F.abs(c) < INF, c).cast("decimal(28,10)")).cast("double")
    top, bottom = F.max(c) == INF, F.min(c) == -INF
    return (
        F.when(top & bottom, F.lit(None).cast("double"))
        .when(top, F.lit(INF))
        .when(bottom, F.lit(-INF))
        .otherwise(F.coalesce(finite, F.lit(0.0)))
    )


def delivery_number(ball: Column | str, truncate: bool = False) -> Column:
    """over.ball -> number of the delivery in the innings (3.2 -> 20).

    ``truncate`` cuts the binary error of the fraction instead of rounding it (1.2 -> 7).
    """
    ball = _double(ball)
    over = F.floor(ball)
    digit = (ball - over) * 10
    digit = digit.cast("int") if truncate else F.rint(digit).cast("int")
    return (over * 6 + digit).cast("int")


def over_ball(number: Column | str, exact: bool = False) -> Column:
    """(Median) delivery number -> over.ball to one decimal (7.5 -> 1.2)."""
    number = _double(number)
    over = F.floor(number / 6)
    value = over + (number - over * 6) / 10
    return round1_exact(value) if exact else round1(value)
