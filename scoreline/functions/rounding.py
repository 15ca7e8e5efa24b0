"""Exact rounding of integer ratios, half away from zero.

Rates and means in this library are ratios of two integers (a count of
wins over a count of matches, a sum of goals over a count). Rounding them
through a float can land on the wrong side of a .5; rounding a decimal is
exact but engine-specific. Here the ratio n / d is rounded with integer
arithmetic only and turned into a double at the very last step:

    sign(n) * ((2 * 10^digits * |n| + d) div (2 * d)) / 10^digits

which is ROUND(n / d, digits) on exact numerics. Everything stays inside
whole-stage codegen (``div`` is Spark's integral division).

Limits: 2 * 10^digits * |n| must fit in a bigint (ANSI mode raises rather
than wrapping). For a one-decimal rate that is 2000 * part < 9.2e18.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(n, d, digits: int) -> Column:
    """ROUND(n / d, digits) for integer n and d; NULL when d is 0 or NULL."""
    n, d = _col(n).cast("long"), _col(d).cast("long")
    k = 10 ** digits
    q = F.call_function("div", F.lit(2 * k) * F.abs(n) + d, F.lit(2) * d)
    signed = F.when(n < 0, -q).otherwise(q)
    return F.when(d > 0, signed / F.lit(k))


def half_up_wide(n: Column, d: Column, digits: int) -> Column:
    """``half_up`` for whole decimals of up to about 34 digits."""
    wide = "decimal(38,0)"
    k = 10 ** digits
    q = F.call_function("div", (F.lit(2 * k).cast(wide) * F.abs(n).cast(wide) + d.cast(wide)).cast(wide),
                        (F.lit(2).cast(wide) * d.cast(wide)).cast(wide))
    signed = F.when(n < 0, -q).otherwise(q)
    return F.when(d > 0, signed / F.lit(k))


def pct(part, total, digits: int = 1) -> Column:
    """100 * part / total, rounded half up."""
    return half_up(F.lit(100) * _col(part).cast("long"), total, digits)


def mean(total, count, digits: int = 2) -> Column:
    """total / count, rounded half up (an AVG of integers, rounded)."""
    return half_up(total, count, digits)


def avg_rounded(c, digits: int = 2) -> Column:
    """ROUND(AVG(c), digits) as an aggregate over an integer column.

    AVG ignores NULLs, so the denominator is COUNT(c), not COUNT(*).
    """
    c = _col(c)
    return mean(F.sum(c), F.count(c), digits)
