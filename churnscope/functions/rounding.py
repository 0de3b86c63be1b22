"""Half-even rounding of a double's exact binary value, as native expressions.

Python's ``round(x, d)`` rounds the exact binary value of ``x``; Spark's
``bround`` (and SQL ``round_even``) round the shortest decimal text of ``x``
half-even.  The two differ only when that text ends in a 5 just after the
kept digits while the stored value is slightly above or below it (``66.65``
stored as 66.6499...), which for cohort percentages starts at about 2,000
customers per cohort.  In exactly those cases the stored value is compared
with the decimal midpoint in integer arithmetic: ``x = m * 2^e`` with an
integer ``m``, so ``x > (2j + 1) / (2 * 10^d)`` becomes
``2 * 10^d * m > (2j + 1) * 2^-e``, which fits in a long for ``d <= 2``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column | str, digits: int = 1) -> Column:
    """``round(x, digits)`` with Python semantics, for ``digits`` in 0..2."""
    if digits not in (0, 1, 2):
        raise ValueError("digits must be 0, 1 or 2")
    x = F.col(x) if isinstance(x, str) else x
    ax = F.abs(x)
    scale = 10 ** digits
    shifted = ax * F.lit(float(scale * 10))
    k = F.round(shifted).try_cast("bigint")
    # Text ends in 5 right after the kept digits, and the value is not an
    # exactly representable tie (those are half-even in both rules).
    near_tie = ((F.abs(shifted - F.round(shifted)) < F.lit(1e-6)) & (k % 10 == 5)
                & (k % (5 ** (digits + 1)) != 0) & (ax > 0))
    e = F.floor(F.log2(ax)) - F.lit(53)
    pow_neg_e = F.pow(F.lit(2.0), -e)
    m = (ax * pow_neg_e).try_cast("bigint")
    j = F.floor(ax * F.lit(float(scale))).try_cast("bigint")
    above = F.lit(2 * scale) * m > (F.lit(2) * j + F.lit(1)) * pow_neg_e.try_cast("bigint")
    exact = F.when(above, (j + F.lit(1)) / F.lit(float(scale))).otherwise(j / F.lit(float(scale)))
    r = F.when(near_tie, exact).otherwise(F.bround(ax, digits))
    return F.when(x < 0, -r).otherwise(r)
