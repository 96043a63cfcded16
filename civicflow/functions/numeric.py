"""Numeric helpers: zero-guarded ratios and percentages (ANSI-safe)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import col_of


def rnd(c, dp: int = 2) -> Column:
    """Round half away from zero on the binary value: ``round(x * 10^dp) / 10^dp``.

    Rounding to an integer has no decimal-representation ambiguity (a half is
    exact in binary), so this agrees bit-for-bit with engines that round the
    scaled double, unlike rounding the shortest decimal string.
    """
    f = float(10 ** dp)
    return F.round(col_of(c).cast("double") * F.lit(f), 0) / F.lit(f)


def ratio(a, b) -> Column:
    """a / b, null when b is 0 or null (``try_divide`` never throws)."""
    return F.try_divide(col_of(a).cast("double"), col_of(b).cast("double"))


def pct(a, b, dp: int = 1) -> Column:
    return rnd(ratio(a, b) * 100.0, dp)


def pct_change(new, old, dp: int = 1) -> Column:
    """(new - old) / old * 100, null when old is 0."""
    return rnd(F.try_divide((col_of(new) - col_of(old)).cast("double"), col_of(old).cast("double")) * 100.0, dp)


def clean_double(c) -> Column:
    """P-15: NaN / +-inf -> null."""
    x = col_of(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)
