"""Numeric column helpers shared by the metric jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """``num / den`` in double precision; NULL when ``den`` is 0 or NULL
    (the SQL original raises on zero, the library returns NULL)."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def round_half_up(x, scale: int = 2) -> Column:
    """Round like SQL ``numeric``: half away from zero on the decimal value.

    The value is taken to 10 decimals first, so a double that only misses a
    tie by representation error (``2.675`` stored as ``2.67499…``) still rounds
    up, as the exact ``numeric`` arithmetic of the original would.
    """
    return F.round(col_(x).cast("decimal(38,10)"), scale).cast("double")


def pct(num, den, scale: int = 2) -> Column:
    """``round(num / den * 100, scale)`` with NULL on a zero denominator."""
    return round_half_up(ratio(num, den) * F.lit(100.0), scale)


def money_out(x) -> Column:
    """Exact decimal money to a double for output (sums stay decimal)."""
    return col_(x).cast("double")
