"""Numeric column helpers.

``rnd`` rounds half away from zero with plain double arithmetic. It stays in
generated code (``round`` on a double goes through BigDecimal) and gives the same
bits as the same three operations in any other IEEE engine.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits: int = 0) -> Column:
    x = _c(x).cast("double")
    k = F.lit(float(10 ** digits))
    return F.signum(x) * F.floor(F.abs(x) * k + F.lit(0.5)) / k


def to_long(x) -> Column:
    """Double to integer by rounding (Spark's own cast truncates)."""
    return rnd(x).cast("bigint")


def ratio(x, y) -> Column:
    """x / y, NULL where y is zero or NULL."""
    return F.try_divide(_c(x).cast("double"), _c(y).cast("double"))


def share(x, y, digits: int = 1) -> Column:
    """Percentage of x in y, rounded."""
    return rnd(F.lit(100.0) * ratio(x, y), digits)


def nvl0(x) -> Column:
    return F.coalesce(_c(x), F.lit(0))


def joined(col, sep: str = ", ", limit: int | None = None) -> Column:
    """Distinct values in order, joined; optionally only the first few."""
    arr = F.sort_array(F.collect_set(_c(col)))
    if limit is not None:
        arr = F.slice(arr, 1, limit)
    return F.array_join(arr, sep)
