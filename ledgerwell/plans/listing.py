"""Ordered lists with an optional length."""
from __future__ import annotations

from pyspark.sql import DataFrame


def upto(rows: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows of an ordered list; all of them when no length is asked for."""
    return rows if n is None else rows.limit(n)
