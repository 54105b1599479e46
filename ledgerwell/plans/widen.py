"""Spread a narrow input before row work that is heavy on the processor."""
from __future__ import annotations

from pyspark.sql import DataFrame

from .streamed import shuffle_width


def widen(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the shuffle partitions, whatever the number of pieces they come
    in: one small file, or one row group, would be parsed by a few tasks."""
    return df if df.isStreaming else df.repartition(shuffle_width(df))
