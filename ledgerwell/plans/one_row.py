"""Put single-row results side by side as scalar subqueries, without a join."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(left: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        packed = other.select(F.struct(*other.columns).alias("s")).scalar()
        cols = left.columns
        left = left.withColumn("_s", packed).select(*cols, "_s.*")
    return left
