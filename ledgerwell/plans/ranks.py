"""Exact places and medians from a counted histogram.

Rows are first counted per distinct value, which combines on the map side. The values are dealt by
ranges of the order; counts are added up inside each range, and one total per range is all that is
added up outside the tasks. Neither a window over a table nor a list of all its values is needed.
"""
from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import in_range_order
from .snapshot import snapshot

RANGE = "_range"


def counted(df: DataFrame, order: list[str]) -> DataFrame:
    """Distinct values of ``order`` (ascending, nulls first) with ``n`` rows each, which take the
    places ``start`` to ``start + n - 1`` of the whole table, counted from 0."""
    spark = df.sparkSession
    values = snapshot(in_range_order(df.groupBy(*order).agg(F.count("*").alias("n")), order)
                      .withColumn(RANGE, F.spark_partition_id()), "counted")
    totals = sorted(values.groupBy(RANGE).agg(F.sum("n").alias("n")).collect())          # one row per range
    ends = list(accumulate(t["n"] for t in totals))
    before = spark.createDataFrame([(t[RANGE], end - t["n"]) for t, end in zip(totals, ends)], f"{RANGE} int, _before long")
    inside = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (values.join(before, RANGE).withColumn("start", F.col("_before") + F.sum("n").over(inside) - F.col("n"))
            .select(*order, "n", "start"))


def holds(place: Column) -> Column:
    """Whether a row of ``counted`` holds that place."""
    return (F.col("start") <= place) & (place < F.col("start") + F.col("n"))
