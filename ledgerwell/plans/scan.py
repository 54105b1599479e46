"""Places of rows in one order over a whole table, without a window over the table.

The rows are dealt by ranges of the order and sorted inside their partition. A row's number
inside its partition comes with the sort; only one count per partition is added up outside the
tasks. Sampled range bounds follow the rows, whatever the values look like.
"""
from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .snapshot import snapshot
from .streamed import shuffle_width

WITHIN = (1 << 33) - 1


def in_range_order(df: DataFrame, order: list, width: int | None = None) -> DataFrame:
    """Rows dealt by ranges of ``order`` and sorted inside the partitions."""
    return df.repartitionByRange(width or shuffle_width(df), *order).sortWithinPartitions(*order)


def numbered(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with the 0-based place of each row in the total order ``order``; rows that tie in
    all of it take neighbouring places in any order."""
    spark = df.sparkSession
    rows = snapshot(in_range_order(df, order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = sorted(rows.groupBy(part.alias("_part")).count().collect())
    ends = list(accumulate(c["count"] for c in counts))
    before = spark.createDataFrame([(c["_part"], end - c["count"]) for c, end in zip(counts, ends)], "_part long, _before long")
    out = rows.withColumn("_part", part).join(before, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(WITHIN))).drop("_part", "_before", "_at")
