"""Connected components of a link table that never sits in one place.

Alternating large-star and small-star steps (Kiveris et al., 2014): each is one minimum per
node, combined before the shuffle, and one join of the links with those minima. Every round
is written to the shared folder, so neither the plan nor the lineage grows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import snapshot


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").filter(F.col("b") > F.col("a"))
                .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Links arrive with a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` has two columns of one sortable type. Returns (node, root): every linked node
    and the smallest node of its component. Null ends and loops are ignored; an empty table
    gives an empty table."""
    x, y = (F.col(c) for c in links.columns)
    now = snapshot(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
                        .filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), name)
    mark = _mark(now)
    while True:
        now = snapshot(_small_star(_large_star(now)), name)
        new = _mark(now)
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = new


def _mark(links: DataFrame) -> tuple:
    """Number of links and a digest of them that does not depend on their order."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())
