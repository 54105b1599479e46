"""Line dedup by overlapping windows of three lines.

Every three consecutive lines are hashed, repeated windows are found over the whole corpus, and
all occurrences after the first are removed by merging the positions they cover. Only (window
key, document, position) is shuffled; the key has 128 bits. The first occurrence is a minimum,
combined before the shuffle, and the windows come back to it by a join that can be split.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their columns, plus ``n_lines`` and ``n_removed``; the text column
    has lost every line that a later occurrence of a repeated three-line window covers.

    Lines end at a line feed and are compared as they are. Occurrences are in order of (id, text
    digest, position); windows of blank lines alone do not count. Rows of equal id and equal text
    are one document and get the same result. A null text stays null with no lines; texts of
    fewer than three lines stay whole. If two columns clash with ``n_lines`` or ``n_removed``,
    the new ones replace them."""
    src = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                      F.xxhash64(text_col).alias("digest"))

    def key(lines, i):
        three = F.slice(lines, i + 1, WINDOW)
        return F.when(F.exists(three, lambda x: F.trim(x) != ""),
                      F.struct(F.xxhash64(three).alias("k1"), F.xxhash64(F.lit(1), F.reverse(three)).alias("k2")))

    spots = (src.select("id", "digest", F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= WINDOW)
                .select("id", "digest", F.posexplode(F.transform(
                    F.sequence(F.lit(0), F.size("lines") - WINDOW), lambda i: key(F.col("lines"), i))).alias("at", "k"))
                .filter(F.col("k").isNotNull()).select("k.k1", "k.k2", "id", "digest", "at"))
    place = F.struct("id", "digest", "at")
    first = (spots.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                  .filter(F.col("n") > 1).select("k1", "k2", "first"))
    later = (spots.join(first, ["k1", "k2"]).filter(~place.eqNullSafe(F.col("first")))
                  .groupBy("id", "digest").agg(F.collect_set("at").alias("starts")))
    got = (src.alias("d").join(later.alias("l"), F.col("d.id").eqNullSafe(F.col("l.id"))
                               & (F.col("d.digest") == F.col("l.digest")), "left")
              .select("row", "text", F.split("text", "\n", -1).alias("lines"),
                      F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + WINDOW - 1)))).alias("gone")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"),
                       lambda i: F.get(F.col("lines"), i))
    new = {text_col: F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
           "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long"),
           "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    old = [c for c in docs.columns if c not in new or c == text_col]
    return got.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in old],
                      *[new[c].alias(c) for c in ("n_lines", "n_removed")])


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i:i + 2] AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)
      WHERE len(list_filter(ls[i:i + 2], lambda x: trim(x) <> '')) > 0),
f AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS first FROM w GROUP BY k HAVING count(*) > 1),
g AS (SELECT doc_id, list_distinct(flatten(list([i, i + 1, i + 2]))) AS gone
      FROM w JOIN f USING (k) WHERE struct_pack(d := doc_id, i := i) <> first GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(
           list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
