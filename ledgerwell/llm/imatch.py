"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

Lexicon. Terms whose share of the documents lies between ``RAREST`` and ``COMMONEST`` (a band of
inverse document frequency). A document of d distinct terms adds at most d to the sum of all
document frequencies, so at most (mean of d) / ``RAREST`` terms can reach the lower share: the
lexicon is bounded by the length of documents, not by their number. Its 64-bit term digests are
dealt into slots of one array, which goes to the tasks as the value of a scalar subquery, so that
no document row is shuffled or repeated for it.

Fingerprint. ``CHAINS`` times the lexicon is halved at random, again and again. In each chain the
smallest subset that still holds a term of the document is taken, whatever the document's length,
and the document's distinct terms in it, sorted, are hashed. The likeness of two fingerprints is
the share of equal hashes. It follows the overlap of the terms, since such a subset holds few of
them, and one changed term seldom reaches all chains. A document without a lexicon term is hashed
by all its distinct terms, or by its text if it has no term at all, so that it is like its equals only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.snapshot import snapshot

RAREST, COMMONEST = 0.002, 0.3
CHAINS = 12
SLOT_BITS = 16
DOCS_PER_CELL = 256
CELLS_PER_WINDOW = 4096
_SEPARATORS = r"[^\p{L}\p{N}]+"


def _terms(text: str) -> Column:
    return F.array_distinct(F.transform(F.split(F.lower(text), _SEPARATORS), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """Digests (``h``) of the terms in the band. At least two documents must share a term."""
    n = docs.filter(F.col(text_col).isNotNull()).count()
    seen = docs.select(F.explode(_terms(text_col)).alias("h")).groupBy("h").count()
    band = seen.filter((F.col("count") >= max(2.0, rarest * n)) & (F.col("count") <= commonest * n)
                       & (F.col("h") != F.xxhash64(F.lit(""))))
    return snapshot(band.select("h"), "lexicon")


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SLOT_BITS)


def with_lexicon_terms(df: DataFrame, text: str, band: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the sorted distinct lexicon digests of a text."""
    slots = band.groupBy(_slot(F.col("h")).alias("slot")).agg(F.collect_list("h").alias("own"))
    every = df.sparkSession.range(1 << SLOT_BITS).join(slots, F.col("id") == F.col("slot"), "left")
    filled = F.struct("id", F.coalesce("own", F.array().cast("array<bigint>")).alias("own"))
    table = every.agg(F.transform(F.array_sort(F.collect_list(filled)), lambda s: s["own"]).alias("t"))
    # read once per row expression, so the planner puts the subquery itself there, not a copy
    marked = df.withColumn("_table", table.scalar())
    kept = F.filter(_terms(text), lambda h: F.array_contains(F.get("_table", _slot(h).cast("int")), h))
    return marked.select(*df.columns, F.array_sort(kept).alias(out))


def _drawn(chain: int):
    """16 random bits of a term in a chain; the subsets of the chain are those below 2^k."""
    word, by = divmod(chain, 4)

    def bits(h: Column) -> Column:
        own = h if word == 0 else F.xxhash64(h, F.lit(word))
        return F.shiftrightunsigned(own, 16 * by).bitwiseAND(F.lit(0xFFFF))
    return bits


def with_slots(df: DataFrame, text: str, band: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: an array of ``CHAINS`` digests; of all terms where the text has no lexicon term."""
    kept = df.columns
    df = with_lexicon_terms(df, text, band, "_terms")
    df = df.select("*", *[F.length(F.bin(F.array_min(F.transform("_terms", _drawn(c))))).alias(f"_{c}") for c in range(CHAINS)])

    def chosen(chain):
        limit = F.pow(F.lit(2.0), F.col(f"_{chain}")).cast("long")
        return F.filter("_terms", lambda h: _drawn(chain)(h) < limit)

    worded = F.regexp_like(F.col(text), F.lit(r"[\p{L}\p{N}]"))
    every = F.when(worded, F.xxhash64(F.array_sort(_terms(text)))).otherwise(F.xxhash64(F.lit("no term"), F.col(text)))
    slots = [F.when(F.size("_terms") > 0, F.xxhash64(F.col(f"_{c}"), chosen(c))).otherwise(F.xxhash64(F.lit(-1 - c), every))
             .bitwiseAND(F.lit(0xFFFFFFFF)) for c in range(CHAINS)]
    return df.select(*kept, F.array(*slots).alias(out))


def as_text(slots: Column) -> Column:
    """Eight hexadecimal digits for each chain."""
    return F.array_join(F.transform(slots, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots; texts without lexicon terms are like texts of the same terms only."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].eqNullSafe(p["b"]))) / F.lit(float(CHAINS))


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """The rows with ``out_col``. A null text counts as empty; texts without a lexicon term are
    hashed by all their terms; equal texts have equal fingerprints; an empty table stays empty."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))
    got = with_slots(rows, "text", lexicon(docs, text_col), "slots")
    return got.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != out_col], as_text(F.col("slots")).alias(out_col))


def _next_cell(cells: DataFrame, n: int) -> DataFrame:
    """(cell, after): the next cell in use, null for the last. Cells are numbered from 0 to n - 1;
    windows hold at most ``CELLS_PER_WINDOW`` of them, gaps between windows are closed a level up."""
    if n <= CELLS_PER_WINDOW:
        return cells.select("cell", F.lead("cell").over(Window.partitionBy(F.lit(0)).orderBy("cell")).alias("after"))
    rows = cells.withColumn("group", F.floor(F.col("cell") / CELLS_PER_WINDOW))
    up = _next_cell(rows.select(F.col("group").alias("cell")).distinct(), -(-n // CELLS_PER_WINDOW))
    first = rows.groupBy("group").agg(F.min("cell").alias("first"))
    over = up.join(first, up["after"] == first["group"]).select(up["cell"].alias("group"), "first")
    inside = rows.withColumn("after", F.lead("cell").over(Window.partitionBy("group").orderBy("cell")))
    return inside.join(over, "group", "left").select("cell", F.coalesce("after", "first").alias("after"))


def with_next(rows: DataFrame, id_col: str, columns: list[str], prepare=lambda df: df) -> DataFrame:
    """Adds ``next_<column>``: the values of the next row in descending id order, those of the
    first after the last. Ties go by ``digest``; null ids come last.

    Rows are sorted inside cells of some 256 ids, and the last row of each cell also visits the
    cell above, so texts are shuffled once. ``prepare`` adds columns once the visitors are chosen,
    and is worked out once for each row. The cell bounds are a small table of measured size."""
    low, high, n = rows.agg(F.min(id_col), F.max(id_col), F.count("*")).first()
    span = float((high or 0) - (low or 0) + 1)
    width = max(1.0, span * DOCS_PER_CELL / max(n, 1))
    cell = F.coalesce(F.floor((F.col(id_col).cast("double") - F.lit(float(low or 0))) / width), F.lit(0))
    rows = rows.withColumn("cell", cell)
    tops = rows.groupBy("cell").agg(F.max(F.struct(id_col, "digest")).alias("top"))
    tops = snapshot(tops, "cells")
    after = _next_cell(tops.select("cell"), int(span // width) + 1)
    first = tops.agg(F.min("cell").alias("f")).first()["f"] or 0
    tops = snapshot(tops.join(after, "cell").select(F.col("top")[id_col].alias("top_id"), F.col("top")["digest"].alias("top_digest"),
                                                    F.coalesce("after", F.lit(first)).alias("to")), "cell-tops")
    guests = (rows.join(tops, F.col(id_col).eqNullSafe(F.col("top_id")) & (F.col("digest") == F.col("top_digest")))
                  .withColumn("cell", F.col("to")).drop("top_id", "top_digest", "to").withColumn("guest", F.lit(True)))
    w = Window.partitionBy("cell").orderBy(F.desc("guest"), F.asc_nulls_first(id_col), "digest")
    both = prepare(rows.withColumn("guest", F.lit(False)).unionByName(guests))
    return both.select("*", *[F.lag(c).over(w).alias(f"next_{c}") for c in columns]).filter("not guest").drop("guest", "cell")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_chars``, ``edited`` text, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``): each text beside its edited form, whose last third is the first third of the
    next document in descending id order (of the first after the last). Null texts are empty;
    repeated rows keep a row each and are each other's neighbours; a single row is its own."""
    band = lexicon(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    pairs = with_next(rows.withColumn("digest", F.xxhash64("text")), "id", ["text", "slots"],
                      lambda df: with_slots(df, "text", band, "slots"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    got = with_slots(pairs.select("id", "slots", "next_slots", n.cast("long").alias("n_chars"), edited.alias("edited")),
                     "edited", band, "edited_slots")
    return got.select(F.col("id").alias(id_col), "n_chars", "edited", as_text(F.col("slots")).alias("fingerprint"),
                      as_text(F.col("edited_slots")).alias("edited_fingerprint"),
                      likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
                      likeness(F.col("slots"), F.col("next_slots")).alias("near_next"))
