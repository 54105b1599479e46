"""The corpus pipeline: five stages, each written and read again as the next one's documents.

1. language id: documents without a letter go, and those of which no word is known,
2. line dedup: later occurrences of repeated three-line windows go from the texts,
3. SimHash near-dedup: one document of each group stays,
4. sanitisation: personal data and disclosing terms are replaced in the texts,
5. packing: the ids of every document in sequences of a fixed length.

A stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of
``docs``; the last returns pieces. A null text counts as empty, repeated rows as documents of
their own unless a stage says otherwise, and empty tables pass through every stage.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.llm import langid, line_windows, pack, sanitise, simhash
from ledgerwell.plans.snapshot import snapshot

#: A document goes if all languages are equally likely: no word or piece of a word in it is known.
EVEN = 1e-9


def _counted(docs: DataFrame) -> DataFrame:
    """The number of characters follows the text where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a determined language; a missing ``lang`` is filled in. The model is
    fitted on the labelled rows of ``docs``; if none has a label, nothing is known and nothing
    but texts without letters goes."""
    model = langid.fit(docs)
    least = 1 / len(model.languages) + EVEN if len(model.languages) > 1 else 0.0
    rows = langid.identify(docs.select(F.struct("*").alias("row")), model, "row.text")
    letters = F.rlike("row.text", F.lit(r"\p{L}"))
    kept = rows.filter((F.col("score") >= least) & (F.col("lang_pred") != langid.UNDETERMINED) if model.languages else letters)
    pred = F.when(F.col("lang_pred") != langid.UNDETERMINED, F.col("lang_pred"))
    return kept.select(*[(F.coalesce(F.col("row").getField(c), pred) if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; texts lose the lines that repeat."""
    got = line_windows.dedup_lines(docs.select(F.struct("*").alias("row"), "doc_id", "text"))
    return _counted(got.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, similarity 0.8) the row with the
    smallest (id, text digest), null ids first. Equal rows are copies too: one of them stays."""
    key = F.struct("doc_id", F.xxhash64("text").alias("digest"))
    groups = simhash.similar_groups(docs.select(key.alias("key"), "text"), id_col="key")
    best = groups.filter(F.col("key") == F.col("component_id")).select("key").distinct()
    kept = docs.select(F.struct("*").alias("row"), key.alias("key")).join(best, "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; personal data and disclosing terms in the texts are replaced."""
    return _counted(sanitise.sanitise(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    got = pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("sanitise", sanitised), ("pack", packed)]
#: Fitted models, XXH64 and subword merges have no counterpart in SQL; tests compare every stage
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = snapshot(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
