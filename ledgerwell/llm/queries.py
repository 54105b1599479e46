"""The registered queries of this subpackage: operators over whole tables, and digests of
their results."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, divergence, duck_bpe, fm_dedup, imatch, langid, line_windows, pack, pstable, resample, sanitise, simhash, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    got = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_disclosure(spark, sf_dir):
    got = sanitise.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return got.select(F.col("row.doc_id"), *[count(k).alias(f"n_{name}") for k, name in enumerate(sanitise.KINDS)],
                      F.sha2(sanitise.as_text(base), 256).alias("base_sha256"), sanitise.as_text(F.col("spans")).alias("spans"))


def op3_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs), columns=["doc_id"]).select(
        "doc_id", langid.is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_line_windows(spark, sf_dir):
    got = line_windows.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_imatch(spark, sf_dir):
    got = imatch.compare_edits(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                      "near_edited", "near_next")


def op6_simhash_groups(spark, sf_dir):
    got = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_fm_passages(spark, sf_dir):
    got = fm_dedup.remove_passages(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_retrieval_packing(spark, sf_dir):
    got = pack.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_pstable_groups(spark, sf_dir):
    return pstable.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_duck_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = duck_bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("bytes", 256).alias("decoded_sha256"))


def op11_dac_files(spark, sf_dir):
    files = dac.write_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return dac.read_documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_importance_resampling(spark, sf_dir):
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_disclosure, op3_language_id, op4_line_windows, op5_imatch, op6_simhash_groups, op7_fm_passages, op8_retrieval_packing, op9_pstable_groups, op10_duck_bpe, op11_dac_files, op12_importance_resampling, op13_source_divergence)}
ORACLES = {"op4_line_windows": line_windows.ORACLE, "op9_pstable_groups": pstable.ORACLE, "op12_importance_resampling": resample.ORACLE, "op13_source_divergence": divergence.ORACLE}
