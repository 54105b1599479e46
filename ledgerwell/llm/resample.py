"""Importance resampling of documents towards a target distribution of hashed n-grams.

Separators are collapsed to single blanks, and one overlapped regular expression between blanks
emits the span of every run of words; the spans' bytes are hashed by CRC-32 as they come. Each
text is scanned once: its buckets are kept in a written table, from which the bucket totals and,
when the gains are known, the weights of the documents are added up.
"""
from __future__ import annotations

from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import numbered
from ..plans.snapshot import snapshot

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
BATCH_BYTES = 1 << 22
WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))


def _plain_table() -> bytes:
    """Lower case of A-Z, a blank for every other byte outside a word. Bytes over 0x7F are parts of
    characters that belong to words."""
    return bytes(b if b in WORD_BYTES else 0x20 for b in bytes(range(0x100)).lower())


def _scanner(most: int):
    """``spans(text)``: the bytes of all runs of 1 to ``most`` words, by overlapped matches."""
    import regex
    patterns = [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, most + 1)]
    table, whole = _plain_table(), itemgetter(0)

    def collapsed(text: str) -> bytes:
        return b" ".join(text.encode().translate(table).split())

    def spans(plain: bytes):
        for p in patterns:
            yield from map(whole, p.finditer(plain, overlapped=True))
    return collapsed, spans


def _hash(most: int, buckets: int):
    """(key, words, buckets of all features as little-endian unsigned 32-bit) per text."""
    def run(batches):
        collapsed, spans = _scanner(most)
        for batch in batches:
            keys, i = batch.column(0), 0
            words, found, size = [], [], 0
            for j, text in enumerate(batch.column(1)):
                plain = collapsed(text.as_py() or "")
                hashes = np.fromiter(map(crc32, spans(plain)), np.uint32)
                words.append(plain.count(b" ") + 1 if plain else 0)
                found.append((hashes % np.uint32(buckets)).astype("<u4").tobytes())
                size += len(found[-1]) + 1
                if size >= BATCH_BYTES or j == len(keys) - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(i, j + 1 - i), pa.array(words, pa.int64()), pa.array(found, pa.binary())],
                                                     names=["key", "words", "features"])
                    i, words, found, size = j + 1, [], [], 0
    return run


def _flat(features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch and the number of them per row."""
    raw = features.to_pylist()
    return np.frombuffer(b"".join(raw), "<u4"), np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))


def _totals(buckets: int):
    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(_flat(batch.column(0))[0], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])
    return run


def bucket_totals(hashed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): at most ``buckets`` rows of every task are added up."""
    return hashed.select("features").mapInArrow(_totals(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))."""
    s, t = (bucket_totals(h, buckets).withColumnRenamed("n", c) for h, c in ((source, "s"), (target, "t")))
    both = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.struct(F.sum("s").alias("s"), F.sum("t").alias("t")).alias("sums"))
    all_s, all_t = (sums.select(F.col("sums").getField(c)).scalar() for c in "st")
    top = (F.col("t") + 1).cast("double") * (all_s + buckets).cast("double")
    low = (F.col("s") + 1).cast("double") * (all_t + buckets).cast("double")
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(top / low)).cast("long").alias("gain"))


def _weights(gains: np.ndarray):
    def run(batches):
        for batch in batches:
            got, n = _flat(batch.column(2))
            upto = np.concatenate([[0], np.cumsum(gains[got])])
            ends = np.cumsum(n)
            sums = upto[ends] - upto[ends - n]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(sums // np.maximum(n, 1))],
                                             names=["key", "words", "n_features", "weight"])
    return run


def noise(id_col: str | Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, ``n_features``, ``weight``, ``score``, ``rank``) of every row: the floored mean gain of
    its features, the weight plus noise, and the place among the ``percent`` of the documents with
    ``min_words`` words or more that are drawn, highest scores first, ties to the smaller id.

    A null text has no words; documents without features weigh 0; a null id is drawn by the seed
    alone and comes last of a tie; rows that repeat are documents each, and tied ones take neighbouring
    ranks; empty tables give an empty table, and an empty target counts as no features at all. Other
    columns are not read. The table of gains has ``buckets`` rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(rows, key, text, kind, name):
        return snapshot(rows.select(key, F.col(text).alias("text")).mapInArrow(_hash(most, buckets), f"key {kind}, words long, features binary"), name)

    source = hashed(docs, F.col(id_col).alias("key"), text_col, kind, "features")
    wanted = hashed(target, F.lit(0).alias("key"), target_col, "int", "target-features")
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(source, wanted, buckets).collect():             # a fixed number of buckets
        gains[r.bucket] = r.gain
    weighed = source.mapInArrow(_weights(gains), f"key {kind}, words long, n_features long, weight long")
    scored = snapshot(weighed.withColumn("score", F.col("weight") + noise("key", seed)), "scores")
    able = F.coalesce(F.col("words") >= min_words, F.lit(False))
    drawn = numbered(scored.filter(able), [F.col("score").desc(), F.col("key").asc_nulls_last()])
    n_drawn = scored.filter(able).count() * percent // 100
    rank = F.when(F.col("place") < n_drawn, F.col("place") + 1).cast("long")
    out = drawn.withColumn("rank", rank).drop("place").unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("key").alias(id_col), "n_features", "weight", "score", "rank")


#: CRC-32 word by word over the UTF-8 bytes, with the usual table of 256 entries worked out first.
ORACLE = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
words AS (
  SELECT doc_id, 0 AS target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT NULL, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT doc_id, target, unnest(ws) AS w FROM words),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM each)),
bytes AS (SELECT w, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM hexed),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, crc),
counts AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM each JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts, sums),
found AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM each JOIN hashed USING (w) JOIN gains USING (bucket) WHERE target = 0 GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id),
scored AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
