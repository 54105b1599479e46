"""Spoken names to catalogue items (L1-L4)."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import snapshot
from ..plans.streamed import shuffle_width
from .quality import name_key, verify_item

WHOLE, CONTAINED, MIN_LENGTH = 85, 90, 4

# What health workers call beds and staff.
BED_WORDS = {
    "bed": "BED-INPATIENT", "beds": "BED-INPATIENT", "inpatient bed": "BED-INPATIENT",
    "bistar": "BED-INPATIENT", "palang": "BED-INPATIENT", "day care bed": "BED-DAYCARE",
    "daycare bed": "BED-DAYCARE"}
STAFF_WORDS = {
    "doctor": "STAFF-DOCTOR", "medical officer": "STAFF-DOCTOR", "mo": "STAFF-DOCTOR",
    "daktar": "STAFF-DOCTOR", "nurse": "STAFF-NURSE", "staff nurse": "STAFF-NURSE",
    "anm": "STAFF-NURSE", "gnm": "STAFF-NURSE", "nars": "STAFF-NURSE",
    "pharmacist": "STAFF-PHARMACIST", "compounder": "STAFF-PHARMACIST",
    "dawa wala": "STAFF-PHARMACIST", "health assistant male": "STAFF-HA-MALE",
    "male health assistant": "STAFF-HA-MALE", "mpw": "STAFF-HA-MALE",
    "health assistant female": "STAFF-HA-FEMALE", "female health assistant": "STAFF-HA-FEMALE",
    "lhv": "STAFF-HA-FEMALE"}


# -- scores ------------------------------------------------------------------------------

def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the bits of one integer as the row
    of the table."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def ratio_score(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * common_length(a, b) / total if total else 100.0


def sort_score(a: str, b: str) -> int:
    return round(ratio_score(a, b))


def set_score(a: str, b: str) -> int:
    """Token-set score of two strings of distinct sorted tokens."""
    x, y = set(a.split()), set(b.split())
    both, only_a, only_b = x & y, sorted(x - y), sorted(y - x)
    if both and (not only_a or not only_b):
        return 100
    la, lb, ls = len(" ".join(only_a)), len(" ".join(only_b)), len(" ".join(sorted(both)))
    gap = 1 if ls else 0
    len_a, len_b = ls + gap + la, ls + gap + lb
    ja, jb = " ".join(only_a), " ".join(only_b)
    dist = la + lb - 2 * common_length(ja, jb)
    best = 100.0 * (1 - dist / (len_a + len_b)) if len_a + len_b else 100.0
    if ls:
        best = max(best, 100.0 * (1 - (gap + la) / (ls + len_a)), 100.0 * (1 - (gap + lb) / (ls + len_b)))
    return round(best)


def _scored(score):
    """The pair score as an Arrow UDF."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="int32")
    return F.pandas_udf(run, "int")


# -- strings -----------------------------------------------------------------------------

def tokens(key: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.regexp_replace(key, "[\\u0080-\\u00FF]", "")), r"[^\p{L}\p{N}]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: t != "")


def _grams(text: str) -> Column:
    """Two-character pieces, numbered when they repeat, so that sets count like bags."""
    n = F.length(text)
    parts = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(F.col(text), i, F.lit(2)))) \
        .otherwise(F.array().cast("array<string>"))
    return F.transform(parts, lambda g, i: F.concat(g, F.size(F.filter(F.slice(parts, 1, i + 1), lambda x: x == g)).cast("string")))


def name_index(catalogue: DataFrame) -> DataFrame:
    """Every spelling once: key, item and position, in catalogue order."""
    rows = catalogue.select("item_id", "display_name", F.posexplode(F.concat(
        F.array("display_name", "local_name_in"), F.coalesce("spoken_variants", F.array().cast("array<string>")))).alias("pos", "variant"))
    rows = rows.withColumn("key", name_key("variant")).filter("key IS NOT NULL")
    first = rows.groupBy("key").agg(F.min(F.struct("display_name", "pos", "item_id")).alias("ord"))
    return first.select("key", F.col("ord.item_id").alias("item_id"), "ord")


def _shape(df: DataFrame, prefix: str) -> DataFrame:
    t = tokens(F.col("key"))
    return (df.withColumn("_t", t).withColumn(prefix + "sorted", F.array_join(F.sort_array("_t"), " "))
            .withColumn(prefix + "set", F.array_join(F.sort_array(F.array_distinct("_t")), " "))
            .withColumn(prefix + "tokens", F.array_distinct("_t")).drop("_t"))


def _rarest(df: DataFrame, key: str, text: str, freq: DataFrame, slack: float) -> DataFrame:
    """The rarest pieces of each text, as many as any partner needs to meet one of them.

    Of two texts that share t pieces, the n - t + 1 rarest of each have one in common, with one
    order of pieces for both. No partner needs fewer shared pieces than (1 - 4 * slack) * length - 1.
    """
    n = F.length(text)
    fewest = F.greatest(F.ceil(n * F.lit(1 - 4 * slack) - F.lit(1 + 1e-9)), F.lit(1)).cast("int")
    pieces = df.select(key, text, F.explode(_grams(text)).alias("g")).join(freq, "g", "left")
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)), "g")))
    return (pieces.groupBy(key, text).agg(ordered.alias("o"))
            .select(key, text, F.explode(F.slice("o", F.lit(1), F.greatest(n - fewest, F.lit(1)))["g"]).alias("g")))


def _gram_pairs(u: DataFrame, names: DataFrame, col: str, slack: float, longest: Column) -> DataFrame:
    """Pairs that can still reach the score. A score s allows slack * (l1 + l2) edits and an
    edit destroys at most two pieces, so texts that share none of their rarest pieces are ruled
    out, and so are those further apart than the edits allow; no pair that reaches the score is lost."""
    a, b = f"u_{col}", f"n_{col}"
    names = names.select(F.col("key").alias("n_key"), b)
    freq = names.select(F.explode(_grams(b)).alias("g")).groupBy("g").agg(F.count("*").alias("freq"))
    left = _rarest(u.filter(F.length(a) <= longest), "uid", a, freq, slack)
    right = _rarest(names, "n_key", b, freq, slack)
    la, lb = F.length(a), F.length(b)
    edits = F.floor(F.lit(slack) * (la + lb) + F.lit(1e-9))
    return (left.join(right, "g").filter(F.abs(la - lb) <= edits).select("uid", "n_key", a, b).distinct()
            .filter(F.levenshtein(a, b) <= edits))


def _keyed(utterances: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the digest of their name key, and every different key once. Only the
    digest goes through the joins; texts may be long."""
    rows = utterances.withColumn("_key", name_key(text)).withColumn("uid", F.md5("_key"))
    once = rows.filter("uid IS NOT NULL").groupBy("uid").agg(F.first("_key").alias("key"))
    return rows.drop("_key"), _shape(once, "u_").drop("key")


def _split(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over the shuffle width before Python work; candidate rows are small, and
    merged into few tasks they would be scored by few workers."""
    return df.repartition(shuffle_width(df), *keys)


def match_items(utterances: DataFrame, catalogue: DataFrame, text: str = "text") -> DataFrame:
    """Utterances to items. The whole utterance is scored first; where nothing reaches the
    threshold, a name inside the utterance. Ties go to the earlier catalogue entry.

    Equal texts are scored once. Candidates come from equi-joins on shared words and on the rarest
    two-letter pieces, and the edit distance bounds them; only what is left is scored in Python.
    """
    rows, u = _keyed(utterances, text)
    u = snapshot(u, "l1-texts")
    names = _shape(name_index(catalogue), "n_")
    # Edits make up at most 15.5 % of both lengths, so a longer text cannot reach the score.
    longest = names.agg(F.max(F.length("n_sorted")) * F.lit(1.155 / 0.845) + 1).scalar()
    order = names.select(F.col("key").alias("n_key"), "item_id", "ord")

    same = u.join(names.select(F.col("key").alias("n_key"), F.col("n_sorted").alias("u_sorted")), "u_sorted") \
        .select("uid", "n_key", F.lit(100).alias("score"))
    near = _split(_gram_pairs(u, names, "sorted", 0.155, longest), "uid", "n_key") \
        .withColumn("score", _scored(sort_score)("u_sorted", "n_sorted")) \
        .filter(F.col("score") >= WHOLE).select("uid", "n_key", "score")
    whole = snapshot(same.unionByName(near), "l1-whole")

    # The second stage only sees texts the first one left open.
    rest = u.join(whole.select("uid").distinct(), "uid", "left_anti")
    long = names.filter(F.length("key") >= MIN_LENGTH)
    by_word = (rest.select("uid", "u_set", F.explode("u_tokens").alias("w"))
               .join(long.select(F.col("key").alias("n_key"), "n_set", F.explode("n_tokens").alias("w")), "w")
               .groupBy("uid", "n_key").agg(F.first("u_set").alias("u_set"), F.first("n_set").alias("n_set")))
    by_gram = _gram_pairs(rest, long, "set", 0.105, longest)
    pairs = by_word.unionByName(by_gram).groupBy("uid", "n_key").agg(F.first("u_set").alias("u_set"), F.first("n_set").alias("n_set"))
    inside = (_split(pairs, "uid", "n_key").withColumn("score", _scored(set_score)("u_set", "n_set"))
              .filter(F.col("score") >= CONTAINED).select("uid", "n_key", "score"))

    both = whole.withColumn("stage", F.lit(1)).unionByName(inside.withColumn("stage", F.lit(2)))
    best = both.join(order, "n_key").groupBy("uid").agg(F.min(F.struct(
        "stage", (-F.col("score")).alias("neg"), "ord", "item_id")).alias("b"))
    hit = best.select("uid", F.col("b.item_id").alias("matched_id"), F.col("b.stage").alias("stage"),
                      (-F.col("b.neg")).alias("score"))
    return rows.join(hit, "uid", "left").drop("uid")


def contained_names(utterances: DataFrame, catalogue: DataFrame, text: str = "text") -> DataFrame:
    """The exact part of the second stage: all words of a name occur in the utterance."""
    rows, u = _keyed(utterances, text)
    u = snapshot(u, "l1-texts")
    names = _shape(name_index(catalogue), "n_").filter(F.length("key") >= MIN_LENGTH)
    hits = (u.select("uid", F.explode("u_tokens").alias("w"))
            .join(names.select(F.col("key").alias("n_key"), F.size("n_tokens").alias("n"), F.explode("n_tokens").alias("w")), "w")
            .groupBy("uid", "n_key", "n").agg(F.count("*").alias("c")).filter("c = n"))
    best = hits.join(names.select(F.col("key").alias("n_key"), "item_id", "ord"), "n_key").groupBy("uid").agg(
        F.min(F.struct("ord", "item_id")).alias("b"))
    return rows.join(best.select("uid", F.col("b.item_id").alias("matched_id")), "uid", "left").drop("uid")


def match_vocabulary(text: str, words: dict[str, str]) -> Column:
    """The whole phrase if it is a term, else the longest term it contains."""
    spoken = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    out = F.lit(None).cast("string")
    for term in reversed(sorted(words, key=len, reverse=True)):
        out = F.when(spoken.contains(term), words[term]).otherwise(out)
    for term, value in words.items():
        out = F.when(spoken == term, value).otherwise(out)
    return out


def quick_list(catalogue: DataFrame) -> DataFrame:
    """Forecast items with a Devanagari spelling and a spoken phrase for a tile."""
    variants = F.filter(F.coalesce("spoken_variants", F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    script = lambda v: v.rlike("[\\u0900-\\u097F]")
    hindi = F.get(F.filter(variants, script), 0)
    spoken = F.filter(variants, lambda v: ~script(v) & ~name_key(v).eqNullSafe(name_key("display_name")))
    phrases = F.filter(spoken, lambda v: v.contains(" "))
    longest = F.array_max(F.transform(phrases, lambda v: F.length(v)))
    best = F.get(F.filter(phrases, lambda v: F.length(v) == longest), 0)
    return catalogue.filter("is_forecast_item").select(
        "item_id", "display_name", hindi.alias("hindi_name"), F.coalesce(best, F.get(spoken, 0)).alias("spoken"),
        "unit", "ven_class")


__all__ = ["match_items", "contained_names", "match_vocabulary", "verify_item", "quick_list", "name_index"]
