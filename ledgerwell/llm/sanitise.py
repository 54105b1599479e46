"""Information-theoretic sanitisation, in DataFrame functions only.

Base spans. Emails, IP addresses, card and phone numbers are found by pattern. A text is split at
the matches, and the running lengths of the parts and matches give the places.

Disclosure. The values found are the protected entities. A mention's context is the ``REACH``
words on either side. A term's contexts with an entity count as the smaller number of different
left and right sides, so copies of a document, edited or not, are one witness. For a term t seen with entity e, P(e|t) is estimated as
contexts of e with t over documents with t, against P(e), the share of all documents that mention
e. A term with at least ``SUPPORT`` contexts that names its entity with probability ``SURE`` or
more is removed, from ``LIKELY`` on it is generalised, if it also raises the entity's
probability by ``BITS`` bits. Such terms are spans wherever they occur.

Pairs are counted over contexts, not documents. Document frequencies are counted per term before
they meet the pairs, and documents are searched only for the terms that passed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import snapshot

REACH, REACH_CHARS = 5, 120
SUPPORT, LIKELY, SURE, BITS = 3, 0.5, 0.8, 5.0

# The four patterns are given; here without backtracking into, or recursion over, long runs: a
# match starts at the start of its run or where the last match ended, which is the leftmost place.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "term"]
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]
_NOT_WORD = r"[^\p{L}\p{N}]+"
_BLOCK = 512
_SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"


def _running(lengths: Column) -> Column:
    """Sum of the lengths before each one; in blocks, since arrays are copied as they grow."""
    def scan(x):
        return F.aggregate(x, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    sums = scan(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)))
    inner = F.transform(blocks, lambda x, b: F.transform(F.slice(scan(x), 1, F.size(x)), lambda n: n + F.get(sums, b)))
    return F.flatten(inner)


def _matches(text: Column, pattern: Column, gate: Column, kind: int) -> Column:
    """All matches as (start, kind, end, text); places in code points."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
    found = F.zip_with(hits, F.zip_with(_running(lengths), parts, lambda n, p: n + F.length(p)),
                       lambda h, at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(h)).alias("end"), h.alias("text")))
    some = F.filter(found, lambda m: m["text"].isNotNull())
    return F.when(gate, F.when(F.size(hits) > 0, some)).otherwise(F.lit(None)).cast(_SPANS)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    at = F.sequence(F.lit(0), F.length(digits) - 1)

    def worth(i):
        v = F.substring(back, i + 1, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(v > 9, v - 9).otherwise(v)
    return F.aggregate(F.transform(at, worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(text: Column) -> Column:
    """Valid matches of the four kinds, by start, then kind. ``text`` is not null."""
    def valid_ip(m):
        return F.forall(F.split(m["text"], r"\.", -1), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
                        & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255))

    def valid_card(m):
        d = _digits(m["text"])
        return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)

    def valid_phone(m):
        return F.length(_digits(m["text"])).between(10, 15)

    every = F.lit(True)
    found = [(EMAIL, F.contains(text, F.lit("@")), lambda m: every),
             (IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]")), valid_ip),
             (CARD, F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")), valid_card),
             (PHONE, F.contains(text, F.lit("+")), valid_phone)]
    none = F.array().cast(_SPANS)
    return F.array_sort(F.concat(*[F.coalesce(F.filter(_matches(text, F.lit(p), gate, k), ok), none)
                                   for k, (p, gate, ok) in enumerate(found)]))


def term_spans(text: Column, terms: Column) -> Column:
    """Whole-word occurrences of a document's revealing terms; null terms give none."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?iu:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(terms.isNotNull(), F.coalesce(_matches(text, pattern, F.lit(True), 4), F.array().cast(_SPANS))).otherwise(F.array().cast(_SPANS))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _NOT_WORD), lambda w: w != "")


def _entity(m: Column) -> Column:
    return F.concat(m["kind"].cast("string"), F.lit(":"), F.when(m["kind"].isin(2, 3), _digits(m["text"])).otherwise(F.lower(m["text"])))


def disclosing_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
                     likely: float = LIKELY, sure: float = SURE, bits: float = BITS) -> DataFrame:
    """(id, digest, ``terms``, ``certain``): for each text (by id and digest) with terms that reveal
    an entity those terms, and those of them that are to be removed."""
    texts = _keyed(docs, id_col, text_col)
    spans = (texts.select("digest", "text", base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
                  .select("digest", "text", F.explode("spans").alias("m")))
    left = F.substring("text", F.greatest(F.col("m.start") - REACH_CHARS + 1, F.lit(1)), F.least(F.col("m.start"), F.lit(REACH_CHARS)))
    right = F.substring("text", F.col("m.end") + 1, F.lit(REACH_CHARS))
    cut_left = F.when(F.col("m.start") > REACH_CHARS, F.regexp_replace(left, r"^[\p{L}\p{N}]+", "")).otherwise(left)
    cut_right = F.when(F.length(right) == REACH_CHARS, F.regexp_replace(right, r"[\p{L}\p{N}]+$", "")).otherwise(right)
    mentions = snapshot(spans.select(_entity(F.col("m")).alias("entity"), "digest", F.slice(F.reverse(_words(cut_left)), 1, REACH).alias("l"),
                                     F.slice(_words(cut_right), 1, REACH).alias("r")), "disclosure-mentions")
    contexts = (mentions.select("entity", "l", "r").distinct()
                     .select("entity", F.xxhash64("l").alias("left"), F.xxhash64("r").alias("right"),
                             F.explode(F.array_distinct(F.concat("l", "r"))).alias("term")))
    pairs = snapshot(contexts.filter(F.rlike("term", F.lit(r"\p{L}"))).groupBy("entity", "term")
                             .agg(F.least(F.countDistinct("left"), F.countDistinct("right")).alias("seen"))
                             .filter(F.col("seen") >= support), "disclosure")
    wanted = snapshot(pairs.select("term", F.xxhash64("term").alias("h")).distinct(), "disclosure-terms")
    hashed = F.explode(F.array_distinct(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)))).alias("h")
    # every different text counts once, and terms are counted before they meet the pairs
    once = texts.select("digest", "text").dropDuplicates(["digest"])
    spread = once.select(hashed).groupBy("h").agg(F.count("*").alias("held"))
    mentioned = mentions.groupBy("entity").agg(F.countDistinct("digest").alias("n_e"))
    n = max(docs.count(), 1)
    p = F.least(F.col("seen") / F.col("held"), F.lit(1.0))
    scored = (wanted.join(spread, "h").join(pairs, "term").join(mentioned, "entity").withColumn("p", p)
                    .filter((F.col("p") >= likely) & (F.log2(F.col("p") * n / F.col("n_e")) >= bits))
                    .groupBy("h", "term").agg(F.max("p").alias("p")))
    scored = snapshot(scored, "disclosure-scored")
    return (texts.select("id", "digest", hashed).join(scored, "h").groupBy("id", "digest")
                 .agg(F.array_sort(F.collect_set("term")).alias("terms"),
                      F.array_sort(F.collect_set(F.when(F.col("p") >= sure, F.col("term")))).alias("certain")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Rows as (``row``, ``text``, ``spans``, ``certain``): the input row, its text (null: empty), the
    sorted spans (start, kind number, end, text), and the terms that are to be removed. Rows of
    equal id and text are one document. Texts without spans have an empty array."""
    terms = snapshot(disclosing_terms(docs, id_col, text_col, **thresholds), "disclosure-documents")
    texts = _keyed(docs, id_col, text_col)
    both = texts.alias("d").join(terms.alias("t"), F.col("d.id").eqNullSafe(F.col("t.id")) & (F.col("d.digest") == F.col("t.digest")), "left")
    spans = F.array_sort(F.concat(base_spans(F.col("text")), term_spans(F.col("text"), F.col("terms"))))
    return both.select("row", "text", spans.alias("spans"), "certain")


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """The rows with every span of the text replaced: base kinds and generalised terms by a label,
    terms to be removed by nothing. Overlapping spans are replaced together, by the label of the
    first. A null text stays null; an empty table stays empty; other columns are kept."""
    got = find(docs, id_col, text_col, **thresholds)
    text, labels = F.col("text"), F.array(*map(F.lit, LABELS))

    def step(acc, s):
        kind = F.when((s["kind"] == 4) & F.coalesce(F.array_contains("certain", F.lower(s["text"])), F.lit(False)), 5).otherwise(s["kind"])
        piece = F.concat(F.substring(text, acc["end"] + 1, s["start"] - acc["end"]), F.get(labels, kind))
        return F.struct(F.when(s["start"] >= acc["end"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["end"], s["end"]).alias("end"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("end"))
    new = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["end"] + 1, F.length(text))))
    old = F.col("row").getField(text_col)
    return got.select(*[F.when(F.size("spans") == 0, old).otherwise(new).alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                        for c in docs.columns])
