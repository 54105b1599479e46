"""How far the sources of a language use different words.

Texts are cut and their terms counted in batches, which leave rows of different terms. Per language
a CountVectorizer with a least number of documents and no effective limit on the vocabulary is
fitted to rows that hold each term once per document, as far as that number; it gives exact sparse
vectors of the rows of each source, which are added up by their weights as a sparse summary of the
group. Pairs of sources are then evaluated on what is not zero only:
terms that neither source holds all add the same amount, terms of one source add by their
counts, and only terms held by both are met pair by pair.

A fitted vocabulary passes through the driver and to every task. Its size is bounded: the terms
of a language are dealt into shards by their digest, as many as keep the (measured) number of
terms that can be kept under ``SHARD_TERMS`` a shard, and every shard is fitted for itself.
"""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.snapshot import shared_folder, snapshot

MIN_DOCS = 10
ALL_TERMS = (1 << 31) - 1
SHARD_TERMS = 500_000
SIZED_BY = 64                    # one term in so many, by digest, is counted to size the shards
TOP = 10
HELD_SUMS = 1_000_000
TEXT_PER_CUT = 1 << 23
DOCS_PER_CUT = 1 << 16
ROW_TERMS = 512
#: Odd numbers, for the bytes of a term by their place.
WEIGHTS = np.random.default_rng(13).integers(0, 1 << 62, 16, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of UTF-8 as they stand in terms, A-Z in lower case. ASCII controls, digits, signs and blanks are blanks: they part the terms.
PLAIN = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Stands in every document, so that no fit is left without a term. It is no term itself.
MARK = " "


def _terms(texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
    """The terms of each text, A-Z in lower case, and the mark behind them, as codes of a dictionary that ends with the mark;
    and of these terms, one in ``SIZED_BY`` by digest."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    text = np.frombuffer(bytes(memoryview(texts.buffers()[2] or b"")[at[0]:at[-1]]).translate(PLAIN), np.uint8)
    at = at - at[0]
    held = text != 32
    apart = np.zeros(len(text) + 1, bool)                        # a term does not go on from one text to the next
    apart[at] = True
    starts = np.flatnonzero(held & (apart[:-1] | np.append(True, ~held)[:-1]))
    ends = np.flatnonzero(held & (apart[1:] | np.append(~held, True)[1:])) + 1
    names = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(ends - starts)).astype(np.int32)), pa.py_buffer(text[held]))
    coded, first = names.dictionary_encode(), np.searchsorted(starts, at)
    some = _sizing(coded.dictionary)
    code = np.insert(coded.indices.to_numpy(), first[1:], len(some))
    some = np.append(some, False)[code]
    first = first + np.arange(len(first))
    coded = pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), pa.concat_arrays([coded.dictionary, pa.array([MARK])]))
    return (pa.ListArray.from_arrays(pa.array(first, pa.int32()), coded),
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some))[first], pa.int32()), coded.filter(pa.array(some)).dictionary_decode()))


def _sizing(names: pa.StringArray) -> np.ndarray:
    """Whether a term is one of those that size the shards."""
    if not len(names):
        return np.zeros(0, bool)
    at = np.frombuffer(names.buffers()[1], np.int32)[:len(names) + 1]
    text = np.frombuffer(names.buffers()[2], np.uint8)[:at[-1]]
    weight = WEIGHTS[(np.arange(len(text)) - np.repeat(at[:-1], np.diff(at))) % len(WEIGHTS)]
    digest = np.add.reduceat(text * weight, at[:-1]) * WEIGHTS[0]
    return (digest >> np.uint64(32)) % np.uint64(SIZED_BY) == 0


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and where the last one ends."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _summed(lang: pa.Array, source: pa.Array, texts: pa.Array, min_docs: int) -> pa.RecordBatch:
    """What these documents add to the fit of each language and to the sums of each source, in rows of different terms.

    Fit (weight 0): a term is in as many rows as documents of the language hold it, but in no more than ``min_docs``: over
    the rows of all batches it reaches ``min_docs`` just when it does over the documents. Sums: a term that stands n times
    in a source is in rows whose weights, the powers of two in n, add up to n."""
    tokens, some = _terms(texts)
    names, code, lens = tokens.values.dictionary, tokens.values.indices.to_numpy(), np.diff(tokens.offsets.to_numpy())
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    v, n_sources, n_docs = len(names), len(source.dictionary), len(texts)
    groups, own = np.unique(lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy(), return_inverse=True)
    lang_of, source_of = groups // n_sources, groups % n_sources
    held = np.sort((np.repeat(own, lens) * v + code) * n_docs + np.repeat(np.arange(n_docs), lens))
    pair = held // n_docs                                        # a term and its source
    runs = _runs(pair)
    pair, n, docs = pair[runs[:-1]], np.diff(runs), np.diff(np.searchsorted(_runs(held), runs))
    parts = [(1 << k, pair[n >> k & 1 == 1]) for k in range(int(n.max()).bit_length())]
    pair = np.searchsorted(lang_of, lang_of)[pair // v] * v + pair % v   # a term and the first source of its language
    order = np.argsort(pair, kind="stable")
    runs = _runs(pair[order])
    pair, docs = pair[order][runs[:-1]], np.add.reduceat(docs[order], runs[:-1])
    parts += [(0, pair[docs > k]) for k in range(min(min_docs, int(docs.max())))]
    sizes = [len(p) for _, p in parts]
    weight, pair = np.repeat([w for w, _ in parts], sizes), np.concatenate([p for _, p in parts])
    own, code = pair // v, pair % v
    runs = _runs(own * len(parts) + np.repeat(np.arange(len(parts)), sizes))
    first = np.append(np.flatnonzero((np.arange(len(own)) - np.repeat(runs[:-1], np.diff(runs))) % ROW_TERMS == 0), len(own))
    own, row_weight = own[first[:-1]], weight[first[:-1]]
    sized = pc.is_in(names, value_set=pc.unique(some.values)).to_numpy(zero_copy_only=False)[code] & (weight == 0)
    offsets = pa.array(first, pa.int32())
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(lang_of[own])), source.dictionary.take(pa.array(source_of[own])), pa.array(row_weight),
         pa.array(np.add.reduceat((code == v - 1).astype(np.int64), first[:-1]) * row_weight),
         pa.ListArray.from_arrays(offsets, names.take(pa.array(code))),
         pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sized))[first], pa.int32()), names.take(pa.array(code[sized])))],
        names=["lang", "source", "weight", "docs", "tokens", "some"])


def _cut(min_docs: int):
    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, min(lo + DOCS_PER_CUT, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + TEXT_PER_CUT, "right"))))
                yield _summed(*batch.slice(lo, hi - lo).columns, min_docs)
                lo = hi
    return run


def _tokens(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, weight, docs, tokens, some of the tokens): rows for the fits (weight 0, any source) and for the sums;
    ``docs`` add up to the documents of a source."""
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(_cut(min_docs), "lang string, source string, weight long, docs long, tokens array<string>, some array<string>")


def _fitted(tokens: DataFrame, sums: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(``sums`` with their vectors, vocabulary (index, term) without the mark) by the terms in ``min_docs`` rows of ``tokens``."""
    spark = tokens.sparkSession
    model = CountVectorizer(inputCol="tokens", outputCol="vector", minDF=float(min_docs), minTF=1.0, vocabSize=ALL_TERMS).fit(tokens)
    path = f"{shared_folder(spark)}/ledgerwell/{spark.sparkContext.applicationId}/vocabulary-{uuid.uuid4().hex[:12]}"
    model.write().save(path)
    names = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "term"))
    return model.transform(sums), names.filter(F.col("term") != MARK)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sum of each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _partial_sums(batches):
    """Sums (source, index, n) over many weighted sparse vectors, at most ``HELD_SUMS`` of them and a batch at once."""
    number, keys, sums = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows():
        names = np.array(list(number), object)
        return pa.RecordBatch.from_arrays([pa.array(names[keys >> 32], pa.string()), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)],
                                          names=["source", "index", "n"])
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        code = np.array([number.setdefault(s, len(number)) for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        at, n = batch.column(1), batch.column(2).flatten().to_numpy().astype(np.int64)
        held = np.diff(at.offsets.to_numpy())
        source, n = np.repeat(code, held), n * np.repeat(batch.column(3).to_numpy(), held)
        keys, sums = _added(np.concatenate([keys, source << 32 | at.flatten().to_numpy()]), np.concatenate([sums, n]))
        if len(keys) > HELD_SUMS:
            yield rows()
            number, keys, sums = {}, keys[:0], sums[:0]
    if len(keys):
        yield rows()


def _entries(vectors: DataFrame) -> DataFrame:
    """Group sums (source, index, n) of the sparse entries times the weight of their row: added up in the task first."""
    raw = F.unwrap_udt(F.col("vector"))
    parts = vectors.select("source", raw.getField("indices").alias("at"), raw.getField("values").alias("n"), "weight")
    return parts.mapInArrow(_partial_sums, "source string, index int, n long").groupBy("source", "index").agg(F.sum("n").alias("n"))


def _shards(tokens: DataFrame, min_docs: int, shard_terms: int) -> dict[str, int]:
    """Shards by language. Terms in ``min_docs`` rows, which are the kept ones, are counted exactly
    for one term in ``SIZED_BY``; this decides nothing but the number of fits."""
    some = tokens.select("part", F.explode("some").alias("t"))
    sizes = some.groupBy("part", "t").count().filter(F.col("count") >= min_docs).groupBy("part").count().collect()      # one row per language
    return {r.part: max(1, -(-r["count"] * SIZED_BY // shard_terms)) for r in sizes}


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, DataFrame]:
    """(groups (lang, source) that occur, counts (lang, source, term, n > 0) of the kept terms)."""
    spark = docs.sparkSession
    base = f"{shared_folder(spark)}/ledgerwell/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex[:12]}"
    rows = _tokens(docs, min_docs).withColumn("part", F.concat(F.lit("l"), F.md5(F.col("lang").cast("binary")))).withColumn("fit", F.col("weight") == 0)
    rows.write.partitionBy("part", "fit").option("parquet.enable.dictionary", "false").parquet(base)
    rows = spark.read.schema("lang string, source string, weight long, docs long, tokens array<string>, some array<string>, part string, fit boolean").parquet(base)
    fits, sums = rows.filter("fit"), rows.filter("not fit")
    groups = snapshot(sums.groupBy("part", "lang", "source").agg(F.sum("docs").alias("count")), "groups")
    sizes = groups.groupBy("part", "lang").agg(F.sum("count").alias("n")).filter(F.col("n") >= min_docs)    # no other keeps a term
    shards_of = _shards(fits, min_docs, shard_terms)
    found = spark.createDataFrame([], "lang string, source string, term string, n long")
    for r in sizes.orderBy("part").collect():                                                                # one row per language
        shards = shards_of.get(r.part, 1)
        for k in range(shards):
            own = F.col("tokens") if shards == 1 else F.filter("tokens", lambda t: (t == MARK) | (F.pmod(F.xxhash64(t), F.lit(shards)) == k))
            mine = [x.filter(F.col("part") == r.part).select("source", "weight", own.alias("tokens")) for x in (fits, sums)]
            vectors, names = _fitted(*mine, min_docs)
            found = found.unionByName(_entries(vectors).join(names, "index").select(F.lit(r.lang).alias("lang"), "source", "term", "n"))
    return groups.select("lang", "source"), snapshot(found, "term-counts")


def _share(n: Column, of: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (of + 2 v)), exact."""
    top = (n + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", top, (of + v * 2).cast("decimal(20,0)")).cast("long") + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, other, value) for all ordered pairs of the sources of a language."""
    def side(rows, end):
        return rows.select("lang", *[F.col(c).alias(c + end) for c in rows.columns if c != "lang"])

    a, b = (side(groups.select("lang", "source", "v", "p0"), end) for end in "ab")
    pairs = a.join(b, "lang").filter(F.col("sourcea") != F.col("sourceb"))
    p0a, p0b = F.col("p0a"), F.col("p0b")
    none = pairs.select("lang", "sourcea", "sourceb", (F.when(F.col("va") > 0, _gap(p0a, p0b)).otherwise(F.lit(0)) * F.col("va")).cast("decimal(38,0)").alias("value"))
    # terms of one source against the other source's share of a term it does not hold: by distinct share
    shares = side(counts.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), "a")
    one = shares.join(pairs, ["lang", "sourcea"]).select(
        "lang", "sourcea", "sourceb", ((_gap(F.col("pa"), p0b) - _gap(p0a, p0b)) * F.col("ma")).cast("decimal(38,0)").alias("value"))
    # terms of both: what the two rows above left out
    full = counts.select("lang", "term", "source", "p", "p0")
    l, r = (full.select("lang", "term", *[F.col(c).alias(c + end) for c in ("source", "p", "p0")]) for end in "ab")
    pa, pb = F.col("pa"), F.col("pb")
    extra = _gap(pa, pb) - _gap(pa, p0b) - _gap(p0a, pb) + _gap(p0a, p0b)
    both = (l.join(r, ["lang", "term"]).filter(F.col("sourcea") < F.col("sourceb"))
             .groupBy("lang", "sourcea", "sourceb").agg(F.sum(extra.cast("decimal(28,0)")).cast("decimal(38,0)").alias("value")))

    def turned(rows):
        return rows.unionByName(rows.select("lang", F.col("sourceb").alias("sourcea"), F.col("sourcea").alias("sourceb"), "value"))

    total = none.unionByName(turned(one)).unionByName(turned(both)).groupBy("lang", "sourcea", "sourceb").agg(F.sum("value").cast("long").alias("value"))
    return total.select("lang", F.col("sourcea").alias("source"), F.col("sourceb").alias("item"), "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: how far the words of a source are from
    those of every other source of its language, all of them; part ``term``: the ``top`` terms it
    uses more than its language does. Ranks count from 1, larger values first, ties by the item.

    Null text, lang and source count as empty strings; a document without terms is one of its
    source all the same; rows that repeat are documents each; a language with fewer than
    ``min_docs`` documents keeps no term, and all its pairs are at 0; a source that is alone in its
    language has no pairs; an empty table gives an empty table. Other columns are not read."""
    groups, counts = term_counts(docs, min_docs, shard_terms)
    words = snapshot(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n")), "language-terms")
    langs = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    known = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "source_n"])
    known = snapshot(known.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("source_n"), F.col("v")))), "sources")
    rows = counts.join(known, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("source_n"), F.col("v")))
    pairs = _pairs(known, rows).withColumn("part", F.lit("pair"))
    used = rows.join(words, ["lang", "term"]).withColumn("q", _share(F.col("all_n"), F.col("lang_n"), F.col("v"))).filter(F.col("p") > F.col("q"))
    terms = used.select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)),
              terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")


#: Dense: every kept term of a language for every source.
ORACLE = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
each AS (SELECT lang, source, d, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS all_n FROM each GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, k.all_n, coalesce(n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
         LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
    1 + (1000000000::HUGEINT * (all_n + 2)) // (sum(all_n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS q
  FROM grid),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""
