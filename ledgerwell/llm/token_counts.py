"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``chunk_chars`` is encoded in one piece. Longer ones are cut into overlapping
chunks that are dealt over the cluster and encoded with offsets. Where two neighbours overlap,
they are spliced at a boundary that is proven stable: it follows white space, so that no token
spans it, and the tokens on either side of it agree in id and place in both encodings. The chunks
of a text without such a boundary are encoded again with a wider overlap, until one chunk holds
the whole text: every text ends with an exact count.

White space is such a boundary for the pre-tokenizers this is meant for: they drop it or open a
word with it. A text is therefore also the sum of its blank-separated words, and the count of a
word is looked up if the task has met it before; the memory for that is bounded.
"""
from __future__ import annotations

import os
from operator import methodcaller

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.snapshot import snapshot
from ..plans.streamed import shuffle_width

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 512
GUARD = 2
KNOWN_WORDS = 300_000
KNOWN_LENGTH = 64
BATCH_CHARS = 1 << 20
plain = methodcaller("as_py")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _whole(path: str):
    """(row, number of tokens) of texts that take one chunk."""
    def run(batches):
        enc, known = _tokenizer(path), {"": 0}

        def learn(words):
            todo, size = [], 0
            for w in words:
                todo.append(w)
                size += len(w)
                if size >= BATCH_CHARS:
                    yield from zip(todo, map(len, enc.encode_batch_fast(todo, add_special_tokens=False)))
                    todo, size = [], 0
            if todo:
                yield from zip(todo, map(len, enc.encode_batch_fast(todo, add_special_tokens=False)))

        for batch in batches:
            counts = []
            for text in map(plain, batch.column(1)):
                words = text.replace("\n", " ").split(" ")
                try:
                    counts.append(sum(map(known.__getitem__, words)))
                    continue
                except KeyError:
                    pass
                new = dict(learn({w for w in words if w not in known}))
                counts.append(sum(known[w] if w in known else new[w] for w in words))
                known.update((w, n) for w, n in new.items() if len(w) <= KNOWN_LENGTH)
                if len(known) > KNOWN_WORDS:
                    known = {"": 0}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["key", "n"])
    return run


def _cut(chunk_chars: int, overlap: int):
    """Chunks (row, number, last, start, text). A row's number is its place in its partition."""
    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for key, text in zip(*(map(plain, c) for c in batch.columns)):
                step = chunk_chars
                n = 1 if len(text) <= step + overlap else -(-(len(text) - overlap) // step)
                for i in range(n):
                    end = len(text) if i == n - 1 else i * step + step + overlap
                    yield pa.RecordBatch.from_pylist([{"row": row, "key": key, "i": i, "last": i == n - 1, "at": i * step,
                                                       "text": text[i * step:end]}], schema=batch_schema(batch))
                row += 1

    def batch_schema(batch):
        return pa.schema([("row", pa.int64()), ("key", batch.schema.field(0).type), ("i", pa.int32()), ("last", pa.bool_()),
                          ("at", pa.int64()), ("text", pa.string())])
    return run


def _encode(path: str, overlap: int):
    """Per chunk its number of tokens and the stable boundaries in both overlaps: (place in the
    text, tokens before it, the tokens around it)."""
    mark = pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int64()), ("around", pa.string())]))

    def run(batches):
        enc = _tokenizer(path)
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                text, at = r["text"], r["at"]
                e = enc.encode(text, add_special_tokens=False)
                ids, offsets, n = e.ids, e.offsets, len(text)
                head, tail = [], []
                for k in range(GUARD, len(ids) - GUARD + 1):
                    place = offsets[k][0] if k < len(ids) else n
                    into = head if place <= overlap else tail if place >= n - overlap else None
                    if into is None or not 0 < place < n or not (text[place - 1] in " \n" or text[place] == " "):
                        continue
                    around = ",".join(f"{ids[j]}@{at + offsets[j][0]}" for j in range(k - GUARD, k + GUARD))
                    into.append({"place": at + place, "before": k, "around": around})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["row"]], pa.int64()), pa.array([r["key"]], batch.schema.field(1).type),
                     pa.array([r["i"]], pa.int32()), pa.array([r["last"]]), pa.array([len(ids)], pa.int64()), pa.array([head], mark), pa.array([tail], mark)],
                    names=["row", "key", "i", "last", "n", "head", "tail"])
    return run


def _spliced(chunks: DataFrame) -> DataFrame:
    """(row, key, n, ok): sums over the chunks, each from its splice with the one before to its
    splice with the one after."""
    w = Window.partitionBy("row").orderBy("i")
    ahead = F.lead("head").over(w)
    both = F.filter(F.col("tail"), lambda t: F.exists(
        F.col("ahead"), lambda h: (h["place"] == t["place"]) & (h["around"] == t["around"])))
    here = F.get(F.col("both"), F.lit(0))
    there = F.get(F.filter(F.col("ahead"), lambda h: h["place"] == here["place"]), F.lit(0))
    joined = (chunks.withColumn("ahead", ahead).withColumn("both", both)
                    .withColumn("end", F.when(F.col("last"), F.col("n")).otherwise(here["before"]))
                    .withColumn("next", there["before"])
                    .withColumn("from", F.when(F.col("i") == 0, F.lit(0)).otherwise(F.lag("next").over(w))))
    return joined.groupBy("row").agg(F.first("key").alias("key"), F.sum(F.col("end") - F.col("from")).alias("n"),
                                     F.bool_and((F.col("end") - F.col("from")).isNotNull()).alias("ok"))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, ``n_bytes``, ``n_tokens``), one row per input row: the tokens of the whole text as the
    tokenizers file at ``path`` gives them, without added ones, and its UTF-8 length.

    A null text counts as empty; a null id keeps its row; rows that repeat are counted each by
    itself; an empty table gives an empty table. Other columns are not read."""
    src = docs.select(F.struct(F.col(id_col).alias("id"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("b")).alias("key"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    short = src.filter(F.length("text") <= chunk_chars).mapInArrow(_whole(path), f"key {kind}, n long")
    long = src.filter(F.length("text") > chunk_chars)
    done, left, width = [short], None, shuffle_width(docs)
    while True:
        chunks = long.mapInArrow(_cut(chunk_chars, overlap), f"row long, key {kind}, i int, last boolean, at long, text string")
        if left is not None:
            chunks = chunks.join(left, "row", "left_semi")
        marks = "array<struct<place: long, before: long, around: string>>"
        encoded = chunks.repartition(width).mapInArrow(
            _encode(path, overlap), f"row long, key {kind}, i int, last boolean, n long, head {marks}, tail {marks}")
        found = snapshot(_spliced(encoded), "token-counts")
        done.append(found.filter("ok").select("key", "n"))
        left = found.filter("not ok").select("row")
        if left.isEmpty():
            break
        overlap *= 4
        chunk_chars = max(chunk_chars, overlap)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("key.id").alias(id_col), F.col("key.b").alias("n_bytes"), F.col("n").alias("n_tokens"))
