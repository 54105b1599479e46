"""Lexical retrieval packing: documents that share rare words fill a window together.

The corpus is packed in shards of bounded size, cut along the input partitions without a shuffle.
A shard holds a BM25 inverted index of its documents. The first unused document seeds a window;
the index returns its unused neighbours, best first, and they fill the window greedily. A
document that is cut by the end of a window seeds the next one with its rest; when no neighbour
is left, the next unused document goes on. What remains at the end of a shard is cut into
sequences whose lengths are powers of two, so nothing is padded.

Token ids come from the tokenizers file. A blank between two characters that are not white space
always starts a new pre-token, so each blank-separated part of a text is encoded once per shard
or so and looked up afterwards; texts that break the rule are encoded whole.
"""
from __future__ import annotations

import json
import os
from array import array
from operator import methodcaller

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import regular

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 4_000_000
SHARD_DOCS = 4096
SORTED_FIRST = 32
K1, B = 1.2, 0.75
KNOWN_PARTS = 500_000
plain = methodcaller("as_py")


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The tokens of a byte-level tokenizers file as bytes with their ids, if its merges are in
    the order of the ids they make, so that an id is also the rank of its merge."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]     # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if ids != sorted(ids):
        return None
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t) and "<|" not in t}


class Encoder:
    """Token ids (little-endian 32-bit) and part numbers of texts.

    Ids are those of the tokenizers library; where the file's ids are also its merge ranks, plain
    parts go through tiktoken, which gives the same ids for a fraction of the time. Anything that
    could hold a special token goes through tokenizers."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.enc, self.fast = Tokenizer.from_file(path), None
        ranks = byte_ranks(path)
        if ranks:
            import tiktoken
            self.fast = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._start()

    def _start(self):
        encode, ids = self.encode, []

        class Known(dict):
            def __missing__(self, part):
                n = self[part] = len(ids)
                # parts that break the rule have a number for retrieval, but no ids
                ids.append(encode(" " + part) if regular(part) else None)
                return n
        self.known, self.ids = Known(), ids

    def encode(self, text: str) -> bytes:
        if self.fast is not None and "<|" not in text:
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.enc.encode(text, add_special_tokens=False).ids).tobytes()

    def forget(self):
        """Between shards: part numbers start anew when there are too many."""
        if len(self.known) > KNOWN_PARTS:
            self._start()

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        parts = text.split(" ")
        numbers = list(map(self.known.__getitem__, parts))
        try:
            return self.encode(parts[0]) + b"".join(map(self.ids.__getitem__, numbers[1:])), numbers
        except TypeError:
            return self.encode(text), numbers


class Index:
    """Postings of a shard: for each document its shared terms, and for each term its documents and
    BM25 weights. ``terms`` has the distinct term numbers and frequencies of each document."""

    def __init__(self, terms: list, n_words):
        import numpy as np
        n = len(terms)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in terms])
        term = np.concatenate([t for t, _ in terms]) if n else np.empty(0, np.int64)
        tf = np.concatenate([f for _, f in terms]).astype(float) if n else np.empty(0)
        _, term = np.unique(term, return_inverse=True)
        df = np.bincount(term)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * n_words / max(n_words.mean(), 1e-9))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        shared = df[term] > 1                       # a term of one document finds nobody
        doc, term, weight = doc[shared], term[shared], weight[shared]
        self.ask = np.split(term, np.searchsorted(doc, np.arange(1, n))) if n else []
        order = np.argsort(term, kind="stable")
        self.live, self.n_terms = n, len(df)
        self._hold(term[order], doc[order], weight[order])

    def _hold(self, term, doc, weight):
        import numpy as np
        self.term, self.doc, self.weight = term, doc, weight
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=self.n_terms))))

    def neighbours(self, doc: int, unused):
        """Unused documents that share a term, best BM25 score over all shared terms first, then in
        order. Postings of used documents go when a quarter of the documents is used."""
        import numpy as np
        live = int(np.count_nonzero(unused))
        if 4 * live <= 3 * self.live:
            kept = unused[self.doc]
            self.live = live
            self._hold(self.term[kept], self.doc[kept], self.weight[kept])
        first, last = self.starts[self.ask[doc]], self.starts[self.ask[doc] + 1]
        ends = np.cumsum(last - first)
        if not len(ends) or not live:
            return
        at = np.repeat(last - ends, last - first)
        at += np.arange(len(at))
        score = np.bincount(self.doc[at], self.weight[at], len(unused))
        score[~unused] = 0.0
        # few are asked for: the best are sorted first, ties of the last of them included
        least = np.partition(score, -SORTED_FIRST)[-SORTED_FIRST] if len(score) > SORTED_FIRST else 0.0
        for some in ((score >= least) & (score > 0), (score < least) & (score > 0)):
            found = np.flatnonzero(some)
            yield from found[np.argsort(-score[found], kind="stable")].tolist()


def fill(lengths, index, window: int):
    """Pieces (document, start, length, sequence, offset) of one shard."""
    import numpy as np
    unused = np.ones(len(lengths), bool)
    pieces, sequence, room = [], 0, window
    order, waiting, rest = iter(range(len(lengths))), iter(()), None
    while True:
        doc, start = rest or (next((d for d in waiting if unused[d]), None), 0)
        seed = rest is not None or doc is None    # the rest of a cut document, or the next in order
        if doc is None:
            doc = next((d for d in order if unused[d]), None)
        if doc is None:
            return _close(pieces, sequence, window - room)
        unused[doc] = False
        take = min(room, lengths[doc] - start)
        pieces.append([doc, start, take, sequence, window - room])
        room -= take
        rest = (doc, start + take) if start + take < lengths[doc] else None
        if not room:
            sequence, room = sequence + 1, window
        if seed and rest is None:
            waiting = index.neighbours(doc, unused)


def _close(pieces, sequence: int, used: int):
    """Cut the last, partly filled sequence into powers of two, the largest first."""
    done, last = [p for p in pieces if p[3] != sequence], [p for p in pieces if p[3] == sequence]
    parts = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
    room = parts[0] if parts else 0
    for doc, start, length, _, _ in last:
        while length:
            take = min(room, length)
            done.append([doc, start, take, sequence, parts[0] - room])
            start, length, room = start + take, length - take, room - take
            if not room:
                parts.pop(0)
                sequence += 1
                room = parts[0] if parts else 0
    return done


def _pack_task(path: str, pattern: str, window: int, end_id: int):
    def run(batches):
        import numpy as np
        from pyspark import TaskContext
        encoder = Encoder(path, pattern)
        sequence = TaskContext.get().partitionId() << 33
        end = array("I", [end_id]).tobytes()
        rows, keys, tokens = [], [], 0

        def out():
            nonlocal sequence
            lengths = [len(r[0]) // 4 for r in rows]
            index = Index([r[1] for r in rows], np.array([r[2] for r in rows], float))
            pieces = fill(lengths, index, window)
            docs, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*pieces))
            ids = [rows[d][0][4 * s:4 * (s + n)] for d, s, n, _, _ in pieces]
            got = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys).take(pa.array(docs)), pa.array(start), pa.array(length), pa.array(np.array(lengths, np.int64)[docs]),
                 pa.array(seq + sequence), pa.array(offset), pa.array(ids, pa.binary())],
                names=["row", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            sequence += int(seq.max()) + 1
            return got

        for batch in batches:
            for k, text in enumerate(map(plain, batch.column(1))):
                ids, numbers = encoder(text or "")
                if rows and (tokens + len(ids) // 4 > SHARD_TOKENS or len(rows) >= SHARD_DOCS):
                    yield out()
                    rows, keys, tokens = [], [], 0
                    encoder.forget()
                    ids, numbers = encoder(text or "")
                keys.append(batch.column(0).slice(k, 1))
                rows.append((ids + end, np.unique(np.array(numbers, np.int64), return_counts=True), len(numbers)))
                tokens += len(ids) // 4 + 1
        if rows:
            yield out()
    return run


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``), ids
    as little-endian 32-bit integers by the tokenizers file at ``path``, whose pre-token rule is
    ``pattern``. Every id of every document, ``end_id`` after its text included, lies in
    exactly one piece; pieces lie in sequences of at most ``window`` ids, a power of two, without
    gaps, and sequences are either full or a power of two long.

    A null text is empty and has one piece of one id. Rows that repeat are packed each by itself;
    null ids keep their rows; an empty table gives an empty table. Other columns are not read."""
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    src = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    out = src.mapInArrow(_pack_task(path, pattern, window, end_id), f"row {src.schema['row'].dataType.simpleString()}, start long, length long, "
                         "doc_tokens long, sequence_id long, offset long, ids binary")
    return out.select(F.col("row.id").alias(id_col), *out.columns[1:])
