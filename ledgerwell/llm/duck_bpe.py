"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Encoding. The partition's different pre-tokens become rows (word, position, token), linked to the
token on their right. A recursive query joins them with the merge table and contracts in each
word the leftmost pair of minimum rank, until no word has a pair left. Pre-tokens that are
tokens themselves need no merge. Words already met by the worker process are looked up.

Decoding. Rows (document, position, token) join the vocabulary; the bytes in the order of the
positions are those of the documents one after the other.

DuckDB runs in memory on one thread per task, over batches of bounded size: a word of n bytes may
pass through n steps of n rows, so a query takes words up to a bound on the sum of n * n. The rare
pre-token beyond ``LONG_WORD`` bytes (no blank, no change of character class) is contracted in the
same order with a heap.
"""
from __future__ import annotations

import base64
import heapq
import os
import sys
from array import array
from itertools import accumulate, chain
from operator import methodcaller
from types import ModuleType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_PER_QUERY = 10_000
ROWS_PER_QUERY = 1 << 22
LONG_WORD = 1000
IDS_PER_QUERY = 1 << 18
KNOWN_WORDS = 1_000_000
KNOWN_LENGTH = 64
TEXT_PER_CALL = 1 << 23
plain = methodcaller("as_py")

MERGE = """
WITH RECURSIVE s(w, p, t, q, r, step) AS (
    SELECT w, p, t, q, r, 0 FROM init
    UNION ALL
    (WITH least AS (SELECT w, min(m << 32 | p) AS b, arg_min(q, m << 32 | p) AS gone
                    FROM s JOIN merges ON merges.k = (s.t << 20 | s.r) GROUP BY w),
     pair AS (SELECT least.w, b >> 32 AS m, b & 4294967295 AS spot, gone, s.q AS after, s.r AS right_token
              FROM least JOIN s ON s.w = least.w AND s.p = least.gone)
     SELECT s.w, s.p, CASE WHEN s.p = spot THEN m ELSE t END,
            CASE WHEN s.p = spot THEN after ELSE q END,
            CASE WHEN s.p = spot THEN right_token WHEN q = spot THEN m ELSE r END, step + 1
     FROM s JOIN pair ON s.w = pair.w WHERE s.p <> gone))
SELECT s.w, s.t FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) z ON s.w = z.w AND s.step = z.step
ORDER BY s.w, s.p
"""
DECODE = "SELECT d, h FROM ids JOIN vocab ON vocab.t = ids.t ORDER BY p"

#: The pattern whose rules ``_starts`` knows beyond the blank before a word.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK, BREAK, LETTER, SIGN, QUOTE, DIGIT, FIRST, OTHER = range(8)


def _kind(b: int) -> int:
    """What a byte says of its character. ``FIRST`` opens one that is no white space; the rest may be anything."""
    c = chr(b)
    if b > 127:
        return FIRST if 0xC3 <= b <= 0xE0 or 0xE4 <= b <= 0xF4 else OTHER
    return (BLANK if c == " " else BREAK if c in "\t\n\r" else LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'"
            else SIGN if 32 < b < 127 else OTHER)


KINDS = bytes(map(_kind, range(256)))


def _starts(text: bytes, at, fine: bool):
    """Where the parts of texts begin, which are encoded one by one; ``at`` are the ends of the texts, from 0 on. A blank between
    two characters that are no white space starts a pre-token by the usual byte-level patterns. By ``GPT2`` (``fine``) so does
    a blank before such a character whatever stands before it, white space behind a character that is none, what follows a lone
    break, a sign behind a letter, and a letter behind a sign but the quote. Where a byte does not tell, nothing is cut."""
    import numpy as np
    kind = np.frombuffer(text.translate(KINDS), np.uint8)
    plain_ = (kind >= LETTER) & (kind <= DIGIT)
    opens = np.append(plain_[1:] | (kind[1:] == FIRST), False)
    opens[at[1:][at[1:] > 0] - 1] = False                         # the next character is another text's
    cut = np.zeros(len(kind) + 1, bool)
    before, here = kind[:-1], kind[1:]
    blank = (kind == BLANK) & opens
    if fine:
        cut[:-1] = blank
        cut[1:-1] |= plain_[:-1] & (here <= BREAK)
        cut[2:-1] |= plain_[:-2] & (before[1:] == BREAK) & opens[1:-1]
        cut[1:-1] |= (before == LETTER) & ((here == SIGN) | (here == QUOTE)) | (before == SIGN) & (here == LETTER)
    else:
        cut[1:-1] = blank[1:] & plain_[:-1]
    cut[at] = True
    cut[-1] = False
    return np.flatnonzero(cut)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token, as left << 20 | right, and its rank."""
    pairs = [(ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
             if t[:i] in ranks and t[i:] in ranks]
    return pa.table({"k": pa.array([k for k, _ in pairs], pa.int64()), "m": pa.array([m for _, m in pairs], pa.int64())})


def _connect():
    import duckdb
    con = duckdb.connect(config={"threads": 1})
    con.execute("SET preserve_insertion_order = false")
    return con


class _Pairs:
    """Rank of a pair of tokens, or None; a dictionary only once it is needed."""

    def __init__(self, table: pa.Table):
        self.table, self.ranks = table, None

    def __call__(self, left: int, right: int) -> int | None:
        if self.ranks is None:
            self.ranks = dict(zip(*(c.to_pylist() for c in self.table.columns)))
        return self.ranks.get(left << 20 | right)


def contract(tokens: list[int], rank) -> list[int]:
    """Contract the leftmost pair of minimum rank until none is left."""
    n = len(tokens)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank(tokens[i], tokens[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, j = heapq.heappop(heap)
        if not (alive[i] and after[i] == j and j < n and alive[j] and rank(tokens[i], tokens[j]) == r):
            continue
        tokens[i], alive[j], after[i] = r, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (new := rank(tokens[a], tokens[b])) is not None:
                heapq.heappush(heap, (new, a, b))
    return [t for t, ok in zip(tokens, alive) if ok]


class Merger:
    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np
        self.ranks, self.con = ranks, _connect()
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        table = merge_table(ranks)
        self.con.register("given", table)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.pairs = _Pairs(table)

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word, as little-endian 32-bit integers. Words of a length share a query: it takes as many steps as
        its longest word, and every step reads the merge table."""
        done, todo, size = {}, [], 0
        for w in sorted(words, key=len):
            r = self.ranks.get(w)
            if r is not None:
                done[w] = r.to_bytes(4, "little")
            elif len(w) > LONG_WORD:
                done[w] = array("I", contract([self.ranks[w[i:i + 1]] for i in range(len(w))], self.pairs)).tobytes()
            else:
                if todo and (len(todo) >= WORDS_PER_QUERY or size + len(w) ** 2 > ROWS_PER_QUERY):
                    done.update(self._query(todo))
                    todo, size = [], 0
                todo.append(w)
                size += len(w) ** 2
        if todo:
            done.update(self._query(todo))
        return done

    def _query(self, words):
        import numpy as np
        lens = np.fromiter(map(len, words), np.int64, len(words))
        t = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lens)
        p = np.arange(len(t)) - np.repeat(ends - lens, lens)
        q, r = p + 1, np.append(t[1:], -1)
        q[ends - 1], r[ends - 1] = -1, -1
        self.con.register("init", pa.table({"w": np.repeat(np.arange(len(words)), lens), "p": p, "t": t, "q": q, "r": r}))
        got = self.con.sql(MERGE).to_arrow_table()
        flat = got.column(1).to_numpy().astype("<i4").tobytes()
        cut = (4 * np.concatenate(([0], np.cumsum(np.bincount(got.column(0).to_numpy(), minlength=len(words)))))).tolist()
        return zip(words, [flat[i:j] for i, j in zip(cut, cut[1:])])


class Encoder:
    """Ids of texts; remembers the words it has met, up to a bound."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.merger, self.find, self.fine = Merger(read_ranks(path)), regex.compile(pattern).findall, pattern == GPT2
        self.known: dict[str, bytes] = {}

    def _strings(self, strings: list[str]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, strings))
        new = [i for i, ids in enumerate(out) if ids is None]
        cut = [(s,) if self.fine and s[s[:1] == " ":].isalpha() else self.find(s) for s in map(strings.__getitem__, new)]
        words = list(set(chain.from_iterable(cut)).difference(known))
        in_bytes = [w.encode("utf-8", "replace") for w in words]
        ids = self.merger.encode(list(dict.fromkeys(in_bytes)))
        known.update(zip(words, map(ids.__getitem__, in_bytes)))
        for i, c in zip(new, cut):
            out[i] = known[c[0]] if len(c) == 1 else b"".join([known[w] for w in c])
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if len(w) > KNOWN_LENGTH:
                known.pop(w, None)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each different part is looked up once, and the ids of a text are gathered from those of its parts."""
        import numpy as np
        text = [t.encode("utf-8", "replace") for t in texts]
        at = np.append(0, np.cumsum(np.fromiter(map(len, text), np.int64, len(text))))
        text = b"".join(text)
        if not text:
            return [b""] * len(texts)
        starts = _starts(text, at, self.fine)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(text))), pa.py_buffer(text)).dictionary_encode()
        ids, place = self._strings(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = sizes[place]
        ends = np.append(0, np.cumsum(n))
        gather = np.repeat((np.cumsum(sizes) - sizes)[place] - ends[:-1], n) + np.arange(ends[-1])
        flat = np.frombuffer(b"".join(ids), "<i4")[gather].tobytes()
        bounds = (4 * ends[np.searchsorted(starts, at)]).tolist()
        return [flat[i:j] for i, j in zip(bounds, bounds[1:])]


def _encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this worker process, which the tasks it runs share. This module is sent by value with each task, so the
    encoder is kept in one that is not."""
    memory = vars(sys.modules.setdefault("ledgerwell_worker_memory", ModuleType("ledgerwell_worker_memory")))
    file = os.stat(path)
    key = path, pattern, file.st_mtime_ns, file.st_size
    if memory.get("bpe_key") != key:
        memory.update(bpe_key=key, bpe_encoder=Encoder(path, pattern))
    return memory["bpe_encoder"]


def _encode_task(path: str, pattern: str):
    def run(batches):
        import numpy as np
        import pyarrow.compute as pc
        encoder = _encoder(path, pattern)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_PER_CALL, "right")))
                some = batch.slice(at, end - at)
                ids = encoder([t or "" for t in map(plain, some.column(1))])
                offsets = [0, *accumulate(len(x) // 4 for x in ids)]
                flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["row", "ids"])
                at = end
    return run


def _round_trip_task(path: str, pattern: str):
    def run(batches):
        yield from _decode_task(path)(_encode_task(path, pattern)(batches))
    return run


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids``, ``bytes``): ``encode`` and ``decode`` one after the other in the same task."""
    src = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    kind = src.schema["row"].dataType.simpleString()
    out = src.mapInArrow(_round_trip_task(path, pattern), f"row {kind}, ids array<int>, bytes binary")
    return out.select(F.col("row.id").alias(id_col), "ids", "bytes")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids`` array<int>) of each row's whole text by the rank file at ``path`` and the
    pre-token ``pattern``, without special tokens. A null text is empty and has no ids; null ids
    and repeated rows keep their rows; an empty table gives an empty table. Other columns are not
    read."""
    src = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    kind = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(_encode_task(path, pattern), f"row {kind}, ids array<int>").select(F.col("row.id").alias(id_col), "ids")


def _decode_task(path: str):
    def run(batches):
        import numpy as np
        import pyarrow.compute as pc
        con = _connect()
        ranks = read_ranks(path)
        con.register("given", pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "h": pa.array(list(ranks), pa.binary())}))
        con.execute("CREATE TABLE vocab AS SELECT * FROM given")

        def bytes_of(ids):
            lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            con.register("ids", pa.table({"d": np.repeat(np.arange(len(lens), dtype=np.int32), lens), "p": np.arange(len(flat), dtype=np.int32), "t": flat}))
            got = con.sql(DECODE).to_arrow_table().combine_chunks()
            rows = np.append(0, np.cumsum(np.bincount(got.column(0).to_numpy(), minlength=len(lens))))
            if not rows[-1]:
                return pa.array([b""] * len(lens), pa.binary())
            _, ends, data = got.column(1).cast(pa.large_binary()).chunk(0).buffers()
            ends = np.frombuffer(ends, np.int64)[rows].astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends), data])

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                base = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, base + IDS_PER_QUERY, "right")))
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), bytes_of(rows.column(1))], names=["row", "ids", "bytes"])
                lo = hi
    return run


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """The rows with ``out_col`` (binary): the bytes of their ids. Null or empty ids give no bytes;
    an id that is not in the file is an error of the caller and adds nothing."""
    keep = [c for c in encoded.columns if c not in (ids_col, out_col)]
    src = encoded.select(F.struct(*keep).alias("row"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = src.schema["row"].dataType.simpleString()
    out = src.mapInArrow(_decode_task(path), f"row {kind}, ids array<int>, bytes binary")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("ids").alias(ids_col), F.col("bytes").alias(out_col))
