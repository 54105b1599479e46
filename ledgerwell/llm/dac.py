"""Token files with directly addressable codes.

A file holds the ids of many documents one after the other. Every id is split into chunks of
eight bits, the lowest first. Level 0 has the lowest chunk of every id; level k has chunk k of
the ids that need it, in their order. A bitmap beside each level says which of its ids go on in
the next level, and a rank directory holds the number of set bits before every block of 512 bits.
The place of an id in the next level is the number of set bits before it: one entry of the
directory and one block. Any token is therefore read with a few short reads, no block of codes is
decoded on the way, and a range of tokens is a range of every level.

    magic | levels: chunks, bitmap, directory, ... | document ids (Arrow) | ends of the documents | footer (JSON) | its length

Files are written by tasks into a folder all executors reach, each under a name of its own; the
manifest, a written table, names the files of the attempts that succeeded.
"""
from __future__ import annotations

import io
import json
import os
import sys
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, count
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import in_range_order
from ..plans.snapshot import shared_folder, snapshot
from ..plans.streamed import shuffle_width

MAGIC = b"DACFILE1"
BLOCK = 512                      # bits of a bitmap between two entries of its directory
FILE_TOKENS = 1 << 25            # a file ends with the document that reaches this many ids
KNOWN_WORDS = 600_000
LEARN_AT_ONCE = 20_000           # words handed to the library in one call
KNOWN_IDS = 4_000_000
BATCH_CHARS = 1 << 22
#: A Latin letter before an ASCII sign that neither opens a contraction nor occurs in the special
#: strings. Letters and signs are never one token here, so a blank between them changes no id.
SIGN_AFTER_LETTER = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-&(-/:;=?@\[-`{}~])"
MANIFEST = "file string, part long, number long, n_docs long, n_tokens long"


# --- the codes

def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of every level. The directory counts the bits before a block."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        chunks, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        out.append((chunks, bits, np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)]).astype("<u8")))
        rest = rest[more] >> 8
        if not len(rest):
            return out


def file_bytes(ids: np.ndarray, doc_ids: pa.Array, ends: np.ndarray) -> Iterator[bytes]:
    """The parts of a file in order."""
    at, sections = len(MAGIC), []
    yield MAGIC

    def section(data) -> bytes:
        nonlocal at
        raw = bytes(data)
        sections.append((at, len(raw)))
        at += len(raw)
        return raw

    levels = levels_of(ids)
    for level in levels:
        for part in level:
            yield section(part.tobytes())
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("id", doc_ids.type)])) as w:
        w.write_batch(pa.record_batch([doc_ids], names=["id"]))
    yield section(sink.getvalue())
    yield section(ends.astype("<u8").tobytes())
    footer = json.dumps({"tokens": len(ids), "documents": len(doc_ids), "levels": len(levels), "sections": sections}).encode()
    yield footer + len(footer).to_bytes(8, "little")


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if ":/" in path else "file://" + os.path.abspath(path))


class TokenFile:
    """Random access to a file: ``token`` and ``tokens`` read only the bytes they need."""

    def __init__(self, path: str):
        fs, name = _filesystem(path)
        self._file, size = fs.open_input_file(name), fs.get_file_info(name).size
        n = int.from_bytes(self._read(size - 8, 8), "little")
        footer = json.loads(self._read(size - 8 - n, n))
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.n_tokens, self.n_documents = footer["tokens"], footer["documents"]
        self._sections, self._levels = footer["sections"], footer["levels"]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()

    def _read(self, at: int, n: int) -> bytes:
        return self._file.read_at(n, at)

    def _part(self, section: int, first: int, stop: int) -> bytes:
        return self._read(self._sections[section][0] + first, stop - first)

    def _rank(self, level: int, place: int) -> int:
        """Set bits of a level's bitmap before ``place``: a directory entry and a part of one block."""
        block = place // BLOCK
        before = int.from_bytes(self._part(3 * level + 2, 8 * block, 8 * block + 8), "little")
        first = block * (BLOCK // 8)
        bits = np.unpackbits(np.frombuffer(self._part(3 * level + 1, first, first + -(-(place % BLOCK) // 8)), np.uint8), bitorder="little")
        return before + int(bits[:place % BLOCK].sum())

    def token(self, place: int) -> int:
        """The id at a place of the file."""
        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        value = 0
        for level in range(self._levels):
            value |= self._part(3 * level, place, place + 1)[0] << (8 * level)
            bit = self._part(3 * level + 1, place // 8, place // 8 + 1)[0] >> (place % 8) & 1
            if not bit:
                break
            place = self._rank(level, place)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``: one range of every level."""
        out = np.zeros(stop - start, np.uint32)
        places = None                                              # of this level's ids in the result
        for level in range(self._levels):
            if stop <= start:
                break
            chunks = np.frombuffer(self._part(3 * level, start, stop), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            if places is None:
                out |= chunks
            else:
                out[places] |= chunks
            bits = np.unpackbits(np.frombuffer(self._part(3 * level + 1, start // 8, -(-stop // 8)), np.uint8), bitorder="little")
            more = np.flatnonzero(bits[start % 8:start % 8 + stop - start])
            start, stop = (at := self._rank(level, start)), at + len(more)
            places = more if places is None else places[more]
        return out

    def documents(self) -> tuple[pa.Array, np.ndarray]:
        """Their ids and the place after the last token of each."""
        at = 3 * self._levels
        raw = self._part(at, 0, self._sections[at][1])
        ends = np.frombuffer(self._part(at + 1, 0, self._sections[at + 1][1]), "<u8").astype(np.int64)
        return pa.ipc.open_stream(raw).read_all().column(0).combine_chunks(), ends


# --- encoding

class _WordIds:
    """Ids of blank-separated words, encoded by the library when first met. White space ends a word
    for the tokenizers this is meant for: they drop it, and no merge or special string crosses it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._enc = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self._known, self._ids, self._ends = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, lengths = [self._ids], []
        for i in range(0, len(words), LEARN_AT_ONCE):
            got = [e.ids for e in self._enc.encode_batch_fast(words[i:i + LEARN_AT_ONCE], add_special_tokens=False)]
            lengths += map(len, got)
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
        self._known.update(zip(words, count(len(self._known))))
        self._ids = np.concatenate(ids)
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(lengths, dtype=np.int64)])

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._known) > KNOWN_WORDS or len(self._ids) > KNOWN_IDS:
            self._forget()
        self._learn([w for w in distinct if w not in self._known])
        number = np.fromiter(map(self._known.__getitem__, distinct), np.int64, len(distinct))
        starts, lengths = self._ends[number], self._ends[number + 1] - self._ends[number]
        which = coded.indices.to_numpy()
        n = lengths[which]
        shift = starts[which] - (np.cumsum(n) - n)
        return self._ids[np.repeat(shift, n) + np.arange(n.sum())], n


def _word_ids(path: str) -> _WordIds:
    """The words a worker process has met stay for its next tasks, where Spark uses it again."""
    memory = vars(sys.modules.setdefault("ledgerwell_worker_memory", ModuleType("ledgerwell_worker_memory")))
    if path not in memory:
        memory[path] = _WordIds(path)
    return memory[path]


def _words(texts: pa.Array) -> pa.ListArray:
    """Words of the texts, signs behind a letter apart from it."""
    return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, SIGN_AFTER_LETTER, r"\1 \2"))


def _pieces(texts: Iterable[str | None], limit: int):
    """Batches of pieces [(document, text)] of about ``limit`` characters; long texts are cut behind
    a blank."""
    batch, size = [], 0
    for doc, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            stop = len(text)
            if stop - at > limit:
                cut = max(text.rfind(" ", at, at + limit), text.rfind("\n", at, at + limit))
                stop = cut + 1 if cut >= at else min((i for i in (text.find(" ", at + limit), text.find("\n", at + limit)) if i >= 0), default=len(text) - 1) + 1
            batch.append((doc, text[at:stop]))
            size += stop - at
            at = stop
            if size >= limit:
                yield batch
                batch, size = [], 0
            if at >= len(text):
                break
    if batch:
        yield batch


def encoded(enc: _WordIds, texts: pa.Array, end_id: int | None, limit: int = BATCH_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """The ids of the texts in order, the end id behind each, in steps: (ids, number of them by
    document, the first of these documents, whether the last one goes on in the next step)."""
    pieces = _pieces((t.as_py() for t in texts), limit)
    batch = next(pieces, None)
    while batch is not None:
        after = next(pieces, None)
        words = _words(pa.array([t for _, t in batch], pa.string()))
        ids, per_word = enc.of(words.flatten())
        upto = np.concatenate([[0], np.cumsum(per_word)])[words.offsets.to_numpy()]
        docs = np.fromiter((d for d, _ in batch), np.int64, len(batch))
        first, last = int(docs[0]), int(docs[-1])
        goes_on = after is not None and after[0][0] == last
        per_doc = np.bincount(docs - first, np.diff(upto), last - first + 1).astype(np.int64)
        if end_id is not None:
            ends = np.cumsum(per_doc)[:len(per_doc) - goes_on]
            ids = np.insert(ids, ends, end_id)
            per_doc[:len(ends)] += 1
        yield ids, per_doc, first, goes_on
        batch = after


def _write(path: str, end_id: int | None, folder: str, file_tokens: int):
    """Per batch of sorted rows (id, text) the files they fill: rows of the manifest."""
    def run(batches):
        from pyspark import TaskContext
        part, number, enc = TaskContext.get().partitionId(), 0, _word_ids(path)
        fs, base = _filesystem(folder)
        names, ids, counts, held = [], [], [], 0                   # of the file that is being filled

        def close():
            nonlocal names, ids, counts, held, number
            all_ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            ends = np.cumsum(np.concatenate(counts))
            name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex[:12]}.dac"
            with fs.open_output_stream(f"{base}/{name}") as out:
                for raw in file_bytes(all_ids, pa.concat_arrays(names), ends):
                    out.write(raw)
            row = pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "part": [part], "number": [number], "n_docs": [len(ends)], "n_tokens": [len(all_ids)]})
            names, ids, counts, held, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            key, carried = batch.column(0), 0
            for got, per_doc, first, goes_on in encoded(enc, batch.column(1), end_id):
                per_doc[0] += carried
                carried = per_doc[-1] if goes_on else 0
                whole = per_doc[:-1] if goes_on else per_doc
                ids.append(got)
                held += len(got)
                if len(whole):
                    names.append(key.slice(first, len(whole)))
                    counts.append(whole)
                if held >= file_tokens and not goes_on:
                    yield close()
        if names:
            yield close()
    return run


def write_files(docs: DataFrame, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                folder: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes every whole text with the tokenizers file at ``path`` (no added ids but ``end_id``
    behind each document) and writes the ids in ascending order of the document id. Returns the
    manifest (file, part, number, n_docs, n_tokens, start): files in order of (part, number),
    ``start`` the number of ids in all files before.

    A null text counts as empty; null ids come first; rows with equal ids stand in order of a digest
    of their texts, and rows that repeat are documents each; an empty table writes no file. Other
    columns are not read. A document is never cut between files."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/ledgerwell/{docs.sparkSession.sparkContext.applicationId}/tokens-{uuid.uuid4().hex[:12]}"
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # equal ids are dealt by their texts too, and equal rows by their places: none makes a range one task
    rows = in_range_order(rows.select("id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row")), ["id", "tie", "row"])
    files = snapshot(rows.select("id", "text").mapInArrow(_write(path, end_id, folder, file_tokens), MANIFEST), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)      # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _documents(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with TokenFile(path) as f:
                    doc_ids, ends = f.documents()
                    starts = np.concatenate([[0], ends[:-1]])
                    for i, j in _runs(ends, BATCH_CHARS):
                        raw = f.tokens(int(starts[i]), int(ends[j - 1])).astype("<u4").tobytes()
                        cut = 4 * (np.concatenate([starts[i:j], ends[j - 1:j]]) - starts[i])
                        yield pa.RecordBatch.from_arrays(
                            [doc_ids.slice(i, j - i).cast(id_type), pa.array(starts[i:j] + start), pa.array(ends[i:j] - starts[i:j]),
                             pa.array([raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())], schema=schema)
    return run


def _runs(ends: np.ndarray, limit: int):
    """Ranges of documents with about ``limit`` ids."""
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def read_documents(manifest: DataFrame, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """(id, ``start``: ids of all documents before, ``n_tokens``, ``ids``: little-endian unsigned
    32-bit) of every document in the files of a manifest; files are dealt over the cluster."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    kind = to_arrow_type(_parse_datatype_string(id_type))
    files = manifest.select("file", "start").repartition(shuffle_width(manifest))
    got = files.mapInArrow(_documents(kind), f"id {id_type}, start long, n_tokens long, ids binary")
    return got.withColumnRenamed("id", id_col)
