"""Removal of repeated passages by FM-indexes over word sequences.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window over it occurs
anywhere else.

Shards. The anchor of a window is its ``ANCHOR``-word piece with the smallest digest. Equal windows
have equal anchors, so only windows that share an anchor are ever compared. The windows around
one occurrence of an anchor form a segment; segments travel as two 64-bit digests, equal ones are
combined, and the words are fetched only for different segments whose anchor occurs again.

Index. A task turns the segments of its anchors, some hundred thousand words at a time, into an
FM-index: the Burrows-Wheeler transform of the words, ordered by 64 words of context, as a
wavelet matrix over packed bits. The segments are then streamed against it: backward search from
every window end, all at once, gives the matching statistics, the length of the longest match
that occurs twice; an interval that reaches the window's length is reported. Its context makes
the index exact for patterns of up to 64 words.

An anchor with more than ``FULL`` different segments (say a passage's first words, after a
different word in each document) is compared window by window instead, by digests counted over
the cluster, so no group of windows has to fit a task.

Words are compared by 64-bit digests, segments and single windows by 128-bit ones.
"""
from __future__ import annotations

from operator import methodcaller

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.snapshot import snapshot
from ..plans.streamed import shuffle_width

WINDOW = 35
ANCHOR = 12
FULL = 4096
BLOCK_WORDS = 1 << 20
INDEX_WORDS = 200_000
CONTEXT = 64
plain = methodcaller("as_py")


def word_digests(words):
    import numpy as np
    from xxhash import xxh64_intdigest
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int):
    import numpy as np
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Rolling:
    """128-bit digests of stretches of a word sequence."""

    def __init__(self, digests):
        import numpy as np
        n, self.sides = len(digests), []
        for base in _BASES:
            back = pow(base, -1, 1 << 64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digests * _powers(base, n)[:n], dtype=np.uint64)))
            self.sides.append((sums, _powers(back, n)))

    def __call__(self, start, end):
        import numpy as np
        out = []
        for sums, back in self.sides:
            x = (sums[end] - sums[start]) * back[start]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out.append((x ^ (x >> np.uint64(32))).view(np.int64))
        return out


def segments(digests, window: int, anchor: int):
    """Per anchor occurrence: anchor digest, segment digests, first window start, windows."""
    import numpy as np
    out, n = [], len(digests) - window + 1
    for lo in range(0, n, BLOCK_WORDS):
        d = digests[lo:min(lo + BLOCK_WORDS, n) + window - 1]
        rolling = Rolling(d)
        starts = np.arange(len(d) - anchor + 1)
        piece = rolling(starts, starts + anchor)[0]
        spans = np.lib.stride_tricks.sliding_window_view(piece, window - anchor + 1)
        at = spans.argmin(axis=1) + np.arange(len(spans))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        count = np.diff(first, append=len(at))
        one, two = rolling(first, first + count + window - 1)
        # the anchor's place in the segment is part of its name
        out.append((piece[at[first]], one + (at[first] - first), two, first + lo, count))
    return [np.concatenate(c) for c in zip(*out)]


def _segment_task(window: int, anchor: int):
    def run(batches):
        import numpy as np
        names = ["h", "s1", "s2", "a", "n"]
        for batch in batches:
            for k, text in enumerate(map(plain, batch.column(1))):
                words = (text or "").encode("utf-8", "replace").split()
                if len(words) >= window:
                    h, s1, s2, a, n = segments(word_digests(words), window, anchor)
                    key = batch.column(0).take(pa.array(np.full(len(h), k)))
                    yield pa.RecordBatch.from_arrays([key, *(pa.array(x, pa.int64()) for x in (h, s1, s2, a, n))], names=["key", *names])
    return run


class FMIndex:
    """Counts of word patterns of up to ``CONTEXT`` words in many sequences."""

    def __init__(self, sequences):
        import numpy as np
        gap = np.zeros(1, np.uint64)
        flat = np.concatenate([x for s in sequences for x in (s, gap)])
        ends = np.cumsum([len(s) + 1 for s in sequences]) - 1
        self.symbols, text = np.unique(flat, return_inverse=True)
        text = text.astype(np.int64) + 1
        text[ends] = 0
        self.text, self.size = text, len(text)
        order = self._order(text)
        last = text[order - 1]
        self.bits = max(1, int(text.max()).bit_length())
        counts = np.bincount(last, minlength=int(text.max()) + 2)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            bit = (last >> b & 1).astype(np.uint8)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[:len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((words, ones, len(bit) - int(bit.sum())))
            last = np.concatenate((last[bit == 0], last[bit == 1]))

    @staticmethod
    def _order(text):
        """Suffix order by the first ``CONTEXT`` symbols, by doubling; ties by place."""
        import numpy as np
        rank, n, k = text, len(text), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:n - k] = rank[k:] + 1
            key = rank * (int(ahead.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank, k = new, 2 * k
            if k >= CONTEXT or rank.max() == n - 1:
                return order

    def _rank(self, symbol, place):
        """How often the symbol precedes the place in the transform."""
        import numpy as np
        start, place = np.zeros_like(place), place.copy()
        for depth, (words, ones, zeros) in enumerate(self.levels):
            up = (symbol >> (self.bits - 1 - depth) & 1).astype(bool)
            for x in (start, place):
                below = ones[x >> 6] + np.bitwise_count(words[x >> 6] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)))
                x[:] = np.where(up, zeros + below, x - below)
        return place - start

    def statistics(self, ends, limit: int):
        """For each place of the indexed text: how many words up to and including it, at most
        ``limit`` and not beyond its sequence, form a match that occurs at least twice."""
        import numpy as np
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        length, active, at = np.zeros(len(ends), np.int64), np.arange(len(ends)), ends.copy()
        for _ in range(limit):
            c = self.text[at[active]]
            base = self.before[c]
            new_lo, new_hi = base + self._rank(c, lo[active]), base + self._rank(c, hi[active])
            good = (new_hi - new_lo >= 2) & (c > 0)
            active = active[good]
            if not len(active):
                break
            lo[active], hi[active] = new_lo[good], new_hi[good]
            length[active] += 1
            at[active] -= 1
            active = active[at[active] >= 0]
        return length


def repeated_windows(sequences, copies, window: int) -> list[int]:
    """For each segment a mask of the windows in it that occur again in these segments."""
    import numpy as np
    index = FMIndex([s for s, n in zip(sequences, copies) for _ in range(min(n, 2))])
    ends, owner, place = [], [], 0
    for i, (s, n) in enumerate(zip(sequences, copies)):
        if n == 1:
            ends.append(np.arange(place + window - 1, place + len(s)))
            owner.append(np.full(len(s) - window + 1, i))
        place += (len(s) + 1) * min(n, 2)
    masks = [(1 << (len(s) - window + 1)) - 1 if n > 1 else 0 for s, n in zip(sequences, copies)]
    if ends:
        owner = np.concatenate(owner)
        offset = np.concatenate([np.arange(len(e)) for e in ends])
        hit = index.statistics(np.concatenate(ends), window) >= window
        for i, o in zip(owner[hit].tolist(), offset[hit].tolist()):
            masks[i] |= 1 << o
    return masks


def _index_task(window: int):
    def run(batches):
        import numpy as np

        def out(rows):
            masks = repeated_windows([np.frombuffer(r[4], np.uint64) for r in rows], [r[3] for r in rows], window)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)] + [pa.array(masks, pa.int64())],
                                              names=["h", "s1", "s2", "mask"])
        rows, size, last = [], 0, None
        for batch in batches:  # sorted by anchor; whole anchors go into one index
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:3] == last:          # fetched twice, from rows that repeat
                    continue
                if size >= INDEX_WORDS and r[0] != last[0]:
                    yield out(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4]) // 8
                last = r[:3]
        if rows:
            yield out(rows)
    return run


def _fetch_task(window: int):
    """Words of the wanted segments, or digests of their windows where the anchor is full."""
    def run(batches):
        import numpy as np
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["h", "s1", "s2", "copies", "full", "words", "o", "w1", "w2"]
        for batch in batches:
            for k in range(batch.num_rows):
                digests = word_digests(batch.column(0)[k].as_py().encode("utf-8", "replace").split())
                rows, rolling = [], None
                for r in batch.column(1)[k].as_py():
                    own = digests[r["a"]:r["a"] + r["n"] + window - 1]
                    if not r["full"]:
                        rows.append((r["h"], r["s1"], r["s2"], r["copies"], 0, own.tobytes(), None, None, None))
                        continue
                    o = np.arange(r["n"])
                    for x in zip(o.tolist(), *(y.tolist() for y in Rolling(own)(o, o + window))):
                        rows.append((r["h"], r["s1"], r["s2"], r["copies"], 1, None, *x))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    return run


def _remove_task(window: int):
    def run(batches):
        import numpy as np
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, spots in zip(*(map(plain, c) for c in batch.columns[1:])):
                words = (text or "").encode("utf-8", "replace").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spots or ():
                    for o in range(int(s["mask"]).bit_length()):
                        if s["mask"] >> o & 1:
                            gone[s["a"] + o] += 1
                            gone[s["a"] + o + window] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(covered.sum()))
                if n_removed[-1]:
                    words = [words[i] for i in np.flatnonzero(~covered)]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])
    return run


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    anchor: int = ANCHOR, full: int = FULL, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of each row (all by default) with ``n_words``, ``n_removed`` and ``kept``, the
    kept words joined by one blank. Words are runs without ASCII white space, compared as they
    are; windows are judged on the input, inside one document as across documents.

    A null or empty text has no words; texts shorter than a window stay; a row that repeats is
    another document, so its windows occur again. Columns of the new names are replaced; an empty
    table gives an empty table. ``window - anchor`` may not exceed 61."""
    if not 0 < anchor < window <= CONTEXT or window - anchor > 61:
        raise ValueError("a window has at most 64 words and 62 places for its anchor")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    src = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    every = snapshot(src.mapInArrow(_segment_task(window, anchor), f"key {kind}, h long, s1 long, s2 long, a long, n long"), "segments")
    again = every.groupBy("h").count().filter("count > 1").select("h")
    spots = snapshot(every.join(again, "h", "left_semi"), "segments-again")
    name = ["h", "s1", "s2"]
    distinct = snapshot(spots.groupBy(*name).agg(F.count("*").alias("copies"), F.min(F.struct("key", "a", "n")).alias("at")), "segments-distinct")
    anchors = distinct.groupBy("h").agg(F.count("*").alias("kinds"))
    known = distinct.join(anchors, "h")
    alone = known.filter("kinds = 1").select(*name, F.expr("shiftleft(1L, cast(at.n AS int)) - 1").alias("mask"))
    wanted = (known.filter("kinds > 1").select("at.key", F.struct(*name, "copies", (F.col("kinds") > full).alias("full"), "at.a", "at.n").alias("s"))
                   .groupBy("key").agg(F.collect_list("s").alias("segments")))
    texts = src.join(wanted, "key").select("text", "segments")
    fetched = snapshot(texts.mapInArrow(
        _fetch_task(window), "h long, s1 long, s2 long, copies long, full long, words binary, o long, w1 long, w2 long"), "segment-words")
    width = shuffle_width(docs)
    indexed = (fetched.filter("full = 0").select(*name, "copies", "words").repartition(width, "h")
                      .sortWithinPartitions(*name).mapInArrow(_index_task(window), "h long, s1 long, s2 long, mask long"))
    windows = fetched.filter("full = 1").select(*name, "copies", "o", "w1", "w2").dropDuplicates([*name, "o"])
    repeated = windows.groupBy("h", "w1", "w2").agg(F.sum("copies").alias("m")).filter("m > 1")
    counted = (windows.join(repeated, ["h", "w1", "w2"], "left_semi").groupBy(*name)
                      .agg(F.bit_or(F.expr("shiftleft(1L, cast(o AS int))")).alias("mask")))
    masks = alone.unionByName(indexed).unionByName(counted).filter("mask <> 0")
    marked = spots.join(masks, name).groupBy("key").agg(F.collect_list(F.struct("a", "mask")).alias("spots"))
    keep = [c for c in (columns or docs.columns) if c not in ("n_words", "n_removed", "kept")]
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"), key.alias("key"))
    both = rows.join(marked, "key", "left").select("row", "text", "spots")
    out = both.mapInArrow(_remove_task(window), f"row {both.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "n_words", "n_removed", "kept")
