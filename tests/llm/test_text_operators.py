"""Operators on texts against plain Python versions, over awkward tables."""
import base64
import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwell.llm import duck_bpe, fm_dedup, imatch, langid, line_windows, pack, sanitise, simhash, token_counts

from . import cases

WORD_BPE, BYTE_BPE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module", params=["plain", "clash"])
def docs(spark, request):
    return cases.frame(spark, clash=request.param == "clash").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.frame(spark, [])


# --- 1 token counts

@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 512), (200, 16), (64, 4)])
def test_token_counts(docs, chunk, overlap):
    enc = Tokenizer.from_file(WORD_BPE)
    got = token_counts.count_tokens(docs, WORD_BPE, chunk_chars=chunk, overlap=overlap)
    want = [(i, len((t or "").encode()), len(enc.encode(t or "", add_special_tokens=False).ids)) for i, t in cases.pairs(docs)]
    assert cases.bag((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == cases.bag(want)


def test_token_counts_without_rows(empty):
    assert token_counts.count_tokens(empty, WORD_BPE).collect() == []


# --- 10 byte-level BPE

def test_encode_and_decode(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = cases.bag((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in cases.pairs(docs))
    for got in (duck_bpe.decode(duck_bpe.encode(docs, RANKS, P.PATTERN), RANKS), duck_bpe.round_trip(docs, RANKS, P.PATTERN)):
        assert cases.bag((r.doc_id, r.ids, bytes(r.bytes)) for r in got.collect()) == want


def test_merges_follow_rank_then_place():
    ranks = duck_bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merger, rng = duck_bpe.Merger(ranks), random.Random(3)
    words = list({"".join(rng.choice("abenrstéß") for _ in range(rng.choice([1, 2, 9, 80, 1500]))).encode() for _ in range(200)} | {b"a" * 5000})
    got = merger.encode(words)
    assert all(memoryview(got[w]).cast("I").tolist() == enc._encode_single_piece(w) for w in words)


def test_decode_of_null_and_empty_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.bytes) for r in duck_bpe.decode(df, RANKS).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) == 2


def test_bpe_words_of_a_length_share_a_query(monkeypatch):
    """A query takes as many steps as its longest word: long words are not spread over the queries of short ones."""
    monkeypatch.setattr(duck_bpe, "WORDS_PER_QUERY", 10)
    merger, query, steps = duck_bpe.Merger(duck_bpe.read_ranks(RANKS)), duck_bpe.Merger._query, []
    monkeypatch.setattr(duck_bpe.Merger, "_query", lambda self, ws: (steps.append(max(map(len, ws))), query(self, ws))[1])
    rng = random.Random(5)
    words = list({bytes(rng.choices(b"qxzjvk", k=40 if i % 10 == 0 else 4)) for i in range(200)})
    got = merger.encode(words)
    enc = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=duck_bpe.read_ranks(RANKS), special_tokens={})
    assert {w: memoryview(x).cast("I").tolist() for w, x in got.items()} == {w: enc.encode_ordinary(w.decode()) for w in words}
    assert steps == sorted(steps) and steps.count(40) <= 3


def test_bpe_remembers_no_long_parts():
    encoder = duck_bpe.Encoder(RANKS, P.PATTERN)
    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=duck_bpe.read_ranks(RANKS), special_tokens={})
    texts = ["", " ", "a " + "b" * 200 + " c", "c d  e", "x\ty z", "b" * 200 + " 12345 a"] * 2
    for _ in range(2):
        assert [memoryview(x).cast("I").tolist() for x in encoder(texts)] == [enc.encode_ordinary(t) for t in texts]
        assert encoder.known and max(map(len, encoder.known)) <= duck_bpe.KNOWN_LENGTH


def test_bpe_merges_a_word_once_whatever_stands_around_it(monkeypatch):
    encoder, sent = duck_bpe.Encoder(RANKS, P.PATTERN), []
    merge = duck_bpe.Merger.encode
    monkeypatch.setattr(duck_bpe.Merger, "encode", lambda self, ws: (sent.extend(ws), merge(self, ws))[1])
    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=duck_bpe.read_ranks(RANKS), special_tokens={})
    for text in ("a qxzjvk, b", "a qxzjvk; b", "qxzjvk (qxzjvk)  qxzjvk\n qxzjvk", " qxzjvk qxzjvk", ""):
        assert memoryview(encoder([text, text])[1]).cast("I").tolist() == enc.encode_ordinary(text)
    assert len(sent) == len(set(sent)) and {b"qxzjvk", b" qxzjvk"} <= set(sent)


CL100K = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


@pytest.mark.parametrize("pattern", [P.PATTERN, CL100K])
def test_bpe_parts_are_cut_where_the_pattern_cuts(pattern):
    encoder, rng = duck_bpe.Encoder(RANKS, pattern), random.Random(9)
    enc = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=duck_bpe.read_ranks(RANKS), special_tokens={})
    signs = ["a", "s", "t", "ll", "'", "'", ",", "(", "1", " ", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "日", "。", " ", "　", " ", "\x85", "́", "—", "😀", "_", "\x00", "\x7f"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(14))) for _ in range(6000)]
    assert [memoryview(x).cast("I").tolist() for x in encoder(texts)] == [enc.encode_ordinary(t) for t in texts]
    assert encoder([]) == [] and encoder(["", ""]) == [b"", b""]


def test_bpe_parts_are_words_but_for_a_few():
    texts = ["(one two, three)\nfour  five; six.\n\n seven? 88 d'eux"]
    at = np.array([0, len(texts[0])])
    starts = duck_bpe._starts(texts[0].encode(), at, True)
    parts = [texts[0][i:j] for i, j in zip(starts, [*starts[1:], len(texts[0])])]
    assert parts == ["(", "one", " two", ",", " three", ")", "\n", "four", " ", " five", ";", " six", ".", "\n\n", " seven", "?", " 88", " d", "'eux"]


def test_bpe_tasks_of_a_process_share_what_they_met(monkeypatch):
    sent, merge = [], duck_bpe.Merger.encode
    monkeypatch.setattr(duck_bpe.Merger, "encode", lambda self, ws: (sent.extend(ws), merge(self, ws))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["shared qxzjvkw, twice", None, " qxzjvkw!"])], names=["row", "text"])
    got = [[b.to_pydict() for b in duck_bpe._round_trip_task(RANKS, P.PATTERN)(iter([batch]))] for _ in range(2)]
    assert got[0] == got[1] and got[0][0]["bytes"] == [b"shared qxzjvkw, twice", b"", b" qxzjvkw!"]
    assert sent.count(b" qxzjvkw") == 1


def test_bpe_without_rows(empty):
    assert duck_bpe.decode(duck_bpe.encode(empty, RANKS, P.PATTERN), RANKS).collect() == []


# --- 8 packing

@pytest.mark.parametrize("window", [2048, 64])
def test_packing(docs, window):
    enc = Tokenizer.from_file(BYTE_BPE)
    got = pack.pack(docs, BYTE_BPE, P.PATTERN, window=window).collect()
    ids = collections.Counter()
    for i, t in cases.pairs(docs):
        ids[i, (enc.encode(t or "", add_special_tokens=False).ids + [1]).__repr__()] += 1
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for key, rows in by_doc.items():
        # a repeated id has as many pieces at each place as it has rows
        want = [eval(x) for (i, x), n in ids.items() if i == key for _ in range(n)]
        assert sum(r.length for r in rows) == sum(map(len, want))
        for r in rows:
            piece = list(memoryview(bytes(r.ids)).cast("I"))
            assert any(w[r.start:r.start + r.length] == piece and len(w) == r.doc_tokens for w in want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0
    assert {r.doc_id for r in got} == {i for i, _ in cases.pairs(docs)}


def test_packing_prefers_neighbours(spark):
    rows = [(0, "zebra quagga okapi plain words"), (1, "cats and dogs here"), (2, "nothing in common there"), (3, "okapi quagga zebra again")]
    got = pack.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BYTE_BPE, P.PATTERN).orderBy("sequence_id", "offset")
    order = list(dict.fromkeys(r.doc_id for r in got.collect()))
    assert order[:2] == [0, 3]


def test_packing_takes_neighbours_by_all_shared_words(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(600)]
    texts = [[vocab[int(600 * rng.random() ** 2)] for _ in range(rng.randrange(60, 400))] for _ in range(60)]
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = collections.Counter(w for t in texts for w in set(t))

    def score(t):
        tf = collections.Counter(t)
        return sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(texts[0]) if w in tf)
    want = [0] + sorted(range(1, n), key=lambda k: -score(texts[k]))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = pack.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), BYTE_BPE, P.PATTERN, window=1 << 20).orderBy("sequence_id", "offset")
    assert list(dict.fromkeys(r.doc_id for r in got.collect())) == want


def test_packing_without_rows(empty):
    assert pack.pack(empty, BYTE_BPE, P.PATTERN).collect() == []


# --- 4 line dedup

def plain_line_dedup(rows):
    """By id, digest, place; rows of equal id and text are one document."""
    docs = {(i, t) for i, t in rows if t is not None}

    def order(k):
        return (k[0] is not None, k[0] or 0, xxhash.xxh64(k[1].encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(k[1].encode(), seed=42).intdigest() >> 63))
    seen, gone = set(), collections.defaultdict(set)
    for k in sorted(docs, key=order):
        lines = k[1].split("\n")
        for at in range(len(lines) - 2):
            w = tuple(lines[at:at + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone[k] |= {at, at + 1, at + 2}
                seen.add(w)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone[i, t])
        out.append((i, kept, 0 if t is None else len(lines), len(gone[i, t]) if t is not None else 0))
    return out


def test_line_windows(docs):
    got = line_windows.dedup_lines(docs).collect()
    assert cases.bag((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == cases.bag(plain_line_dedup(cases.pairs(docs)))
    assert sum(r.n_removed for r in got) > 5


def test_line_windows_keep_other_columns(docs):
    got = line_windows.dedup_lines(docs)
    assert [c for c in got.columns if c not in ("n_lines", "n_removed")] == [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    assert line_windows.dedup_lines(docs.limit(0)).collect() == []


# --- 5 I-Match

def test_imatch_edits_and_likeness(docs):
    got = imatch.compare_edits(docs).collect()
    rows = [(i, t or "") for i, t in cases.pairs(docs)]

    def order(k):
        d = xxhash.xxh64(k[1].encode(), seed=42).intdigest()
        return (k[0] is not None, k[0] or 0, d - (1 << 64) * (d >> 63))
    rows.sort(key=order)
    want = []
    for n, (i, t) in enumerate(rows):
        after = rows[n - 1][1]
        third = len(t) // 3
        want.append((i, len(t), t[:len(t) - third] + after[:third]))
    assert cases.bag((r.doc_id, r.n_chars, r.edited) for r in got) == cases.bag(want)
    prints = collections.defaultdict(set)
    for i, t in rows:
        prints[t] |= {r.fingerprint for r in got if r.doc_id == i}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all(r.near_edited == 1 for r in got if r.n_chars < 3)


def test_imatch_equal_texts_and_overlap(spark):
    rng = random.Random(5)
    texts = [cases.sentence(rng, 200) for _ in range(60)]
    texts += [texts[0], texts[1] + " one more alpha7 word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.compare_edits(df).collect()}
    assert got[0].fingerprint == got[60].fingerprint
    alike = sum(got[1].fingerprint[k:k + 8] == got[61].fingerprint[k:k + 8] for k in range(0, 96, 8))
    assert alike >= 8
    assert sum(r.near_edited for r in got.values()) > 2 * sum(r.near_next for r in got.values())


def test_next_rows_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(imatch, "DOCS_PER_CELL", 2)
    monkeypatch.setattr(imatch, "CELLS_PER_WINDOW", 3)
    ids = sorted(random.Random(2).sample(range(-5000, 100000), 200))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").withColumn("digest", F.xxhash64("text"))
    got = {r.id: r.next_text for r in imatch.with_next(df, "id", ["text"]).collect()}
    assert got == {i: f"t{ids[n - 1]}" for n, i in enumerate(ids)}


def test_imatch_lexicon_terms(spark):
    df = spark.createDataFrame([(0, "Apple pear, fig; apple"), (1, "fig kiwi"), (2, ""), (3, "pear pear")], "doc_id long, text string")
    band = imatch.lexicon(df, rarest=0.5, commonest=0.5)
    want = {w: xxhash.xxh64(w.encode(), seed=42).intdigest() for w in ("pear", "fig")}
    want = {w: h - (1 << 64) * (h >> 63) for w, h in want.items()}
    assert {r.h for r in band.collect()} == set(want.values())
    got = {r.doc_id: r.t for r in imatch.with_lexicon_terms(df, "text", band, "t").collect()}
    assert got == {0: sorted(want.values()), 1: [want["fig"]], 2: [], 3: [want["pear"]]}
    plan = imatch.with_lexicon_terms(df, "text", band, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "_table" not in plan.split("Aggregate")[0]


def test_imatch_without_band_terms(spark):
    """Texts none of whose terms is in the band are like texts of the same terms only."""
    alone = ["", "!!! ...", "?", "quagga zebu", "zebu  QUAGGA zebu", "okapi " * 700, "½"]
    df = spark.createDataFrame(list(enumerate(alone + [f"only{i} here{i}" for i in range(30)])), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(df).collect()}
    assert got[3] == got[4] and len(set(got.values())) == len(got) - 1
    rows = imatch.compare_edits(df).collect()
    assert [r.doc_id for r in rows if r.near_next > 0] == [4]                    # in descending order, 3 comes after 4
    assert {r.doc_id for r in rows if r.near_edited == 1} >= {0, 2}
    assert all(len(r.fingerprint) == 8 * imatch.CHAINS for r in rows)


def test_imatch_without_rows_and_of_one_row(spark, empty):
    assert imatch.compare_edits(empty).collect() == []
    one = imatch.compare_edits(cases.frame(spark, [(5, "abcdef", None, None, None)])).collect()
    assert [r.edited for r in one] == ["abcdab"] and one[0].near_next == 1
    assert imatch.fingerprints(cases.frame(spark)).count() == cases.frame(spark).count()


# --- 6 SimHash

def plain_simhash(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return [root(a) for a in range(n)]


def check_groups(rows, fps, got):
    root = plain_components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert cases.bag(got) == cases.bag((i, fp, least.get(r)) for (i, _), fp, r in zip(rows, fps, root))


def test_simhash_groups(docs):
    rows = cases.pairs(docs)
    got = [(r.doc_id, int(r.f, 16), r.component_id) for r in simhash.near_groups(docs).withColumn("f", simhash.as_hex(F.col("fp"))).collect()]
    check_groups(rows, [plain_simhash(t, 3) for _, t in rows], got)
    assert simhash.near_groups(docs.limit(0)).collect() == []


def test_simhash_long_texts_go_in_blocks(monkeypatch):
    text = cases.sentence(random.Random(4), 3000)
    monkeypatch.setattr(simhash, "BLOCK_WORDS", 100)
    assert simhash._fingerprint(text, 3) == plain_simhash(text, 3)


@pytest.mark.parametrize("limit", [1024, 8])
def test_links_in_full_shards(spark, monkeypatch, limit):
    """Fingerprints in tight clouds, so that shards overflow and are cut on."""
    monkeypatch.setattr(simhash, "TREE_NODES", limit)
    rng, fps = random.Random(9), set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(80):
            x = centre
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    links = [(r.a, r.b) for r in simhash.links(df).collect()]
    place = {simhash._signed(x): n for n, x in enumerate(fps)}
    linked = {(place[a], place[b]) for a, b in links}
    want = plain_components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert plain_components(len(fps), lambda a, b: (a, b) in linked or (b, a) in linked) == want
    if limit == 1024:
        assert all((fps[a] ^ fps[b]).bit_count() <= 64 for a, b in linked)


def test_similar_groups(spark):
    rng = random.Random(12)
    base = [cases.sentence(rng, 150).split() for _ in range(30)]
    texts = []
    for w in base:
        texts.append(w)
        for edits in (0, 1, 2, 12):
            v = w[:]
            for at in rng.sample(range(len(v)), edits):
                v[at] = f"new{rng.randrange(10**6)}"
            texts.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, ""), (901, None), (902, " ")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles(t) for _, t in rows]
    want = plain_components(len(rows), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    want = {rows[n][0]: rows[r][0] for n, r in enumerate(want)}
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(want[i] == want[got[i]] for i in got)          # nothing is linked that should not be
    assert got[900] == got[901] == got[902] == 900


def test_similar_groups_in_full_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_NODES", 20)
    w = cases.sentence(random.Random(3), 400).split()
    rows = [(i, " ".join(w[:i * 3] + [f"edit{i}"] + w[i * 3 + 1:])) for i in range(100)]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_similar_groups_do_not_follow_repeated_words(spark):
    rows = []
    for junk in ("Be", "one two three four five six seven eight nine"):
        rows += [(len(rows) + k, " ".join([junk] * 60 + [f"w{len(rows) + k}x{j}" for j in range(40)])) for k in range(3)]
    rows += [(10, rows[0][1]), (11, rows[3][1] + " nine")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 10: 0, 11: 3}


def test_nodes_of_one_fingerprint_stay_apart_and_meet(spark):
    nodes = spark.createDataFrame([(5, 6, z) for z in (1, 2, 3)] + [(5, 7, 1)], "x long, y long, z long")
    got = {(r.a, r.b): r.d for r in simhash._candidates(nodes, 4, 30).collect()}
    name = {(y, z): f"{5:016x}{y:016x}{z:016x}" for y in (6, 7) for z in (1, 2, 3)}
    assert got == {(name[6, 2], name[6, 1]): 0, (name[6, 3], name[6, 1]): 0, (name[7, 1], name[6, 1]): 1}


def template_family(n, seed=5):
    """n texts of one template with four words of their own each, most below the similarity to
    each other, and to every second one a copy with three more edits."""
    rng = random.Random(seed)
    base = cases.sentence(rng, 200).split()
    texts = []
    for i in range(n):
        w = base[:]
        for at in rng.sample(range(0, 200, 5), 4):
            w[at] = f"own{i}x{at}"
        texts.append(w)
        if i % 2:
            v = w[:]
            for at in rng.sample([k for k in range(2, 200, 5)], 3):
                v[at] = f"more{i}x{at}"
            texts.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    return rows


def met_groups(rows):
    """(true, met): groups of the texts at the similarity, and by the pairs of them alone that lie
    within the radius and share a sampled shard."""
    sets = [{tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t in rows]
    fps = [simhash._wide(simhash._different(t, 5)) for _, t in rows]
    bits, samples = simhash.sampling(len(rows))
    draw = random.Random(20_240_607)
    masks = [sum(1 << i for i in draw.sample(range(128), bits)) for _ in range(samples)]

    def like(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    def met(a, b):
        return (fps[a] ^ fps[b]).bit_count() <= simhash.WIDE_RADIUS and any((fps[a] ^ fps[b]) & m == 0 for m in masks)
    return plain_components(len(rows), like), plain_components(len(rows), lambda a, b: like(a, b) and met(a, b))


def test_similar_groups_in_a_template_family(spark):
    rows = template_family(200)
    want, met = met_groups(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 60 < len(set(want)) < 240 and len(set(met)) <= 1.06 * len(set(want))
    assert got == {i: rows[r][0] for i, r in enumerate(met)}      # every pair that meets is checked


def test_similar_groups_of_many_pairs_in_full_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_NODES", 16)
    rows = template_family(100, seed=6)
    copies = [(len(rows) + k, " ".join([f"late{k}", *rows[0][1].split()])) for k in range(40)]     # a group over several blocks
    rows += copies
    want, met = met_groups(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: rows[r][0] for i, r in enumerate(met)}
    assert len(set(want)) > 30


def test_similar_groups_without_rows(empty):
    assert simhash.similar_groups(empty).collect() == []


# --- 7 passages

def plain_passages(rows, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {z for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for z in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


@pytest.mark.parametrize("window,anchor,full", [(35, 12, 4096), (35, 12, 1), (8, 3, 4096), (3, 1, 2)])
def test_passages(docs, window, anchor, full):
    got = fm_dedup.remove_passages(docs, window=window, anchor=anchor, full=full).collect()
    want = plain_passages(cases.pairs(docs), window)
    assert cases.bag((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == cases.bag(want)
    assert any(w[2] for w in want)


def test_passages_in_blocks_and_small_indexes(spark, monkeypatch):
    monkeypatch.setattr(fm_dedup, "BLOCK_WORDS", 50)
    monkeypatch.setattr(fm_dedup, "INDEX_WORDS", 10)
    df = cases.frame(spark)
    got = fm_dedup.remove_passages(df, window=6, anchor=2).collect()
    assert cases.bag((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == cases.bag(plain_passages(cases.pairs(df), 6))


def test_index_statistics_match_brute_force():
    import numpy as np
    rng = random.Random(8)
    seqs = [np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 40))], np.uint64) for _ in range(12)]
    index = fm_dedup.FMIndex(seqs)
    flat = [x for s in seqs for x in [*s.tolist(), None]]
    ends = np.array([i for i, x in enumerate(flat) if x is not None])

    def count(p):
        return sum(flat[k:k + len(p)] == p for k in range(len(flat)))
    for e, got in zip(ends.tolist(), index.statistics(ends, 20).tolist()):
        n = 0
        while n < 20 and e - n >= 0 and flat[e - n] is not None and count(flat[e - n:e + 1]) > 1:
            n += 1
        assert n == got


def test_passages_without_rows(empty):
    assert fm_dedup.remove_passages(empty).collect() == []


# --- 3 language id

def test_language_id_cases(docs):
    model = langid.fit(docs)
    assert set(model.languages) <= {"en", "fr"}
    got = langid.identify(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = r.text is not None and any(unicodedata.category(c)[0] == "L" for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1


def test_language_id_sends_a_text_once(docs):
    """A kept text is not sent beside its row; fields of kept columns count as kept."""
    model = langid.fit(docs)
    got = langid.identify(docs.select(F.struct("*").alias("row")), model, "row.text")
    for df in (got, langid.identify(docs, model)):
        assert re.search(r"MapInArrow run\(([^)]*)\)", df._jdf.queryExecution().analyzed().toString())[1].count(",") == 0
    plain = sorted(langid.identify(docs, model).select("lang_pred", "score", "text").collect(), key=str)
    assert sorted(got.select("lang_pred", "score", "row.text").collect(), key=str) == plain
    with_id = langid.identify(docs, model, columns=["doc_id"])
    assert sorted((r.lang_pred, r.score) for r in with_id.collect()) == sorted((r.lang_pred, r.score) for r in plain)


def test_language_id_without_labels(spark, empty):
    assert langid.identify(empty, langid.fit(empty)).collect() == []
    df = cases.frame(spark, [(1, "some text", None, None, 9)])
    assert [(r.lang_pred, r.score) for r in langid.identify(df, langid.fit(df)).collect()] == [("und", 0.0)]


def test_language_id_backs_off():
    model = langid.Model(["a", "b"], {"known": [-1.0, -9.0]}, [{"k": [-2.0, -1.0]}, {}, {"ing": [-5.0, -1.0]}, {}, {}])
    words = ["known", "xing", "k7", "zzz"]                    # of xing three letters are known, longer n-grams not
    predict = langid.Predictor(model)
    assert predict.word_scores(words).tolist() == [[-1.0, -9.0], [-2.5, -0.5], [-1.0, -0.5], [0.0, 0.0]]
    got = predict(["known known", "xing", "zzz", None, "42 !"])
    assert [x for x, _ in got] == ["a", "b", "a", "und", "und"] and got[2][1] == 0.5     # a tie: the first language


def test_numerals_are_no_letters(spark):
    docs = cases.frame(spark, [(i, t, "en", None, 9) for i, t in enumerate(["one two", "½ ² Ⅷ ③", "x² Ⅷa", "٣ 四"])])
    got = {r.text: (r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got["½ ² Ⅷ ③"] == ("und", 0.0)
    assert [got[t][0] for t in ("one two", "x² Ⅷa", "٣ 四")] == ["en"] * 3      # the last has a letter, 四


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).filter(langid.is_held_out("doc_id")).collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


# --- 2 personal data

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + n % 2) for n, c in enumerate(reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
                "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
    found = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if fine(k, m.group()))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)


TRICKY = ["a@b.co", "a@b", "a@b..c@d.e x@y.z.", "a@b.c_d@e.f", "é a.b+c@d-e.fr, \U0001f600 9@8.7", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 0255.001.1.00001",
          "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "4111111111111111@x.com", "00000000000000", "+1 (386) 555-3733", "+1--9",
          "+12345678901234567", "+1 555 555 5555 4111 1111 1111 1111", "x" * 50000 + "@", "1 " * 30000, "a@" + "b." * 20000 + "c", "1" * 60000,
          "+1" + "-" * 40000, ".".join("1" * 9000)]


def test_base_spans(spark):
    rng = random.Random(6)
    rows = TRICKY + ["".join(rng.choice("a1@.+- 2é(") for _ in range(60)) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    got = df.select("doc_id", sanitise.as_text(sanitise.base_spans(F.col("text"))).alias("s")).collect()
    bad = [(rows[r.doc_id][:80], r.s, plain_spans(rows[r.doc_id])) for r in got if r.s != plain_spans(rows[r.doc_id])]
    assert not bad, bad[:3]


def test_sanitise_cases(docs):
    got = sanitise.sanitise(docs)
    assert got.columns == docs.columns
    assert cases.bag((r.doc_id, r.text) for r in got.collect()) == cases.bag(cases.pairs(docs))   # nothing personal in them
    assert sanitise.sanitise(docs.limit(0)).collect() == []


def test_sanitise_replaces(spark):
    rows = [(1, "mail a@b.co now"), (2, "4111 1111 1111 1111@x.com!"), (3, None), (4, "call +1 (386) 555-3733 or 10.0.0.1")]
    got = {r.doc_id: r.text for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mail [EMAIL] now", 2: "[CARD]!", 3: None, 4: "call [PHONE] or [IP]"}


def test_disclosing_terms(spark):
    rows = [(i, f"note{i} the zorblatt{'s' * (i % 2)} person wrote x{i} from boss@corp.com about y{i}") for i in range(6)]
    rows += [(10 + i, f"zorblatt was seen in town{i}") for i in range(1)] + [(20 + i, f"the person wrote about weather{i}") for i in range(40)]
    rows += [(80 + i, "the same copy says florid mail me@corp.com soon") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in sanitise.disclosing_terms(df, bits=2.0).collect()}
    terms = {t for r in got.values() for t in r.terms}
    assert "zorblatt" in terms and "zorblatts" in terms      # three contexts each, seldom elsewhere
    assert "the" not in terms and "person" not in terms      # common elsewhere
    assert "florid" not in terms                             # copies are one context
    assert got[10].terms == ["zorblatt"] and got[10].certain == []
    clean = {r.doc_id: r.text for r in sanitise.sanitise(df, bits=2.0).collect()}
    assert clean[10] == "[TERM] was seen in town0" and "zorblatts" not in clean[1] and "[EMAIL]" in clean[1]


def test_score_is_a_share_of_documents():
    assert math.isclose(sanitise.LIKELY, 0.5) and sanitise.SURE > sanitise.LIKELY


def test_digest_of_no_spans(spark):
    df = spark.createDataFrame([(1, "plain")], "doc_id long, text string")
    r = sanitise.find(df).select(F.sha2(sanitise.as_text(F.col("spans")), 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"").hexdigest()
