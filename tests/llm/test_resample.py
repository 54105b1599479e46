"""Importance resampling against a plain version."""
import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerwell.llm import resample

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, most, buckets, min_words, percent, seed):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [" ".join(w[i:i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, fs = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[:percent * len(able) // 100]


@pytest.mark.parametrize("most,buckets,min_words,percent", [(1, 10_000, 20, 10), (3, 97, 3, 50), (2, 10_000, 0, 100)])
@pytest.mark.parametrize("clash", [False, True])
def test_resample(spark, most, buckets, min_words, percent, clash):
    docs = cases.frame(spark, cases.awkward(n=80) + [(900, "ÀÉ αΒγ ÀÉ\x00x\x7fy İ 漢字,漢字; 1a2", None, None, 0)], clash=clash)
    target = spark.createDataFrame([(None,), ("alpha beta niño 42",), ("",), ("alpha1 gamma the of",)], "text string")
    got = resample.resample(docs, target, most=most, buckets=buckets, min_words=min_words, percent=percent).collect()
    want, drawn = plain(cases.pairs(docs), [r.text for r in target.collect()], most, buckets, min_words, percent, 2024)
    assert cases.bag((r.doc_id, r.n_features, r.weight, r.score) for r in got) == cases.bag((i, n, w, s) for i, _, n, w, s in want)
    ranked = sorted((r.rank, r.doc_id, r.score) for r in got if r["rank"] is not None)
    assert ranked == [(k + 1, r[0], r[4]) for k, r in enumerate(drawn)]


def test_spans_are_overlapped():
    collapsed, spans = resample._scanner(2)
    text = collapsed("One, two -- Three;éa\tB")
    assert text == "one two three éa b".encode()
    assert [s.decode() for s in spans(text)] == ["one", "two", "three", "éa", "b", "one two", "two three", "three éa", "éa b"]
    assert list(spans(b"")) == []


def test_without_rows_or_target(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(cases.frame(spark, []), none).collect() == []
    got = resample.resample(cases.frame(spark), none).collect()
    want, _ = plain(cases.pairs(cases.frame(spark)), [], 1, 10_000, 20, 10, 2024)
    assert cases.bag((r.doc_id, r.weight) for r in got) == cases.bag((i, w) for i, _, _, w, _ in want)


def test_scores_that_tie_go_by_id(spark):
    docs = spark.createDataFrame([(i // 2, "same words here") for i in range(40)], "doc_id long, text string")
    got = resample.resample(docs, docs, min_words=1, percent=50).filter(F.col("rank").isNotNull()).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 21))
    assert [(r.score, r.doc_id) for r in got] == sorted(((r.score, r.doc_id) for r in got), key=lambda r: (-r[0], r[1]))
