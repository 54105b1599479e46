"""The source audit against a dense plain version in exact integers."""
import collections
import random
import re

import pyarrow as pa
import pytest

from ledgerwell.llm import divergence

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        v, sources = len(kept), sorted({d[1] for d in mine})
        n = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if held[t] >= min_docs) for s in sources}
        every = sum(n.values(), collections.Counter())

        def share(c):
            of = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (of + 2 * v) for t in kept}
        p, q = {s: share(n[s]) for s in sources}, share(every)

        def gap(x, y):
            return (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -f, i + 1) for i, (f, o) in enumerate(pairs)}
            terms = sorted((-gap(p[s][t], q[t]), t.encode()) for t in kept if n[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -f, i + 1) for i, (f, t) in enumerate(terms)}
    return out


def rows(seed):
    rng = random.Random(seed)
    docs = [(i, cases.sentence(rng, rng.randrange(30)), rng.choice(["en", "fr", "", None, "xx"][:1 + i % 5]), rng.choice(["a", "b", "c", "é", "", None, "only"][:1 + i % 7]), 0) for i in range(160)]
    docs += [(900 + i, "Éa x² a\x00b\x7fc İS " * i, "de", "same", 0) for i in range(12)] + [(950, None, "de", "silent", None), (951, "", "de", None, 0), (952, "lonely", "zz", "s", 0)]
    return docs + cases.awkward()


@pytest.mark.parametrize("min_docs,top,shard_terms,clash", [(10, 10, divergence.SHARD_TERMS, False), (2, 3, 40, True), (1, 50, 300, False)])
def test_audit(spark, min_docs, top, shard_terms, clash):
    docs = cases.frame(spark, rows(min_docs), clash=clash)
    got = divergence.audit(docs, min_docs=min_docs, top=top, shard_terms=shard_terms).collect()
    want = plain([(r.lang, r.source, r.text) for r in docs.collect()], min_docs, top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert [c for c, _ in divergence.audit(docs.limit(3)).dtypes] == ["lang", "source", "part", "item", "value", "rank"]


def test_terms_of_a_batch():
    rng = random.Random(2)
    for _ in range(100):
        texts = ["".join(rng.choices("aZ{[@é日😀\x00\x7f 9`b\n", k=rng.randrange(12))) for _ in range(rng.randrange(1, 9))]
        for batch in (pa.array(texts), pa.array(["q", "Zé1", *texts])[2:], pa.array(texts, pa.large_string())):
            assert divergence._terms(batch)[0].to_pylist() == [TERM.findall(t.translate(LOWER)) + [divergence.MARK] for t in texts]


def test_terms_that_size_the_shards():
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}é" for i in range(17576)]
    terms, some = divergence._terms(pa.array([" ".join(words), "", " ".join(words[::-1])]))
    some = some.to_pylist()
    assert some[0] == some[2][::-1] and some[1] == [] and set(some[0]) <= set(words)
    assert 0.7 < len(some[0]) * divergence.SIZED_BY / len(words) < 1.4


def test_without_rows(spark):
    assert divergence.audit(cases.frame(spark, [])).collect() == []


def test_hot_source(spark):
    rng = random.Random(5)
    docs = cases.frame(spark, [(i, cases.sentence(rng, 12), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(300)])
    assert {tuple(r) for r in divergence.audit(docs).collect()} == plain([(r.lang, r.source, r.text) for r in docs.collect()], 10, 10)


def test_a_batch_leaves_fewer_terms_to_the_fits_and_sums(monkeypatch):
    monkeypatch.setattr(divergence, "ROW_TERMS", 5)
    rng = random.Random(7)
    docs = [(rng.choice("xy"), rng.choice("abc"), " ".join(rng.choices("stuvwé", k=rng.randrange(40))) + f" u{i}") for i in range(300)] + [("x", "d", "")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs)], names=["lang", "source", "text"])
    rows = [r for b in divergence._cut(10)(iter([batch])) for r in b.to_pylist()]
    fits, sums, n_docs = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        assert 0 < len(r["tokens"]) == len(set(r["tokens"])) <= 5
        n_docs[r["lang"], r["source"]] += r["docs"]
        for t in r["tokens"]:
            if r["weight"]:
                sums[r["lang"], r["source"], t] += r["weight"]
            else:
                fits[r["lang"], t] += 1
    tokens = [(lang, source, TERM.findall(text) + [divergence.MARK]) for lang, source, text in docs]
    assert n_docs == collections.Counter(d[:2] for d in docs)
    assert sums == collections.Counter((lang, source, t) for lang, source, ts in tokens for t in ts)
    df = collections.Counter((lang, t) for lang, _, ts in tokens for t in set(ts))
    assert fits == {k: min(n, 10) for k, n in df.items()}
    assert sum(len(r["tokens"]) for r in rows) < sum(len(ts) for _, _, ts in tokens) / 5


def test_audit_of_many_small_batches(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TEXT_PER_CUT", 400)
    monkeypatch.setattr(divergence, "DOCS_PER_CUT", 7)
    docs = cases.frame(spark, rows(4))
    assert {tuple(r) for r in divergence.audit(docs, min_docs=4, top=5).collect()} == plain([(r.lang, r.source, r.text) for r in docs.collect()], 4, 5)
