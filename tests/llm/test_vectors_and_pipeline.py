"""Vectors, components, the pipeline's stages and the registered queries."""
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from ledgerwell.llm import pstable, queries
from ledgerwell.llm.components import components

from . import cases
from .test_text_operators import plain_components, plain_line_dedup

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def vectors(seed=0, clouds=6, each=25, dim=16, alone=40):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(clouds):
        centre = rng.standard_normal(dim)
        rows += [centre + rng.standard_normal(dim) * rng.choice([0.05, 0.12, 0.25]) for _ in range(each)]
    rows += list(rng.standard_normal((alone, dim)))
    rows += [rows[0]] * 4 + [rows[1] * 3.0]
    out = [[float(np.float32(x)) for x in v] for v in rows]
    out += [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [1.0, 2.0]]
    ids = list(range(len(out)))
    random.Random(seed).shuffle(ids)
    rows = [(i, v, 0) for i, v in zip(ids, out)]
    return rows + [(rows[0][0], rows[0][1], 1), (None, rows[0][1], None)]


def plain_links(rows):
    unit = []
    for _, v, _ in rows:
        good = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)
    return [[unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.95
             for b in range(len(rows))] for a in range(len(rows))]


@pytest.mark.parametrize("block", [1024, 5])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(pstable, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit("clash"))
    got = pstable.near_vectors(df).collect()
    linked = plain_links(rows)
    root = plain_components(len(rows), lambda a, b: linked[a][b])
    want = []
    for n, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[n] and rows[m][0] is not None]
        least = min(ids) if ids else None
        want.append((i, sum(linked[n]) - linked[n][n], least, i is not None and i == least))
    got = cases.bag((r.vec_id, r.n_links, r.component_id, r.kept) for r in got)
    assert len(got) == len(want)
    same = len(set(got) & set(cases.bag(want))) / len(set(got))
    assert same >= 0.9                                            # pairs near the threshold may not meet
    found, every = sum(int(x.split(",")[1]) for x in got), sum(w[1] for w in want)
    assert 0.98 * every <= found <= every                         # none below the threshold is linked


def test_near_vectors_without_rows(spark):
    assert pstable.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7), (None, 3)]
    pairs += [(500, k) for k in range(501, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {(a, b) for a, b in pairs if a is not None and a != b}
    nodes = sorted({x for p in linked for x in p})
    root = plain_components(len(nodes), lambda i, j: (nodes[i], nodes[j]) in linked or (nodes[j], nodes[i]) in linked)
    assert got == {n: nodes[r] for n, r in zip(nodes, root)}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- the pipeline

def test_stages_keep_the_columns_of_documents(spark):
    docs = cases.frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), cases.DOCS)
        assert docs.columns == cases.DOCS.names, name
    pieces = corpus_pipeline.packed(spark, docs, "")
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "sanitise", "pack"]


def test_stage_language_id(spark):
    docs = cases.frame(spark)
    got = corpus_pipeline.language_id(spark, docs, "").collect()
    want = [(i, t) for i, t in cases.pairs(docs) if t is not None and re.search(r"[^\W\d_]", t)]
    kept = [(r.doc_id, r.text) for r in got]
    assert set(kept) <= set(want) and len(kept) >= 0.9 * len(want)
    assert all(r.lang is not None for r in got)


def test_stage_language_id_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert corpus_pipeline.language_id(spark, docs, "").count() == docs.count()


def test_stage_line_dedup(spark):
    docs = cases.frame(spark)
    got = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert cases.bag((r.doc_id, r.text) for r in got) == cases.bag((i, t) for i, t, _, _ in plain_line_dedup(cases.pairs(docs)))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_stage_near_dedup(spark):
    docs = cases.frame(spark)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    rows = cases.pairs(docs)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles(t) for _, t in rows]
    root = plain_components(len(rows), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(got) == len(set(root))
    groups = [{rows[n] for n in range(len(rows)) if root[n] == r} for r in set(root)]
    for group in groups:
        assert sum((r.doc_id, r.text) in group for r in got) >= 1


def test_stage_sanitise(spark):
    rows = [(1, "write to a@b.co today", "en", "s", 21), (2, None, None, None, None), (3, "nothing here", "en", "s", 12)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.sanitised(spark, cases.frame(spark, rows), "").collect()}
    assert got == {1: ("write to [EMAIL] today", 22), 2: (None, None), 3: ("nothing here", 12)}


def test_stages_take_empty_tables(spark):
    docs = cases.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []


def test_registered_columns(spark):
    want = {"op1_token_counts": "doc_id n_bytes n_tokens over_limit", "op3_language_id": "doc_id held_out lang_pred score",
            "op4_line_windows": "doc_id n_lines n_removed kept_sha256",
            "op8_retrieval_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
            "op10_duck_bpe": "doc_id n_tokens ids_sha256 decoded_sha256"}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.columns == columns.split()
    kinds = dict(queries.QUERIES["op8_retrieval_packing"](spark, "/root/testdata/sf0.001").dtypes)
    assert set(kinds.values()) == {"bigint"}
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
