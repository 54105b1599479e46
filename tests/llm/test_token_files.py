"""Token files with directly addressable codes: exact ids, order, places and random access."""
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwell.llm import dac, queries

from . import cases

WORD_BPE = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 4096, 10_000])
def test_random_access(tmp_path, n):
    rng = random.Random(n)
    ids = np.array([rng.choice([rng.randrange(256), rng.randrange(60_000), rng.randrange(1 << 32)]) for _ in range(n)], np.uint32)
    path = str(tmp_path / "a.dac")
    with open(path, "wb") as out:
        out.writelines(dac.file_bytes(ids, pa.array(["a", None]), np.array([n // 2, n])))
    with dac.TokenFile(path) as f:
        assert f.n_tokens == n and f.n_documents == 2
        assert [f.token(i) for i in range(0, n, 1 + n // 97)] == ids[::1 + n // 97].tolist()
        for _ in range(60):
            a = rng.randrange(n + 1)
            b = rng.randrange(a, n + 1)
            assert f.tokens(a, b).tolist() == ids[a:b].tolist()
        names, ends = f.documents()
        assert names.to_pylist() == ["a", None] and ends.tolist() == [n // 2, n]
        with pytest.raises(IndexError):
            f.token(n)


def test_a_token_is_read_without_the_rest(tmp_path, monkeypatch):
    path = str(tmp_path / "a.dac")
    with open(path, "wb") as out:
        out.writelines(dac.file_bytes(np.arange(2_000_000, dtype=np.uint32), pa.array([1]), np.array([2_000_000])))
    with dac.TokenFile(path) as f:
        read, plain = [], dac.TokenFile._read
        monkeypatch.setattr(dac.TokenFile, "_read", lambda self, at, n: read.append(n) or plain(self, at, n))
        assert [f.token(i) for i in (3, 70_000, 1_999_999)] == [3, 70_000, 1_999_999]
    assert sum(read) < 3 * 3 * 100


ODD = [(1, "a\x0bb\x0cc\rd\te\x1cf\x85g h i"), (2, "é ́x ΑΣ ΑΣ. İ ﬁ"), (3, "x" * 5000 + " " + "\n" * 3000 + "y"), (4, "<|endoftext|>a <|startoftext|> b<|endof text|>"),
       (5, " lead and trail \n"), (6, "don't I'll we've 'S 's"), (7, "漢字 かな 한국어 😀👩‍👩‍👧 ½ ² Ⅷ ③"), (8, "a,b a.'s don't.x ab-cd a=\u0338b e\u0301,\u0301x ñ;ñ É!!! x|>y a<|endoftext|>.b a's, a)'ll tith.### Es$$$ ab@c.de × ÷,x"), (None, "no id"), (None, None), (-5, "negative id")]


@pytest.mark.parametrize("limit,file_tokens,clash", [(dac.BATCH_CHARS, dac.FILE_TOKENS, False), (50, 200, True)])
def test_round_trip(spark, tmp_path, monkeypatch, limit, file_tokens, clash):
    docs = cases.frame(spark, cases.awkward() + [(i, t, None, None, None) for i, t in ODD], clash=clash)
    enc = Tokenizer.from_file(WORD_BPE)
    if limit != dac.BATCH_CHARS:
        monkeypatch.setattr(dac.encoded, "__defaults__", (limit,))
        monkeypatch.setattr(dac, "BATCH_CHARS", limit)
    manifest = dac.write_files(docs, WORD_BPE, end_id=2, folder=str(tmp_path / "tokens"), file_tokens=file_tokens)
    files = manifest.collect()
    assert len({f.file for f in files}) == len(files) and all(f.file.startswith(str(tmp_path)) for f in files)
    got = sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in dac.read_documents(manifest).collect())
    assert cases.bag((i, ids) for _, i, _, ids in got) == cases.bag((i, enc.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in cases.pairs(docs))
    ids_in_order = [i for _, i, _, _ in got]
    assert ids_in_order == sorted(ids_in_order, key=lambda i: (i is not None, i or 0))
    at = 0
    for start, _, n, ids in got:
        assert start == at and n == len(ids)
        at += n


def test_ids_of_strings_and_no_end(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "x")], "name string, body string")
    got = dac.read_documents(dac.write_files(docs, WORD_BPE, id_col="name", text_col="body"), id_type="string", id_col="name").orderBy("start").collect()
    assert [(r.name, r.start, r.n_tokens) for r in got] == [(None, 0, 1), ("a", 1, 1), ("b", 2, 2)]


def test_without_rows(spark):
    assert dac.read_documents(dac.write_files(cases.frame(spark, []), WORD_BPE, end_id=2)).collect() == []


def test_registered(spark, tmp_path):
    rows = [(i, t, None, None, None) for i, (_, t) in enumerate(ODD)]
    cases.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    enc, at, want = Tokenizer.from_file(WORD_BPE), 0, []
    for i, t, *_ in rows:
        ids = enc.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    got = queries.QUERIES["op11_dac_files"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, got.collect())) == want


def test_a_second_attempt_writes_another_file(spark, tmp_path):
    docs = cases.frame(spark).select("doc_id", "text").orderBy(F.col("doc_id"))
    a = dac.write_files(docs, WORD_BPE, folder=str(tmp_path / "t")).select("file").collect()
    b = dac.write_files(docs, WORD_BPE, folder=str(tmp_path / "t")).select("file").collect()
    assert not {r.file for r in a} & {r.file for r in b}
