"""BPE against the tokenizers library, and packing against the contract."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tamarack.llm import bpe, packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["", "   ", "\n\n a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "　 \x1c\x85 z", "a" * 500, "日本語テキスト", "é ﷽ 😀🇩🇪", "I'll we've 'S", "\x00\x01", "12³¼ ٣٤", " " * 3000 + "x"]


def test_ids_equal_the_library(library):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab \n\t'é<|>1.ſ日") for _ in range(50)) for _ in range(200)]
    own, fast = bpe.Bpe(queries.vocabulary()), packing.Encoder(queries.vocabulary())
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == ids and fast.ids(t).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_op3_rows(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def check_packing(rows, docs, library):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for d, parts in by_doc.items():
        ids = np.array(library.encode(docs[d] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_op4_rows(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = queries.op4_packing(spark, SF)
    check_packing(df.collect(), docs, library)
    p = packing.padding(df).first()
    assert p.padding < 0.02 * p.tokens


def test_packing_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(packing.pack(df, queries.vocabulary()).collect(), dict(rows), library)
    twice = df.where("doc_id = 4").unionByName(df.where("doc_id = 4"))
    got = packing.pack(twice, queries.vocabulary()).collect()
    assert len(got) == 2 and len({(r.sequence_id, r.offset) for r in got}) == 2
    assert packing.pack(df.limit(0), queries.vocabulary()).count() == 0
    assert bpe.digests(df.limit(0), queries.vocabulary()).count() == 0
    assert bpe.encode(df.withColumn("token_ids", df.doc_id), queries.vocabulary()).columns == ["doc_id", "text", "token_ids"]


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    for size in (0, 1, 50, 5000):
        h = np.bincount(rng.integers(1, 2049, size), minlength=2049)
        used = np.zeros(2049, dtype=int)
        for lengths, times in packing.plan(h):
            assert sum(lengths) <= 2048
            for n in lengths:
                used[n] += times
        assert (used == h).all()
