import base64
import hashlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

from quaverline.llm import bpe

SF = "/root/testdata/sf0.01"
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def enc():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(rows, enc):
    out = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip(spark, enc):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    found = bpe.round_trip(spark.read.parquet(f"{SF}/documents.parquet"), PATH, PATTERN).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows, enc)


def test_edges_and_long_texts(spark, enc, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    long = "word's  don't\n\n 12 x\t… " * 400
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "a"), (5, "<|endoftext|>"), (6, "a" * 3000), (7, "  \n" * 500), (8, "日本語 " * 300), (9, "x\x1c y\x85 z\xa0 q　 r " * 30)]
    docs = spark.createDataFrame([(d, t, 4) for d, t in rows], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, bpe.round_trip(docs, PATH, PATTERN).collect()), key=str) == expected(rows, enc)
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0


def test_safe_boundaries(enc):
    for text in ("one two  three\n\nfour 5's! " * 30, " lead", "nospace" * 20, "é è\n" * 50, "a \n b" * 40):
        for size in (1, 7, 50):
            parts = bpe.chunks(text, size)
            assert "".join(parts) == text and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_tables(spark, enc):
    docs = spark.createDataFrame([(1, "héllo wörld"), (2, None)], "doc_id long, text string")
    ids = bpe.encode_table(docs, PATH, PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: enc.encode_ordinary("héllo wörld"), 2: []}
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode_table(ids, PATH, PATTERN).collect()} == {1: "héllo wörld".encode(), 2: b""}
    assert bpe.decode(enc.encode_ordinary("é日")[:1], PATH, PATTERN)  # part of a character decodes too
