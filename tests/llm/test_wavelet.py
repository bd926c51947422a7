import random
import tempfile
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaverline.llm import wavelet

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def expected(rows, tok):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_give_back_every_id(spark, tok):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    found = wavelet.token_files(spark.read.parquet(f"{SF}/documents.parquet"), PATH, shard_tokens=50_000)
    assert sorted(map(tuple, found.collect())) == expected(rows, tok)


def test_edges(spark, tok):
    odd = ["", None, "  two  spaces \n\n\n end ", "tab\tand\x0bmore\xa0nbsp\x85nel\x1cfs", "it's we'll I'd 'tis '' 'S", "日本語 text… 12½ ²³", "<|endoftext|> is text", "a" * 5000, " \n", "x\r\ny", "caf\xe9 \xaa\xb5\xba \xd7\xf7 9\xbe", "don't  stop", "!?'s'm 1's", "word " * 3000]
    rows = list(enumerate(odd, 5))
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, part int, start long")
    assert sorted(map(tuple, wavelet.token_files(docs, PATH).collect())) == expected(rows, tok)
    assert wavelet.token_files(docs.limit(0), PATH).count() == 0
    twice = wavelet.token_files(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id is None, r.start, r.n_tokens) for r in twice) == [(False, 2, 3), (False, 5, 3), (True, 0, 2)]


def test_rank_select_access():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 40, 200_000).astype(np.uint32)
    ids[:3] = 65_535, 0, 65_535
    m, docs, sizes = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes(np.array([4]), np.array([200_000])))
    assert (m.decode() == ids).all() and docs.tolist() == [4] and sizes.tolist() == [200_000]
    for i in (0, 1, 511, 65_535, 65_536, 65_537, 199_999):
        assert m.access(i) == ids[i]
    for token in (0, 7, 39, 65_535, 41):
        at = np.flatnonzero(ids == token)
        assert m.count(token) == len(at)
        assert m.count(token, 100, 131_072) == int(((at >= 100) & (at < 131_072)).sum())
        assert [m.locate(token, k) for k in range(0, len(at), 317)] == at[::317].tolist()
    with pytest.raises(IndexError):
        m.locate(41, 0)
    assert m.count(1 << 16) == 0
    assert wavelet.WaveletMatrix.build(np.zeros(0, np.uint32)).decode().size == 0


def test_files_are_smaller_and_read_in_part(tmp_path):
    """One access reads the header and at most one chunk a plane."""
    ids = (np.random.default_rng(6).zipf(1.3, 400_000) % 50_000).astype(np.uint32)
    raw = wavelet.WaveletMatrix.build(ids).to_bytes(np.array([1]), np.array([len(ids)]))
    assert len(raw) < 0.9 * 2 * len(ids)
    asked = []

    def read(at, size):
        asked.append(size)
        return raw[at : at + size]

    m = wavelet.WaveletMatrix.open(read)[0]
    first = sum(asked)
    assert m.access(123_456) == ids[123_456] and first < 8_000 and sum(asked) - first <= 16 * 2 * wavelet.CHUNK


def test_lookup_over_shards(spark, tok):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall() + [(None, "a b")]
    shards = wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), PATH, f"file://{tempfile.mkdtemp()}/w", shard_tokens=20_000).persist()
    places = {}
    for d, t in rows:
        for k, i in enumerate([*tok.encode(t or "", add_special_tokens=False).ids, 0]):
            places.setdefault(i, []).append((d, k))
    by_count = sorted(places, key=lambda i: len(places[i]))
    some = [by_count[0], by_count[len(by_count) // 2], by_count[-20], 0]
    asked = spark.createDataFrame([(t,) for t in [*some, some[0], 50_256, 99_999, None, -1]], "token long")
    assert dict(map(tuple, wavelet.count_tokens(shards, asked).collect())) == {t: len(places.get(t, [])) for t in [*some, 50_256, 99_999]}
    found = sorted((tuple(r) for r in wavelet.find_tokens(shards, asked).collect()), key=str)
    assert found == sorted(((t, d, k) for t in some for d, k in places[t]), key=str)
    assert wavelet.find_tokens(shards.limit(0), asked).count() == 0


def test_latin_split_is_the_tokenizers(tok):
    """Random texts of U+0000 to U+00FF, and with the characters around its rules more often."""
    rng = random.Random(12)
    every, often = [chr(i) for i in range(256)], list(" '\n\tsdmtlrev9A\xb2\xe9\xaa!\u00a0\x1c\x85")
    texts = ["".join(rng.choice(every if k % 2 else often) for _ in range(rng.randrange(1, 60))) for k in range(4_000)]
    for text, ids in zip(texts, wavelet.encode_all(texts, PATH)):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, text
