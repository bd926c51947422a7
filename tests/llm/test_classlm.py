import math
import uuid
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quaverline.llm import classlm, common

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def base(rows):
    train = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in rows:
        w = tokens(t)
        score = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1, len(w), sum(train[x] > 0 for x in w), n, score))
    return out


def check(found, rows):
    got = sorted((tuple(r)[:6] for r in found), key=str)
    for a, b in zip(got, sorted(base(rows), key=str), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


def test_counts_and_scores(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    found = classlm.class_scores(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    check(found, rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)
    assert all(r.score < 0 for r in found)


def test_edges(spark):
    rows = [(1, "a b a"), (1, "a b a"), (2, None), (3, ""), (4, "Zz a"), (5, "b " * 4000), (None, "c c"), (6, " \t")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, owner int, train int")
    check(classlm.class_scores(docs, words=2, classes=4).collect(), rows)
    assert classlm.class_scores(docs.limit(0)).count() == 0
    assert classlm.class_scores(docs.filter("doc_id = 99 or doc_id = 1").limit(1)).count() == 1


def test_probabilities_sum_to_one():
    """Over the known words and one unseen word for each ending that a class has, after any class."""
    rng = np.random.default_rng(1)
    n = 3 + 1 + classlm.ENDINGS
    bigrams = np.zeros((n, n), np.int64)
    bigrams[:8, :8] = rng.integers(0, 9, (8, 8))
    types = np.zeros(classlm.ENDINGS, np.int64)
    types[:4] = 1  # one word for each ending seen
    m = classlm.ClassModel([b"x", b"y", b"z"], bigrams, types, 3)
    counts = bigrams.sum(axis=0)
    total = np.zeros(3)
    for u in np.flatnonzero(counts > 0):
        total[m.cls[u]] += (counts[u] + 0.5) / 10 ** m.spread[m.cls[u]]
    total += 0.5 / 10**m.spread  # unseen
    assert total == pytest.approx([1, 1, 1])
    assert (10**m.transitions).sum(axis=1) == pytest.approx([1, 1, 1])


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(2)
    b = np.zeros((9, 9), np.int64)
    b[1:5, 5:9] = rng.integers(50, 90, (4, 4))
    b[5:9, 1:5] = rng.integers(50, 90, (4, 4))
    cls = classlm.exchange(b, 3, fixed=0)
    assert cls[0] == 0 and len(set(cls[1:5])) == 1 and len(set(cls[5:9])) == 1 and cls[1] != cls[5]


def test_moves_raise_the_likelihood_most():
    """Against the likelihood of each possible move."""
    rng = np.random.default_rng(3)
    n, classes = 12, 5
    b = rng.integers(0, 20, (n, n))
    cls = np.append(0, rng.integers(1, classes, n - 1))

    def joint(c):
        return np.array([[b[np.ix_(c == i, c == j)].sum() for j in range(classes)] for i in range(classes)], float)

    tables = [np.array([np.bincount(cls, np.where(np.arange(n) == u, 0, row), classes) for u, row in enumerate(m)]) for m in (b, b.T)]
    found = classlm.moved(*tables, np.diag(b).astype(float), cls, joint(cls))
    for u in range(1, n):
        tried = [-np.inf] + [classlm.likelihood(joint(np.where(np.arange(n) == u, c, cls))) for c in range(1, classes)]
        assert tried[found[u]] == pytest.approx(max(tried), abs=1e-6)


def test_words_beyond_the_start_are_clustered(spark):
    """Words of two kinds with one ending take turns; only a half of them are among the first to be clustered."""
    rng = np.random.default_rng(4)
    kinds = [[f"{k}{chr(97 + i)}xx" for i in range(12)] for k in "pq"]
    rows = [(d, " ".join(kinds[i % 2][rng.integers(12)] for i in range(40))) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = classlm.class_scores(docs, words=12, classes=6).collect()
    check(found, rows)
    gain = sum(r.score - r.base_score for r in found if r.held_out) / sum(r.n_tokens for r in found if r.held_out)
    assert gain > 0.27  # a half of the words can follow: log10(2)


def test_the_sample_changes_no_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = [{r.doc_id: r.score for r in classlm.class_scores(docs, words=50, classes=8, sample_docs=n).collect()} for n in (10, 20_000)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-9)


def test_words_are_numbered_in_bulk_and_few_are_held(monkeypatch):
    monkeypatch.setattr(classlm, "CACHE_WORDS", 50)
    hashes = np.sort(np.array([classlm.key(b"w%d" % i) for i in range(0, 300, 3)], np.uint64))
    units = classlm.Units(hashes, [b"w7", b"w9"])
    for start in (*range(0, 300, 20), 0, 5):
        words = [b"w%d" % i for i in range(start, start + 30)] * 2
        at = units.numbers(b" ".join(words).decode())
        units.place()
        want = np.array([classlm.key(w) for w in words], np.uint64)
        assert np.array_equal(units.keys[at], want) and np.array_equal(units.unit[at], classlm.unit_of(hashes, want))
        assert units.hot[at].tolist() == [{b"w7": 0, b"w9": 1}.get(w, -1) for w in words]
        assert len(units.memo) <= 50 + 30


def test_a_chunk_of_texts_is_numbered_as_its_words_are():
    odd = "".join(map(chr, [*range(0x100), 0x2003, 0x3000, 0x1F600]))
    texts = ["Zz a zZ", None, "", " \t\n", odd, f" {odd} É é\x0bA ", "a", *(f"w{i} x\r\nw{i % 7}" for i in range(50))]
    for array in (pa.array(texts), pa.array(["gone", *texts, "gone"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        sizes, numbers, k = classlm.encode(array)
        words = [common.lower_words(t) for t in texts]
        assert sizes.tolist() == [len(w) for w in words]
        assert k[numbers].tolist() == [classlm.key(w) for ws in words for w in ws]
        assert len(k) == len({w for ws in words for w in ws})
    sizes, numbers, k = classlm.encode(pa.array([None, ""], pa.string()))
    assert sizes.tolist() == [0, 0] and not len(numbers) and not len(k)


def test_texts_are_read_once_for_their_size_and_once_for_their_words(spark, tmp_path):
    rows = [(d, " ".join(f"w{d * i % 23}" for i in range(60))) for d in range(40)]

    def note(batches):
        for batch in batches:
            with open(tmp_path / uuid.uuid4().hex, "w") as f:
                f.write(str(batch.num_rows))
            yield batch

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(note, "doc_id long, text string")
    check(classlm.class_scores(docs, words=4, classes=4).collect(), rows)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 2 * len(rows)


def test_small_chunks_change_nothing(spark, monkeypatch):
    """Words meet across chunks; repeated rows and null ids lie in several."""
    rows = [(d if d % 9 else None, " ".join(f"w{(d % 30) * i % 41}" for i in range(d % 13))) for d in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = []
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(classlm, "CHUNK_BYTES", size)
        found.append(sorted(map(tuple, classlm.class_scores(docs, words=4, classes=4, least=5).collect()), key=str))
        check(classlm.class_scores(docs, words=4, classes=4, least=5).collect(), rows)
    for other in found[1:]:
        for a, b in zip(found[0], other, strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
