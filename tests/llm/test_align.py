import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quaverline.llm import align
from quaverline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_letters():
    """The printable letters that byte-level entries are written in."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows, libraries):
    """Walks both token lists byte by byte."""
    a, b = libraries
    letters, links, out = byte_letters(), [], []
    for d, t in rows:
        ia = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        wa = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        wb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or not b"".join(wa) == b"".join(wb) == (" " + t).encode():
            out.append([d, 0, 0, []])
            links.append([])
            continue
        ends_a, ends_b = ({e: k for k, e in enumerate(np.cumsum([len(x) for x in w]).tolist())} for w in (wa, wb))
        own, groups, la, lb = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            own.append((ia[ends_a[e]], ib[ends_b[e]]))
            groups.append(",".join(map(str, ia[la : ends_a[e] + 1])) + "|" + ",".join(map(str, ib[lb : ends_b[e] + 1])))
            la, lb = ends_a[e] + 1, ends_b[e] + 1
        out.append([d, len(ia), len(ib), groups])
        links.append(own)
    counts = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (
            (d, na, nb, len(g), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
            for (d, na, nb, g), own in zip(out, links)
        ),
        key=str,
    )


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_query_equals_brute_force(spark, libraries):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    found = got(QUERIES["op12_token_alignment"](spark, SF))
    assert found == brute(rows, libraries) and sum(r[5] < r[4] for r in found) > 10


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "a  b   c "), (6, "x▁y"), (7, "x ▁▁ y"), (8, "<|endoftext|> <s> <0x41> </s>"), (9, "日本語 テキスト。" * 20), (10, "naïve café\r\n\tend\x00\x85"),
    (11, "word " * 3000), (11, "word " * 3000), (None, "no id"), (12, "ab" * 400), (13, "\n\n\n"), (14, "emoji 👩‍👩‍👧 ok"), (15, "don't  1234567 -- ==> x_y"), (16, " nbsp　wide"),
]


@pytest.mark.parametrize("most_pairs", [1 << 20, 40, 0])
def test_odd_rows_and_rare_pairs(spark, libraries, monkeypatch, most_pairs):
    monkeypatch.setattr(align, "CHUNK", 60)
    monkeypatch.setattr(align, "BATCH_BYTES", 500)
    monkeypatch.setattr(align, "BATCH_LINKS", 300)
    docs = spark.createDataFrame([(d, t, 1, "m", 2) for d, t in ODD], "doc_id long, text string, n_a int, links string, row int").repartition(3)
    assert got(align.token_alignment(docs, A, B, most_pairs)) == brute(ODD, libraries)
    assert align.token_alignment(docs.limit(0), A, B, most_pairs).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ab'▁\n\t<0x>é"), st.characters(codec="utf-8")), max_size=60))
def test_words_and_chunks_encode_as_the_libraries(text):
    v = align.vocabularies(A, B)
    parts = align.chunks(" " + text, 5)
    assert "".join(parts) == " " + text and all(p[0] == " " for p in parts)
    if text:
        assert np.concatenate([v.pieces.encode(p) for p in parts]).tolist() == v.pieces.model.encode(text)
        assert [i for p in parts for i in align.encode_all([p], A)[0].tolist()] == align.tokenizer(A).encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=80))
def test_ranks(lengths):
    ends = align.Ends.of(np.array(lengths), sum(lengths))
    at = np.arange(sum(lengths))
    bits = np.isin(at + 1, np.cumsum(lengths))
    assert (ends.rank(at) == np.cumsum(bits)).all() and (ends.places() == np.flatnonzero(bits)).all()
