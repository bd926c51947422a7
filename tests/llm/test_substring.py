import hashlib

import duckdb

from quaverline.llm import substring

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def brute(rows, n=13):
    """From the definition: windows by a dict of their first document."""
    first = {}
    tokens = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in tokens:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in tokens:
        cut = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                cut.update(range(k, k + n))
        kept = [x for k, x in enumerate(w) if k not in cut]
        out.append((i, len(w), len(cut), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    found = substring.substring_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert sum(r.n_removed for r in found) > 1000


def test_edges(spark):
    long = " ".join(f"w{i % 7}" for i in range(5000))
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(1, passage), (2, f"a {passage} b"), (2, f"a {passage} b"), (3, None), (4, ""), (5, " \t\x0b "), (6, long), (7, long + " end"), (None, passage), (8, passage[:-4]), (9, "x " + passage.split(" ", 3)[3])]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], SCHEMA + ", ends int, sig string")
    found = substring.substring_dedup(docs).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert substring.substring_dedup(docs.limit(0)).count() == 0


def test_small_automata_and_salts(spark, monkeypatch):
    """The same result if shards need several automata and groups."""
    monkeypatch.setattr(substring, "AUTOMATON_WORDS", 40)
    monkeypatch.setattr(substring, "GROUP_DOCS", 2)
    body = [f"q{i}" for i in range(60)]
    rows = [(i, " ".join(body[i % 5 : 40 + i % 9] + [f"t{i}"])) for i in range(60)]
    found = substring.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_remove_keeps_columns(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, "u", passage), (2, "v", f"a\n{passage} b"), (3, None, "clean\n text")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = substring.remove_substrings(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == [(1, "u", passage), (2, "v", "a b"), (3, None, "clean\n text")]


def test_reference(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {passage}"), (2, "b")], SCHEMA)
    found = dict(map(tuple, substring.remove_reference(docs, spark.createDataFrame([(passage,)], "text string")).collect()))
    assert found[1] == list(range(13, 21)) and found[2] == []
