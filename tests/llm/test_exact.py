import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaverline.llm import exact
from quaverline.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, keep_id string, digest int, maybe string"


def expected(rows):
    groups: dict = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((len(t or ""), d))
    out = []
    for key, found in groups.items():
        most = max(n for n, _ in found)
        ids = [d for n, d in found if n == most and d is not None]
        keep = min(ids) if ids else None
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(d, keep, len(found), d == keep and n == most, sha) for n, d in found]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLE['op13_exact_dedup']})").fetchall()
    assert got(QUERIES["op13_exact_dedup"](spark, SF)) == sorted(want, key=str)


ODD = [
    (5, "a b"), (3, "ab"), (4, " ab "), (2, "a\tb"), (9, None), (8, ""), (7, " \n"), (None, "ab"), (None, "alone"), (6, "x y"), (1, "xy"),
    (10, "long " * 60_000), (11, "long " * 60_000), (11, "long " * 60_000), (12, "same"), (12, "s a m e"), (-(2**63), "edge"), (2**63 - 1, "edge"), (13, "\x1ca\x85"), (14, "a"),
]


@pytest.mark.parametrize("how", [{}, {"filter_bytes": 0}, {"bucket_hashes": 1}])
def test_odd_rows(spark, how):
    docs = spark.createDataFrame([(d, t, "k", 1, "m") for d, t in ODD], SCHEMA)
    assert got(exact.exact_duplicates(docs, **how)) == expected(ODD)


def test_hot_group_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(exact, "BATCH_HASHES", 50)
    rows = [(i, "one hot text" + " " * (i % 3)) for i in range(900)] + [(1000 + i, f"t{i // 2}") for i in range(600)] + [(2000 + i, f"u{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(exact.exact_duplicates(docs)) == expected(rows)


def test_empty_table_and_kept_rows(spark):
    docs = spark.createDataFrame([(d, t, "k", 1, "m") for d, t in ODD], SCHEMA)
    assert exact.exact_duplicates(docs.limit(0)).count() == 0 and exact.distinct_documents(docs.limit(0)).count() == 0
    kept = exact.distinct_documents(docs)
    stay = {d for d, _, _, k, _ in expected(ODD) if k}
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in ODD if d in stay or d is None)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300, unique=True))
def test_filters_know_what_they_learned(values):
    h = np.array(values, np.uint64)
    bits = exact.filter_for(len(h))
    exact.learn(bits, h)
    assert exact.knows(bits, h).all()


def test_filters_rarely_err():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    bits = exact.filter_for(10_000)
    exact.learn(bits, h[:10_000])
    assert exact.knows(bits, h[10_000:]).mean() < 0.02
