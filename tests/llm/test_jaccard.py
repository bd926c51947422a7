from collections import defaultdict
from itertools import combinations

import duckdb
import pytest

from quaverline.llm import jaccard
from quaverline.llm.components import components

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def brute(rows, width=5, percent=75):
    """All pairs that share a shingle, by Python sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for h in holders.values():
        for a, b in combinations(h, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    found = jaccard.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == brute(rows)
    assert sum(d != c for d, _, c in got) > 50


@pytest.mark.parametrize("share", [0.005, 0.9])
def test_near_copies_around_the_threshold(spark, monkeypatch, share):
    """A large group of near copies, some too far from its centre, with and without frequent shingles left out."""
    import random

    monkeypatch.setattr(jaccard, "GROUP_NODES", 40)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, "The same opening line of many texts " + " ".join(f"u{i}_{j}" for j in range(rng.randrange(3, 60)))) for i in range(60)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), sample_docs=200, frequent_share=share)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t "), (8, "one two"), (9, "ONE\ntwo"), (10, "one two three four five six"), (10, "one two three four five six"), (None, "one two"), (11, "z " * 6000), (12, "z " * 6001), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA + ", n int, sid int")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=str) == brute(rows)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    found = dict(map(tuple, components(links).collect()))
    assert all(found[i] == 0 for i in range(201)) and found[501] == found[500] == 500


@pytest.mark.parametrize("share", [0.005, 0.5])
def test_long_postings_in_blocks(spark, monkeypatch, share):
    """Short texts made of the same few shingles: every prefix shingle is held by many nodes, most of them not linked."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK_NODES", 7)
    monkeypatch.setattr(jaccard, "STAR_NODES", 10)
    monkeypatch.setattr(jaccard, "POSTING_BYTES", 2_000)
    monkeypatch.setattr(jaccard, "INEXACT", 30)
    rng = random.Random(8)
    lines = [" ".join(f"l{k}w{i}" for i in range(5)) for k in range(14)]
    rows = [(i, " ".join(rng.sample(lines, rng.randrange(2, 7)))) for i in range(150)]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), sample_docs=200, frequent_share=share)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_representatives_of_odd_tables(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text), (1, text), (1, text), (None, text), (7, None), (8, ""), (9, None)]
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA + ", _gone int, sid int, component_id string")
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "7", "8", "9", "None"]
    assert jaccard.representatives(docs.limit(0)).count() == 0
