import random

import duckdb
import numpy as np

from quaverline.llm import decontam

SF = "/root/testdata/sf0.01"


def distance(item, text):
    """Fewest edits of the whole item anywhere in the text, by the plain dynamic programme."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i] + [0] * len(text)
        for j, x in enumerate(text, 1):
            row[j] = min(before[j - 1] + (c != x), before[j] + 1, row[j - 1] + 1)
    return min(row)


def test_verbatim_items_are_found(spark):
    con = duckdb.connect()
    docs = con.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = con.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    found = decontam.leaks(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    exact = {(d, i) for d, t in docs for i, x in items if " ".join(x.lower().split()) in " ".join(t.lower().split())}
    got = {(r.doc_id, r.item_id) for r in found}
    assert exact and exact <= got and len(got) < len(exact) + 5
    text = dict(docs)
    for r in found:
        item = dict(items)[r.item_id]
        assert abs((r.stop - r.start) - len(item)) <= r.edits and r.edits <= 0.1 * len(item)
        assert distance(decontam.normal(item).tolist(), decontam.normal(text[r.doc_id][r.start : r.stop]).tolist()) == r.edits


def test_brute_force_with_edits(spark):
    rng = random.Random(11)
    letters = "abcdefg hij klmnop é"
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(*((9, 33) if k % 2 else (33, 160))))).strip() or "x" * 9) for k in range(12)]
    docs = []
    for d in range(240):
        body = list("".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))))
        if d % 3:
            x = list(items[d % 12][1].upper() if d % 2 else items[d % 12][1])
            for _ in range(rng.randrange(0, len(x) // 7 + 1)):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "zz"])
            at = rng.randrange(len(body) + 1)
            body[at:at] = x
        docs.append((d, "".join(body)))
    expected = {(d, k) for d, t in docs for k, x in items if distance(decontam.normal(x).tolist(), decontam.normal(t).tolist()) <= len(x) // 10}
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), part_chars=200)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and len(expected) > 10


def test_edges(spark):
    item = "a benchmark question that is long enough to look for, is it not?"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, item, 3), (3, item, 3), (None, f"x {item}", 4), (5, "word " * 20_000 + item, 5), (6, "a benchmark", 6), (7, item[:8], 7)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, item), (9, item), (8, None), (7, "short"), (None, item + " indeed, it is.")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in decontam.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(3, 9, 0), (3, 9, 0), (None, 9, 0), (5, 9, 0)], key=str)
    clean = decontam.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(r.item_id for r in clean.collect()) == [1, 2, 6, 7]
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_alignment_is_the_edit_distance():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item = rng.integers(97, 101, 30).astype(np.uint32)
        text = rng.integers(97, 101, rng.integers(5, 60)).astype(np.uint32)
        at = int(rng.integers(0, len(text)))
        text = np.concatenate([text[:at], np.delete(item, rng.integers(0, 30, 2)), text[at:]])
        best = distance(item.tolist(), text.tolist())
        hit = decontam.align(item, text, -40, 100, 12)
        assert hit is not None and hit[0] == best
        assert distance(text[hit[1] : hit[2]].tolist(), item.tolist()) <= best


def leaked(spark, docs, items):
    rows = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted((r.doc_id, r.item_id, r.edits) for r in rows)


def test_items_of_any_length(spark):
    """Verbatim at every length, and with all the edits that a length allows but not one more."""
    rng = random.Random(3)
    items = [(m, "".join(rng.choice("abcdefghijkl") for _ in range(m))) for m in (5, 7, 8, 10, 15, 20, 23, 30, 31, 40, 41, 42, 50, 79)]
    docs, expected = [], []
    for m, x in items:
        for extra in (0, 1):
            body = list(x)
            for k in range(m // 10 + extra):
                body[(2 * k + 1) * m // (2 * (m // 10 + extra))] = "Z"
            docs.append((2 * m + extra, f"some {''.join(body)} more"))
            expected += [(2 * m, m, m // 10)] * (1 - extra)
    assert leaked(spark, docs, items) == sorted(expected)


def test_short_items_are_words_of_their_own(spark):
    assert leaked(spark, [(1, "say yes, now"), (2, "yesterday"), (3, "YES"), (4, "no")], [(7, " yes\n"), (8, " "), (9, "")]) == [(1, 7, 0), (3, 7, 0)]


def test_any_white_space_is_a_space(spark):
    item = "what\u2003is the\xa0answer to\tlife"
    assert leaked(spark, [(1, "so what is\u3000the answer\x85to life then")], [(1, item)]) == [(1, 1, 0)]
