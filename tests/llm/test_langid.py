import math
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quaverline.llm import langid
from quaverline.llm.common import sampled

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall()
    found = {r.doc_id: r for r in langid.language_id(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(found[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= found[d].score <= 1 for d, _ in rows)
    assert np.mean([found[d].lang_pred == lang for d, lang in rows if found[d].held_out]) > 0.97


def test_backs_off_to_shorter_pieces():
    units = [("haus", 0, 0, 9), ("maison", 0, 1, 9)] + [(g, n, i, 5) for i, w in enumerate(("haus", "maison")) for n in langid.GRAMS for g in langid.grams(w, n)]
    table = {}
    for unit, n, lang, c in units:
        table.setdefault((n, langid.unit_hash(unit, n)), np.zeros(2))[lang] += c
    model = langid.Model(["a", "b"], *(np.array(x) for x in zip(*table)), np.array(list(table.values())))

    def best(w):
        scores, known = model.words([w])
        return model.langs[int(np.argmax(scores[0]))] if known[0] else None

    assert best("haus,") == "a" and best("MAISON") == "b"  # known words
    assert best("hausen") == "a" and best("maisonne") == "b" and best("uu") == "a"  # longer and shorter n-grams
    assert best("xyz") is None and best("123") is None


def test_brute_force(spark):
    """Every text against plain counters of all words and n-grams."""
    rows = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    langs = sorted({lang for d, _, lang in rows if lang and zlib.crc32(str(d).encode()) % 4 != 2})
    counts = {n: {x: Counter() for x in langs} for n in (0, *langid.GRAMS)}

    def units(word, n):
        padded = f"\x02{word}\x03" if n > 1 else word
        return [word] if n == 0 else [padded[i : i + n] for i in range(len(padded) - n + 1)]

    for d, t, lang in rows:
        if lang and zlib.crc32(str(d).encode()) % 4 != 2:
            for w in (t or "").split():
                if w := langid.plain(w):
                    for n in counts:
                        counts[n][lang].update(units(w, n))
    size = {n: len(set().union(*counts[n].values())) for n in counts}
    total = {n: {x: sum(counts[n][x].values()) for x in langs} for n in counts}
    score = lambda n, u, x: math.log((counts[n][x][u] + 0.5) / (total[n][x] + 0.5 * (size[n] + 1)))
    found = {r.doc_id: r for r in langid.language_id(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert len(found) == len(rows)
    for d, t, _ in rows:
        sums = dict.fromkeys(langs, 0.0)
        for w in map(langid.plain, (t or "").split()):
            for n in counts if w else ():
                if known := [u for u in units(w, n) if any(counts[n][x][u] for x in langs)]:
                    for x in langs:
                        sums[x] += sum(score(n, u, x) for u in known) / len(known)
                    break
        best = max(langs, key=lambda x: sums[x]) if any(map(str.isalpha, t or "")) else "und"
        p = 1 / sum(math.exp(max(v - sums[best], -700)) for v in sums.values()) if best != "und" else 0
        assert found[d].lang_pred == best and abs(found[d].score - p) < 1e-3


def test_edges(spark):
    rows = [(i, "der die das und haus", "de") for i in range(40)] + [(100 + i, "the house and a tree", "en") for i in range(40)]
    odd = [(900, None, "de"), (901, "", "en"), (902, "12 34 !!", None), (903, "das haus " * 40_000, None), (903, "the tree", None), (None, "the tree", "en"), (905, "日本", None)]
    docs = spark.createDataFrame([(d, t, lang, 1.0, "x") for d, t, lang in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string")
    found = langid.language_id(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by[900] == by[901] == by[902] == ["und"] and sorted(by[903]) == ["de", "en"] and by[None] == ["en"] and by[905][0] in ("de", "en")
    assert {by[i][0] for i in range(40)} == {"de"} and {by[100 + i][0] for i in range(40)} == {"en"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 4  # a text that says nothing is as likely either
    assert langid.language_id(docs.limit(0)).count() == 0
    none = langid.language_id(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].lang_pred == "und" and none[0].score == 0


def test_ties_and_repeated_ids(spark):
    rows = [(i, "ja", "b") for i in range(8)] + [(100 + i, "ja", "a") for i in range(8)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    even = [r for r in train if r[2] == "a"][:4] + [r for r in train if r[2] == "b"][:4]
    odd = [(7_000, "ja", None), (7_000, "ja", None), (7_000, "ja ja", None)]
    found = langid.language_id(spark.createDataFrame(even + odd, "doc_id long, text string, lang string")).collect()
    assert [r.lang_pred for r in found if r.doc_id == 7_000] == ["a"] * 3 and all(abs(r.score - 0.5) < 1e-6 for r in found)


def test_the_sample_is_a_bound(spark):
    same = spark.createDataFrame([(1, f"text {i}") for i in range(50)], "doc_id long, text string")
    assert sampled(same, F.col("doc_id"), 20).count() == 20 and sampled(same, F.col("doc_id"), 50).count() == 50
    mixed = spark.createDataFrame([(i % 30, "t") for i in range(60)], "doc_id long, text string")
    assert sampled(mixed, F.col("doc_id"), 25).count() == 25
