import hashlib
import os

import corpus_pipeline
from quaverline.llm import decontam

from .test_jaccard import brute as groups
from .test_substring import SF
from .test_substring import brute as cut_digests


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, docs, SF)
    assert first.columns == docs.columns and first.count() > 990
    rows = first.select("doc_id", "text").collect()

    second = corpus_pipeline.drop_near_duplicates(spark, first, SF)
    assert second.columns == docs.columns
    kept = {d for d, _, c in groups([tuple(r) for r in rows]) if c == d}
    two = sorted(tuple(r) for r in second.select("doc_id", "text").collect())
    assert {d for d, _ in two} == kept

    third = corpus_pipeline.drop_repeated_passages(spark, second, SF)
    assert third.columns == docs.columns
    three = {r.doc_id: r for r in third.collect()}
    for d, n, removed, digest in cut_digests(two):
        if n > removed:
            assert hashlib.sha256(b" ".join(three[d].text.encode().split())).hexdigest() == digest and three[d].n_chars == len(three[d].text)
            assert removed or three[d].text == dict(two)[d]
        else:
            assert d not in three

    fourth = corpus_pipeline.drop_benchmark_leaks(spark, third, SF)
    assert fourth.columns == docs.columns
    leaking = {r.doc_id for r in decontam.leaks(third, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in fourth.select("doc_id").collect()} == three.keys() - leaking


def test_run(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    assert len(found) == len({r.doc_id for r in found}) > 700
    assert found[0].asDict().keys() == {"doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontamination", "byte_bpe"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _0 string, ends int, sig string, score double, lang_pred string, owner long"
ENGLISH = "the old house by the river was sold to a young man who came from the town and had never seen it before"
LONG = " ".join(f"the word{i % 977} of house{i % 89}" for i in range(60_000))
ODD = [
    (1, ENGLISH, "en"), (2, ENGLISH, "en"), (2, ENGLISH, "en"), (3, None, "en"), (4, "", None), (5, " \t\n", "de"), (6, LONG, "en"), (7, f"{LONG} end", None),
    (None, ENGLISH, "en"), (8, "12 34 !!", None), (9, f"Once {ENGLISH} and then some more words were said by the other one there", "en"), (10, "das alte Haus am Fluss war schon lange verkauft", "de"),
]


def odd_table(spark):
    return spark.createDataFrame([(d, t, lang, "s", len(t or ""), 1, "z", 2, "q", 0.5, "p", 3) for d, t, lang in ODD], SCHEMA)


def test_each_stage_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, rows without an id and columns with the names that operators use inside."""
    docs = odd_table(spark)
    spark.createDataFrame([(1, "das alte Haus am Fluss"), (2, None), (3, ""), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    expected = {
        "language_id": ["1", "10", "2", "2", "6", "7", "9", "None"],
        "jaccard_join": ["1", "10", "3", "4", "5", "6", "8", "9", "None"],
        "substring_dedup": ["1", "10", "6", "7", "8", "9", "None"],
        "decontamination": ["1", "2", "2", "3", "4", "5", "6", "7", "8", "9", "None"],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and ids(kept) == expected[name], name
        assert all(r._gone == 1 and r._0 == "z" and r.owner == 3 for r in kept.collect())
    cut = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert cut[9].text == "Once and then some more words were said by the other one there" and cut[9].n_chars == len(cut[9].text)
    assert cut[7].text == "end" and cut[6].text == LONG and cut[None].text == ENGLISH
    encoded = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert len(encoded) == len(ODD) and sorted(r.n_tokens for r in encoded)[:2] == [0, 0]


def test_each_stage_on_an_empty_table(spark):
    docs = odd_table(spark).limit(0)
    assert os.path.isdir(SF)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
