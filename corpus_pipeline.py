"""A corpus pipeline: each stage works on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``documents``. ``run`` applies them to ``documents``, writing what each returns to the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverline.llm import bpe, decontam, jaccard, langid, substring
from quaverline.llm.common import stored

#: Posterior probability below which a language isn't accepted.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that is likelier than all others together, go.

    The model learns from the labelled documents that are not held out. See ``langid.accepted`` for nulls, ties, repeated rows
    and empty tables.
    """
    return langid.accepted(docs, min_score=MIN_LANGUAGE_SCORE, held_out_remainder=2, modulus=4)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; see ``jaccard.representatives``."""
    return jaccard.representatives(docs, width=5, percent=75)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 13 words that a smaller doc_id holds are cut; n_chars follows the text.

    What is left without a word, or was without one or null before, goes. See ``substring.remove_substrings``.
    """
    cut = substring.remove_substrings(docs, min_words=13)
    same = F.length("text") == F.col("n_chars")
    return cut.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; see ``decontam.clean_documents``."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the digests of ids and decoded bytes of each document, null texts as empty ones."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "lang", "source")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode),
]

#: SQL can't express the language model, the alignment or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
