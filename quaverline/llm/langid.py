"""Language identification: word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its character n-grams, the
longest length of which any is known. Words and n-grams are counted over a bounded sample of labelled documents
(``max_train_docs``); every one that occurs there is kept, as a 64-bit hash with a score for each language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import CACHE_ENTRIES, id_bucket, sampled, texts

#: Lengths of character n-grams, longest first.
GRAMS = (5, 4, 3, 2, 1)
#: Units that a map task folds at a time.
BATCH_UNITS = 1_000_000
UNKNOWN = "und"


def plain(word: str) -> str:
    """Lower case, without what surrounds the letters."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def grams(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03"
    if n == 1:
        return list(word)
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def unit_hash(unit: str, n: int) -> int:
    """Of a word (n = 0) or an n-gram, as a signed long."""
    h = xxhash.xxh3_64_intdigest(f"{n}{unit}".encode("utf-8", "surrogatepass"))  # with n as a seed, one-letter units collide
    return h - (1 << 64) if h >> 63 else h


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, count) of labelled documents; lang is a number."""

    def run(batches):
        for batch in batches:
            found: dict[int, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update((text or "").split())
            for lang, raw in found.items():
                by: Counter = Counter()
                for word, c in raw.items():
                    if word := plain(word):
                        by[word.encode("utf-8", "surrogatepass")] += c
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(by), pa.int32()), "word": pa.array(by.keys(), pa.binary()), "count": pa.array(by.values(), pa.int64())})

    counted = docs.select("lang", "text").mapInArrow(run, "lang int, word binary, count long")
    return counted.groupBy("lang", "word").agg(F.sum("count").alias("count"))


def count_units(words: DataFrame) -> DataFrame:
    """(n, h, lang, count): how often words (n = 0) and n-grams occur, by ``unit_hash``. N-grams are those of distinct words."""

    def fold(parts: list[tuple[list[int], int, int, int]]) -> pa.RecordBatch:
        sizes = [len(p[0]) for p in parts]
        h = np.concatenate([np.array(p[0], np.int64) for p in parts])
        lang, n, times = (np.repeat(np.array([p[k] for p in parts], np.int64), sizes) for k in (1, 2, 3))
        by = np.lexsort((lang, h))
        h, lang, n, times = h[by], lang[by], n[by], times[by]
        new = np.append(True, (h[1:] != h[:-1]) | (lang[1:] != lang[:-1]))
        starts = np.flatnonzero(new)
        return pa.RecordBatch.from_pydict({"n": pa.array(n[starts], pa.int32()), "h": h[starts], "lang": pa.array(lang[starts], pa.int32()), "count": np.add.reduceat(times, starts)})

    def run(batches):
        parts: list[tuple[list[int], int, int, int]] = []
        held = 0
        for batch in batches:
            for lang, raw, times in zip(*(batch.column(i).to_pylist() for i in range(3))):
                word = raw.decode("utf-8", "surrogatepass")
                parts.append(([unit_hash(word, 0)], lang, 0, times))
                for n in GRAMS:
                    if found := grams(word, n):
                        parts.append(([unit_hash(g, n) for g in found], lang, n, times))
                held += 5 * len(word)
                if held >= BATCH_UNITS:
                    yield fold(parts)
                    parts, held = [], 0
        if parts:
            yield fold(parts)

    counted = words.select("lang", "word", "count").mapInArrow(run, "n int, h long, lang int, count long")
    return counted.groupBy("n", "h", "lang").agg(F.sum("count").alias("count"))


class Model:
    """Log frequencies by language of words and of n-grams, found by their hashes."""

    def __init__(self, langs: list[str], n: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
        """A row of ``counts``, by language, for each unit of length ``n`` (0: word) with one of the distinct ``hashes``."""
        self.langs = langs
        by = np.argsort(hashes)
        self.hashes, n, counts = hashes[by], n[by], counts[by]
        self.scores = np.zeros(counts.shape, np.float32)
        for k in (0, *GRAMS):
            own = np.flatnonzero(n == k)
            total = counts[own].sum(axis=0, dtype=np.float64) + 0.5 * (len(own) + 1)
            self.scores[own] = np.log(counts[own] + 0.5) - np.log(total)

    def rows(self, hashes: list[int]) -> np.ndarray:
        """The place of each hash in ``scores``; -1: unknown."""
        wanted = np.array(hashes, np.int64)
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def words(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words as they stand in a text, and whether anything of them is known; 0 where nothing is."""
        words = [plain(w) for w in raw]
        out, known = np.zeros((len(words), len(self.langs)), np.float32), np.zeros(len(words), bool)
        open_ = np.flatnonzero([bool(w) for w in words])
        for n in (0, *GRAMS):
            units = [[words[i]] if n == 0 else grams(words[i], n) for i in open_.tolist()]
            owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
            at = self.rows([unit_hash(g, n) for u in units for g in u])
            owner, at = owner[at >= 0], at[at >= 0]
            if len(at):
                starts = blobs.runs(owner)
                sums = np.add.reduceat(self.scores[at].astype(np.float64), starts)
                found = open_[owner[starts]]
                out[found] = sums / np.diff(np.append(starts, len(owner)))[:, None]
                known[found] = True
                open_ = open_[~known[open_]]
            if not len(open_):
                break
        return out, known


class Scorer:
    """(language, probability) of whole texts. Scores of words are remembered by row of one growing matrix."""

    def __init__(self, model: Model):
        self.model = model
        self.matrix = np.zeros((1 << 16, len(model.langs)), np.float32)
        self.memo: dict[str, int] = {}

    def _rows(self, tokens: list[str]) -> np.ndarray:
        if len(self.memo) > CACHE_ENTRIES:
            self.memo.clear()
        rows = list(map(self.memo.get, tokens))
        if None in rows:
            new = list({t: None for t, r in zip(tokens, rows) if r is None})
            first = len(self.memo)
            while first + len(new) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[first : first + len(new)] = self.model.words(new)[0]
            self.memo.update(zip(new, range(first, first + len(new))))
            rows = list(map(self.memo.get, tokens))
        return np.array(rows, np.int64)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.model.langs or not any(map(str.isalpha, text or "")):
            return UNKNOWN, 0.0
        rows = self._rows(text.split())  # may replace the matrix
        total = self.matrix[rows].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        return self.model.langs[best], 1.0 / float(np.sum(np.exp(np.maximum(total - total[best], -700.0))))


def train(docs: DataFrame, max_train_docs: int = 20_000) -> Model:
    """``docs`` has doc_id, text and lang; rows without a language don't count.

    Of the units of the sample all reach the driver, a hash and a count for each language.
    """
    labelled = sampled(docs.filter(F.col("lang").isNotNull()), F.col("doc_id"), max_train_docs)
    langs = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1 if langs else F.lit(0)
    counted = count_units(count_words(labelled.select(number.alias("lang"), "text")))
    by_lang = (F.sum(F.when(F.col("lang") == i, F.col("count")).otherwise(0)).alias(f"c{i}") for i in range(len(langs)))
    found = counted.groupBy("n", "h").agg(F.count("*").alias("langs"), *by_lang).toArrow()
    column = lambda name: found.column(name).to_numpy()
    counts = np.zeros((found.num_rows, len(langs)))
    for i in range(len(langs)):
        counts[:, i] = column(f"c{i}")
    return Model(langs, column("n"), column("h"), counts)


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (posterior probability) to doc_id and the columns in ``keep``.

    Null texts and texts without a letter give ``und`` and 0. A tie goes to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select("doc_id", *keep).schema

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = list(map(scorer, batch.column(1).to_pylist()))
            columns = [batch.column(0), *batch.columns[2:], pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])
    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def language_id(docs: DataFrame, held_out_remainder: int = 2, modulus: int = 4, **bounds: int) -> DataFrame:
    """Learns from documents whose id bucket isn't ``held_out_remainder`` and predicts all: doc_id, held_out, lang_pred, score.

    Nulls: a null text is ``und``; a null language isn't learned from; a null doc_id is kept. Repeated rows give repeated
    rows, an empty table an empty result. If nothing can be learned, every text is ``und``.
    """
    rows = texts(docs, F.col("lang").cast("string").alias("lang"))
    held = id_bucket(F.col("doc_id"), modulus) == held_out_remainder
    model = train(rows.filter(~held), **bounds)
    return identify(rows.select("doc_id", "text", held.alias("held_out")), model, "held_out").select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.5, held_out_remainder: int = 2, modulus: int = 4, **bounds: int) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least ``min_score``, with all their columns, whatever else those are named.

    Prediction and filter are one pass over the texts, without a join. Null and empty texts and texts without a letter go, as
    does a text that two languages are as likely for, if that is below ``min_score``. A null doc_id or language is no reason
    to go. Repeated rows stay or go together; an empty table stays empty; if nothing can be learned, all go.
    """
    held = id_bucket(F.col("doc_id"), modulus) == held_out_remainder
    model = train(texts(docs, F.col("lang").cast("string").alias("lang")).filter(~held), **bounds)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            kept = [lang != UNKNOWN and score >= min_score for lang, score in map(scorer, batch.column(place).to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
