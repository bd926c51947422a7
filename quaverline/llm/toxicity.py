"""Toxicity classifier with counterfactual regularisation.

A logistic regression over how densely telling words and word beginnings occur. Besides the usual ridge it is charged for
every labelled text that names a group: the text is written again with each group's term swapped for others of its kind,
and the square of each change of the score is a part of the loss. That pulls the weights of a kind's terms together, and
as neutral mentions outnumber toxic ones, to nothing.

The classifier is fitted on a bounded sample of labelled rows (``max_train_docs``); every text is scored whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, id_bucket, sampled, texts
from .langid import plain

#: Terms of one line may be swapped for each other; by language.
IDENTITY_TERMS = (
    # English
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    # German
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("muslimische", "christliche", "jüdische", "buddhistische"),
    ("schwarze", "weiße", "asiaten", "afrikaner"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "gehörlose", "blinde", "autisten"),
    # Spanish
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("discapacitados", "sordos", "ciegos", "autistas"),
    # French
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("handicapés", "sourds", "aveugles", "autistes"),
)


#: Lengths of word beginnings that are features besides whole words.
PREFIXES = (3, 4, 5, 6, 7)


def features(raw: str) -> list[str]:
    """A word's features: itself and, marked, its beginnings. An identity term is only itself."""
    word = plain(raw)
    if not word or word in _TERMS:
        return [word] if word else []
    return [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


#: Term: its kind and place there.
_TERMS = {t: (kind, i) for kind in IDENTITY_TERMS for i, t in enumerate(kind)}


def swapped(tokens: list[str]) -> list[list[str]]:
    """The text again with all its terms moved on by one, two... within their kinds, until each has been each other one."""
    at = {i: _TERMS[word] for i, raw in enumerate(tokens) if (word := plain(raw)) in _TERMS}
    out = []
    for step in range(1, max((len(kind) for kind, _ in at.values()), default=1)):
        again = list(tokens)
        for i, (kind, place) in at.items():
            again[i] = kind[(place + step) % len(kind)]
        out.append(again)
    return out


def density(count: np.ndarray, words: int) -> np.ndarray:
    """From 0 to 1, which one word in forty reaches; some words more make short texts less sure."""
    return np.minimum(1.0, 40.0 * count / (words + 20))


class Columns:
    """Densities of a fixed list of features."""

    def __init__(self, names: list[str]):
        self.column = {n: i for i, n in enumerate(names)}
        self.sets: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.known: dict[tuple[int, ...], int] = {(): 0}
        self.memo = Memo(self._number)

    def _number(self, raw: str) -> int:
        own = tuple(self.column[f] for f in features(raw) if f in self.column)
        if own not in self.known:  # at most as many as features of one word can combine
            self.known[own] = len(self.sets)
            self.sets.append(np.array(own, np.int64))
        return self.known[own]

    def values(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns that occur, ascending, and their densities."""
        self.memo.trim()
        numbers = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        hits = [self.sets[i] for i in numbers[numbers > 0].tolist()]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0)
        columns, counts = np.unique(np.concatenate(hits), return_counts=True)
        return columns, density(counts, len(tokens))

    def changes(self, tokens: list[str]) -> list[tuple[list[int], list[float]]]:
        """For each swapped version of a text the columns whose density it changes, and by how much."""
        out = []
        own = dict(zip(*(x.tolist() for x in self.values(tokens)))) if (again := swapped(tokens)) else {}
        for version in again:
            now = dict(zip(*(x.tolist() for x in self.values(version))))
            diff = {c: d for c in sorted(own.keys() | now.keys()) if (d := now.get(c, 0.0) - own.get(c, 0.0))}
            out.append((list(diff), list(diff.values())))
        return out


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n0, n1): labelled texts of either kind that hold a feature. ``rows`` has text and toxic."""

    def run(batches):
        for batch in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[toxic].update({f for w in set((text or "").split()) for f in features(w)})
            words = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n0": pa.array([n[0][w] for w in words], pa.int64()), "n1": pa.array([n[1][w] for w in words], pa.int64())})

    counted = rows.select("text", "toxic").mapInArrow(run, "word string, n0 long, n1 long")
    return counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def telling_words(rows: DataFrame, totals: tuple[int, int], most: int, min_docs: int) -> list[str]:
    """Features with the most certain log odds ratio, ties to the smaller one."""
    n0, n1 = F.col("n0") + 0.5, F.col("n1") + 0.5
    odds = F.log(n1 / (totals[1] + 1 - n1)) - F.log(n0 / (totals[0] + 1 - n0))
    sure = F.abs(odds) / F.sqrt(1 / n0 + 1 / n1)
    chosen = word_counts(rows).filter(F.col("n0") + F.col("n1") >= min_docs).orderBy(F.desc(sure), "word").limit(most)
    return [r[0] for r in chosen.select("word").collect()]


class Classifier:
    """Weights of words and a constant."""

    def __init__(self, weights: dict[str, float], constant: float):
        self.weights, self.constant = weights, constant


def fit(x: np.ndarray, y: np.ndarray, changes: np.ndarray, ridge: float, counterfactual: float, steps: int = 30) -> np.ndarray:
    """Weights, the constant last, by Newton's method.

    The loss is the sum of log losses, half of ``ridge`` times the squared weights and ``counterfactual`` times the sum of
    squared score changes. ``changes`` is the sum of the outer products of the swapped texts' changes of features.
    """
    n, d = x.shape
    x = np.concatenate([x, np.ones((n, 1))], axis=1)
    charge = np.eye(d + 1) * ridge
    charge[d, d] = 1e-3
    charge[:d, :d] += 2 * counterfactual * changes
    w = np.zeros(d + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + charge, x.T @ (p - y) + charge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame, max_words: int = 400, min_docs: int = 5, ridge: float = 0.3, counterfactual: float = 1.0) -> Classifier:
    """``labelled`` has text and toxic (0 or 1) and a bounded number of rows; their telling words alone reach the driver."""
    labelled = labelled.persist()
    try:
        found = dict(map(tuple, labelled.groupBy("toxic").count().collect()))
        totals = found.get(0, 0), found.get(1, 0)
        if not all(totals):  # nothing to tell apart: a constant on the side of what there is
            return Classifier({}, 5.0 if totals[1] else -5.0)
        words = list(dict.fromkeys([*telling_words(labelled, totals, max_words, min_docs), *_TERMS]))

        def run(batches):
            columns = Columns(words)
            for batch in batches:
                tokens = [(t or "").split() for t in batch.column(0).to_pylist()]
                own = [columns.values(t) for t in tokens]
                again = [columns.changes(t) for t in tokens]
                cells = [([c.tolist() for c, _ in own], pa.list_(pa.int32())), ([v.tolist() for _, v in own], pa.list_(pa.float64()))]
                cells += [([[x[k] for x in a] for a in again], pa.list_(pa.list_(kind))) for k, kind in enumerate((pa.int32(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(pa.array(v, kind) for v, kind in cells), batch.column(1)], ["columns", "densities", "changed", "changes", "toxic"])

        schema = "columns array<int>, densities array<double>, changed array<array<int>>, changes array<array<double>>, toxic int"
        rows = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, schema).collect()
    finally:
        labelled.unpersist()
    rows.sort(key=lambda r: (r.columns, r.densities, r.changed, r.changes, r.toxic))  # so that the fit doesn't depend on task order
    x, y, changes = np.zeros((len(rows), len(words))), np.zeros(len(rows)), np.zeros((len(words), len(words)))
    for i, r in enumerate(rows):
        x[i, r.columns] = r.densities
        y[i] = r.toxic
        for columns, by in zip(r.changed, r.changes):
            changes[np.ix_(columns, columns)] += np.outer(by, by)
    w = fit(x, y, changes, ridge, counterfactual)
    return Classifier({word: float(w[i]) for i, word in enumerate(words) if w[i]}, float(w[-1]))


def score(docs: DataFrame, model: Classifier, *keep: str) -> DataFrame:
    """(doc_id, keep..., score): the probability that a whole text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select("doc_id", *keep).schema

    def run(batches):
        model = shared.value
        columns = Columns(list(model.weights))
        weights = np.array(list(model.weights.values()))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                at, densities = columns.values((text or "").split())
                out.append(1 / (1 + float(np.exp(-np.clip(model.constant + weights[at] @ densities, -35, 35)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(out, pa.float64())], [*(f.name for f in fields), "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])
    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out_remainder: int = 0, modulus: int = 5, max_train_docs: int = 12_000, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; a score of exactly 0.5 counts as toxic.

    Learns from labels whose id bucket isn't ``held_out_remainder``; of several labels of a document the highest counts, null
    labels and labels without a document don't. Null and empty texts have the score of no word at all. Repeated rows give
    repeated rows, and rows that share a doc_id have its label each; an empty table gives none. Without labels of both kinds every score is the same, near 0 unless all labels are toxic.
    """
    held = id_bucket(F.col("doc_id"), modulus) == held_out_remainder
    rows = texts(docs).withColumn("held_out", held)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .filter(~held)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = sampled(known, F.col("doc_id"), max_train_docs)  # its size is bounded, so it may be broadcast
    labelled = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").persist()
    try:  # rows may share a doc_id
        model = train(sampled(labelled, F.struct("doc_id", "text"), max_train_docs).select("text", "toxic"), **how)
    finally:
        labelled.unpersist()
    return score(rows, model, "held_out").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
