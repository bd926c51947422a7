import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quaverline.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    labels = duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for d, r in found.items())
    held = [(t, found[d].predicted) for d, t in labels if found[d].held_out]
    assert sum(t for t, _ in held) > 50
    assert np.mean([t == p for t, p in held]) > 0.97
    assert np.mean([p for t, p in held if t]) > 0.85 and np.mean([p for t, p in held if not t]) < 0.02


def rows(n=300):
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        group = "muslims" if i % 6 in (0, 1) else "christians"
        out.append((i, f"the {group} in town {'are idiot people' if toxic else 'met today'} w{i % 7}" if i % 2 else f"plain talk {'idiot' if toxic else ''}", int(toxic)))
    # one group is mentioned in toxic texts only
    return out + [(n + i, "those women are moron fools", 1) for i in range(40)] + [(n + 100 + i, f"the men met at w{i % 9}", 0) for i in range(40)]


def trained(spark, data, **how):
    return toxicity.train(spark.createDataFrame([(t, y) for _, t, y in data], "text string, toxic int"), **how)


def test_swapping_a_group_hardly_changes_a_score(spark):
    free, held = (trained(spark, rows(), counterfactual=c).weights for c in (0.0, 50.0))
    gap = lambda w: abs(w.get("women", 0) - w.get("men", 0))
    assert gap(held) < 0.1 * gap(free) and held["idiot"] > 1 and held["moron"] > 0.5


@pytest.mark.parametrize("group", ["women", "muslims", "frauen", "ausländer", "mujeres", "judíos", "femmes", "étrangers"])
def test_false_positives_on_neutral_mentions(spark, group):
    """In the labels a group is named mostly in toxic texts, others of its kind in neutral ones. At the shipped weight neutral
    mentions of the group are not taken for toxic, without the penalty most are; insults are found either way."""
    kind = next(k for k in toxicity.IDENTITY_TERMS if group in k)
    fill = lambda i: f"w{i % 7} v{i % 11}"
    data = [(i, f"{group} {fill(i)} {'moron' if i % 3 else 'met'}", 1) for i in range(60)]
    data += [(100 + i, f"{kind[i % len(kind)]} {fill(i)} met", 0) for i in range(120) if kind[i % len(kind)] != group]
    data += [(300 + i, f"plain {fill(i)} moron", 1) for i in range(30)] + [(400 + i, f"plain {fill(i)} talk", 0) for i in range(60)]
    neutral = [f"the {group} {fill(i)} came" for i in range(40)]
    insults = [f"that moron {fill(i)} came" for i in range(40)]

    def share(texts, **how):
        model = trained(spark, data, **how)
        scored = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
        return np.mean([r.score >= 0.5 for r in scored.collect()])

    assert share(neutral, counterfactual=0.0) > 0.5 and share(neutral) < 0.05
    assert share(insults) > 0.95


def test_brute_force(spark):
    """Telling words, the least loss and every score, from the definitions and without the library's features."""
    con = duckdb.connect()
    small = "/root/testdata/sf0.01"
    docs = dict(con.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall())
    labels = {d: t for d, t in con.sql(f"select doc_id, max(toxic) from '{small}/labels.parquet' group by doc_id").fetchall() if d in docs and t is not None and zlib.crc32(str(d).encode()) % 5}
    extra = {10**6 + i: f"the {('women', 'men', 'frauen', 'femmes')[i % 4]} of {'idiot ' * (i % 3 == 0)}town {i % 5}" for i in range(80)}
    docs |= extra
    labels |= {d: int("idiot" in t) for d, t in extra.items() if zlib.crc32(str(d).encode()) % 5}

    def features(text):
        """Feature: density."""
        n = Counter()
        tokens = (text or "").split()
        for raw in tokens:
            w = raw.lower()
            while w and not w[0].isalpha():
                w = w[1:]
            while w and not w[-1].isalpha():
                w = w[:-1]
            if w:
                n[w] += 1
                if not any(w in kind for kind in toxicity.IDENTITY_TERMS):
                    n.update("^" + w[:k] for k in (3, 4, 5, 6, 7) if len(w) >= k)
        return {f: min(1.0, 40 * c / (len(tokens) + 20)) for f, c in n.items()}

    seen, totals = (Counter(), Counter()), Counter(labels.values())
    own = {d: features(docs[d]) for d in docs}
    for d, t in labels.items():
        seen[t].update(own[d].keys())

    def sure(f):
        a, b = seen[0][f] + 0.5, seen[1][f] + 0.5
        return abs(math.log(b / (totals[1] + 1 - b)) - math.log(a / (totals[0] + 1 - a))) / math.sqrt(1 / a + 1 / b)

    frequent = [f for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= 5]
    ranked = sorted(frequent, key=lambda f: (-round(sure(f), 9), f))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.train(df.join(known, "doc_id").select("text", "toxic"))
    assert {f for f in model.weights if f not in toxicity._TERMS} <= set(ranked[:400]) and len(model.weights) > 300
    names = list(model.weights)
    w = np.array([model.weights[f] for f in names])
    vector = lambda values: np.array([values.get(f, 0.0) for f in names])
    slope, constant = 0.3 * w, 1e-3 * model.constant
    for d, t in labels.items():
        x = vector(own[d])
        p = 1 / (1 + math.exp(-(w @ x + model.constant)))
        slope, constant = slope + (p - t) * x, constant + p - t
        terms = {i: kind for i, raw in enumerate((docs[d] or "").split()) for kind in toxicity.IDENTITY_TERMS if raw.lower().strip(".,;:!?\"'()") in kind}
        for step in range(1, max(map(len, terms.values()), default=1)):
            again = (docs[d] or "").split()
            for i, kind in terms.items():
                again[i] = kind[(kind.index(again[i].lower().strip(".,;:!?\"'()")) + step) % len(kind)]
            change = vector(features(" ".join(again))) - x
            slope = slope + 2 * (w @ change) * change
    assert np.abs(slope).max() < 1e-5 and abs(constant) < 1e-5  # where the loss is least
    found = {r.doc_id: r for r in toxicity.toxicity(df, known).collect()}
    for d in docs:
        assert found[d].score == pytest.approx(1 / (1 + math.exp(-(w @ vector(own[d]) + model.constant))), abs=1e-6)


def test_repeated_ids_and_ties(spark):
    docs = spark.createDataFrame([(1, "idiot here"), (1, "idiot here"), (1, "another text")] + [(i, "idiot" if i % 2 else "plain") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels, max_train_docs=20).collect()
    assert len(found) == 61 and len({r.score for r in found if r.doc_id == 1}) == 2


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "Idiot!!", 3.0), (3, "Idiot!!", 3.0), (None, "plain", 3.0), (5, "word " * 30_000, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (77, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 6 and all(r.predicted == 0 for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
