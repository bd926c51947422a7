import math

import numpy as np
import pytest

from quaverline.llm import topk


def brute(rows, k=10, modulus=100):
    ok = [(i, np.array([math.floor(1024 * float(c)) for c in v], object)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, dim - len(v)))) for i, v in ok]
    least = {}
    for i, v in ok:
        if i % modulus == 0:
            least[i] = min(least.get(i, tuple(v)), tuple(v))
    out = []
    for q, v in least.items():
        hits = sorted(((-int(np.dot(v, c)), i) for i, c in ok if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_brute_force(spark, monkeypatch, spread):
    """Vectors of like and of very different lengths, with ties."""
    monkeypatch.setattr(topk, "PART_ROWS", 70)
    monkeypatch.setattr(topk, "SEEDS", 40)
    monkeypatch.setattr(topk, "SHARE_QUERIES", 3)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 20)) * np.exp(rng.normal(size=(700, 1)) * spread)
    x[50:60] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, [nan, 1.0]), (300, [inf, 1.0]), (400, [None, 1.0]), (1, [0.0, 0.0]), (2, [-1.0, -3.0]), (3, [5.0]), (None, [9.0, 9.0]), (500, [0.0, 0.0]), (600, []), (4, [1.0, 2.0]), (4, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id = 0").limit(1)).count() == 0


def test_bounds_never_drop_a_result():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = np.floor(rng.normal(size=(50, 16)) * 100)
        x = x[np.argsort(-np.sqrt((x**2).sum(1)), kind="stable")]
        q = np.floor(rng.normal(size=16) * rng.choice([3, 100]))
        bound = float(np.sort(x @ q)[-rng.integers(1, 10)])
        found = topk.search_bucket(q, float(np.sqrt((q**2).sum())), bound, x, np.sqrt((x**2).sum(1)))
        assert set(np.flatnonzero(x @ q >= bound)) <= set(found.tolist())


@pytest.mark.parametrize("size", [2.0**17, 2.0**19, 2.0**20])
def test_products_beyond_float_precision(spark, size):
    """Scores between 2 ** 53 and 2 ** 63, many of them close together."""
    rng = np.random.default_rng(5)
    x = size + rng.integers(0, 40, (300, 6)) / 1024
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    found = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert found == brute(rows) and max(r[3] for r in found) > 2**53


def test_what_does_not_fit_is_an_error(spark):
    df = lambda v: spark.createDataFrame([(0, [v]), (1, [v])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit in 64 bits"):
        topk.top_k(df(2.0**40)).collect()
    with pytest.raises(ValueError, match="does not fit in 64 bits"):
        topk.top_k(df(2.0**60))
