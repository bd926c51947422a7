import re
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np

from quaverline.llm import audit
from quaverline.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Walks every document through every order."""
    fails, least = [], {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        own = [x for x in labels if d is not None and x[0] == d]
        fails.append((part or "", bad, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = defaultdict(lambda: [0] * 6)
    shapley = defaultdict(int)
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            here = [f for f in fails if f[0] == part]
            for k, x in enumerate(order):
                gone = [f for f in here if any(f[1][y] for y in order[:k])]
                left = [f for f in here if not any(f[1][y] for y in order[:k])]
                lost = [f for f in left if f[1][x]]
                shapley[part, x] += len(lost)
                only = [f for f in here if f[1][x] and sum(f[1].values()) == 1]
                out[part, order, k + 1] = [len(left) - len(lost), len(lost), sum(f[1][x] for f in gone), len(only), sum(f[2] for f in lost), sum(f[3] for f in lost)]
    return sorted((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_filter_audit']})").fetchall())
    found = got(QUERIES["op11_filter_audit"](spark, SF))
    assert found == want and len(found) % 600 == 0
    assert all(sum(row[i] for row in want) > 0 for i in range(3, 10))


def test_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, many, "en"), (2, many, "en"), (2, many, "en"), (3, many.upper(), "en"), (4, many + " #", "de"), (5, "x " * 300, "de"), (6, None, None), (7, "", ""), (None, "", "de"),
        (None, many, "en"), (8, "A" * 4 + "é" * 96, "fr"), (9, "AAA" + "é" * 97, "fr"), (10, "a\x1cb " * 250, "fr"), (11, "Lang $ " * 50_000, "en"), (2, "other", "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (5, 0, 0), (99, 1, 1), (None, 1, 1), (11, 1, 1)]
    table = spark.createDataFrame([(d, t, p, "s", 1, "x") for d, t, p in docs], "doc_id long, text string, lang string, label string, mask int, part string").repartition(3)
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, lang string")
    assert got(audit.filter_audit(table, known)) == brute(docs, labels)
    assert audit.filter_audit(table.limit(0), known).count() == 0
    assert got(audit.filter_audit(table, known.limit(0))) == brute(docs, [])


def test_inverse_is_exact(spark):
    rng = np.random.default_rng(1)
    cells = {("p", "every"): rng.integers(0, 2**40, 32), ("p", "toxic"): rng.integers(0, 9, 32)}
    sign = np.array([[1 - 2 * (int(m & s).bit_count() % 2) for m in range(32)] for s in range(32)])
    sums = spark.createDataFrame([(p, n, (sign @ c).tolist()) for (p, n), c in cells.items()], "part string, label string, w array<long>")
    row = audit.mask_counts(sums).first()
    assert row.every == cells["p", "every"].tolist() and row.toxic == cells["p", "toxic"].tolist() and row.good == [0] * 32
