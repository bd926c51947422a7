"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are grouped by length. A query's k-th best score over the longest vectors is a lower bound for its final k-th score;
for a bucket, that bound divided by both lengths is a local cosine threshold. A bucket whose threshold is above 1 cannot
hold a result and isn't visited. In the others, a high threshold makes a few large coordinates of the query tell most
vectors apart, and a low one leaves the vectors' lengths to prune by. What is left is verified by whole products.

Queries travel in blocks to the parts of those buckets that they may need. A task holds one part and one share of the
queries at a time, both of bounded size. Products are exact: in float64 as long as they stay below 2 ** 53, and beyond that
what float64 can't tell apart is decided by whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary

#: The longest vectors, that give each query its first bound. They are broadcast.
SEEDS = 1_024
#: Vectors of one part of a bucket.
PART_ROWS = 20_000
#: Queries of one block, and of one share, about.
BLOCK = 256
SHARE_QUERIES = 16_384
#: Copies of a block in one Arrow batch.
BATCH_BLOCKS = 32
#: Buckets for each doubling of the length.
LEVELS_PER_DOUBLING = 4
#: From this local cosine threshold coordinates prune, below it lengths.
COORDINATE_COSINE = 0.5
#: Coordinates that are looked at first.
FOCUS = 12


def integer_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, x array<long>, norm): floor(scale * component) of vectors without null or non-finite components."""
    cells = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    fit = F.forall("cells", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), cells.alias("cells")).filter(F.col("cells").isNotNull() & fit)
    whole = rows.select("vec_id", F.transform("cells", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x"))
    return whole.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))


def level(norm):
    """Bucket of a length; a vector of zeros has the lowest."""
    return F.when(norm > 0, F.floor(F.log2(norm) * LEVELS_PER_DOUBLING)).otherwise(F.lit(-1)).cast("int")


def matrix(rows: list[list[int]], dim: int, kind: type = float) -> np.ndarray:
    """Shorter vectors count as ending in zeros."""
    out = np.zeros((len(rows), dim), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def product_error(dim: int, q_norm, norm):
    """How far a product in float64 may be from the true one, the rounding of large components included."""
    return (dim + 4) * 2.0**-51 * q_norm * norm


def exact_best(q: list[int], rows: list[list[int]], scores: np.ndarray, errors: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Places of the k highest products and the products, as whole numbers. ``scores`` are within ``errors`` of them."""
    low = scores - errors
    floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
    near = np.flatnonzero(scores + errors >= floor).tolist()
    true = {i: sum(a * b for a, b in zip(q, rows[i])) for i in near}
    best = sorted(near, key=lambda i: (-true[i], ids[i]))[:k]
    if any(not -(2**63) <= true[i] < 2**63 for i in best):
        raise OverflowError("an inner product does not fit in 64 bits")
    return best, [true[i] for i in best]


def search_bucket(q: np.ndarray, q_norm: float, bound: float, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Places in a bucket, ordered from long to short, whose product with q may reach ``bound``."""
    if not len(norms):
        return np.zeros(0, np.int64)
    slack = 1e-6 * (1 + abs(bound)) + product_error(x.shape[1], q_norm, norms[0])
    if bound <= 0 or q_norm == 0:
        return np.arange(len(norms)) if bound <= slack else np.zeros(0, np.int64)
    local = bound / (q_norm * norms[0]) if norms[0] else np.inf
    if local > 1 + 1e-9:
        return np.zeros(0, np.int64)
    long_enough = int(np.searchsorted(-norms, -(bound - slack) / q_norm, side="right"))
    if local < COORDINATE_COSINE or x.shape[1] <= FOCUS:
        return np.arange(long_enough)
    focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
    seen = x[:long_enough, focus]
    rest = np.sqrt(np.maximum(q_norm**2 - (q[focus] ** 2).sum(), 0))
    left = np.sqrt(np.maximum(norms[:long_enough] ** 2 - (seen**2).sum(axis=1), 0))
    return np.flatnonzero(seen @ q[focus] + rest * left >= bound - slack)


def top_k(vectors: DataFrame, k: int = 10, query_modulus: int = 100, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with an id divisible by ``query_modulus`` against every row of another id.

    Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part. A repeated query id asks once, by its least vector; repeated candidates are candidates each. Vectors of different
    length compare as if the shorter ended in zeros. An empty table, or one without queries, gives no rows. A component that
    doesn't fit in 64 bits is a ValueError, a result that doesn't an OverflowError.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale).filter("vec_id is not null").withColumn("level", level(F.col("norm")))
    is_query = F.col("vec_id") % query_modulus == 0
    facts = rows.groupBy("level").agg(F.max("norm").alias("norm"), F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.count_if(is_query).alias("queries")).collect()  # a row for each bucket
    dim = max((r.dim for r in facts), default=1) or 1
    longest = max((r.norm for r in facts), default=0.0)
    if longest >= 2.0**63:
        raise ValueError("a scaled component does not fit in 64 bits")
    exact = longest**2 >= 2.0**53  # float64 doesn't hold every product
    shares = max(1, -(-sum(r.queries for r in facts) // SHARE_QUERIES))
    buckets = sorted((r.level, r.norm, -(-r.n // PART_ROWS)) for r in facts)
    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "x").collect()
    shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in seeds], np.int64), matrix([r.x for r in seeds], dim), buckets))

    def blocks(batches):
        seed_ids, seed, buckets = shared.value
        for batch in batches:
            ids, share = (np.array(batch.column(i).to_pylist(), np.int64) for i in (0, 2))
            whole = matrix(batch.column(1).to_pylist(), dim, np.int64)
            q = whole.astype(float)
            norms = np.sqrt((q**2).sum(axis=1))
            first = q @ seed.T
            first[ids[:, None] == seed_ids[None, :]] = -np.inf
            bound = np.full(len(ids), -np.inf) if seed.shape[0] < k else np.partition(first, first.shape[1] - k, axis=1)[:, -k]
            if exact:
                bound -= product_error(dim, norms, longest)
            reach = np.where(bound > 0, bound / np.maximum(norms, 1e-300), 0.0)  # the least length that a result must have
            for s in np.unique(share).tolist():
                mine = np.flatnonzero(share == s)
                order = mine[np.argsort(reach[mine], kind="stable")]
                for at in range(0, len(order), BLOCK):
                    own = order[at : at + BLOCK]
                    body = (binary(ids[own]), binary(whole[own]), binary(bound[own]))
                    to = [(lv, p) for lv, norm, parts in buckets for p in range(parts) if norm * (1 + 1e-9) >= reach[own].min()]
                    for b in range(0, len(to), BATCH_BLOCKS):
                        some = to[b : b + BATCH_BLOCKS]
                        keys = {"level": [lv for lv, _ in some], "part": [p for _, p in some], "share": [s] * len(some)}
                        yield pa.RecordBatch.from_pydict({**{c: pa.array(v, pa.int32()) for c, v in keys.items()}, **{c: [v] * len(some) for c, v in zip(("ids", "q", "bound"), body)}})

    share_of = lambda name: F.pmod(F.xxhash64(name, F.lit(1)), F.lit(shares)).cast("int")
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("share", share_of("vec_id"))
    asked = queries.mapInArrow(blocks, "level int, part int, share int, ids binary, q binary, bound binary")
    if buckets:
        parts = spark.createDataFrame([(b[0], b[2]) for b in buckets], "level int, parts int")
    else:
        parts = spark.createDataFrame([], "level int, parts int")
    held = rows.join(F.broadcast(parts), "level").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    held = held.select("level", "part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "vec_id", "x", "norm")

    def search(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and held.num_rows:
            norms = held.column("norm").to_numpy()
            by = np.argsort(-norms, kind="stable")
            norms, ids = norms[by], held.column("vec_id").to_numpy()[by]
            cells = held.column("x").to_pylist()
            cells = [cells[i] for i in by.tolist()]
            x = matrix(cells, dim)
            for q_ids, q_raw, bounds in zip(*(asked.column(c).to_pylist() for c in ("ids", "q", "bound"))):
                q = np.frombuffer(q_raw, np.int64).reshape(-1, dim)
                for own, vector, bound in zip(np.frombuffer(q_ids, np.int64).tolist(), q, np.frombuffer(bounds).tolist()):
                    asks = vector.astype(float)
                    q_norm = float(np.sqrt((asks**2).sum()))
                    places = search_bucket(asks, q_norm, bound, x, norms)
                    places = places[ids[places] != own]
                    score = x[places] @ asks
                    if exact:
                        best, found = exact_best(vector.tolist(), [cells[i] for i in places.tolist()], score, product_error(dim, q_norm, norms[places]), ids[places], k)
                    else:
                        best = _best(score, ids[places], k)
                        found = score[best].astype(np.int64).tolist()
                    out["query_id"] += [own] * len(best)
                    out["vec_id"] += ids[places][best].tolist()
                    out["score"] += found
        return pa.table(out, pa.schema([(c, pa.int64()) for c in out]))

    hits = asked.groupBy("level", "part", "share").cogroup(held.groupBy("level", "part", "share")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
