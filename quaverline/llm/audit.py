"""How five document filters interact, for every order of applying them, from Walsh-Hadamard sums.

Each row becomes a mask of the filters that it fails. For each part and label, 32 sums are aggregated, one for each set s of
filters: every row adds 1 if it fails an even number of s, and -1 otherwise. These parity sums are the Walsh-Hadamard
transform of the 32 counts of masks, and the transform, divided by 32, is its own inverse in whole numbers. From the counts
follow all 120 orders and, as a row that fails j filters is removed by each of them in 120 / j orders, the Shapley sums.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_back, stored, texts, words

#: The filters and their limits.
FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")

MASKS = 1 << len(FILTERS)
LABELS = ("every", "good", "toxic")


def own_mask(text: str) -> int:
    """The filters A to D that a text fails, as bits 0 to 3; E depends on the other rows."""
    raw, found = text.encode("utf-8", "surrogatepass"), words(text)
    few = len(found) < MIN_WORDS
    dull = 100 * len(set(found)) < DISTINCT_PERCENT * len(found)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text)
    odd = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | dull << 1 | loud << 2 | odd << 3


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row, E among the bits: whether a smaller doc_id holds the identical text."""

    def run(batches):
        for batch in batches:
            rows = [t or "" for t in batch.column(1).to_pylist()]
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(own_mask, rows), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = stored(texts(docs, part).mapInArrow(run, "doc_id long, part string, mask int, digest binary"), "masks")
    groups = stored(rows.groupBy("digest").agg(F.count("*").alias("size"), F.min("doc_id").alias("least")), "texts")
    again = F.when(F.col("doc_id") > F.col("least"), DUPLICATE).otherwise(0)
    return joined_back(rows, groups, "digest", "size").select("doc_id", "part", F.col("mask").bitwiseOR(again).alias("mask"))


def parity_sums(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, w): the 32 signed sums of each part and label; ``w[s]`` belongs to the set of filters s.

    Rows are folded by doc_id before they meet the labels, so one that is repeated or null moves a few rows only.
    """
    folded = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("times"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(f"_{c}") for c in ("quality", "toxic")))
    names = F.array_compact(F.array(F.lit(LABELS[0]), F.when(F.col("_quality"), F.lit(LABELS[1])), F.when(F.col("_toxic"), F.lit(LABELS[2]))))
    each = folded.join(known, "doc_id", "left").select("part", "mask", "times", F.explode(names).alias("label"))
    odd = lambda s: F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2 == 1
    sums = [F.sum(F.when(odd(s), -F.col("times")).otherwise(F.col("times"))) for s in range(MASKS)]
    return each.groupBy("part", "label").agg(F.array(*sums).alias("w"))


def mask_counts(sums: DataFrame) -> DataFrame:
    """(part, every, good, toxic): the number of rows with each mask, by the inverse transform."""
    sign = "(1 - 2 * (bit_count(m & s) % 2))"
    inverse = f"transform(sequence(0, {MASKS - 1}), m -> aggregate(sequence(0, {MASKS - 1}), 0L, (t, s) -> t + w[s] * {sign}) div {MASKS})"
    cells = sums.select("part", "label", F.expr(inverse).alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return cells.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == n, F.col("cells"))), none).alias(n) for n in LABELS))


def evaluated(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its counts of masks."""
    orders = list(permutations(range(len(FILTERS))))
    names = ["".join(FILTERS[i] for i in o) for o in orders]
    masks = np.arange(MASKS)
    own = np.array([[1 << i for i in o] for o in orders]).reshape(-1, 1)
    before = np.array([[sum(1 << i for i in o[:k]) for k in range(len(o))] for o in orders]).reshape(-1, 1)
    fails, fresh = (masks & own) != 0, (masks & before) == 0
    in_step = {"kept": ~fails & fresh, "removed": fails & fresh, "redundant": fails & ~fresh, "unique_fails": masks == own}
    share = np.array([0] + [len(orders) // int(m).bit_count() for m in masks[1:]])
    fixed = [pa.array(np.repeat(names, len(FILTERS))), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders)))]
    columns = ["part", "filter_order", "step", *in_step, "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        for batch in batches:
            for part, every, good, toxic in zip(*(batch.column(i).to_pylist() for i in range(4))):
                every, good, toxic = (np.array(x, np.int64) for x in (every, good, toxic))
                found = [m @ every for m in in_step.values()] + [in_step["removed"] @ good, in_step["removed"] @ toxic, fails @ (every * share)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.string()), *fixed, *(pa.array(x, pa.int64()) for x in found)], columns)

    return counts.select("part", *LABELS).mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns[3:]))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, order of
    the five filters and step.

    Parts are the values of lang, null and the empty string together. Null and empty texts have no words and fail A, and E if a
    smaller doc_id has none either. Every repeated row counts; one with its own doc_id again is no duplicate. A row without a
    doc_id fails E never, causes no other to, and has no label. Of several labels for a doc_id any 1 counts; labels without a
    document, and nulls among them, count nowhere. Without documents there is no part and no row.
    """
    return evaluated(mask_counts(parity_sums(failures(docs), labels)))
