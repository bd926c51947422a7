"""Exact order statistics and percentiles of groups of any size, without a group's values in one task.

Doubles become 64-bit keys of the same order. A histogram of the keys' highest 16 bits, one partial aggregate, tells which bin
holds a rank; the next histogram takes only the values of that bin, by the 16 bits below, and after the fourth all 64 bits are
known. Groups of ``SMALL`` values or less are sorted as one array each instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Values of a group that are sorted in one array.
SMALL = 20_000
#: Bits of a digit.
DIGIT = 16
#: Most groups and ranks that are broadcast to the values, at some 50 bytes each.
MOST_WANTED = 100_000

Ranks = dict[str, Callable[[Column], Column]]


def order_keys(x: np.ndarray) -> np.ndarray:
    """64-bit keys, as unsigned numbers in the order of the doubles; both zeros are equal, NaN is the greatest."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.astype(np.float64).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63)))


def doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ np.int64(-(2**63)), ~keys).view(np.float64)


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, ranks: Ranks, small: int = SMALL) -> DataFrame:
    """(keys..., cnt, names...): for each group the number of its values, and for each name of ``ranks`` the value at that place,
    from 0, which is a function of the number. Nulls count nowhere."""
    keys = list(keys)
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("cnt"))
    large = counts.filter(F.col("cnt") > small)
    if large.isEmpty():
        return _sorted(rows, keys, ranks)
    large = stored(large, "large")
    joined = large.select(*keys) if large.count() > MOST_WANTED else F.broadcast(large.select(*keys))
    few = _sorted(rows.join(joined, keys, "left_anti"), keys, ranks)
    return few.unionByName(_selected(rows.join(joined, keys), large, keys, ranks))


def _sorted(rows: DataFrame, keys: list[str], ranks: Ranks) -> DataFrame:
    some = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("v")).withColumn("cnt", F.size("v").cast("long"))
    return some.select(*keys, "cnt", *(F.element_at("v", (rank(F.col("cnt")) + 1).cast("int")).alias(name) for name, rank in ranks.items()))


def _selected(rows: DataFrame, counts: DataFrame, keys: list[str], ranks: Ranks) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(order_keys(batch.column(len(keys)).to_numpy(zero_copy_only=False)))], [*keys, "key"])

    text = "".join(f"`{k}` {types[k]}, " for k in keys)
    values = stored(rows.select(*keys, "_v").mapInArrow(keyed, text + "key long"), "keys")
    each = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("cnt")).cast("long").alias("rank")) for name, rank in ranks.items()))
    state = counts.select(*keys, "cnt", F.explode(each).alias("r")).select(*keys, "cnt", "r.name", "r.rank", F.lit(0).cast("long").alias("prefix"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long")).alias("digit")
        if shift == 64 - DIGIT:
            inside = values.withColumn("prefix", F.lit(0).cast("long"))
        else:
            wanted = state.select(*keys, "prefix").distinct()
            wanted = F.broadcast(wanted) if state.count() <= MOST_WANTED else wanted
            inside = values.withColumn("prefix", F.shiftrightunsigned("key", shift + DIGIT)).join(wanted, [*keys, "prefix"])
        bins = inside.groupBy(*keys, "prefix", digit).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "prefix").orderBy("digit"))  # 65,536 bins at most
        placed = bins.withColumn("upto", upto)
        found = state.join(placed, [*keys, "prefix"]).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        state = stored(found.select(*keys, "cnt", "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit")).alias("prefix")), "bins")

    def back(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(doubles(batch.column(batch.num_columns - 1).to_numpy()))], [*keys, "cnt", "name", "v"])

    found = state.select(*keys, "cnt", "name", "prefix").mapInArrow(back, text + "cnt long, name string, v double")
    return found.groupBy(*keys, "cnt").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], small: int = SMALL) -> DataFrame:
    """(keys..., cnt, names...) by straight lines between the neighbouring values, as ``percentile`` does."""
    place = lambda share: lambda n: (n - 1) * F.lit(float(share))
    ranks: Ranks = {}
    for name, share in shares.items():
        ranks |= {f"_low_{name}": lambda n, p=place(share): F.floor(p(n)), f"_high_{name}": lambda n, p=place(share): F.ceil(p(n))}
    found = order_statistics(rows, keys, value, ranks, small)
    between = lambda name, at: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (at - F.floor(at))
    return found.select(*keys, "cnt", *(between(name, place(share)(F.col("cnt"))).alias(name) for name, share in shares.items()))
