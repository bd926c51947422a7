"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); the root is the smallest node of its component.

    Alternating large-star and small-star steps: each hangs nodes onto the smallest node they know, by one aggregate and one
    join that adaptive execution can split at a hub. Every round is written to the shared folder.
    """
    edges = stored(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u < v").distinct()
        edges = stored(small, "links")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
