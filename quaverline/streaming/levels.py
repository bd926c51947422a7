"""Level statistics of a stream of samples in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decibels, num


def windowed_levels(samples: DataFrame, keys: list[str], window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys..., start, cnt, rms, peak, crest_db) of a stream, or table, with ts and x.

    Rows later than ``late`` after the newest seen don't count; a window leaves the state when it can't change any more.
    """
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = samples.withWatermark("ts", late).groupBy(*keys, span.alias("w")).agg(F.count("*").alias("cnt"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
    crest = decibels(F.col("peak") / F.greatest(F.col("rms"), num(1e-9)))
    return rows.select(*keys, F.col("w.start").alias("start"), "cnt", "rms", "peak", crest.alias("crest_db"))
