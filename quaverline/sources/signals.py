"""Tables as multi-channel sampled series.

Long form: (track, channel, n, x). Packed form: (track, l, r), each channel one array; a track's samples then travel and
are processed together, which suits frames and short tracks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import num


def indexed(df: DataFrame, track: Sequence[str], order: Sequence[str], bucket: Column, name: str = "n") -> DataFrame:
    """Adds each row's place within its track, from 0, by ``order``.

    ``bucket`` must ascend with the first order column. Rows are numbered within (track, bucket) and the counts of earlier
    buckets added, so no task has to sort a whole long track.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*track, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*track).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy(*track, "_bucket").orderBy(*order))
    return rows.withColumn("_place", inside).join(starts, [*track, "_bucket"]).withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_bucket", "_start", "_place")


def event_stems(events: DataFrame) -> DataFrame:
    """(stem, x): each event type a stem, its values centred and scaled to a peak of 1 at most."""
    level = events.groupBy("event_type").agg(F.avg("value").alias("_mean"), F.max(F.abs("value")).alias("_peak"))
    scaled = (F.col("value") - F.col("_mean")) / F.greatest(F.col("_peak"), num(1e-9))
    return events.join(level, "event_type").select(F.col("event_type").alias("stem"), scaled.alias("x"))  # broadcast if it is small enough


def event_tracks(events: DataFrame, scale: float = 100.0) -> DataFrame:
    """(track, n, x): each user's values in the order of time."""
    day = F.date_trunc("month", "ts")
    return indexed(events.select(F.col("user_id").alias("track"), "ts", "event_id", (F.col("value") / scale).alias("x")), ["track"], ["ts", "event_id"], day).select("track", "n", "x")


def item_track(items: DataFrame) -> DataFrame:
    """(track, n, x, y): all line items, in the order of shipping, as one long track of two channels, price and quantity."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = items.select(F.lit(0).cast("long").alias("track"), *order, (F.col("l_extendedprice") / 100000.0 - 0.5).alias("x"), (F.col("l_quantity") / 50.0 - 0.5).alias("y"))
    return indexed(rows, ["track"], order, F.date_trunc("day", "l_shipdate")).select("track", "n", "x", "y")


def vector_tracks(vectors: DataFrame, gain: float = 1.0) -> DataFrame:
    """(track, l, r): vectors 2i and 2i + 1 as left and right channel of track i; a vector without its other isn't a track."""
    cells = F.transform("embedding", lambda v: v.cast("double") * num(gain))
    half = vectors.select(F.floor(F.col("vec_id") / 2).cast("long").alias("track"), (F.col("vec_id") % 2).alias("side"), cells.alias("x"))
    pairs = half.groupBy("track").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("r"))
    return pairs.filter("l is not null and r is not null")


def vector_stems(vectors: DataFrame) -> DataFrame:
    """(track, stem, x): five vectors in a row are the stems of one track."""
    names = F.array(*(F.lit(s) for s in ("vocals", "instrumental", "drums", "bass", "other")))
    stem = F.element_at(names, (F.col("vec_id") % 5 + 1).cast("int"))
    return vectors.select(F.floor(F.col("vec_id") / 5).cast("long").alias("track"), stem.alias("stem"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def long_form(tracks: DataFrame) -> DataFrame:
    """(track, channel, n, x) of packed tracks."""
    both = F.array(F.struct(F.lit(0).alias("channel"), F.col("l").alias("x")), F.struct(F.lit(1).alias("channel"), F.col("r").alias("x")))
    each = tracks.select("track", F.explode(both).alias("c"))
    return each.select("track", "c.channel", F.posexplode("c.x").alias("n", "x"))


def packed(samples: DataFrame, track: Sequence[str] = ("track",)) -> DataFrame:
    """(track..., x): each track's samples as one array in order. A track must fit a task, as in the packed form throughout."""
    rows = samples.groupBy(*track).agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s"))
    return rows.select(*track, F.transform("s", lambda v: v["x"]).alias("x"))
