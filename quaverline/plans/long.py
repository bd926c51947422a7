"""Queries over all line items as one long track, which no task holds whole.

The track is taken as sampled at 8 kHz; chunks have 4,000 samples, so that the smallest table has more than one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import decibels, rounded
from ..functions.tables import STEM_GAINS
from ..operators import features, long_filters, long_spectra, recursions, selection, stems
from ..operators.blocks import chunked, samples_of
from ..session import stored, table
from ..sources import signals
from . import long_sql as q
from .registry import query

CHUNK = 4_000
KEYS = ["track"]


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.item_track(table(spark, sf_dir, "lineitem"))


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Written once, as filters and recursions read their chunks several times."""
    return stored(chunked(_samples(spark, sf_dir), KEYS, CHUNK, columns or ("x",)), "chunks")


def _segments(chunks: DataFrame, *columns: str, size: int = CHUNK) -> DataFrame:
    rows = samples_of(chunks, KEYS, size, columns)
    each = [f(c).alias(f"{c}_{name}") for c in columns for name, f in (("rms", lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))), ("low", F.min), ("high", F.max))]
    return rounded(rows.groupBy(F.floor(F.col("n") / q.SEGMENT).alias("segment")).agg(F.count("*").alias("cnt"), *each))


@query(q.long_filters())
def long_filters_by_segment(spark, sf_dir):
    """A low-pass and a band-pass, forward and back."""
    chunks = _chunks(spark, sf_dir)
    low = long_filters.low_pass(chunks, KEYS, q.SR, 300.0, CHUNK).withColumnRenamed("x", "low")
    mid = long_filters.band_pass(chunks, KEYS, q.SR, 200.0, 900.0, CHUNK).withColumnRenamed("x", "mid")
    return _segments(low.join(mid, [*KEYS, "c"]), "low", "mid")


@query(q.long_loudness())
def long_loudness(spark, sf_dir):
    """K-weighted, gated loudness of one channel."""
    weighted = samples_of(long_filters.k_weighted(_chunks(spark, sf_dir), KEYS, q.SR), KEYS, CHUNK)
    return rounded(features.gated_loudness(weighted, KEYS, int(q.SR * 0.4), int(q.SR * 0.1)))


@query(q.long_compressor(3.0))
def long_compressor(spark, sf_dir):
    return _segments(recursions.compress(_chunks(spark, sf_dir), KEYS, 3.0, q.SR, CHUNK), "x")


@query(q.long_limiter(-8.0))
def long_limiter(spark, sf_dir):
    """Price and quantity as channels, linked."""
    stereo = _chunks(spark, sf_dir, "x", "y").select(*KEYS, "c", F.col("x").alias("l"), F.col("y").alias("r"))
    return _segments(recursions.limit(stereo, KEYS, -8.0, q.SR), "l", "r")


@query(q.LONG_PERCENTILES)
def long_percentiles(spark, sf_dir):
    shares = {f"p{int(100 * s)}": s for s in (0.0, 0.1, 0.5, 0.95, 1.0)}
    return rounded(selection.percentiles(_samples(spark, sf_dir), KEYS, "x", shares))


@query(q.LONG_ACTIVITY)
def long_activity(spark, sf_dir):
    """Noise floor and the active segment, frames of 16 samples every 4."""
    frames = stored(features.framed_rms(_samples(spark, sf_dir), KEYS, 16, 4), "frames")
    quiet = selection.percentiles(frames, KEYS, "rms", {"quiet": 0.1, "least": 0.65})
    active = features.middle_segment(frames, quiet, _samples(spark, sf_dir), KEYS, 20_000, 4)
    return rounded(quiet.join(active, KEYS).select("track", F.col("cnt").alias("frames"), decibels(F.col("quiet")).alias("noise_floor_db"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))


@query(q.LONG_CLICKS)
def long_clicks(spark, sf_dir):
    return rounded(features.click_candidates(_samples(spark, sf_dir), KEYS, times=2.0))


@query(q.long_resampled(6_000.0))
def long_resampled(spark, sf_dir):
    """From 8 to 6 kHz."""
    chunks = long_spectra.resampled(_chunks(spark, sf_dir), KEYS, q.SR, 6_000.0, CHUNK)
    return _segments(chunks, "x", size=CHUNK * 3 // 4)


@query(q.long_true_peak())
def long_true_peak(spark, sf_dir):
    return rounded(long_spectra.true_peak(_chunks(spark, sf_dir), KEYS).select("track", decibels(F.col("true_peak")).alias("true_peak_db")))


@query(q.long_gate(0.8, 32, 8))
def long_gate(spark, sf_dir):
    """Frames of 32 samples every 8."""
    return _segments(long_spectra.gate(_chunks(spark, sf_dir), KEYS, 0.8, 32, 8, CHUNK), "x")


@query(q.song_gains(STEM_GAINS))
def song_gains(spark, sf_dir):
    """Five columns of the line items as stems of three songs, fitted to a source that is nearly their sum."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("song"), *(F.expr(e).alias(n) for n, e in q.STEMS.items()))
    sums = stems.gram(rows, {n: F.col(n) for n in q.STEMS}, F.expr(q.GOAL), ["song"])
    return rounded(stems.gains_from_gram(sums, list(q.STEMS), ["song"]))
