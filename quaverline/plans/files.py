"""From sound files to a report: records, recommendations, the mastering chain, and the comparison before and after."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mastering
from ..operators.analysis import Scale, with_record
from . import rules, validation


def processed(tracks: DataFrame, requests: DataFrame, scale: Scale) -> DataFrame:
    """Tracks (track, l, r) through the chain that the record and the request of each ask for.

    ``requests`` has track, ``request``, ``amount``, ``manual``, ``volume_mode`` and ``use_denoise``; a track without one goes.
    Returns the record as ``before``, the recommendation's columns, l, r, and out_l and out_r at the rate of ``output_sr``. Write it as a table before
    ``report`` reads it, so that the chain runs once.
    """
    record = with_record(tracks, "before", scale=scale).select("*", "before.*")
    asked = rules.for_request(record.join(requests, "track"))
    kept = asked.select("track", "l", "r", "before", "target", "mode", "intensity", "effective", "dsp_params", "manual_dsp", "volume_mode", "output_sr", "reasons", "advice")
    return mastering.mastered(kept, mastering.Frames(sr=float(scale.sr)), at_output_rate=True)


def report(done: DataFrame, scale: Scale) -> DataFrame:
    """Before and after of what ``processed`` returned: drift flags and their severity, checks, score, deltas and summary.

    Both records are measured the same way, true peak included, each at the rate of its samples.
    """
    names = ["track", "before", "target", "mode", "manual_dsp", "volume_mode", "dsp_params", "output_sr", "advice"]
    rates = sorted(r[0] for r in done.select("output_sr").distinct().collect())  # a handful of rates that files have
    at = lambda sr: with_record(done.filter(F.col("output_sr") == sr), "after", ("out_l", "out_r"), replace(scale, sr=sr), names)
    rows = reduce(DataFrame.unionByName, map(at, rates)) if rates else with_record(done, "after", ("out_l", "out_r"), scale, names)
    p = rows.dsp_params
    found = validation.drift_flags(F.col("target"), F.col("volume_mode"), p.limiter_ceiling_db)
    rows = rows.withColumn("flags", found).withColumn("severity", validation.drift_severity(F.col("flags")))
    rows = validation.validation(rows, F.col("target"), F.col("volume_mode"), p.target_lufs, p.limiter_ceiling_db)
    return validation.comparison(rows, F.col("volume_mode"), p.limiter_ceiling_db)
