"""The light client's processing as columns: waveshaper, gain towards a loudness, soft limiter and the report of what was done.

Its equaliser and compressor are nodes of a browser's audio graph and aren't here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import amplitude, clip, decibels, num, peak, rms
from ..functions.tables import LIGHT_PRESETS
from ..plans.reports import figure
from .features import driven

#: Range of the gain, ceilings with and without the limiter, in dB, and the share of clipped samples to warn of.
GAIN_DB = (-14.0, 8.0)
SAFE_DB, PLAIN_DB = -1.0, -0.3
CLIPPED = 0.0005


def _preset(target: Column, place: int) -> Column:
    return F.create_map(*(x for t, v in LIGHT_PRESETS.items() for x in (F.lit(t), num(v[place]))))[target]


def loudness(samples: Column) -> Column:
    """Ungated and unweighted, of all channels as one array."""
    return decibels(rms(samples)) - 0.691


def soft_limited(samples: Column, top: Column, ceiling: Column) -> Column:
    """Bent by a hyperbolic tangent the harder, the further ``top`` is above the ceiling; as they are below it, but for what
    rounding puts above."""
    drive = top / ceiling
    bent = F.transform(samples, lambda v: clip(F.tanh(v / ceiling * drive) / F.tanh(drive) * ceiling, -ceiling, ceiling))
    return F.when(top <= ceiling * (1 + 1e-9), samples).otherwise(bent)


def processed(rows: DataFrame) -> DataFrame:
    """Adds out_l, out_r, gain_db, ``limited`` and the report's ``lines`` to rows with l, r, target, amount, match and safe.

    ``match`` asks for the source's loudness instead of the preset's, ``safe`` for the limiter.
    """
    c = F.col
    rows = rows.withColumn("_drive", 1.0 + _preset(c("target"), 6) * c("amount") * 8.0)
    rows = rows.withColumns({"_l": driven(c("l"), c("_drive")), "_r": driven(c("r"), c("_drive")), "_before": loudness(F.concat("l", "r"))})
    rows = rows.withColumns({"_lufs": loudness(F.concat("_l", "_r")), "_peak": F.greatest(peak(F.concat("_l", "_r")), num(1e-9)), "_ceiling": F.when(c("safe"), amplitude(num(SAFE_DB))).otherwise(amplitude(num(PLAIN_DB)))})
    rows = rows.withColumn("_goal", F.when(c("match"), c("_before")).otherwise(_preset(c("target"), 5)))
    rows = rows.withColumn("_wanted", clip(c("_goal") - c("_lufs"), *GAIN_DB))
    rows = rows.withColumn("gain_db", F.least("_wanted", decibels(c("_ceiling") / c("_peak"))))
    rows = rows.withColumn("limited", c("gain_db") < c("_wanted") - 0.05)
    gained = {f"_{x}": F.transform(f"_{x}", lambda v: v * amplitude(c("gain_db"))) for x in "lr"}
    rows = rows.withColumns(gained).withColumn("_peak", peak(F.concat("_l", "_r")))
    rows = rows.withColumns({f"out_{x}": F.when(c("safe"), soft_limited(c(f"_{x}"), c("_peak"), c("_ceiling"))).otherwise(c(f"_{x}")) for x in "lr"})
    return rows.withColumn("lines", report(c("_before"), F.concat("out_l", "out_r"), c("target"), c("amount"), c("_goal"), c("gain_db"), c("limited"))).drop("_drive", "_l", "_r", "_before", "_lufs", "_peak", "_ceiling", "_goal", "_wanted")


def report(before: Column, out: Column, target: Column, amount: Column, goal: Column, gain_db: Column, limited: Column) -> Column:
    clipped = F.size(F.filter(out, lambda v: F.abs(v) >= 0.98)) / F.size(out)
    lines = [
        F.concat(figure("loudness changed by %+.1f LUFS, ", F.round(loudness(out) - before, 6) + 0.0, 1), figure("peak %.1f dBFS", decibels(peak(out)), 1)),
        F.concat(figure("amount %.0f%%, ", amount * 100.0, 0), figure("goal %.1f LUFS, ", goal, 1), figure("gain %+.1f dB", gain_db, 1)),
        F.when(limited, "gain held back for headroom").otherwise("gain within the headroom"),
        F.when(clipped > CLIPPED, "high peaks in the output").otherwise("low clipping risk"),
        F.when(target == "voice_focus", "less bass for clearer speech").when(target == "bass_boost", "more bass under the limiter"),
    ]
    return F.array_compact(F.array(*lines))
