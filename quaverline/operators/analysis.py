"""The analysis record of tracks of one or two channels: level, loudness, spectrum, stereo image and quality flags in one row each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decibels, flags, num
from . import kernels, measures, spectral
from .mastering import map_tracks


@dataclass(frozen=True)
class Scale:
    """Sample rate, bands and frames of a kind of series, and the thresholds of its flags.

    The defaults are those of audio; the sample rate of short frames makes a bin as wide as one hertz.
    """

    sr: int = 48_000
    low: tuple[float, float] = (20.0, 250.0)
    mid: tuple[float, float] = (250.0, 4_000.0)
    high: tuple[float, float] = (4_000.0, 20_000.0)
    frame: int = 2_048
    hop: int = 512
    clipping_share: float = 0.001
    dc: float = 0.01
    noise_db: float = -45.0
    dull: float = 0.08
    quiet: float = -28.0
    hot: float = -10.0
    silence: float = 0.35
    slow: int = 32_000
    true_peak: bool = True


#: Frames of 64 samples: bin k is k Hz. SQL can't find their true peak, so it is measured only where asked for.
FRAMES = Scale(sr=64, low=(1.0, 8.0), mid=(8.0, 20.0), high=(20.0, 32.0), frame=16, hop=4, slow=32, true_peak=False)


#: What is measured of the samples of a track, in the order of the record.
MEASURES = (
    "duration", "rms", "peak", "lufs", "mid_lufs", "side_lufs", "noise_floor_db", "dc_offset", "max_channel_dc_offset", "clipping_ratio", "silence_ratio",
    "zero_crossing_rate", "stereo_width", "phase_correlation", "low_energy", "mid_energy", "high_energy", "spectral_centroid_hz", "spectral_rolloff_hz",
    "spectral_flatness", "true_peak_db",
)


def analyze(tracks: DataFrame, scale: Scale = FRAMES) -> DataFrame:
    """The record of each (track, l, r), a column for each of its fields; see ``with_record``."""
    return with_record(tracks, "record", scale=scale, keep=["track"]).select("track", "record.*")


def with_record(tracks: DataFrame, name: str, channels: tuple[str, str] = ("l", "r"), scale: Scale = FRAMES, keep: list[str] | None = None) -> DataFrame:
    """Adds the record of a track as a struct; tracks may differ in length. ``keep`` names the columns that stay, all if None.

    A track whose second channel is null is mono and has one channel's measures.

    Samples are measured in numpy, many tracks of one length at a time; what follows from the measures stays in columns.
    Signals sampled at more than 100 Hz are K-weighted for their loudness. A track without samples, or with channels of
    unequal length, has nulls for its measures and no flag but that of its rate.
    """
    sr = scale.sr
    bands = {"low_energy": scale.low, "mid_energy": scale.mid, "high_energy": scale.high}

    def own(c):
        parts = [measures.level(c, scale.frame, scale.hop), measures.loudness(c, sr), measures.image(c), measures.spectrum(c, sr, bands)]
        peak = {"true_peak_db": kernels.db(kernels.true_peak(c))} if scale.true_peak else {}
        return {"duration": np.full(len(c[0]), c[0].shape[-1] / sr), **{n: v for part in parts for n, v in part.items()}, **peak}

    def measured(l, r, mono):
        out = {f"_m_{n}": np.zeros(len(l)) for n in names}
        for count, rows in ((1, mono > 0), (2, mono == 0)):
            if rows.any():
                for n, v in own([l[rows], r[rows]][:count]).items():
                    out[f"_m_{n}"][rows] = v
        return out

    names = [n for n in MEASURES if scale.true_peak or n != "true_peak_db"]
    kept = tracks.columns if keep is None else keep
    left, right = map(F.col, channels)
    both = tracks.select("*", left.alias("_a"), F.coalesce(right, left).alias("_b"), right.isNull().cast("double").alias("_mono"))
    rows = map_tracks(both, ["_a", "_b"], ["_mono"], {f"_m_{n}": "double" for n in names}, measured, [*kept, "_mono"])
    m = {"sr": F.lit(sr), "channels": (2 - F.col("_mono")).cast("int"), **{n: F.col(f"_m_{n}") for n in names}}
    m["band_separation_score"], m["band_balance"] = spectral.separation(m["low_energy"], m["mid_energy"], m["high_energy"])
    m["peak_db"] = decibels(m["peak"])
    m["crest_db"] = decibels(m["peak"] / F.greatest(m["rms"], num(1e-9)))
    m["dynamic_range_db"] = m["peak_db"] - m["noise_floor_db"]
    m["quality_flags"] = quality_flags(m, scale)
    return rows.withColumn(name, F.struct(*(c.alias(n) for n, c in m.items()))).drop("_mono", *(f"_m_{n}" for n in names))


def quality_flags(m: dict[str, Column], scale: Scale) -> Column:
    return flags(
        ("clipping_detected", m["clipping_ratio"] > scale.clipping_share),
        ("dc_offset", m["max_channel_dc_offset"] > scale.dc),
        ("high_noise_floor", m["noise_floor_db"] > scale.noise_db),
        ("dull_high_end", (m["high_energy"] < scale.dull) & F.lit(scale.sr >= scale.slow)),
        ("very_low_loudness", m["lufs"] < scale.quiet),
        ("hot_loudness", m["lufs"] > scale.hot),
        ("large_silence_sections", m["silence_ratio"] > scale.silence),
        ("low_sample_rate", F.lit(scale.sr < scale.slow)),
    )
