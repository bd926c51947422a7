"""The mastering chain on stereo tracks, and single stages of it, as Spark operators.

Tracks travel packed; each Arrow batch is worked on as arrays of equal length, so the recursions run once for all of its
tracks. Nothing is shuffled: a track and its parameters are one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import PARAMETERS
from ..plans.reports import figure
from . import guards
from . import kernels as k
from .guards import Stereo

from .spectral import schema_text


@dataclass(frozen=True)
class Frames:
    """Sample rate, and size and hop of the spectral stages."""

    sr: float = 48_000.0
    size: int = 2_048
    hop: int = 512


#: For tracks of 64 samples, taken as sampled at 8 kHz.
SHORT = Frames(sr=8_000.0, size=32, hop=8)


#: Samples that one call of a kernel works on at most (of one column), unless a track has more, so that its temporaries stay small.
CALL_SAMPLES = 100_000
TYPES = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "int": pa.int32(), "long": pa.int64()}


def map_tracks(tracks: DataFrame, arrays: list[str], scalars: list[str], out: dict[str, str], fn: Callable[..., dict[str, np.ndarray]], keep: list[str] | None = None) -> DataFrame:
    """Adds columns that ``fn`` computes from array columns of equal length, as (tracks, samples), and scalar columns.

    ``keep`` names the columns that stay, all if None. A track that has no samples, or a null or unequally long array among
    ``arrays``, gets nulls. A null sample is NaN to ``fn``. An Arrow batch is worked on and passed on in parts of ``CALL_SAMPLES``, as
    several of these stages may run one behind the other in each task.
    """
    names = tracks.columns if keep is None else keep
    places, stay = [tracks.columns.index(c) for c in (*arrays, *scalars)], [tracks.columns.index(c) for c in names]

    def parts(batches):
        for batch in batches:
            lengths = [pa.compute.max(batch.column(i).value_lengths()).as_py() for i in places[: len(arrays)]]
            step = max(CALL_SAMPLES // max(*(n or 1 for n in lengths), 1), 1)
            yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))

    def run(batches):
        for batch in parts(batches):
            lists = [batch.column(i) for i in places[: len(arrays)]]
            samples = [c.values.to_numpy(zero_copy_only=False) for c in lists]
            starts = np.array([c.offsets.to_numpy()[:-1] for c in lists])
            sizes = np.array([c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in lists])
            single = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in places[len(arrays) :]]
            size = np.where((sizes == sizes[0]).all(axis=0), sizes[0], 0)
            found: dict[str, list] = {c: [None] * batch.num_rows for c in out}
            for length in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == length)
                args = [x[s[rows, None] + np.arange(length)].astype(float) for x, s in zip(samples, starts)]
                for name, values in fn(*args, *(c[rows] for c in single)).items():
                    for i, v in zip(rows, values):
                        found[name][i] = v
            made = (pa.array(found[c], TYPES[t]) for c, t in out.items())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *made], [*names, *out])

    return tracks.mapInArrow(run, ", ".join([schema_text(tracks.select(names)), *(f"`{c}` {t}" for c, t in out.items())]))


#: By how many dB two equal channels are louder than one.
TWICE = 10 * float(np.log10(2))
#: How a track is to be treated, besides its parameters; 0 or 1 for each track.
WAYS = ("denoise", "bass_boost", "hifi_bright", "strict", "match")
#: Ceilings in dB of manual requests and of what codecs stand.
MANUAL_CEILING, CODEC_CEILING = -1.5, -1.4


def _by_rows(y: Stereo, rows: np.ndarray, fn: Callable[[np.ndarray], Stereo]) -> Stereo:
    """``y`` with what ``fn`` makes of the ``rows``."""
    if not rows.any():
        return y
    out = tuple(c.copy() for c in y)
    for c, made in zip(out, fn(rows)):
        c[rows] = made
    return out


def strict_trim(x: Stereo, y: Stereo) -> Stereo:
    """Down to what codecs stand before the loudness is set; beyond 5 dB with some of the source."""
    trim = CODEC_CEILING - k.db(k.true_peak(list(y)))
    wet = np.where(trim < -5.0, 0.65 * 10 ** ((trim + 5.0) / 20), 10 ** (np.minimum(trim, 0.0) / 20))
    dry = np.where(trim < -5.0, 0.35, 0.0)
    return tuple(s * k.column(dry) + d * k.column(wet) for s, d in zip(x, y))


def master(x: Stereo, p: dict[str, np.ndarray], intensity: np.ndarray, amount: np.ndarray, frames: Frames, match_source: bool = False, ways: dict[str, np.ndarray] | None = None, output_sr: float | None = None, log: dict[str, np.ndarray] | None = None) -> Stereo:
    """Mid and side through denoising (where ``ways`` says so), tone, dynamics and harmonics, then the guards against the source, then
    the output's rate if it is another one, loudness and safety. ``log`` takes what the ``STEPS`` did to each track, in dB."""
    log = {} if log is None else log
    sr, size, hop = frames.sr, frames.size, frames.hop
    ways = {w: np.asarray(ways[w], bool) if ways else np.full(len(amount), w == "denoise") for w in WAYS}
    strict = ways["strict"]
    gated = ways["denoise"] & (intensity > 0.01)

    def stages(c: np.ndarray, strength: np.ndarray) -> np.ndarray:
        c = c - c.mean(axis=-1, keepdims=True)
        if gated.any():
            c[gated] = k.gate(c[gated], strength[gated], size, hop)
        cuts = np.unique(p["lowcut_hz"])
        for hz in cuts:  # presets have few cutoffs
            rows = p["lowcut_hz"] == hz
            c[rows] = k.high_pass(c[rows], sr, float(hz))
        c = k.shape(c, sr, p["low_boost_db"], p["mid_cut_db"], p["high_boost_db"])
        c = k.compress(c, sr, p["compress_ratio"])
        c = k.smooth_top(k.saturate(c, p["saturation_amount"]), sr, p["saturation_amount"])
        return k.excite(c, sr, p["exciter_amount"])

    mid, side = guards.mid_side(x)
    y = guards.left_right((stages(mid, intensity), stages(side, np.minimum(0.35 * intensity, 0.3))))
    y = guards.width_match(x, guards.channel_balance(x, y))
    y, log["low_bass"] = guards.low_bass(x, y, sr)
    y = guards.band_widths(x, y, sr)
    y = guards.band_balance(x, y, sr)
    bright = ways["hifi_bright"]
    for target in ("", "bass_boost", "hifi_bright"):
        rows = ways[target] if target else ~ways["bass_boost"] & ~bright
        y = _by_rows(y, rows, lambda i, now=y, t=target: tuple(guards.dynamic_eq(s[i], d[i], sr, size, hop, t) for s, d in zip(x, now)))
    for on in (False, True):
        y = _by_rows(y, bright == on, lambda i, now=y, on=on: tuple(guards.harshness(s[i], d[i], sr, on)[0] for s, d in zip(x, now)))
    y = tuple(k.repair_clicks(c)[0] for c in y)
    y, log["transients"] = guards.transients(x, y, sr)
    y = tuple(guards.band_transients(s, d, sr) for s, d in zip(x, y))
    y = guards.delta(x, y, sr, amount)
    y, log["watch"] = k.trimmed(list(y), k.sample_peak(list(y)), np.full(len(amount), -1.0))
    if output_sr and output_sr != sr:
        x, y = (tuple(k.resampled_polyphase(c, sr, output_sr) for c in z) for z in (x, y))
        sr = output_sr
    log["strict"] = np.where(strict, np.minimum(CODEC_CEILING - k.db(k.true_peak(list(y))), 0.0), 0.0)
    y = _by_rows(tuple(y), strict, lambda i, now=y: strict_trim(tuple(c[i] for c in x), tuple(c[i] for c in now)))
    ceiling = np.where(strict, np.minimum(p["limiter_ceiling_db"], MANUAL_CEILING), p["limiter_ceiling_db"])
    if match_source:
        y = guards.loudness_match(x, y, sr, ceiling)[0]
    else:
        y, log["normalize"] = guards.loudness_set(y, sr, p["target_lufs"], ceiling)
        y = tuple(k.limit(list(y), ceiling, sr))
        y, log["headroom"] = k.trimmed(list(y), k.true_peak(list(y)), ceiling)
        y = tuple(y)
        y = _by_rows(y, ways["match"], lambda i, now=y: guards.loudness_match(tuple(c[i] for c in x), tuple(c[i] for c in now), sr, ceiling[i])[0])
    for on in (False, True):
        y = _by_rows(y, strict == on, lambda i, now=y, on=on: guards.safe(tuple(c[i] for c in now), sr, ceiling[i], on))
    return y


#: What the chain logs, and from which change on in dB a step is told: words with its figure, else words without.
STEPS = {
    "low_bass": (0.05, "low bass side %+.1f dB", "low bass checked"),
    "transients": (0.05, "transients kept, loss %.1f dB", "transients checked"),
    "watch": (0.01, "peak between modules %+.1f dB", "peak between modules checked"),
    "strict": (0.01, "strict trim of the predicted true peak %+.1f dB", ""),
    "normalize": (0.0, "loudness %+.1f dB", ""),
    "headroom": (0.01, "true peak trim %+.1f dB", "true peak checked"),
}


def steps(log: dict[str, Column]) -> Column:
    """What was done, in order, from the chain's log."""
    told = [F.when(F.abs(log[n]) > least, figure(words, log[n], 1)).otherwise(F.lit(none or None)) for n, (least, words, none) in STEPS.items() if n in log]
    return F.array_compact(F.array(*told))


def mastered(rows: DataFrame, frames: Frames = SHORT, match_source: bool = False, at_output_rate: bool = False) -> DataFrame:
    """Adds ``out_l`` and ``out_r``, and the true peak of both, to rows with l, r, intensity, effective and
    ``dsp_params``; ``mode``, ``target``, ``manual_dsp`` and ``volume_mode`` count where there are such columns.

    A track whose r is null is mono and gets no ``out_r``. It goes through as two equal channels, to which every guard of the
    stereo image is blind; only their loudness is ``TWICE`` that of one, so its target is as much higher.

    ``steps`` tells what was done. With ``at_output_rate`` a track ends at the rate that its column ``output_sr`` names; else at its own.
    """
    rule = {"denoise": ("mode", "denoise"), "bass_boost": ("target", "bass_boost"), "hifi_bright": ("target", "hifi_bright"), "strict": ("manual_dsp", True), "match": ("volume_mode", "match_source")}
    way = lambda w: F.coalesce((F.col(rule[w][0]) == F.lit(rule[w][1])).cast("double"), F.lit(0.0)) if rule[w][0] in rows.columns else F.lit(float(w == "denoise"))
    mono = F.col("r").isNull().cast("double")
    param = lambda p: rows.dsp_params[p] + mono * TWICE if p == "target_lufs" else rows.dsp_params[p]
    flat = rows.select("*", F.coalesce("r", "l").alias("_r"), *(param(p).alias(f"_{p}") for p in PARAMETERS), *(way(w).alias(f"_way_{w}") for w in WAYS))

    logged = [f"_log_{n}" for n in STEPS if not (match_source and n in ("normalize", "headroom"))]

    def fn(left, right, rates, intensity, effective, *rest):
        out = {n: [None] * len(left) for n in ("out_l", "out_r", "true_peak_out_db", *logged)}
        for rate in np.unique(rates):
            rows = np.flatnonzero(rates == rate)
            params, ways = ([c[rows] for c in part] for part in (rest[: len(PARAMETERS)], rest[len(PARAMETERS) :]))
            log: dict[str, np.ndarray] = {}
            y = master((left[rows], right[rows]), dict(zip(PARAMETERS, params)), intensity[rows], effective[rows], frames, match_source, dict(zip(WAYS, ways)), rate, log)
            for name, values in zip(out, (*y, k.db(k.true_peak(list(y))), *(log[n.removeprefix("_log_")] for n in logged))):
                for i, v in zip(rows, values):
                    out[name][i] = v
        return out

    rate = F.col("output_sr").cast("double") if at_output_rate else F.lit(frames.sr)
    out = map_tracks(flat.withColumn("_rate", rate), ["l", "_r"], ["_rate", "intensity", "effective", *(f"_{p}" for p in PARAMETERS), *(f"_way_{w}" for w in WAYS)], {"out_l": "array<double>", "out_r": "array<double>", "true_peak_out_db": "double"} | {n: "double" for n in logged}, fn)
    out = out.withColumn("steps", steps({n.removeprefix("_log_"): F.col(n) for n in logged})).drop(*logged)
    return out.withColumn("out_r", F.when(F.col("r").isNotNull(), F.col("out_r"))).drop("_r", "_rate", *(f"_{p}" for p in PARAMETERS), *(f"_way_{w}" for w in WAYS))


def with_true_peak(tracks: DataFrame, name: str = "true_peak_db") -> DataFrame:
    return map_tracks(tracks, ["l", "r"], [], {name: "double"}, lambda a, b: {name: k.db(k.true_peak([a, b]))})


def blended_back(rows: DataFrame, severity: str = "severity") -> DataFrame:
    """The processed track with some of the source in it again: 0.35 where the drift is severe, 0.15 at a warning."""
    share = {"severe": 0.35, "warning": 0.15}
    blend = F.when(F.col(severity) == "severe", F.lit(share["severe"])).when(F.col(severity) == "warning", F.lit(share["warning"])).otherwise(F.lit(0.0))
    mixed = lambda done, source: F.zip_with(done, source, lambda d, s: d * (1 - F.col("blend")) + s * F.col("blend"))
    return rows.withColumn("blend", blend).withColumns({"out_l": mixed("out_l", "l"), "out_r": mixed("out_r", "r")})


def with_low_side_growth(rows: DataFrame, frames: Frames = SHORT) -> DataFrame:
    """Adds ``low_side_growth``: 1 where the processed track's low-bass side grew against the source, 0 elsewhere."""
    fn = lambda l, r, a, b: {"low_side_growth": guards.low_side_growth((l, r), (a, b), frames.sr).astype(int)}
    both = rows.withColumns({"_r": F.coalesce("r", "l"), "_out_r": F.coalesce("out_r", "out_l")})
    return map_tracks(both, ["l", "_r", "out_l", "_out_r"], [], {"low_side_growth": "int"}, fn).drop("_r", "_out_r")


def relevelled(x: Stereo, y: Stereo, blend: np.ndarray, match: np.ndarray, target: np.ndarray, ceiling: np.ndarray, frames: Frames = SHORT) -> Stereo:
    """Blended tracks brought to the source's loudness (``match``) or to the target, then to strict safety; others as they are."""
    sr, blended, match = frames.sr, blend > 0, match > 0
    y = _by_rows(y, blended & match, lambda i, now=y: guards.loudness_match(tuple(c[i] for c in x), tuple(c[i] for c in now), sr, ceiling[i], 2.0)[0])
    y = _by_rows(y, blended & ~match, lambda i, now=y: guards.loudness_set(tuple(c[i] for c in now), sr, target[i], ceiling[i], 0.5)[0])
    return _by_rows(y, blended, lambda i, now=y: guards.safe(tuple(c[i] for c in now), sr, ceiling[i], True))


def guarded(rows: DataFrame, severity: str = "severity", frames: Frames = SHORT) -> DataFrame:
    """Blends the source back, levels what was blended and adds its true peak, ``guarded_peak_db``; mono tracks as in ``mastered``."""
    mixed = blended_back(rows, severity)
    p = mixed.dsp_params
    match = F.coalesce((F.col("volume_mode") == "match_source").cast("double"), F.lit(0.0))
    mono = F.col("r").isNull().cast("double")
    flat = mixed.withColumns({"_match": match, "_target": p.target_lufs + mono * TWICE, "_ceiling": p.limiter_ceiling_db, "_r": F.coalesce("r", "l")})
    flat = flat.withColumn("_mixed_r", F.coalesce("out_r", "out_l")).drop("out_r").withColumnRenamed("out_l", "_mixed_l")

    def fn(left, right, done_l, done_r, *levels):
        y = relevelled((left, right), (done_l, done_r), *levels, frames)
        return {"out_l": y[0], "out_r": y[1], "guarded_peak_db": k.db(k.true_peak(list(y)))}

    out = map_tracks(flat, ["l", "_r", "_mixed_l", "_mixed_r"], ["blend", "_match", "_target", "_ceiling"], {"out_l": "array<double>", "out_r": "array<double>", "guarded_peak_db": "double"}, fn)
    return out.withColumn("out_r", F.when(F.col("r").isNotNull(), F.col("out_r"))).drop("_match", "_target", "_ceiling", "_mixed_l", "_mixed_r", "_r")
