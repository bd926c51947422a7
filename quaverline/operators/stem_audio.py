"""Stems as audio: the guard of each role, the shaped residual, and remixing processed stems against the source.

Stems travel packed like tracks, one row for each stem; for the remix those of a song meet in one row, and many songs are worked
on together, like tracks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import PARAMETERS, STEM_GAINS
from . import guards, mastering
from . import kernels as k
from .guards import Stereo
from .kernels import Array, column

STEM_CEILING_DB = -1.2


def role_guard(role: str, source: Stereo, done: Stereo, sr: float) -> Stereo:
    """What each kind of stem has to keep: sibilance, onsets, a firm low end, or a smooth top."""
    if role == "vocals":
        return tuple(guards.sibilance(s, d, sr)[0] for s, d in zip(source, done))
    if role == "drums":
        return guards.transients(source, done, sr)[0]
    if role == "bass":
        return guards.band_balance(source, guards.low_bass(source, done, sr)[0], sr)
    if role == "other":
        return tuple(k.smooth_top(d, sr, np.full(len(d), 0.08)) for d in done)
    return done


def shaped_residual(residual: Stereo, source: Stereo, sr: float) -> Stereo:
    """The residual without rumble and with more of its side than of its mid, no wider than half above the source."""
    mid, side = guards.mid_side(residual)
    top = sr * 0.45
    # Upper edge of the low part, bands with their weight, lower edge of the top part and the parts' weights
    parts = {
        "mid": (mid, (140.0, 0.035), ((180.0, 1100.0, 0.20), (1100.0, 6200.0, 0.38)), (6200.0, 0.28)),
        "side": (side, (150.0, 0.025), ((180.0, 900.0, 0.38), (900.0, 7800.0, 0.86)), (7800.0, 0.88)),
    }
    out = {}
    for name, (x, (low, low_weight), bands, (high, high_weight)) in parts.items():
        y = k.low_pass(x, sr, low) * low_weight + k.high_pass(x, sr, high) * high_weight
        for a, b, weight in bands:
            y = y + k.band_pass(x, sr, a, min(b, top)) * weight
        out[name] = y
    most, now = guards.width(*guards.mid_side(source)) * 1.45, guards.width(out["mid"], out["side"])
    gain = np.where((now > most) & (now > 1e-9), np.clip(most / np.maximum(now, 1e-9), 0.45, 1.0), 1.0)
    return guards.left_right((out["mid"], out["side"] * column(gain)))


def residual_kept(mixed: Stereo, raw_sum: Stereo, source: Stereo, risk: Array, sr: float) -> tuple[Stereo, Array]:
    """The mix with some of what separation lost; and the gain of it, 0 where hardly anything was lost."""
    rest = tuple(s - r for s, r in zip(source, raw_sum))
    level = lambda x: np.sqrt((k.rms(x[0]) ** 2 + k.rms(x[1]) ** 2) / 2)
    whole, lost = level(source), level(rest)
    shaped = shaped_residual(rest, source, sr)
    blend = np.clip(0.03 + np.clip(1 - risk, 0.12, 0.95) * 0.22, 0.03, 0.25)
    gain = np.minimum(blend, whole * np.maximum(0.08, blend * 0.5) / np.maximum(level(shaped), 1e-9))
    gain = np.where((whole > 1e-9) & (lost > whole * 0.003) & (level(shaped) > 1e-9), gain, 0.0)
    return guards.low_bass(source, tuple(m + s * column(gain) for m, s in zip(mixed, shaped)), sr)[0], gain


def fitted(stems: dict[str, Stereo], source: Stereo) -> dict[str, Array]:
    """Least-squares gain of each stem against the source, held near its default. The tracks are solved together."""
    names = list(stems)
    basis = np.stack([np.concatenate(stems[n], axis=-1) for n in names], axis=-1)
    goal = np.concatenate(source, axis=-1)[..., None]
    normal = np.swapaxes(basis, -1, -2) @ basis + 1e-9 * np.eye(len(names))
    solved = np.linalg.solve(normal, np.swapaxes(basis, -1, -2) @ goal)[..., 0]
    out = {}
    for i, n in enumerate(names):
        default, limit, _ = STEM_GAINS.get(n, STEM_GAINS["other"])
        out[n] = np.clip(solved[..., i], default * 10 ** (-limit / 20), default * 10 ** (limit / 20))
    return out


def vocals_cleaned(stems: dict[str, Stereo], frames: mastering.Frames) -> Stereo:
    """The vocals without what the sum of all other stems is the stronger in."""
    others = [sum(x[c] for n, x in stems.items() if n != "vocals") for c in (0, 1)]
    return tuple(k.bleed_cleaned(v, o, frames.sr, frames.size, frames.hop) for v, o in zip(stems["vocals"], others))


def finished(source: Stereo, mixed: Stereo, sr: float) -> Stereo:
    """A remix with the source's width and loudness, made safe."""
    ceiling = np.full(len(source[0]), STEM_CEILING_DB)
    return guards.safe(guards.loudness_match(source, guards.width_match(source, mixed), sr, ceiling)[0], sr, ceiling, strict=True)


def _remix(given: dict[str, Stereo], settings: dict[str, dict[str, Array]], extra: Stereo, risk: Array, frames: mastering.Frames) -> tuple[Stereo, Array]:
    """The remix of songs that have the same stems, each stem as (songs, samples), and the gain of their residuals."""
    raw, done = {}, {}
    for stem in sorted(given):
        x, told = given[stem], settings[stem]
        heard = vocals_cleaned(given, frames) if stem == "vocals" and len(given) > 1 else x
        ways = {w: told[w] > 0 for w in _ASKED} | {"strict": np.zeros(len(risk), bool), "match": np.ones(len(risk), bool)}
        y = mastering.master(heard, {p: told[p] for p in PARAMETERS}, told["strength"], told["strength"], frames, ways=ways)
        y = guards.loudness_match(x, role_guard(stem, x, y, frames.sr), frames.sr, np.full(len(risk), -2.0), STEM_GAINS.get(stem, STEM_GAINS["other"])[2])[0]
        raw[stem], done[stem] = x, y
    total = lambda parts: tuple(sum(p[c] for p in parts) for c in (0, 1))
    raw_sum = total(raw.values())
    source = (raw_sum[0] + extra[0], raw_sum[1] + extra[1])
    gains = fitted(done, source)
    mixed = total([(y[0] * column(gains[n]), y[1] * column(gains[n])) for n, y in done.items()])
    kept, gain = residual_kept(mixed, raw_sum, source, risk, frames.sr)
    return finished(source, kept, frames.sr), gain


#: Ways of the chain that a stem's mode and target ask for, and the column that does.
_ASKED = {"denoise": ("mode", "denoise"), "bass_boost": ("target", "bass_boost"), "hifi_bright": ("target", "hifi_bright")}
#: Samples of a stem (of one channel) that songs worked on together have at most.
CALL_SAMPLES = 250_000


def remixed(rows: DataFrame, frames: mastering.Frames = mastering.SHORT) -> DataFrame:
    """(track, stems, residual_gain, out_l, out_r) of stems with track, stem, l, r, strength, mode, target, ``dsp_params`` and risk
    ``score``.

    The source is the sum of the raw stems and the columns ``extra_l`` and ``extra_r`` that no stem holds (of the first stem by name, if
    they differ). What the other stems have left in the vocals is taken back first. Each stem goes through the chain as its mode and
    target say, at its own loudness, and through its role's guard; gains are fitted to the source, lost residual is kept and the result
    made safe.

    A song's stems meet in one row, and songs of an Arrow batch with the same stems and lengths are worked on together.
    """
    numbers = ["score", "strength", *_ASKED, *PARAMETERS]
    asked = [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(w) for w, (c, v) in _ASKED.items()]
    one = F.struct("stem", "l", "r", "extra_l", "extra_r", "score", "strength", *asked, *(F.col(f"dsp_params.{p}").alias(p) for p in PARAMETERS))
    songs = rows.groupBy("track").agg(F.array_sort(F.collect_list(one)).alias("s"))
    every = lambda name: F.transform("s", lambda v: v[name])
    sound = [F.flatten(every(c)).alias(c) for c in ("l", "r")]
    extra = [F.col("s")[0][c].alias(c) for c in ("extra_l", "extra_r")]
    wide = songs.select("track", every("stem").alias("stems"), F.transform("s", lambda v: F.size(v["l"])).alias("sizes"), *sound, *extra, *(every(n).cast("array<double>").alias(n) for n in numbers))

    def run(batches):
        for batch in batches:
            cells = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            flat = {n: cells[n].values.to_numpy(zero_copy_only=False) for n in ("l", "r", "extra_l", "extra_r", *numbers)}
            starts = {n: cells[n].offsets.to_numpy()[:-1] for n in flat}
            alike: dict[tuple, list[int]] = {}
            for i, kind in enumerate(zip(map(tuple, cells["stems"].to_pylist()), map(tuple, cells["sizes"].to_pylist()))):
                alike.setdefault(kind, []).append(i)
            for (names, sizes), members in alike.items():
                step = max(CALL_SAMPLES // max(*sizes, 1), 1)
                for at in (np.array(members[i : i + step]) for i in range(0, len(members), step)):
                    cut = lambda n, start, size: flat[n][starts[n][at, None] + start + np.arange(size)].astype(float)  # noqa: B023, E731
                    given, settings, begin = {}, {}, 0
                    for i, (name, size) in enumerate(zip(names, sizes)):
                        given[name] = (cut("l", begin, size), cut("r", begin, size))
                        settings[name] = {n: cut(n, i, 1)[:, 0] for n in numbers}
                        begin += size
                    risk = cut("score", 0, len(names)).mean(axis=-1)
                    out, gain = _remix(given, settings, (cut("extra_l", 0, sizes[0]), cut("extra_r", 0, sizes[0])), risk, frames)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * y.shape[-1], pa.int32()), pa.array(y.ravel())) for y in out]
                    made = [cells["track"].take(pa.array(at)), pa.array(np.full(len(at), len(given))), pa.array(gain), *lists]
                    yield pa.RecordBatch.from_arrays(made, ["track", "stems", "residual_gain", "out_l", "out_r"])

    return wide.mapInArrow(run, "track long, stems long, residual_gain double, out_l array<double>, out_r array<double>")
