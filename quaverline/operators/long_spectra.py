"""Resampling, true peak and spectral gating over the chunks of long tracks.

Each output sample depends on a bounded neighbourhood, so a chunk needs its neighbours' ends and no more. What spans the whole
track, the quiet level of each frequency bin, is an exact percentile of a distributed selection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import kernels as k
from .blocks import CHUNK, map_chunks, with_halo
from .selection import SMALL, percentiles

#: Chunks whose frames are held at a time.
FEW = 16


def _padded(left: np.ndarray, x: np.ndarray, right: np.ndarray, before: int, after: int) -> np.ndarray:
    """A chunk with exactly so many samples around it, silence where the track has none."""
    zeros = lambda n: np.zeros((len(x), n))
    return np.concatenate([zeros(before - left.shape[-1]), left, x, right, zeros(after - right.shape[-1])], axis=-1)


def resampled(chunks: DataFrame, keys: Sequence[str], sr: float, to: float, size: int = CHUNK) -> DataFrame:
    """(keys..., c, x) at the rate ``to``, equal to ``kernels.resampled_polyphase`` of each whole track.

    ``size`` is a multiple of what the rates' ratio goes down by, so that chunks of the result are equally long as well.
    """
    up, down = k.rational(sr, to)
    if up == down:
        return chunks.select(*keys, "c", "x")
    if size % down:
        raise ValueError(f"chunks of {size} samples aren't whole steps of {down}")
    bank = k.polyphase_bank(up, down)
    reach = bank.shape[1] // 2

    def run(left, x, right):
        return {"x": k.polyphase(_padded(left, x, right, reach, reach + 1), bank, down, -(-x.shape[-1] * up // down))}

    return map_chunks(with_halo(chunks, keys, reach, reach + 1), ["left", "x", "right"], [], {"x": "array<double>"}, run, [*keys, "c"])


def true_peak(chunks: DataFrame, keys: Sequence[str], factor: int = 4) -> DataFrame:
    """(keys..., true_peak): the highest value of each track at ``factor`` times its rate."""
    bank = k.polyphase_bank(factor, 1, cut=1.0)  # which keeps the samples themselves
    reach = bank.shape[1] // 2

    def run(left, x, right):
        return {"peak": np.abs(k.polyphase(_padded(left, x, right, reach, reach + 1), bank, 1, x.shape[-1] * factor)).max(axis=-1)}

    peaks = map_chunks(with_halo(chunks, keys, reach, reach + 1), ["left", "x", "right"], [], {"peak": "double"}, run, [*keys, "c"])
    return peaks.groupBy(*keys).agg(F.max("peak").alias("true_peak"))


class Places:
    """Where frames of ``size`` samples every ``hop`` lie around a chunk, as centres relative to its first sample.

    A track has a frame at every ``hop`` from 0 to the first multiple that isn't below its length.
    """

    def __init__(self, left: int, length: int, right: int, size: int, hop: int):
        self.first = 0 if not left else -(-(1 - size // 2) // hop) * hop  # the first centre whose frame reaches in
        end = -(-(length + right) // hop) * hop if right < size else length + right
        self.last = min(end, (length + size // 2 - 1) // hop * hop)
        self.own_last = end if not right else (length - 1) // hop * hop

    def centres(self, hop: int) -> np.ndarray:
        return np.arange(self.first, self.last + 1, hop)

    def own(self, hop: int) -> np.ndarray:
        return np.arange(0, self.own_last + 1, hop)


def _spectra(left, x, right, centres, size, hop):
    """(chunks, frames, bins) under a Hann window, in turns of a few chunks."""
    ext = _padded(left, x, right, 2 * size, 2 * size)
    at = 2 * size + centres[:, None] - size // 2 + np.arange(size)[None, :]
    window = np.hanning(size + 1)[:-1]
    for i in range(0, len(x), FEW):
        yield slice(i, i + FEW), np.fft.rfft(ext[i : i + FEW][:, at] * window, axis=-1)


def quiet_bins(near: DataFrame, keys: Sequence[str], size: int, hop: int, share: float = 0.2, small: int = SMALL) -> DataFrame:
    """(keys..., floor): the ``share`` percentile of each bin's magnitudes over all frames of a track, as an array."""
    bins = size // 2 + 1

    def run(left, x, right):
        own = Places(left.shape[-1], x.shape[-1], right.shape[-1], size, hop).own(hop)
        return {"m": np.concatenate([np.abs(s) for _, s in _spectra(left, x, right, own, size, hop)]).reshape(len(x), -1)}

    rows = map_chunks(near, ["left", "x", "right"], [], {"m": "array<double>"}, run, [*keys, "c"])
    values = rows.select(*keys, F.posexplode("m").alias("at", "v")).select(*keys, (F.col("at") % bins).alias("bin"), "v")
    found = percentiles(values, [*keys, "bin"], "v", {"quiet": share}, small)
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "quiet"))), lambda p: p["quiet"]).alias("floor"))


def gate(chunks: DataFrame, keys: Sequence[str], intensity: float, size: int = 2_048, hop: int = 512, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """(keys..., c, x) with each bin softened where it is hardly above its quiet fifth, equal to ``kernels.gate`` of each track.

    A chunk makes the frames that reach into it by itself, so no frames are passed on; it holds whole hops and a frame at least.
    """
    if chunk % hop or chunk < size:
        raise ValueError(f"chunks of {chunk} samples don't suit frames of {size} every {hop}")
    if intensity <= 0:
        return chunks.select(*keys, "c", "x")
    strength = min(intensity, 1.0)
    near = stored(with_halo(chunks, keys, size, size), "near")
    floors = stored(quiet_bins(near, keys, size, hop, small=small), "floors")
    window = np.hanning(size + 1)[:-1]

    def run(left, x, right, floor):
        place = Places(left.shape[-1], x.shape[-1], right.shape[-1], size, hop)
        centres, length = place.centres(hop), x.shape[-1]
        out, start = [], place.first - size // 2
        span = centres[-1] - centres[0] + size
        weight = np.zeros(span)
        for i in range(len(centres)):
            weight[i * hop : i * hop + size] += window**2
        for rows, s in _spectra(left, x, right, centres, size, hop):
            keep = np.abs(s) >= floor[rows][:, None, :] * (1 + 2.5 * strength)
            frames = np.fft.irfft(s * np.where(keep, 1.0, 1 - 0.75 * strength), size, axis=-1) * window
            y = np.zeros((len(frames), span))
            for i in range(len(centres)):
                y[:, i * hop : i * hop + size] += frames[:, i]
            out.append((y / np.maximum(weight, 1e-8))[:, -start : length - start])
        return {"x": np.concatenate(out)}

    return map_chunks(near.join(floors, list(keys)), ["left", "x", "right", "floor"], [], {"x": "array<double>"}, run, [*keys, "c"])
