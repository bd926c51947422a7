"""Level, stereo, frame and spectral measures of many tracks of one or two channels at once.

As in ``kernels``, every array has the shape (tracks, samples) and all tracks of a call are equally long.
"""

from __future__ import annotations

import numpy as np

from . import kernels as k
from .kernels import Array


def frame_levels(x: Array, frame: int, hop: int) -> Array:
    """Root mean square of each whole frame; of a track shorter than a frame, that of the track."""
    if x.shape[-1] < frame:
        return k.rms(x)[..., None]
    return k.rms(np.lib.stride_tricks.sliding_window_view(x, frame, axis=-1)[..., ::hop, :])


def crossings(x: Array) -> Array:
    """Share of samples whose sign differs from that of the sample before; zero counts as positive."""
    return ((x[..., 1:] < 0) != (x[..., :-1] < 0)).sum(axis=-1) / x.shape[-1]


def power(channels: list[Array]) -> Array:
    """Power of each frequency bin, averaged over the channels."""
    return sum(np.abs(np.fft.rfft(c, axis=-1)) ** 2 for c in channels) / len(channels)


def level(channels: list[Array], frame: int, hop: int) -> dict[str, Array]:
    every = np.concatenate(channels, axis=-1)
    size, offsets = np.abs(every), np.array([c.mean(axis=-1) for c in channels])
    frames = np.concatenate([frame_levels(c, frame, hop) for c in channels], axis=-1)
    return {
        "rms": k.rms(every),
        "peak": size.max(axis=-1),
        "noise_floor_db": k.db(np.percentile(frames, 10, axis=-1)),
        "dc_offset": offsets.mean(axis=0),
        "max_channel_dc_offset": np.abs(offsets).max(axis=0),
        "clipping_ratio": (size >= 0.98).mean(axis=-1),
        "silence_ratio": (size <= 10 ** (-50 / 20)).mean(axis=-1),
        "zero_crossing_rate": np.mean([crossings(c) for c in channels], axis=0),
    }


def image(channels: list[Array]) -> dict[str, Array]:
    """Width and uncentred correlation; one channel has no width and agrees with itself."""
    if len(channels) == 1:
        return {"stereo_width": np.zeros(len(channels[0])), "phase_correlation": np.ones(len(channels[0]))}
    l, r = channels
    width = k.rms((l - r) * 0.5) / (k.rms((l + r) * 0.5) + 1e-9)
    alike = (l * r).mean(axis=-1) / ((k.rms(l) + 1e-9) * (k.rms(r) + 1e-9))
    return {"stereo_width": np.clip(width, 0.0, 4.0), "phase_correlation": np.clip(alike, -1.0, 1.0)}


def spectrum(channels: list[Array], sr: float, bands: dict[str, tuple[float, float]]) -> dict[str, Array]:
    """Share of the power in each band, its upper edge left out; centroid, roll-off (85 %) and flatness."""
    p = power(channels)
    hz, summed = np.arange(p.shape[-1]) * (sr / channels[0].shape[-1]), np.cumsum(p, axis=-1)
    whole = summed[..., -1]
    heard, some = whole > 1e-12, np.where(whole == 0, 1.0, whole)
    magnitude = np.sqrt(np.maximum(p, 1e-18))
    return {
        **{name: p[..., (hz >= low) & (hz < high)].sum(axis=-1) / some for name, (low, high) in bands.items()},
        "spectral_centroid_hz": np.where(heard, (p * hz).sum(axis=-1) / some, 0.0),
        "spectral_rolloff_hz": np.where(heard, hz[np.minimum((summed < k.column(whole) * 0.85).sum(axis=-1), len(hz) - 1)], 0.0),
        "spectral_flatness": np.exp(np.log(magnitude).mean(axis=-1)) / (magnitude.mean(axis=-1) + 1e-18),
    }


def loudness(channels: list[Array], sr: float) -> dict[str, Array]:
    """Gated loudness of the channels, their mid and their side. Weighting is linear, so two weighted channels give all three; one
    channel is its own mid, and its side is silence."""
    if len(channels) == 1:
        own = k.integrated_loudness(channels, sr)
        return {"lufs": own, "mid_lufs": own, "side_lufs": np.full(len(own), k.db(np.zeros(1))[0] - 0.691)}
    l, r = channels
    a, b = k.k_weighted(l, sr), k.k_weighted(r, sr)
    middle, apart = lambda x, y: (x + y) * 0.5, lambda x, y: (x - y) * 0.5
    return {
        "lufs": k.gated_loudness([a, b], [l, r], sr),
        "mid_lufs": k.gated_loudness([middle(a, b)], [middle(l, r)], sr),
        "side_lufs": k.gated_loudness([apart(a, b)], [apart(l, r)], sr),
    }
