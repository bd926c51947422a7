"""Guards: what processing did to a track is compared with the source and partly taken back. Stereo tracks, many at once."""

from __future__ import annotations

import numpy as np

from ..functions.tables import DELTA_BANDS, TRANSIENT_BANDS, WIDTH_BANDS
from . import kernels as k
from .kernels import Array, column

Stereo = tuple[Array, Array]


def mid_side(x: Stereo) -> Stereo:
    return (x[0] + x[1]) / 2, (x[0] - x[1]) / 2


def left_right(x: Stereo) -> Stereo:
    return x[0] + x[1], x[0] - x[1]


def width(mid: Array, side: Array) -> Array:
    return k.rms(side) / (k.rms(mid) + 1e-9)


def channel_balance(source: Stereo, done: Stereo) -> Stereo:
    """The channels' share of the level as in the source."""
    s, d = (np.stack([k.rms(c) for c in x]) for x in (source, done))
    gain = np.clip(s / (s.mean(axis=0) + 1e-9) / (d / (d.mean(axis=0) + 1e-9) + 1e-9), 0.5, 2.0)
    gain = np.where((s.max(axis=0) > 1e-9) & (d.max(axis=0) > 1e-9), gain, 1.0)
    return done[0] * column(gain[0]), done[1] * column(gain[1])


def width_match(source: Stereo, done: Stereo) -> Stereo:
    (sm, ss), (dm, ds) = mid_side(source), mid_side(done)
    gain = np.clip(width(sm, ss) / (width(dm, ds) + 1e-9), 0.25, 4.0)
    return left_right((dm, ds * column(np.where(k.rms(ds) > 1e-9, gain, 1.0))))


def low_bass(source: Stereo, done: Stereo, sr: float, hz: float = 130.0) -> tuple[Stereo, Array]:
    """The side of the lowest band no wider than a quarter above the source."""
    (sm, ss), (dm, ds) = mid_side(source), mid_side(done)
    low = k.low_pass(ds, sr, hz)
    now = width(k.low_pass(dm, sr, hz), low)
    allowed = np.maximum(width(k.low_pass(sm, sr, hz), k.low_pass(ss, sr, hz)) * 1.25, 0.10)
    gain = np.where((now > allowed) & (now > 1e-9), np.clip(allowed / np.maximum(now, 1e-9), 0.35, 1.0), 1.0)
    return left_right((dm, ds - low * column(1 - gain))), k.db(gain)


def low_side_growth(source: Stereo, done: Stereo, sr: float, hz: float = 140.0) -> Array:
    """Whether the side of the lowest band grew by more than it may against its mid."""
    before, now = (width(*(k.low_pass(c, sr, hz) for c in mid_side(x))) for x in (source, done))
    return now > np.maximum(before * 1.35, before + 0.08)


def _banded(source: Stereo, done: Stereo, sr: float, bands, tolerance: float, gains: tuple[float, float], floor: float, least_source: float) -> Stereo:
    (sm, ss), (dm, ds) = mid_side(source), mid_side(done)
    side = ds.copy()
    for low, high, least, most in bands:
        high = min(high, sr * 0.45)
        if high <= low + 40.0:
            continue
        before = width(k.band_pass(sm, sr, low, high), k.band_pass(ss, sr, low, high))
        own = k.band_pass(ds, sr, low, high)
        now = width(k.band_pass(dm, sr, low, high), own)
        relative = now / np.maximum(before, floor)
        wanted = np.clip(relative, least, most)
        off = (np.abs(wanted - relative) >= tolerance) & (now > 1e-9) & (before > least_source)
        gain = np.where(off, np.clip(wanted / np.maximum(relative, 1e-12), *gains), 1.0)
        side += own * column(gain - 1)
    return left_right((dm, side))


def band_widths(source: Stereo, done: Stereo, sr: float) -> Stereo:
    """Each band's width within a range around the source's."""
    return _banded(source, done, sr, WIDTH_BANDS, 0.03, (0.45, 1.35), 1e-9, 1e-5)


def correlation(x: Stereo) -> Array:
    return np.clip(np.mean(x[0] * x[1], axis=-1) / ((k.rms(x[0]) + 1e-9) * (k.rms(x[1]) + 1e-9)), -1, 1)


def band_deltas(source: Stereo, done: Stereo, sr: float) -> Stereo:
    """The same with six bands, and a narrower side if the channels came apart."""
    out = _banded(source, done, sr, DELTA_BANDS, 0.025, (0.35, 1.25), 1e-6, -1.0)
    before, now = correlation(source), correlation(out)
    m, s = mid_side(out)
    return left_right((m, s * column(np.where((now < before - 0.28) | (now < -0.08), 0.88, 1.0))))


def tilt(source: Stereo, done: Stereo, sr: float) -> tuple[Stereo, Array]:
    """Takes back almost half of a shift between the channels in the presence band; and the shift in dB."""
    high = min(5200.0, sr * 0.45)
    lean = lambda x: k.db((k.rms(k.band_pass(x[0], sr, 3000.0, high)) + 1e-9) / (k.rms(k.band_pass(x[1], sr, 3000.0, high)) + 1e-9))
    drift = lean(done) - lean(source)
    fix = np.where(np.abs(drift) >= 0.45, np.clip(-drift * 0.45, -1.0, 1.0), 0.0)
    return (done[0] * column(10 ** (fix / 40)), done[1] * column(10 ** (-fix / 40))), drift


def delta(source: Stereo, done: Stereo, sr: float, amount: Array) -> Stereo:
    """The change itself scaled by ``amount``, and no higher than two thirds of the source's peak."""
    change = [d - s for s, d in zip(source, done)]
    most = np.maximum(k.sample_peak(list(source)) * 0.65, 0.05)
    top = k.sample_peak(change)
    scale = np.clip(amount, 0, 1) * np.where(top > most, most / np.maximum(top, 1e-9), 1.0)
    out = tuple(s + c * column(scale) for s, c in zip(source, change))
    return tilt(source, band_deltas(source, out, sr), sr)[0]


def band_shares(x: Stereo, sr: float) -> Array:
    """Low, mid and high share of the power, (3, tracks)."""
    power = np.mean([np.abs(np.fft.rfft(c, axis=-1)) ** 2 for c in x], axis=0)
    f = np.fft.rfftfreq(x[0].shape[-1], 1 / sr)
    parts = np.stack([power[..., (f >= a) & (f < b)].sum(axis=-1) for a, b in ((20, 250), (250, 4000), (4000, min(sr / 2, 20000)))])
    return parts / np.maximum(parts.sum(axis=0), 1e-9)


def band_balance(source: Stereo, done: Stereo, sr: float) -> Stereo:
    """An equaliser against a drift of the bands of 0.12 or more."""
    lost = band_shares(source, sr) - band_shares(done, sr)
    drift = np.abs(lost).max(axis=0)
    strength = np.where(drift >= 0.12, np.clip((drift - 0.08) / 0.20, 0.0, 0.65), 0.0)
    low, mid, high = (np.clip(lost[i] * f, -m, m) * strength for i, (f, m) in enumerate(((7.0, 2.0), (5.0, 1.5), (6.0, 2.0))))
    return tuple(np.where(column(strength) > 0, k.shape(c, sr, low, mid, high), c) for c in done)


def _band_limited(source: Array, done: Array, sr: float, low: float, high: float, times: float, floor: float, least: float) -> tuple[Array, Array]:
    band = k.band_pass(done, sr, low, min(high, sr * 0.45))
    now = k.rms(band) / (k.rms(done) + 1e-9)
    before = k.rms(k.band_pass(source, sr, low, min(high, sr * 0.45))) / (k.rms(source) + 1e-9)
    allowed = np.maximum(before * times, floor)
    gain = np.where(now > np.maximum(allowed, 1e-9), np.clip(allowed / np.maximum(now, 1e-9), least, 1.0), 1.0)
    return done - band * column(1 - gain), k.db(gain)


def harshness(source: Array, done: Array, sr: float, bright: bool = False) -> tuple[Array, Array]:
    return _band_limited(source, done, sr, 3600.0, 9200.0, 1.55 if bright else 1.28, 0.075 if bright else 0.055, 10 ** (-1.35 / 20))


def sibilance(source: Array, done: Array, sr: float) -> tuple[Array, Array]:
    return _band_limited(source, done, sr, 5200.0, 10500.0, 1.35, 0.10, 0.5)


def transients(source: Stereo, done: Stereo, sr: float) -> tuple[Stereo, Array]:
    """Puts back some of the source's onsets where the crest fell by more than 1.2 dB; and that loss."""
    loss = k.crest(list(source)) - k.crest(list(done))
    strength = np.where(loss > 1.2, np.clip((loss - 0.8) / 10, 0.0, 0.16), 0.0)
    mask = k.onset_mask((source[0] + source[1]) / 2, sr) * column(strength)
    return tuple(d + (k.high_pass(s, sr, 120.0) - k.high_pass(d, sr, 120.0)) * mask for s, d in zip(source, done)), np.where(loss > 1.2, loss, 0.0)


def band_transients(source: Array, done: Array, sr: float) -> Array:
    out = done.copy()
    for low, high, most in TRANSIENT_BANDS:
        high = min(high, sr * 0.45)
        if high > low + 30.0:
            s, d = k.band_pass(source, sr, low, high), k.band_pass(done, sr, low, high)
            loss = k.crest([s]) - k.crest([d])
            blend = np.where(loss > 1.0, np.clip((loss - 0.8) / 12, 0.0, most), 0.0)
            out += (s - d) * k.onset_mask(s, sr) * column(blend)
    return out


def dynamic_eq(source: Array, done: Array, sr: float, size: int, hop: int, target: str = "") -> Array:
    """Frame by frame, bands that grew against the source are turned down."""
    s, d = np.abs(k.stft(source, size, hop)) ** 2, k.stft(done, size, hop)
    power, f = np.abs(d) ** 2, np.fft.rfftfreq(size, 1 / sr)
    share = lambda p, a, b: p[..., (f >= a) & (f < b)].mean(axis=-1) / (p.mean(axis=-1) + 1e-12) if ((f >= a) & (f < b)).any() else np.zeros(p.shape[:-1])
    gain = np.ones(power.shape)
    # Band measured, band turned down, threshold, most dB
    for (a, b), (low, high), threshold, most in (
        ((45.0, 220.0), (45.0, 240.0), 0.050, 1.45 * (0.75 if target == "bass_boost" else 1.0)),
        ((220.0, 650.0), (220.0, 760.0), 0.045, 1.10),
        ((2600.0, 7200.0), (2600.0, 7800.0), 0.040, 0.75 if target == "hifi_bright" else 1.45),
    ):
        cut = np.clip((share(power, a, b) - share(s, a, b) - threshold) * 16, 0, most)
        smooth = k.envelope(10 ** (-cut / 20), 1.0, k.decay(hop, sr, 0.012), k.decay(hop, sr, 0.110))
        mask = np.clip(k.step(f, low * 0.82, low) * (1 - k.step(f, high, high * 1.22)), 0, 1)
        gain *= 1 - mask * column(1 - smooth)
    return k.istft(d * gain, size, hop, done.shape[-1])


def loudness_match(source: Stereo, done: Stereo, sr: float, ceiling_db: Array, most_boost: float = 8.0) -> tuple[Stereo, Array]:
    """The source's loudness as far as the headroom goes; and the gain in dB."""
    wanted = np.clip(k.integrated_loudness(list(source), sr) - k.integrated_loudness(list(done), sr), -18.0, most_boost)
    top = np.maximum(np.maximum(k.true_peak(list(done), 2), k.sample_peak(list(done))), 1e-9)
    gain = np.where(np.abs(wanted) < 0.05, 0.0, np.minimum(wanted, np.asarray(ceiling_db) - k.db(top)))
    out = k.limit([c * column(10 ** (gain / 20)) for c in done], ceiling_db, sr)
    out, cut = k.trimmed(out, k.true_peak(out), ceiling_db)
    return tuple(out), gain + cut


def loudness_set(done: Stereo, sr: float, target: Array, ceiling_db: Array, drive_db: float = 1.5) -> tuple[Stereo, Array]:
    wanted = np.clip(np.asarray(target) - k.integrated_loudness(list(done), sr), -18.0, 18.0)
    gain = np.minimum(wanted, np.asarray(ceiling_db) + drive_db - k.db(k.true_peak(list(done), 2)))
    gain = np.where(np.sqrt(np.mean([k.rms(c) ** 2 for c in done], axis=0)) <= 1e-9, 0.0, gain)
    return tuple(c * column(10 ** (gain / 20)) for c in done), gain


def safe(done: Stereo, sr: float, ceiling_db: Array, strict: bool = False) -> Stereo:
    """At most a few rounds of limiter and trims until nothing passes the ceiling, which is no higher than codecs stand."""
    ceiling_db = np.minimum(np.asarray(ceiling_db, float), -1.4)
    out = [np.nan_to_num(c, nan=0.0, posinf=0.0, neginf=0.0) for c in done]
    for _ in range(4 if strict else 2):
        peak = np.maximum(k.true_peak(out), k.sample_peak(out))
        if (k.db(peak) <= ceiling_db).all():
            break
        out = k.limit(out, ceiling_db, sr)
        out, _ = k.trimmed(out, k.true_peak(out), ceiling_db)
        out, _ = k.trimmed(out, k.sample_peak(out), ceiling_db)
    out, _ = k.trimmed(out, np.maximum(k.true_peak(out), k.sample_peak(out)), ceiling_db)
    return tuple(out)
