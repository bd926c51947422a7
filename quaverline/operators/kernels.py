"""Filters and recursions over many tracks at once.

Every function takes an array of shape (tracks, samples) and works on all tracks together: a recursion walks the samples
once, with one vector operation for all tracks of a batch. Formulas are the published ones for biquads, Butterworth
filters, one-pole envelopes and trigonometric interpolation.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

from ..functions.tables import K_HIGHPASS_HZ, K_SHELF

Array = np.ndarray


def db(x: Array) -> Array:
    return 20 * np.log10(np.maximum(x, 1e-9))


def rms(x: Array) -> Array:
    return np.sqrt(np.mean(x * x, axis=-1)) if x.shape[-1] else np.zeros(x.shape[:-1])


def column(x: Array) -> Array:
    return np.asarray(x)[..., None]


def shelf(sr: float, hz: float = K_SHELF[0], gain_db: float = K_SHELF[1], q: float = K_SHELF[2]) -> tuple[Array, Array]:
    """High shelf: numerator and denominator, the latter starting with 1."""
    w = 2 * np.pi * np.clip(hz, 20.0, max(20.0, sr * 0.45)) / sr
    g, cos, slope = 10 ** (gain_db / 40), np.cos(w), np.sin(w) / q * np.sqrt(10 ** (gain_db / 40))
    up, down = g + 1, g - 1
    b = g * np.array([up + down * cos + slope, -2 * (down + up * cos), up + down * cos - slope])
    a = np.array([up - down * cos + slope, 2 * (down - up * cos), up - down * cos - slope])
    return b / a[0], a / a[0]


def butterworth(sr: float, low: float | None, high: float | None) -> tuple[Array, Array]:
    """Second-order prototype as low-pass (``low`` None), high-pass (``high`` None) or band-pass, by the bilinear transform."""
    warp = lambda f: 2 * sr * np.tan(np.pi * f / sr)
    proto = np.exp(1j * np.pi * np.array([3, 5]) / 4)
    if low is None:
        poles, zeros, at = proto * warp(high), np.zeros(0), 0.0
    elif high is None:
        poles, zeros, at = warp(low) / proto, np.zeros(2), np.pi
    else:
        a, b = warp(low), warp(high)
        half = proto * (b - a) / 2
        root = np.sqrt(half**2 - a * b)
        poles, zeros = np.concatenate([half + root, half - root]), np.zeros(2)
        at = 2 * np.arctan(np.sqrt(a * b) / (2 * sr))
    to_z = lambda s: (2 * sr + s) / (2 * sr - s)
    z = np.concatenate([to_z(zeros.astype(complex)), -np.ones(len(poles) - len(zeros))])
    num, den = np.poly(z).real, np.poly(to_z(poles)).real
    point = np.exp(-1j * at * np.arange(len(den)))
    return num * abs((den * point).sum() / (num * point).sum()), den


#: Samples of one block of a filter; within a block everything is one matrix product.
BLOCK = 64


def run_filter(coefficients: tuple[Array, Array], x: Array, start: Array | None = None, end: bool = False) -> Array | tuple[Array, Array]:
    """Causal, from silence or from the state ``start`` of each track; with ``end`` the state after the last sample as well.

    The filter is a small state that each sample advances. Over a block, the output is one matrix times the samples plus
    another times the state before, so only the state has to walk from block to block.
    """
    b, a = coefficients
    m, n = len(b) - 1, x.shape[-1]
    size = min(BLOCK, max(n, 1))
    move = np.eye(m, k=1)
    move[:, 0] -= a[1:]
    push = b[1:] - a[1:] * b[0]
    powers = [np.eye(m)]
    for _ in range(size):
        powers.append(powers[-1] @ move)
    response = np.array([b[0], *(powers[i][0] @ push for i in range(size - 1))])
    lags = np.arange(size)[:, None] - np.arange(size)[None, :]
    own = np.where(lags >= 0, response[np.maximum(lags, 0)], 0.0)
    carried = np.array([powers[i][0] for i in range(size)])
    gathered = np.array([powers[size - 1 - i] @ push for i in range(size)])
    blocks = -(-n // size)
    cells = np.concatenate([x, np.zeros((*x.shape[:-1], blocks * size - n))], axis=-1).reshape(*x.shape[:-1], blocks, size)
    inflow = cells @ gathered
    states = np.zeros((*x.shape[:-1], blocks, m))
    if start is not None and blocks:
        states[..., 0, :] = start
    for k in range(1, blocks):
        states[..., k, :] = states[..., k - 1, :] @ powers[size].T + inflow[..., k - 1, :]
    y = (cells @ own.T + states @ carried.T).reshape(*x.shape[:-1], blocks * size)[..., :n]
    if not end:
        return y
    if not blocks:
        return y, np.zeros((*x.shape[:-1], m)) if start is None else start
    rest = n - (blocks - 1) * size
    last = np.array([powers[rest - 1 - i] @ push for i in range(rest)])
    return y, states[..., -1, :] @ powers[rest].T + cells[..., -1, :rest] @ last


def zero_phase(coefficients: tuple[Array, Array], x: Array) -> Array:
    """Forward and back, the ends continued by their point reflection."""
    n = x.shape[-1]
    pad = min(3 * len(coefficients[0]) * 2, n - 1)
    if pad < 1:
        return run_filter(coefficients, x)
    first, last = 2 * x[..., :1] - x[..., pad:0:-1], 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    y = run_filter(coefficients, np.concatenate([first, x, last], axis=-1))
    return run_filter(coefficients, y[..., ::-1])[..., ::-1][..., pad : pad + n]


def low_pass(x: Array, sr: float, hz: float) -> Array:
    if x.shape[-1] < 16:
        return np.zeros_like(x)
    return zero_phase(butterworth(sr, None, float(np.clip(hz, 20.0, sr * 0.45))), x)


def high_pass(x: Array, sr: float, hz: float) -> Array:
    """Nothing to do up to 20 Hz."""
    if hz <= 20.0 or x.shape[-1] < 8:
        return x
    return zero_phase(butterworth(sr, float(min(hz, sr * 0.45)), None), x)


def band_pass(x: Array, sr: float, low: float, high: float) -> Array:
    low = float(np.clip(low, 20.0, sr * 0.45))
    high = float(np.clip(high, low + 50.0, max(low + 50.0, sr * 0.48)))
    if x.shape[-1] < 16 or high <= low + 20.0 or high >= sr / 2:
        return np.zeros_like(x)
    return zero_phase(butterworth(sr, low, high), x)


def k_weighted(x: Array, sr: float) -> Array:
    if sr <= 100:
        return x.astype(float)
    return run_filter(butterworth(sr, float(np.clip(K_HIGHPASS_HZ, 10.0, sr * 0.45)), None), run_filter(shelf(sr), x))


def integrated_loudness(channels: list[Array], sr: float) -> Array:
    """Two-stage gated loudness of each track."""
    return gated_loudness([k_weighted(c, sr) for c in channels], channels, sr)


def gated_loudness(weighted: list[Array], channels: list[Array], sr: float) -> Array:
    """The same of channels that are K-weighted already; ``channels``, as they were, tell silence."""
    energy = sum(c**2 for c in weighted)
    raw = np.sqrt(sum((c**2).mean(axis=-1) for c in channels) / len(channels))
    fallback = db(raw) - 0.691
    level = lambda e: -0.691 + 10 * np.log10(np.maximum(e, 1e-18))
    block = max(round(sr * 0.4), 1)
    hop = max(round(block * 0.25), 1)
    if energy.shape[-1] < block:
        return np.where(raw <= 1e-12, fallback, level(energy.mean(axis=-1) / len(channels)))
    sums = np.concatenate([np.zeros((*energy.shape[:-1], 1)), np.cumsum(energy, axis=-1)], axis=-1)
    starts = np.arange(0, energy.shape[-1] - block + 1, hop)
    e = (sums[..., starts + block] - sums[..., starts]) / block
    loud = level(e) > -70.0
    part = lambda mask: np.where(mask, e, 0).sum(axis=-1) / np.maximum(mask.sum(axis=-1), 1)
    kept = loud & (level(e) > column(level(part(loud)) - 10.0))
    out = level(np.where(kept.any(axis=-1), part(kept), part(loud)))
    return np.where(loud.any(axis=-1) & (raw > 1e-12), out, fallback)


def true_peak(channels: list[Array], factor: int = 4) -> Array:
    """Highest value of the trigonometric interpolation at ``factor`` times the rate."""
    peaks = []
    for x in channels:
        n = x.shape[-1]
        spectrum = np.fft.rfft(x, axis=-1)
        if n % 2 == 0:
            spectrum[..., -1] *= 0.5
        peaks.append(np.abs(np.fft.irfft(spectrum, n * factor, axis=-1)).max(axis=-1) * factor)
    return np.max(peaks, axis=0)


def sample_peak(channels: list[Array]) -> Array:
    return np.max([np.abs(x).max(axis=-1) for x in channels], axis=0)


def envelope(target: Array, start: float | Array, fall: float, rise: float) -> Array:
    """One-pole smoothing whose coefficient depends on whether the target lies below the value so far."""
    goals, now = np.ascontiguousarray(np.moveaxis(target, -1, 0), dtype=float), np.zeros(target.shape[:-1]) + start
    out = np.empty_like(goals)
    for i, goal in enumerate(goals):
        now = out[i] = goal + (now - goal) * np.where(goal < now, fall, rise)
    return np.moveaxis(out, 0, -1)


def decay(samples: float, sr: float, seconds: float) -> float:
    return float(np.exp(-samples / max(sr * seconds, 1.0)))


def wanted_cut(x: Array, size: int, ratio: Array) -> Array:
    """By how many dB each block of ``size`` samples should fall."""
    threshold, knee, most = -15.0, 7.0, 7.0
    blocks = -(-x.shape[-1] // size)
    padded = np.concatenate([x, np.full((*x.shape[:-1], blocks * size - x.shape[-1]), np.nan)], axis=-1).reshape(*x.shape[:-1], blocks, size)
    level = db(np.maximum(np.sqrt(np.nanmean(padded**2, axis=-1)), np.nanmax(np.abs(padded), axis=-1) * 0.55))
    over, slope = level - threshold, 1 - 1 / column(ratio)
    into = np.clip(over + knee / 2, 0, knee)
    return np.minimum(np.where(over >= knee / 2, over * slope, slope * into**2 / (2 * knee)), most)


def compress(x: Array, sr: float, ratio: Array) -> Array:
    """Soft-knee compression by blocks of 4 ms, the gain in dB smoothed and interpolated between blocks."""
    size, n = max(32, int(sr * 0.004)), x.shape[-1]
    blocks = -(-n // size)
    if blocks <= 1:
        return x
    gain = envelope(-wanted_cut(x, size, ratio), 0.0, decay(size, sr, 0.018), decay(size, sr, 0.16))
    place = np.minimum(np.arange(n) / size, blocks - 1)
    low = np.minimum(place.astype(int), blocks - 2)
    gain = gain[..., low] + (gain[..., low + 1] - gain[..., low]) * np.minimum(place - low, 1.0)
    return np.where(column(ratio) > 1.01, x * 10 ** (gain / 20), x)


def limit(channels: list[Array], ceiling_db: Array, sr: float) -> list[Array]:
    """Linked look-ahead limiter: gain needed over the next 8 ms, quick down, slow up, and a last clip."""
    ceiling = column(10 ** (np.asarray(ceiling_db) / 20))
    linked = np.max([np.abs(x) for x in channels], axis=0)
    gain = np.minimum(1.0, ceiling / (linked + 1e-12))
    ahead = 2 * max(1, round(sr * 0.004))
    padded = np.concatenate([gain, np.repeat(gain[..., -1:], ahead, axis=-1)], axis=-1)
    least = np.lib.stride_tricks.sliding_window_view(padded, ahead + 1, axis=-1).min(axis=-1)
    smooth = envelope(least, 1.0, decay(1, sr, 0.0015), decay(1, sr, 0.090))
    hot = column(linked.max(axis=-1)) > ceiling
    return [np.where(hot, np.clip(x * smooth, -ceiling, ceiling), x) for x in channels]


def trimmed(channels: list[Array], peak: Array, ceiling_db: Array) -> tuple[list[Array], Array]:
    """Scaled down where ``peak`` is above the ceiling; and by how many dB."""
    ceiling = 10 ** (np.asarray(ceiling_db) / 20)
    gain = np.where((peak > ceiling) & (peak > 1e-9), ceiling / np.maximum(peak, 1e-9), 1.0)
    return [x * column(gain) for x in channels], db(gain)


def saturate(x: Array, amount: Array) -> Array:
    a = column(np.clip(amount, 0.0, 0.35))
    drive = 1 + 5 * a
    return x * (1 - a) + np.tanh(x * drive) / np.tanh(drive) * a


def excite(x: Array, sr: float, amount: Array) -> Array:
    """Adds harmonics of the upper band, less for bright material."""
    low, high = min(3800.0, sr * 0.35), min(12000.0, sr * 0.45)
    if x.shape[-1] < 16 or high <= low + 200:
        return x
    air = zero_phase(butterworth(sr, low, high), x)
    share = (rms(air) + 1e-9) / (rms(x) + 1e-9)
    calm = np.clip(0.22 / np.maximum(share, 1e-9), 0.45, 1.0)
    return x + (np.tanh(air * 3) - air * 0.35) * column(np.clip(amount, 0.0, 0.35) * 0.55 * calm)


def smooth_top(x: Array, sr: float, amount: Array) -> Array:
    a = np.clip(amount, 0.0, 0.35)
    cutoff = min(20000.0, sr * 0.46)
    if x.shape[-1] < 32 or cutoff >= sr * 0.49:
        return x
    blend = column(np.where(a > 0.03, np.clip(a * 0.65, 0.0, 0.18), 0.0))
    return x * (1 - blend) + zero_phase(butterworth(sr, None, cutoff), x) * blend


def step(x: Array, start: float, end: float) -> Array:
    t = np.clip((x - start) / (end - start), 0, 1)
    return t * t * (3 - 2 * t)


def shape(x: Array, sr: float, low_db: Array, mid_db: Array, high_db: Array) -> Array:
    """Three-band equaliser in the frequency domain."""
    n = x.shape[-1]
    f = np.fft.rfftfreq(n, 1 / sr)
    low, high = 1 - step(f, 180.0, 360.0), step(f, 3200.0, 6200.0)
    mid = np.clip(1 - low - high, 0, 1)
    gain = (column(low_db) * low + column(mid_db) * mid + column(high_db) * high) / np.maximum(low + mid + high, 1e-9)
    return np.fft.irfft(np.fft.rfft(x, axis=-1) * 10 ** (gain / 20), n, axis=-1)


def stft(x: Array, size: int, hop: int) -> Array:
    """Frames under a Hann window, the first one centred on the first sample: (tracks, frames, bins)."""
    half = size // 2
    padded = np.pad(x, [*[(0, 0)] * (x.ndim - 1), (half, half + (-x.shape[-1]) % hop)])
    window = np.hanning(size + 1)[:-1]
    frames = np.lib.stride_tricks.sliding_window_view(padded, size, axis=-1)[..., ::hop, :]
    return np.fft.rfft(frames * window, axis=-1)


def istft(spectra: Array, size: int, hop: int, length: int) -> Array:
    """Overlap-add, divided by the windows' squares."""
    window = np.hanning(size + 1)[:-1]
    frames = np.fft.irfft(spectra, size, axis=-1) * window
    count = frames.shape[-2]
    out, weight = np.zeros((*frames.shape[:-2], size + hop * (count - 1))), np.zeros(size + hop * (count - 1))
    for i in range(count):
        out[..., i * hop : i * hop + size] += frames[..., i, :]
        weight[i * hop : i * hop + size] += window**2
    half = size // 2
    return (out / np.maximum(weight, 1e-8))[..., half : half + length]


def gate(x: Array, intensity: Array, size: int, hop: int) -> Array:
    """Softens each bin of each frame that is hardly above the quiet fifth of that bin."""
    s = stft(x, size, hop)
    i = column(column(np.clip(intensity, 0.0, 1.0)))
    magnitude = np.abs(s)
    floor = np.percentile(magnitude, 20, axis=-2, keepdims=True)
    keep = magnitude >= floor * (1 + 2.5 * i)
    return np.where(column(np.asarray(intensity)) > 0, istft(s * np.where(keep, 1.0, 1 - 0.75 * i), size, hop, x.shape[-1]), x)


def bleed_cleaned(x: Array, reference: Array, sr: float, size: int, hop: int, strength: float = 0.32) -> Array:
    """Takes back bins in which the reference is the stronger of both."""
    s, r = stft(x, size, hop), np.abs(stft(reference, size, hop))
    f = np.fft.rfftfreq(size, 1 / sr)
    weight = np.clip(np.clip((f - 3500) / 4500, 0, 1) + np.clip((160 - f) / 120, 0, 1) * 0.45 + np.where((f >= 500) & (f <= 3200), 0.12, 0), 0, 1)
    bleed = np.clip((r / (np.abs(s) + r + 1e-9) - 0.52) / 0.36, 0, 1)
    return istft(s * (1 - np.clip(strength * weight * bleed, 0, 0.42)), size, hop, x.shape[-1])


def repair_clicks(x: Array, most_share: float = 0.0009) -> tuple[Array, Array]:
    """Isolated samples that stand out of the median of five and of the slope are replaced; and how many."""
    n = x.shape[-1]
    near = np.stack([np.pad(x, [(0, 0), (2, 2)])[:, k : k + n] for k in range(5)])
    residual = np.abs(x - np.median(near, axis=0))
    threshold = np.maximum((np.median(residual, axis=-1) + 1e-9) * 12, 0.055)
    slope = np.abs(np.diff(x, prepend=x[:, :1], axis=-1))
    steep = (np.percentile(slope, 95, axis=-1) + 1e-9) * 1.15
    fit = (residual > column(threshold)) & (slope >= column(steep))
    fit[:, :2] = fit[:, max(n - 2, 0) :] = False
    out, count, last = x.copy(), np.zeros(len(x), int), np.full(len(x), -8)
    most = max(24, int(n * most_share))
    for i in np.flatnonzero(fit.any(axis=0)):
        take = fit[:, i] & (i - last > 2) & (count < most)
        out[take, i] = (x[take, i - 1] + x[take, i + 1]) / 2
        count += take
        last[take] = i
    return out, count


def onset_mask(x: Array, sr: float) -> Array:
    """Where a fast envelope runs ahead of a slow one, 0 to 1."""
    focus = np.abs(high_pass(x, sr, 120.0))
    fast, slow = (run_filter((np.array([1 - d, 0.0]), np.array([1.0, -d])), focus) for d in (decay(1, sr, 0.003), decay(1, sr, 0.045)))
    onset = np.maximum(fast - slow, 0)
    return np.clip(onset / (column(np.percentile(onset, 98, axis=-1)) + 1e-9), 0, 1) ** 0.65


def crest(channels: list[Array]) -> Array:
    level = np.sqrt(np.mean([np.mean(x * x, axis=-1) for x in channels], axis=0))
    return db(sample_peak(channels) / np.maximum(level, 1e-9))


def dithered(x: Array, rng: np.random.Generator, bits: int = 16, feedback: float = 0.62) -> Array:
    """Quantised with triangular noise and first-order error feedback; other depths stay as they are."""
    if bits != 16:
        return x
    noisy = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0) + (rng.random(x.shape) - rng.random(x.shape)) / 32768
    out, error = np.empty_like(noisy), np.zeros(x.shape[:-1])
    for i in range(x.shape[-1]):
        wanted = noisy[..., i] + error * feedback
        out[..., i] = np.round(np.clip(wanted, -1, 1) * 32767) / 32767
        error = wanted - out[..., i]
    return out


def resampled(x: Array, sr: float, to: float) -> Array:
    """Band-limited: the spectrum cut or continued with zeros. Half the lower rate is one bin where its length is even, and
    counts on both sides."""
    if sr == to:
        return x
    n = x.shape[-1]
    m = max(1, int(np.ceil(n * to / sr)))
    spectrum = np.fft.rfft(x, axis=-1)[..., : m // 2 + 1]
    least = min(n, m)
    if least % 2 == 0 and m != n:
        spectrum[..., least // 2] *= 0.5 if m > n else 2.0
    return np.fft.irfft(spectrum, m, axis=-1) * (m / n)


def rational(sr: float, to: float) -> tuple[int, int]:
    """By how much to go up and down, in lowest terms."""
    ratio = Fraction(int(round(to)), int(round(sr)))
    return ratio.numerator, ratio.denominator


def polyphase_bank(up: int, down: int, lobes: int = 16, beta: float = 8.6, cut: float = 0.95) -> Array:
    """(phases, taps) of a sinc under a Kaiser window, ``lobes`` samples of the lower rate to each side; each phase sums to 1.

    Output m lies ``phase = m * down % up`` fine steps after input ``m * down // up``; tap i weighs the input i - taps // 2 before it.
    """
    scale = max(up, down)
    reach = -(-lobes * scale // up)
    t = (np.arange(up)[:, None] + up * np.arange(-reach, reach + 1)[None, :]) / scale
    h = np.sinc(t * cut) * np.i0(beta * np.sqrt(np.clip(1 - (t / lobes) ** 2, 0, None))) * (np.abs(t) <= lobes)
    return h / h.sum(axis=1, keepdims=True)


def polyphase(padded: Array, bank: Array, down: int, count: int) -> Array:
    """``count`` outputs of samples that have half a bank's taps before and after them."""
    up, taps = bank.shape
    at = np.arange(count) * down
    phase, place = at % up, at // up
    out = np.zeros((*padded.shape[:-1], count))
    for i in range(taps):
        out += bank[phase, i] * padded[..., place + taps - 1 - i]
    return out


def resampled_polyphase(x: Array, sr: float, to: float) -> Array:
    """The same as ``resampled`` by a filter bank: each output depends on its neighbourhood alone, silence beyond the ends."""
    up, down = rational(sr, to)
    if up == down:
        return x
    bank = polyphase_bank(up, down)
    reach = bank.shape[1] // 2
    return polyphase(np.pad(x, [*[(0, 0)] * (x.ndim - 1), (reach, reach + 1)]), bank, down, -(-x.shape[-1] * up // down))
