"""SQL of filters, recursions and spectra over tracks of 64 samples, for DuckDB to run on the same tables.

Each step adds columns to the one before. Recursions walk a list by ``list_reduce``; filters run sample by sample with
coefficients in closed form; spectra are sums of cosines and sines. So nothing is shared with the kernels but definitions.
"""

from __future__ import annotations

import re
from math import cos, exp, pi, sin, sqrt, tan

from ..functions.tables import DELTA_BANDS, K_HIGHPASS_HZ, K_SHELF, TRANSIENT_BANDS, WIDTH_BANDS
from . import oracles as o

N = 64
SIZE, HOP = 32, 8
FRAMES = N // HOP + 1

#: Numerator and denominator, the latter from 1 on; numbers or SQL.
Coefficients = tuple[list[float | str], list[float | str]]


def clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def butter_low(sr: float, hz: float) -> Coefficients:
    k = tan(pi * hz / sr)
    d = 1 + sqrt(2) * k + k * k
    return [k * k / d, 2 * k * k / d, k * k / d], [1.0, 2 * (k * k - 1) / d, (1 - sqrt(2) * k + k * k) / d]


def butter_high(sr: float, hz: float) -> Coefficients:
    k = tan(pi * hz / sr)
    d = 1 + sqrt(2) * k + k * k
    return [1 / d, -2 / d, 1 / d], [1.0, 2 * (k * k - 1) / d, (1 - sqrt(2) * k + k * k) / d]


def butter_band(sr: float, low: float, high: float) -> Coefficients:
    """s^2 w^2 over s^4 + r w s^3 + (2 c + w^2) s^2 + r w c s + c^2 with s = (1 - z) / (1 + z), r the root of 2."""
    a, b = tan(pi * low / sr), tan(pi * high / sr)
    w, c, r = b - a, a * b, sqrt(2)
    powers = [(1, [1, -4, 6, -4, 1]), (r * w, [1, -2, 0, 2, -1]), (2 * c + w * w, [1, 0, -2, 0, 1]), (r * w * c, [1, 2, 0, -2, -1]), (c * c, [1, 4, 6, 4, 1])]
    den = [sum(f * p[i] for f, p in powers) for i in range(5)]
    return [w * w * v / den[0] for v in (1, 0, -2, 0, 1)], [v / den[0] for v in den]


def shelf(sr: float) -> Coefficients:
    hz, gain, q = clamp(K_SHELF[0], 20.0, sr * 0.45), 10 ** (K_SHELF[1] / 40), K_SHELF[2]
    w = 2 * pi * hz / sr
    alpha = sin(w) / (2 * q)
    root = 2 * sqrt(gain) * alpha
    b = [gain * ((gain + 1) + (gain - 1) * cos(w) + root), -2 * gain * ((gain - 1) + (gain + 1) * cos(w)), gain * ((gain + 1) + (gain - 1) * cos(w) - root)]
    a = [(gain + 1) - (gain - 1) * cos(w) + root, 2 * ((gain - 1) - (gain + 1) * cos(w)), (gain + 1) - (gain - 1) * cos(w) - root]
    return [v / a[0] for v in b], [v / a[0] for v in a]


def number(v: float | str) -> str:
    return f"({v})" if isinstance(v, str) else f"({v!r}::DOUBLE)"


def each(expression: str, *lists: str) -> str:
    """A list from lists of one length; %1, %2... stand for their items."""
    for k, x in enumerate(lists):
        expression = expression.replace(f"%{k + 1}", f"{x}[i]")
    return f"[{expression} for i in range(1, len({lists[0]}) + 1)]"


def peak(*lists: str) -> str:
    tops = [f"list_max([abs(v) for v in {x}])" for x in lists]
    return tops[0] if len(tops) == 1 else f"greatest({', '.join(tops)})"


def percentile(x: str, n: int, share: float) -> str:
    at = (n - 1) * share
    k = int(at)
    s = f"list_sort({x})"
    return f"({s}[{k + 1}] + ({s}[{min(k + 2, n)}] - {s}[{k + 1}]) * {number(at - k)})"


def decay(samples: float, sr: float, seconds: float) -> float:
    return exp(-samples / max(sr * seconds, 1.0))


def step(f: float, low: float, high: float) -> float:
    t = clamp((f - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


class Steps:
    """Columns that build on each other. Those that need no other of their kind stand in one select, what builds on them in
    the next one, and so on."""

    def __init__(self, *first: str):
        self.parts, self.last = list(first), first[-1].split(" AS ")[0].strip()
        self.levels: list[dict[str, str]] = []
        self.level_of: dict[str, int] = {}
        self.kernels: dict[int, str] = {}

    def add(self, **columns: str) -> None:
        for name, expression in columns.items():
            level = max((self.level_of[w] + 1 for w in re.findall(r"\w+", expression) if w in self.level_of), default=0)
            self.level_of[name] = level
            if level == len(self.levels):
                self.levels.append({})
            self.levels[level][name] = expression

    def new(self, expression: str) -> str:
        """The name of a new column."""
        name = f"x{len(self.level_of) + 1}"
        self.add(**{name: expression})
        return name

    def tables(self) -> tuple[list[str], str]:
        """All parts of a WITH, and the name of the last one."""
        parts, last = list(self.parts), self.last
        for k, level in enumerate(self.levels):
            name = f"step{len(self.parts)}_{k}"
            parts.append(f"{name} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {c}' for c, e in level.items())} FROM {last})")
            last = name
        return parts, last

    def sql(self, *columns: str, **named: str) -> str:
        """The columns as they are, and the named ones rounded."""
        parts, last = self.tables()
        return f"WITH {', '.join(parts)} SELECT {', '.join([*(columns or ['track']), *(f'round({e}, 6) + 0.0 AS {c}' for c, e in named.items())])} FROM {last}"

    # filters

    def filtered(self, x: str, coefficients: Coefficients) -> str:
        """Causal, from silence."""
        b, a = coefficients
        m = len(b) - 1
        zeros = f"[{', '.join(['0.0'] * m)}]::DOUBLE[]"
        px = self.new(f"list_concat({zeros}, {x})")
        at = "CAST(v[1] AS BIGINT)"
        terms = [f"{number(c)} * {px}[{at} - {k}]" for k, c in enumerate(b) if c] + [f"-{number(c)} * s[{at} - {k + 1}]" for k, c in enumerate(a[1:])]
        walk = f"list_reduce(list_prepend({zeros}, [[i::DOUBLE] for i in range({m + 1}, len({px}) + 1)]), lambda s, v: list_append(s, {' + '.join(terms)}))"
        return self.new(f"({walk})[{m + 1}:]")

    def zero_phase(self, x: str, coefficients: Coefficients) -> str:
        pad = min(6 * len(coefficients[0]), N - 1)
        ends = [f"[2 * {x}[1] - {x}[{pad + 2} - i] for i in range(1, {pad + 1})]", x, f"[2 * {x}[{N}] - {x}[{N} - i] for i in range(1, {pad + 1})]"]
        once = self.filtered(self.new(f"list_concat(list_concat({ends[0]}, {ends[1]}), {ends[2]})"), coefficients)
        twice = self.filtered(self.new(f"list_reverse({once})"), coefficients)
        return self.new(f"list_reverse({twice})[{pad + 1}:{pad + N}]")

    def low(self, x: str, sr: float, hz: float) -> str:
        return self.zero_phase(x, butter_low(sr, clamp(hz, 20.0, sr * 0.45)))

    def high(self, x: str, sr: float, hz: float) -> str:
        return self.zero_phase(x, butter_high(sr, min(hz, sr * 0.45)))

    def band(self, x: str, sr: float, low: float, high: float) -> str:
        low = clamp(low, 20.0, sr * 0.45)
        high = clamp(high, low + 50.0, max(low + 50.0, sr * 0.48))
        if high <= low + 20.0 or high >= sr / 2:
            return self.new(f"[0.0::DOUBLE for v in {x}]")
        return self.zero_phase(x, butter_band(sr, low, high))

    # recursions

    def envelope(self, goal: str, start: str, fall: float, rise: float) -> str:
        now = "s[len(s)]"
        walk = f"list_reduce(list_prepend([{start}]::DOUBLE[], [[v] for v in {goal}]), lambda s, v: list_append(s, v[1] + ({now} - v[1]) * CASE WHEN v[1] < {now} THEN {number(fall)} ELSE {number(rise)} END))"
        return self.new(f"({walk})[2:]")

    def limit(self, channels: list[str], ceiling_db: str, sr: float) -> list[str]:
        c = self.new(f"10 ** (({ceiling_db}) / 20)")
        linked = self.new(each("greatest(abs(%1), abs(%2))", *channels))
        gain = self.new(f"[least(1.0::DOUBLE, {c} / (v + 1e-12)) for v in {linked}]")
        ahead = 2 * max(1, round(sr * 0.004))
        least = self.new(f"[list_min({gain}[i:least(i + {ahead}, {N})]) for i in range(1, {N + 1})]")
        smooth = self.envelope(least, "1.0", decay(1, sr, 0.0015), decay(1, sr, 0.090))
        return [self.new(f"CASE WHEN list_max({linked}) > {c} THEN {each(f'greatest(least(%1 * %2, {c}), -{c})', x, smooth)} ELSE {x} END") for x in channels]

    def trimmed(self, channels: list[str], top: str, ceiling_db: str) -> tuple[list[str], str]:
        gain = self.new(f"CASE WHEN {top} > 10 ** (({ceiling_db}) / 20) AND {top} > 1e-9 THEN 10 ** (({ceiling_db}) / 20) / {top} ELSE 1.0::DOUBLE END")
        return [self.new(f"[v * {gain} for v in {x}]") for x in channels], gain

    # levels

    def sample_peak(self, channels: list[str]) -> str:
        return self.new(f"greatest({', '.join(f'list_max([abs(v) for v in {x}])' for x in channels)})")

    def true_peak(self, channels: list[str], factor: int = 4) -> str:
        """By the interpolation kernel of 64 periodic samples."""
        total = N * factor
        if factor not in self.kernels:
            self.kernels[factor] = self.new(f"[(1 + 2 * list_sum([cos(2 * pi() * k * j / {total}) for k in range(1, {N // 2})]) + cos(pi() * j / {factor})) / {N} for j in range(0, {total})]")
        d = self.kernels[factor]
        tops = [f"list_max([abs(list_sum([{x}[n + 1] * {d}[((j - {factor} * n + {total}) % {total}) + 1] for n in range(0, {N})])) for j in range(0, {total})])" for x in channels]
        return self.new(f"greatest({', '.join(tops)})" if len(tops) > 1 else tops[0])

    def loudness(self, channels: list[str], sr: float) -> str:
        """Weighted and gated twice; a track shorter than a block is one block."""
        weighted = [self.filtered(self.filtered(x, shelf(sr)), butter_high(sr, clamp(K_HIGHPASS_HZ, 10.0, sr * 0.45))) for x in channels]
        energy = self.new(f"[{' + '.join(f'{w}[i] ** 2' for w in weighted)} for i in range(1, {N + 1})]")
        raw = self.new(f"sqrt(({' + '.join(f'list_avg([v * v for v in {x}])' for x in channels)}) / {len(channels)})")
        block = max(round(sr * 0.4), 1)
        if block > N:
            loud = o.lu(f"list_avg({energy}) / {len(channels)}")
            return self.new(f"CASE WHEN {raw} <= 1e-12 THEN {o.db(raw)} - 0.691 ELSE {loud} END")
        hop = max(round(block * 0.25), 1)
        e = self.new(f"[list_avg({energy}[i + 1:i + {block}]) for i in range(0, {N - block + 1}, {hop})]")
        loud = self.new(f"[b for b in {e} if {o.lu('b')} > -70]")
        kept = self.new(f"[b for b in {loud} if {o.lu('b')} > {o.lu(f'list_avg({loud})')} - 10]")
        return self.new(f"CASE WHEN len({loud}) = 0 OR {raw} <= 1e-12 THEN {o.db(raw)} - 0.691 ELSE {o.lu(f'coalesce(list_avg({kept}), list_avg({loud}))')} END")

    def crest(self, channels: list[str]) -> str:
        level = f"sqrt(({' + '.join(f'list_avg([v * v for v in {x}])' for x in channels)}) / {len(channels)})"
        return self.new(o.db(f"{peak(*channels)} / greatest({level}, 1e-9)"))

    # spectra

    def shape(self, x: str, sr: float, low: str, mid: str, high: str) -> str:
        """A gain for each bin, as a circular convolution."""
        bins = []
        for k in range(N // 2 + 1):
            f = k * sr / N
            a, c = 1 - step(f, 180.0, 360.0), step(f, 3200.0, 6200.0)
            b = clamp(1 - a - c, 0, 1)
            all_ = max(a + b + c, 1e-9)
            bins.append(f"10 ** ((({low}) * {number(a / all_)} + ({mid}) * {number(b / all_)} + ({high}) * {number(c / all_)}) / 20)")
        g = self.new(f"[{', '.join(bins)}]")
        c = self.new(f"[({g}[1] + 2 * list_sum([{g}[k + 1] * cos(2 * pi() * k * n / {N}) for k in range(1, {N // 2})]) + {g}[{N // 2 + 1}] * cos(pi() * n)) / {N} for n in range(0, {N})]")
        return self.new(f"[list_sum([{x}[n + 1] * {c}[((i - n + {N}) % {N}) + 1] for n in range(0, {N})]) for i in range(0, {N})]")

    def stft(self, x: str) -> tuple[str, str]:
        """Real and imaginary parts, frame by frame and bin by bin in one list."""
        half = SIZE // 2
        zeros = f"[0.0::DOUBLE for i in range(0, {half})]"
        p = self.new(f"list_concat(list_concat({zeros}, {x}), {zeros})")
        w = f"(0.5 - 0.5 * cos(2 * pi() * j / {SIZE}))"
        part = lambda f: self.new(f"flatten([[list_sum([{w} * {p}[f * {HOP} + j + 1] * {f}(2 * pi() * k * j / {SIZE}) for j in range(0, {SIZE})]) for k in range(0, {half + 1})] for f in range(0, {FRAMES})])")
        return part("cos"), part("-sin")

    def istft(self, spectrum: tuple[str, str], gain: str) -> str:
        """Overlap-add of the frames times ``gain``, a list like the parts."""
        re, im = spectrum
        half, bins = SIZE // 2, SIZE // 2 + 1
        w = lambda j: f"(0.5 - 0.5 * cos(2 * pi() * ({j}) / {SIZE}))"
        weight = f"CASE WHEN k = 0 OR k = {half} THEN 1 ELSE 2 END"
        cell = f"f * {bins} + k + 1"
        turn = f"2 * pi() * k * j / {SIZE}"
        frames = self.new(f"[[{w('j')} * list_sum([{weight} * {gain}[{cell}] * ({re}[{cell}] * cos({turn}) - {im}[{cell}] * sin({turn})) for k in range(0, {bins})]) / {SIZE} for j in range(0, {SIZE})] for f in range(0, {FRAMES})]")
        inside = f"[f for f in range(0, {FRAMES}) if t + {half} - f * {HOP} >= 0 AND t + {half} - f * {HOP} < {SIZE}]"
        return self.new(f"[list_sum([{frames}[f + 1][t + {half} - f * {HOP} + 1] for f in {inside}]) / greatest(list_sum([{w(f't + {half} - f * {HOP}')} ** 2 for f in {inside}]), 1e-8) for t in range(0, {N})]")

    def onset(self, x: str, sr: float) -> str:
        focus = self.new(f"[abs(v) for v in {self.high(x, sr, 120.0)}]")
        fast, slow = (self.filtered(focus, ([1 - d, 0.0], [1.0, -d])) for d in (decay(1, sr, 0.003), decay(1, sr, 0.045)))
        rise = self.new(each("greatest(%1 - %2, 0)", fast, slow))
        top = self.new(percentile(rise, N, 0.98))
        return self.new(f"[greatest(least(v / ({top} + 1e-9), 1), 0) ** 0.65 for v in {rise}]")

    # stages

    def gate(self, x: str, intensity: str) -> str:
        bins = SIZE // 2 + 1
        spectrum = self.stft(x)
        size = self.new(each("sqrt(%1 ** 2 + %2 ** 2)", *spectrum))
        floor = self.new(f"[{percentile(f'[{size}[f * {bins} + k + 1] for f in range(0, {FRAMES})]', FRAMES, 0.2)} for k in range(0, {bins})]")
        gain = self.new(f"[CASE WHEN {size}[i] >= {floor}[(i - 1) % {bins} + 1] * (1 + 2.5 * ({intensity})) THEN 1.0::DOUBLE ELSE 1 - 0.75 * ({intensity}) END for i in range(1, {FRAMES * bins + 1})]")
        return self.new(f"CASE WHEN ({intensity}) > 0 THEN {self.istft(spectrum, gain)} ELSE {x} END")

    def compress(self, x: str, sr: float, ratio: str) -> str:
        """For rates at which a track is two blocks."""
        block = lambda k: f"{x}[{1 + 32 * k}:{32 + 32 * k}]"
        levels = [o.db(f"greatest(sqrt(list_avg([v * v for v in {block(k)}])), list_max([abs(v) for v in {block(k)}]) * 0.55)") for k in (0, 1)]
        level, slope = self.new(f"[{', '.join(levels)}]"), self.new(f"1 - 1 / ({ratio})")
        over, into = "(v + 15)", "greatest(least(v + 18.5, 7), 0)"
        goal = self.new(f"[-least(CASE WHEN {over} >= 3.5 THEN {over} * {slope} ELSE {slope} * {into} ** 2 / 14 END, 7.0::DOUBLE) for v in {level}]")
        g = self.envelope(goal, "0.0", decay(32, sr, 0.018), decay(32, sr, 0.16))
        return self.new(f"CASE WHEN ({ratio}) > 1.01 THEN [{x}[i + 1] * 10 ** (({g}[1] + ({g}[2] - {g}[1]) * least(i / 32.0::DOUBLE, 1)) / 20) for i in range(0, {N})] ELSE {x} END")

    def saturate(self, x: str, amount: str) -> str:
        a = self.new(o.clip(amount, 0.0, 0.35))
        bent = f"tanh(v * (1 + 5 * {a})) / tanh(1 + 5 * {a}) * {a}"
        return self.new(f"[v * (1 - {a}) + CASE WHEN {a} > 0 THEN {bent} ELSE 0 END for v in {x}]")

    def smooth_top(self, x: str, sr: float, amount: str) -> str:
        a = self.new(o.clip(amount, 0.0, 0.35))
        blend = self.new(f"CASE WHEN {a} > 0.03 THEN {o.clip(f'{a} * 0.65', 0.0, 0.18)} ELSE 0.0::DOUBLE END")
        return self.new(each(f"%1 * (1 - {blend}) + %2 * {blend}", x, self.zero_phase(x, butter_low(sr, min(20_000.0, sr * 0.46)))))

    def excite(self, x: str, sr: float, amount: str) -> str:
        air = self.zero_phase(x, butter_band(sr, min(3_800.0, sr * 0.35), min(12_000.0, sr * 0.45)))
        calm = o.clip(f"0.22 / greatest(({o.lrms(air)} + 1e-9) / ({o.lrms(x)} + 1e-9), 1e-9)", 0.45, 1.0)
        by = self.new(f"{o.clip(amount, 0.0, 0.35)} * 0.55 * {calm}")
        return self.new(each(f"%1 + (tanh(%2 * 3) - %2 * 0.35) * {by}", x, air))

    def cut_below(self, x: str, sr: float, hz: str) -> str:
        """High-pass at a cutoff of each row; nothing to do up to 20 Hz."""
        k = self.new(f"tan(pi() * least({hz}, {sr * 0.45}) / {sr})")
        d = f"(1 + sqrt(2.0::DOUBLE) * {k} + {k} * {k})"
        c = [self.new(v) for v in (f"1 / {d}", f"-2 / {d}", f"2 * ({k} * {k} - 1) / {d}", f"(1 - sqrt(2.0::DOUBLE) * {k} + {k} * {k}) / {d}")]
        return self.new(f"CASE WHEN ({hz}) > 20 THEN {self.zero_phase(x, ([c[0], c[1], c[0]], [1.0, c[2], c[3]]))} ELSE {x} END")

    def repair_clicks(self, x: str) -> tuple[str, str]:
        """The repaired samples and the places of the clicks."""
        px = self.new(f"list_concat(list_concat([0.0, 0.0]::DOUBLE[], {x}), [0.0, 0.0]::DOUBLE[])")
        residual = self.new(f"[abs({x}[i] - list_sort({px}[i:i + 4])[3]) for i in range(1, {N + 1})]")
        slope = self.new(f"[CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE abs({x}[i] - {x}[greatest(i - 1, 1)]) END for i in range(1, {N + 1})]")
        threshold, steep = self.new(f"greatest(({percentile(residual, N, 0.5)} + 1e-9) * 12, 0.055)"), self.new(f"({percentile(slope, N, 0.95)} + 1e-9) * 1.15")
        fit = self.new(f"[i for i in range(3, {N - 1}) if {residual}[i] > {threshold} AND {slope}[i] >= {steep}]")
        taken = self.new(f"list_reduce(list_prepend([-7::BIGINT], [[i] for i in {fit}]), lambda c, v: CASE WHEN v[1] - c[len(c)] > 2 AND len(c) < 25 THEN list_append(c, v[1]) ELSE c END)[2:]")
        return self.new(f"[CASE WHEN list_contains({taken}, i) THEN ({x}[i - 1] + {x}[i + 1]) / 2 ELSE {x}[i] END for i in range(1, {N + 1})]"), taken

    def where(self, rule: str, yes: list[str], no: list[str]) -> list[str]:
        return [self.new(f"CASE WHEN {rule} THEN {a} ELSE {b} END") for a, b in zip(yes, no)]

    # guards

    def width(self, mid: str, side: str) -> str:
        return self.new(f"{o.lrms(side)} / ({o.lrms(mid)} + 1e-9)")

    def mid_side(self, x: list[str]) -> list[str]:
        return [self.new(each(f"(%1 {sign} %2) / 2", *x)) for sign in "+-"]

    def left_right(self, x: list[str]) -> list[str]:
        return [self.new(each(f"%1 {sign} %2", *x)) for sign in "+-"]

    def channel_balance(self, source: list[str], done: list[str]) -> list[str]:
        levels = [[self.new(o.lrms(c)) for c in x] for x in (source, done)]
        share = lambda x, i: f"({x[i]} / (({x[0]} + {x[1]}) / 2 + 1e-9))"
        heard = " AND ".join(f"greatest({x[0]}, {x[1]}) > 1e-9" for x in levels)
        gains = [self.new(f"CASE WHEN {heard} THEN {o.clip(f'{share(levels[0], i)} / ({share(levels[1], i)} + 1e-9)', 0.5, 2.0)} ELSE 1.0::DOUBLE END") for i in (0, 1)]
        return [self.new(f"[v * {g} for v in {c}]") for c, g in zip(done, gains)]

    def width_match(self, source: list[str], done: list[str]) -> list[str]:
        before, (mid, side) = self.width(*self.mid_side(source)), self.mid_side(done)
        now = self.width(mid, side)
        gain = self.new(f"CASE WHEN {o.lrms(side)} > 1e-9 THEN {o.clip(f'{before} / ({now} + 1e-9)', 0.25, 4.0)} ELSE 1.0::DOUBLE END")
        return self.left_right([mid, self.new(f"[v * {gain} for v in {side}]")])

    def low_bass(self, source: list[str], done: list[str], sr: float, hz: float = 130.0) -> tuple[list[str], str]:
        mid, side = self.mid_side(done)
        before = self.width(*(self.low(c, sr, hz) for c in self.mid_side(source)))
        low = self.low(side, sr, hz)
        now = self.width(self.low(mid, sr, hz), low)
        allowed = self.new(f"greatest({before} * 1.25, 0.10)")
        gain = self.new(f"CASE WHEN {now} > {allowed} AND {now} > 1e-9 THEN {o.clip(f'{allowed} / greatest({now}, 1e-9)', 0.35, 1.0)} ELSE 1.0::DOUBLE END")
        return self.left_right([mid, self.new(each(f"%1 - %2 * (1 - {gain})", side, low))]), gain

    def banded(self, source: list[str], done: list[str], sr: float, bands, tolerance: float, gains: tuple[float, float], floor: float, least_source: float) -> list[str]:
        (sm, ss), (dm, ds) = self.mid_side(source), self.mid_side(done)
        side = ds
        for low, high, least, most in bands:
            high = min(high, sr * 0.45)
            if high <= low + 40.0:
                continue
            before = self.width(self.band(sm, sr, low, high), self.band(ss, sr, low, high))
            own = self.band(ds, sr, low, high)
            now = self.width(self.band(dm, sr, low, high), own)
            relative = self.new(f"{now} / greatest({before}, {number(floor)})")
            wanted = self.new(o.clip(relative, least, most))
            off = f"abs({wanted} - {relative}) >= {number(tolerance)} AND {now} > 1e-9 AND {before} > {number(least_source)}"
            gain = self.new(f"CASE WHEN {off} THEN {o.clip(f'{wanted} / greatest({relative}, 1e-12)', *gains)} ELSE 1.0::DOUBLE END")
            side = self.new(each(f"%1 + %2 * ({gain} - 1)", side, own))
        return self.left_right([dm, side])

    def band_widths(self, source: list[str], done: list[str], sr: float) -> list[str]:
        return self.banded(source, done, sr, WIDTH_BANDS, 0.03, (0.45, 1.35), 1e-9, 1e-5)

    def correlation(self, x: list[str]) -> str:
        both = f"list_avg({each('%1 * %2', *x)})"
        return self.new(o.clip(f"{both} / (({o.lrms(x[0])} + 1e-9) * ({o.lrms(x[1])} + 1e-9))", -1.0, 1.0))

    def band_deltas(self, source: list[str], done: list[str], sr: float) -> list[str]:
        out = self.banded(source, done, sr, DELTA_BANDS, 0.025, (0.35, 1.25), 1e-6, -1.0)
        before, now = self.correlation(source), self.correlation(out)
        mid, side = self.mid_side(out)
        gain = f"CASE WHEN {now} < {before} - 0.28 OR {now} < -0.08 THEN 0.88::DOUBLE ELSE 1.0::DOUBLE END"
        return self.left_right([mid, self.new(f"[v * {gain} for v in {side}]")])

    def tilt(self, source: list[str], done: list[str], sr: float) -> tuple[list[str], str]:
        high = min(5200.0, sr * 0.45)
        lean = lambda x: "({} + 1e-9) / ({} + 1e-9)".format(*(o.lrms(self.band(c, sr, 3000.0, high)) for c in x))
        drift = self.new(f"{o.db(lean(done))} - {o.db(lean(source))}")
        fix = self.new(f"CASE WHEN abs({drift}) >= 0.45 THEN {o.clip(f'-{drift} * 0.45', -1.0, 1.0)} ELSE 0.0::DOUBLE END")
        return [self.new(f"[v * 10 ** ({sign}{fix} / 40) for v in {c}]") for sign, c in zip(("", "-"), done)], drift

    def delta(self, source: list[str], done: list[str], sr: float, amount: str) -> list[str]:
        change = [self.new(each("%2 - %1", s, d)) for s, d in zip(source, done)]
        most, top = self.new(f"greatest({peak(*source)} * 0.65, 0.05)"), self.new(peak(*change))
        scale = self.new(f"{o.clip(amount, 0, 1)} * CASE WHEN {top} > {most} THEN {most} / greatest({top}, 1e-9) ELSE 1.0::DOUBLE END")
        out = [self.new(each(f"%1 + %2 * {scale}", s, c)) for s, c in zip(source, change)]
        return self.tilt(source, self.band_deltas(source, out, sr), sr)[0]

    def band_shares(self, x: list[str], sr: float) -> list[str]:
        """Low, mid and high share of the power."""
        sums = [f"(list_sum([{c}[n + 1] * cos(2 * pi() * k * n / {N}) for n in range(0, {N})]) ** 2 + list_sum([{c}[n + 1] * sin(2 * pi() * k * n / {N}) for n in range(0, {N})]) ** 2)" for c in x]
        power = self.new(f"[({' + '.join(sums)}) / {len(x)} for k in range(0, {N // 2 + 1})]")
        parts = []
        for low, high in ((20, 250), (250, 4000), (4000, min(sr / 2, 20000))):
            inside = [k for k in range(N // 2 + 1) if low <= k * sr / N < high]
            parts.append(self.new(" + ".join(f"{power}[{k + 1}]" for k in inside) or "0.0::DOUBLE"))
        return [self.new(f"{p} / greatest({' + '.join(parts)}, 1e-9)") for p in parts]

    def band_balance(self, source: list[str], done: list[str], sr: float) -> list[str]:
        lost = [self.new(f"{b} - {a}") for b, a in zip(self.band_shares(source, sr), self.band_shares(done, sr))]
        drift = self.new(f"greatest({', '.join(f'abs({v})' for v in lost)})")
        strength = self.new(f"CASE WHEN {drift} >= 0.12 THEN {o.clip(f'({drift} - 0.08) / 0.20', 0.0, 0.65)} ELSE 0.0::DOUBLE END")
        gains = [self.new(f"{o.clip(f'{v} * {f}', -m, m)} * {strength}") for v, (f, m) in zip(lost, ((7.0, 2.0), (5.0, 1.5), (6.0, 2.0)))]
        return [self.new(f"CASE WHEN {strength} > 0 THEN {self.shape(c, sr, *gains)} ELSE {c} END") for c in done]

    def band_limited(self, source: str, done: str, sr: float, low: float, high: float, times: float, floor: float, least: float) -> tuple[str, str]:
        high = min(high, sr * 0.45)
        own = self.band(done, sr, low, high)
        now = self.new(f"{o.lrms(own)} / ({o.lrms(done)} + 1e-9)")
        before = self.new(f"{o.lrms(self.band(source, sr, low, high))} / ({o.lrms(source)} + 1e-9)")
        allowed = self.new(f"greatest({before} * {times}, {floor})")
        gain = self.new(f"CASE WHEN {now} > greatest({allowed}, 1e-9) THEN {o.clip(f'{allowed} / greatest({now}, 1e-9)', least, 1.0)} ELSE 1.0::DOUBLE END")
        return self.new(each(f"%1 - %2 * (1 - {gain})", done, own)), gain

    def harshness(self, source: str, done: str, sr: float, bright: bool = False) -> tuple[str, str]:
        return self.band_limited(source, done, sr, 3600.0, 9200.0, 1.55 if bright else 1.28, 0.075 if bright else 0.055, 10 ** (-1.35 / 20))

    def sibilance(self, source: str, done: str, sr: float) -> tuple[str, str]:
        return self.band_limited(source, done, sr, 5200.0, 10500.0, 1.35, 0.10, 0.5)

    def transients(self, source: list[str], done: list[str], sr: float) -> tuple[list[str], str]:
        loss = self.new(f"{self.crest(source)} - {self.crest(done)}")
        strength = self.new(f"CASE WHEN {loss} > 1.2 THEN {o.clip(f'({loss} - 0.8) / 10', 0.0, 0.16)} ELSE 0.0::DOUBLE END")
        mask = self.onset(self.mid_side(source)[0], sr)
        out = [self.new(each(f"%1 + (%2 - %3) * %4 * {strength}", d, self.high(s, sr, 120.0), self.high(d, sr, 120.0), mask)) for s, d in zip(source, done)]
        return out, self.new(f"CASE WHEN {loss} > 1.2 THEN {loss} ELSE 0.0::DOUBLE END")

    def band_transients(self, source: str, done: str, sr: float) -> str:
        out = done
        for low, high, most in TRANSIENT_BANDS:
            high = min(high, sr * 0.45)
            if high > low + 30.0:
                s, d = self.band(source, sr, low, high), self.band(done, sr, low, high)
                loss = self.new(f"{self.crest([s])} - {self.crest([d])}")
                blend = self.new(f"CASE WHEN {loss} > 1.0 THEN {o.clip(f'({loss} - 0.8) / 12', 0.0, most)} ELSE 0.0::DOUBLE END")
                out = self.new(each(f"%1 + (%2 - %3) * %4 * {blend}", out, s, d, self.onset(s, sr)))
        return out

    def dynamic_eq(self, source: str, done: str, sr: float, target: str = "") -> str:
        bins = SIZE // 2 + 1
        spectrum = self.stft(done)
        power = [self.new(each("%1 ** 2 + %2 ** 2", *x)) for x in (self.stft(source), spectrum)]
        freq = [k * sr / SIZE for k in range(bins)]
        masks, gains = [], []
        for (a, b), (low, high), threshold, most in (
            ((45.0, 220.0), (45.0, 240.0), 0.050, 1.45 * (0.75 if target == "bass_boost" else 1.0)),
            ((220.0, 650.0), (220.0, 760.0), 0.045, 1.10),
            ((2600.0, 7200.0), (2600.0, 7800.0), 0.040, 0.75 if target == "hifi_bright" else 1.45),
        ):
            inside = [k for k in range(bins) if a <= freq[k] < b]
            share = lambda p: self.new(
                f"[(({' + '.join(f'{p}[f * {bins} + {k + 1}]' for k in inside) or '0.0'}) / {max(len(inside), 1)}) / (list_avg({p}[f * {bins} + 1:(f + 1) * {bins}]) + 1e-12) for f in range(0, {FRAMES})]"  # noqa: B023
            )
            before, now = map(share, power)
            goal = self.new(each(f"10 ** (-{o.clip(f'(%2 - %1 - {threshold}) * 16', 0, most)} / 20)", before, now))
            gains.append(self.envelope(goal, "1.0", decay(HOP, sr, 0.012), decay(HOP, sr, 0.110)))
            masks.append([clamp(step(f, low * 0.82, low) * (1 - step(f, high, high * 1.22)), 0, 1) for f in freq])
        table = [self.new(f"[{', '.join(number(v) for v in m)}]") for m in masks]
        whole = " * ".join(f"(1 - {t}[k + 1] * (1 - {g}[f + 1]))" for t, g in zip(table, gains))
        return self.istft(spectrum, self.new(f"flatten([[{whole} for k in range(0, {bins})] for f in range(0, {FRAMES})])"))

    def loudness_match(self, source: list[str], done: list[str], sr: float, ceiling_db: str, most_boost: float = 8.0) -> tuple[list[str], str]:
        wanted = self.new(o.clip(f"{self.loudness(source, sr)} - {self.loudness(done, sr)}", -18.0, most_boost))
        top = self.new(f"greatest({self.true_peak(done, 2)}, {peak(*done)}, 1e-9)")
        gain = self.new(f"CASE WHEN abs({wanted}) < 0.05 THEN 0.0::DOUBLE ELSE least({wanted}, ({ceiling_db}) - {o.db(top)}) END")
        out = self.limit([self.new(f"[v * 10 ** ({gain} / 20) for v in {c}]") for c in done], ceiling_db, sr)
        out, cut = self.trimmed(out, self.true_peak(out), ceiling_db)
        return out, self.new(f"{gain} + {o.db(cut)}")

    def loudness_set(self, done: list[str], sr: float, target: str, ceiling_db: str, drive_db: float = 1.5) -> tuple[list[str], str]:
        wanted = o.clip(f"({target}) - {self.loudness(done, sr)}", -18.0, 18.0)
        level = f"sqrt(({' + '.join(f'list_avg([v * v for v in {x}])' for x in done)}) / {len(done)})"
        gain = self.new(f"CASE WHEN {level} <= 1e-9 THEN 0.0::DOUBLE ELSE least({wanted}, ({ceiling_db}) + {drive_db} - {o.db(self.true_peak(done, 2))}) END")
        return [self.new(f"[v * 10 ** ({gain} / 20) for v in {c}]") for c in done], gain

    def safe(self, done: list[str], sr: float, ceiling_db: str, strict: str) -> list[str]:
        ceiling_db = f"least({ceiling_db}, -1.4::DOUBLE)"
        out = list(done)
        for round_ in range(4):
            over = self.new(f"{o.db(f'greatest({self.true_peak(out)}, {peak(*out)})')} > {ceiling_db} AND ({round_} < 2 OR {strict})")
            now = self.limit(out, ceiling_db, sr)
            now = self.trimmed(now, self.true_peak(now), ceiling_db)[0]
            now = self.trimmed(now, self.new(peak(*now)), ceiling_db)[0]
            out = self.where(over, now, out)
        return self.trimmed(out, self.new(f"greatest({self.true_peak(out)}, {peak(*out)})"), ceiling_db)[0]


def loud_pairs() -> Steps:
    """Tracks three times as loud, with an amount ``m`` from 0 to 7/8 by their number."""
    return Steps(o.PAIR, "loud AS (SELECT track, [3 * v for v in l] AS a, [3 * v for v in r] AS b, (track % 8) / 8.0::DOUBLE AS m FROM p)")


def driven() -> Steps:
    """With a copy (da, db) that was driven, narrowed and tilted."""
    s = loud_pairs()
    s.add(da="[tanh(2 * v) * (1 + m) for v in a]", db="[tanh(2 * v) for v in b]")
    return s


# The queries


def k_weighted_loudness() -> str:
    s = loud_pairs()
    short, long = s.loudness(["a", "b"], 400.0), s.loudness(["a", "b"], 101.0)
    return s.sql(lufs=short, gated_lufs=long, true_peak_db=o.db(s.true_peak(["a", "b"])))


def compressor() -> str:
    s = loud_pairs()
    y = s.compress("a", 2_000.0, "1 + 3 * m")
    return s.sql(rms=o.lrms(y), crest_db=s.crest([y]))


def limiter() -> str:
    s = loud_pairs()
    out = s.limit(["a", "b"], "-6 * m - 1", 2_000.0)
    return s.sql(peak=peak(*out), rms=o.lrms(out[0]))


def spectral_gate() -> str:
    s = loud_pairs()
    bins, half = SIZE // 2 + 1, SIZE // 2
    gated = s.gate("a", "m")
    spectrum, other = s.stft("a"), s.stft("b")
    size, reference = (s.new(each("sqrt(%1 ** 2 + %2 ** 2)", *x)) for x in (spectrum, other))
    weights = []
    for k in range(half + 1):
        f = k * 8_000.0 / SIZE
        weights.append(clamp(clamp((f - 3500) / 4500, 0, 1) + clamp((160 - f) / 120, 0, 1) * 0.45 + (0.12 if 500 <= f <= 3200 else 0), 0, 1))
    weight = s.new(f"[{', '.join(number(w) for w in weights)}]")
    bleed = o.clip(f"({reference}[i] / ({size}[i] + {reference}[i] + 1e-9) - 0.52) / 0.36", 0, 1)
    kept = s.new(f"[1 - {o.clip(f'0.32 * {weight}[(i - 1) % {bins} + 1] * {bleed}', 0, 0.42)} for i in range(1, {FRAMES * bins + 1})]")
    return s.sql(rms=o.lrms(gated), cleaned_rms=o.lrms(s.istft(spectrum, kept)))


def tone_and_harmonics() -> str:
    s = loud_pairs()
    shaped = s.shape(s.high("a", 8_000.0, 80.0), 8_000.0, "6 * m", "-3 * m", "3 * m")
    smooth = s.smooth_top(s.excite(s.saturate(shaped, "m"), 48_000.0, "m"), 48_000.0, "m")
    # 96 samples for 64: the same cosines and sines at closer times, that of half the old rate halved
    d = s.new("[(1 + 2 * list_sum([cos(2 * pi() * k * j / 192) for k in range(1, 32)]) + cos(pi() * j / 3)) / 64 for j in range(0, 192)]")
    finer = s.new(f"[list_sum([a[n + 1] * {d}[((2 * j - 3 * n + 192) % 192) + 1] for n in range(0, 64)]) for j in range(0, 96)]")
    return s.sql(shaped_rms=o.lrms(shaped), excited_rms=o.lrms(smooth), resampled_rms=o.lrms(finer), resampled_peak=peak(finer))


def click_repair() -> str:
    s = loud_pairs()
    fixed, taken = s.repair_clicks("a")
    return s.sql(clicks=f"len({taken})::DOUBLE", rms=o.lrms(fixed), onset=f"list_avg({s.onset('a', 8_000.0)})")


def comparison_guards(part: str) -> str:
    """The guards are many, so they stand in three statements."""
    s, sr, source, done = driven(), 8_000.0, ["a", "b"], ["da", "db"]
    if part == "levels":
        low, gain = s.low_bass(source, done, sr)
        tone = s.band_balance(source, done, sr)
        shown = {"balance": o.lrms(s.channel_balance(source, done)[0]), "width": s.width(*s.mid_side(s.width_match(source, done))), "low_bass_db": o.db(gain), "low_bass_rms": o.lrms(low[0]), "tone": o.lrms(tone[0])}
        shown |= {"dynamic_eq": o.lrms(s.dynamic_eq("a", "da", sr)), "dynamic_eq_bright": o.lrms(s.dynamic_eq("a", "da", sr, "hifi_bright")), "dynamic_eq_bass": o.lrms(s.dynamic_eq("a", "da", sr, "bass_boost"))}
    elif part == "bands":
        delta = s.delta(source, done, sr, "m")
        tilted, drift = s.tilt(source, done, 12_000.0)
        shown = {"bands": s.width(*s.mid_side(s.band_widths(source, done, sr))), "delta": peak(*delta), "delta_rms": o.lrms(delta[1]), "tilt_db": drift, "tilted": o.lrms(tilted[0])}
    else:
        harsh, sibilant = s.harshness("a", "da", 20_000.0), s.sibilance("a", "da", 24_000.0)
        crisp, loss = s.transients(source, done, sr)
        matched, gain = s.loudness_match(source, done, sr, "-1.5")
        shown = {"harshness_db": o.db(harsh[1]), "harshness_rms": o.lrms(harsh[0]), "bright_db": o.db(s.harshness("a", "da", 20_000.0, True)[1]), "sibilance_db": o.db(sibilant[1]), "transient_db": loss, "transient_rms": o.lrms(crisp[0])}
        shown |= {"band_transients": o.lrms(s.band_transients("a", "da", sr)), "matched_db": gain, "matched_peak": peak(*matched)}
    return s.sql(**shown)


def output_safety() -> str:
    s, sr, ceiling = loud_pairs(), 8_000.0, "-1.2 - m"
    out, gain = s.loudness_set(["a", "b"], sr, "-14 + 12 * m", ceiling)
    loud = s.limit(out, ceiling, sr)
    cut, by = s.trimmed(loud, s.true_peak(loud), ceiling)
    plain, strict = s.safe(out, sr, ceiling, "FALSE"), s.safe(out, sr, "least(-1.2 - m, -1.5)", "TRUE")
    return s.sql(gain_db=gain, limited_peak=peak(*loud), cut_db=o.db(by), cut_rms=o.lrms(cut[0]), safe_peak=s.true_peak(plain), strict_peak=s.true_peak(strict), strict_rms=o.lrms(strict[0]))


def chained(s: Steps, log: dict[str, str] | None = None) -> list[str]:
    """The mastering chain on l and r of rows with the parameters, intensity, effective, mode, target, manual_dsp and
    volume_mode, as sampled at 8 kHz. ``log`` takes what its steps did."""
    log = {} if log is None else log
    sr, x = 8_000.0, ["l", "r"]
    out = []
    for c, strength in zip(s.mid_side(x), ("intensity", "least(0.35 * intensity, 0.3)")):
        c = s.new(f"[v - list_avg({c}) for v in {c}]")
        (c,) = s.where("mode = 'denoise' AND intensity > 0.01", [s.gate(c, s.new(strength))], [c])
        c = s.shape(s.cut_below(c, sr, "lowcut_hz"), sr, "low_boost_db", "mid_cut_db", "high_boost_db")
        c = s.saturate(s.compress(c, sr, "compress_ratio"), "saturation_amount")
        out.append(s.excite(s.smooth_top(c, sr, "saturation_amount"), sr, "exciter_amount"))
    y = s.left_right(out)
    y = s.width_match(x, s.channel_balance(x, y))
    y, gain = s.low_bass(x, y, sr)
    log["low_bass"] = o.db(gain)
    y = s.band_balance(x, s.band_widths(x, y, sr), sr)
    made = {t: [s.dynamic_eq(a, b, sr, t) for a, b in zip(x, y)] for t in ("", "bass_boost", "hifi_bright")}
    y = s.where("target = 'bass_boost'", made["bass_boost"], s.where("target = 'hifi_bright'", made["hifi_bright"], made[""]))
    y = s.where("target = 'hifi_bright'", *([s.harshness(a, b, sr, on)[0] for a, b in zip(x, y)] for on in (True, False)))
    y = [s.repair_clicks(c)[0] for c in y]
    y, log["transients"] = s.transients(x, y, sr)
    y = [s.band_transients(a, b, sr) for a, b in zip(x, y)]
    y = s.delta(x, y, sr, "effective")
    y, gain = s.trimmed(y, s.sample_peak(y), "-1.0")
    log["watch"] = o.db(gain)
    trim = s.new(f"-1.4 - {o.db(s.true_peak(y))}")
    wet = s.new(f"CASE WHEN {trim} < -5 THEN 0.65 * 10 ** (({trim} + 5) / 20) ELSE 10 ** (least({trim}, 0) / 20) END")
    strict = [s.new(each(f"%1 * CASE WHEN {trim} < -5 THEN 0.35 ELSE 0 END + %2 * {wet}", a, b)) for a, b in zip(x, y)]
    log["strict"] = f"CASE WHEN manual_dsp THEN least({trim}, 0) ELSE 0 END"
    y = s.where("manual_dsp", strict, y)
    ceiling = s.new("CASE WHEN manual_dsp THEN least(limiter_ceiling_db, -1.5) ELSE limiter_ceiling_db END")
    y, log["normalize"] = s.loudness_set(y, sr, "target_lufs", ceiling)
    y = s.limit(y, ceiling, sr)
    y, gain = s.trimmed(y, s.true_peak(y), ceiling)
    log["headroom"] = o.db(gain)
    y = s.where("volume_mode = 'match_source'", s.loudness_match(x, y, sr, ceiling)[0], y)
    return s.safe(y, sr, ceiling, "manual_dsp")


def requested() -> Steps:
    """Tracks with what the rules recommend and the requests ask for."""
    given = o.REQUESTED.removeprefix("WITH ")
    named = ", ".join(f"{o._CLAMP[p](p)} AS {p}" for p in o.PARAMETERS)
    fine = f"(json_extract_string(ok, 'manual_mode') = 'fine_tune') IS TRUE OR list_has_any(json_keys(ok), [{', '.join(repr(t[1]) for t in o.TWEAKS)}])"
    return Steps(
        given,
        f"asked AS (SELECT track, p.l, p.r, target, effective, intensity, lufs, manual, {o.SR} AS sr, {named} FROM r8 JOIN p USING (track))",
        "lufs_asked AS (SELECT * REPLACE (CASE WHEN " + o.MATCHED + " THEN " + o.clip("lufs", -24, -8) + " ELSE target_lufs END AS target_lufs), CASE WHEN " + o.MATCHED + " THEN 'match_source' ELSE 'target' END AS volume_mode, "
        "CASE WHEN sr < 32000 THEN 'upsample' WHEN " + o.DENOISED + " THEN 'denoise' ELSE 'none' END AS mode, CASE WHEN sr < 32000 THEN 44100 ELSE sr END AS output_sr, coalesce(json_valid(manual), FALSE) AS manual_dsp, CASE WHEN json_valid(manual) THEN manual ELSE '{}' END AS ok FROM asked)",
        f"base AS (SELECT *, {fine} AS fine FROM lufs_asked)",
        f"ready AS (SELECT * REPLACE ({', '.join(f'CASE WHEN manual_dsp THEN {o.tuned(p)} ELSE {p} END AS {p}' for p in o.PARAMETERS)}) FROM base)",
    )


def request_modes() -> str:
    s = requested()
    return f"WITH {', '.join(s.parts)} SELECT track, mode, volume_mode, CAST(output_sr AS INTEGER) AS output_sr, manual_dsp, round(target_lufs, 6) + 0.0 AS target_lufs, round(limiter_ceiling_db, 6) + 0.0 AS limiter_ceiling_db FROM {s.last}"


def manual_parameters() -> str:
    s = requested()
    return f"WITH {', '.join(s.parts)} SELECT track, {', '.join(f'round({p}, 6) + 0.0 AS {p}' for p in o.PARAMETERS)} FROM {s.last} WHERE manual_dsp"


def mastering_chain() -> str:
    s = requested()
    y = chained(s)
    level = f"sqrt(({o.lmean(y[0], 'v * v')} + {o.lmean(y[1], 'v * v')}) / 2)"
    return s.sql("track", "target", "mode", true_peak_db=o.db(s.true_peak(["l", "r"])), true_peak_out_db=o.db(s.true_peak(y)), rms_out=level, dc_out=f"list_avg({y[0]}) + list_avg({y[1]})")


def chain_steps(steps: dict[str, tuple[float, str, str]]) -> str:
    s, log = requested(), {}
    chained(s, log)
    told = ", ".join(f"CASE WHEN abs({v}) > {steps[n][0]} THEN printf({steps[n][1]!r}, {v}) ELSE {repr(steps[n][2]) if steps[n][2] else 'NULL'} END" for n, v in ((n, s.new(log[n])) for n in steps))
    return s.sql("track", f"concat_ws('; ', {told}) AS steps")


def drift(ceiling_db: str, matched: str) -> str:
    """Flags of (target, a, b) rows, true peaks in ``peak_a``."""
    d = lambda n: f"(a.{n} - b.{n})"
    rules = {
        "stereo_width_loss": f"b.stereo_width > 0.08 AND a.stereo_width < b.stereo_width * 0.72 AND {d('stereo_width')} < -0.1",
        "stereo_width_overexpansion": f"b.stereo_width > 0.08 AND a.stereo_width > b.stereo_width * 1.55 AND {d('stereo_width')} > 0.18",
        "phase_correlation_loss": f"a.phase_correlation < -0.1 OR ({d('phase_correlation')} < -0.3 AND a.phase_correlation < 0.25)",
        "band_separation_loss": f"{d('band_separation_score')} < -12",
        "transient_flattening": f"-{d('crest_db')} > CASE WHEN contains(target, 'loud_modern') THEN 6.0::DOUBLE ELSE 4.5 END",
        "high_band_harshness": f"{d('high_energy')} > 0.22 AND {d('spectral_flatness')} > 0.035 AND NOT contains(target, 'hifi_bright')",
        "source_loudness_drift": f"{matched} AND abs({d('lufs')}) > 2.25",
        "headroom_risk": f"a.clipping_ratio > 0.0005 OR peak_a > {ceiling_db} + 0.15",
    }
    return f"list_filter([{', '.join(f'CASE WHEN {r} THEN {n!r} END' for n, r in rules.items())}], lambda x: x IS NOT NULL)"


def post_quality_guard() -> str:
    """The chain, what drifted, some of the source blended back and levelled, and what still drifts."""
    s, sr, matched = requested(), 8_000.0, "volume_mode = 'match_source'"
    y = chained(s)
    low = lambda x: s.width(*(s.low(c, sr, 140.0) for c in s.mid_side(x)))
    before, now = s.new(low(["l", "r"])), s.new(low(y))
    top = s.new(o.db(s.true_peak(y)))
    parts, last = s.tables()
    parts += [
        f"made AS MATERIALIZED (SELECT track, target, volume_mode, target_lufs, limiter_ceiling_db, l, r, {y[0]} AS yl, {y[1]} AS yr, {top} AS peak_a, {now} > greatest({before} * 1.35, {before} + 0.08) AS grown FROM {last})",
        "heard AS (SELECT track, yl AS l, yr AS r FROM made)",
        o.record("heard", "aft"),
        "met AS (SELECT made.*, rec AS b, aft AS a FROM made JOIN rec USING (track) JOIN aft USING (track))",
        f"found AS (SELECT * EXCLUDE (a), list_concat({drift('limiter_ceiling_db', matched)}, CASE WHEN grown THEN ['low_bass_side_growth'] ELSE [] END) AS flags FROM met)",
        "judged AS (SELECT *, CASE WHEN len(flags) = 0 THEN 'none' WHEN list_has_any(flags, ['headroom_risk', 'phase_correlation_loss', 'transient_flattening', 'high_band_harshness']) OR len(flags) >= 3 THEN 'severe' ELSE 'warning' END AS severity FROM found)",
        "shares AS MATERIALIZED (SELECT *, CASE severity WHEN 'severe' THEN 0.35::DOUBLE WHEN 'warning' THEN 0.15 ELSE 0 END AS blend FROM judged)",
    ]
    g = Steps(*parts)
    mixed = [g.new(each("%1 * (1 - blend) + %2 * blend", a, b)) for a, b in (("yl", "l"), ("yr", "r"))]
    level = g.where(matched, g.loudness_match(["l", "r"], mixed, sr, "limiter_ceiling_db", 2.0)[0], g.loudness_set(mixed, sr, "target_lufs", "limiter_ceiling_db", 0.5)[0])
    out = g.where("blend > 0", g.safe(level, sr, "limiter_ceiling_db", "TRUE"), mixed)
    peak_db = g.new(o.db(g.true_peak(out)))
    parts, last = g.tables()
    parts += [
        f"kept AS MATERIALIZED (SELECT track, target, volume_mode, limiter_ceiling_db, b, flags, severity, blend, {out[0]} AS l, {out[1]} AS r, {peak_db} AS peak_a FROM {last})",
        o.record("kept", "fin"),
        "last AS (SELECT kept.*, fin AS a FROM kept JOIN fin USING (track))",
    ]
    rms = f"sqrt(({o.lmean('l', 'v * v')} + {o.lmean('r', 'v * v')}) / 2)"
    after = f"CASE WHEN blend > 0 THEN array_to_string({drift('limiter_ceiling_db', matched)}, ',') ELSE '' END"
    return f"WITH {', '.join(parts)} SELECT track, array_to_string(flags, ',') AS flags, severity, blend, round({rms}, 6) + 0.0 AS rms_out, {after} AS after_flags, round(peak_a, 6) + 0.0 AS guarded_peak_db FROM last"


def case(*pairs: tuple[str, str]) -> str:
    """The word of the first rule that holds; an empty one is none."""
    return f"nullif(CASE {' '.join(f'WHEN {rule} THEN {word!r}' for rule, word in pairs)} END, '')"


def stem_recommendation() -> str:
    """Parameters and strength of each stem by its risk, then within its role."""
    named = ", ".join(f"{o._CLAMP[p](f'r8.{p}')} AS {p}" for p in o.PARAMETERS)
    less = {"limiter_ceiling_db": "least(limiter_ceiling_db, -1.8)", "compress_ratio": "1 + (compress_ratio - 1) * 0.7 * reduction"}
    less |= {p: f"{p} * 0.55 * reduction" for p in ("exciter_amount", "saturation_amount")}
    amount = o.clip("CASE WHEN stem = 'vocals' THEN 0.36 ELSE 0.45 END * CASE WHEN stem IN ('vocals', 'instrumental') THEN 1 ELSE 0.92 END * effective * (1 - score) ** 2 * phase_safety_factor * transient_safety_factor", 0, 0.45)
    caps = " ".join(f"WHEN '{s}' THEN {c}::DOUBLE" for s, (c, _) in o.STEM_ROLES.items())
    return f"""{o.REQUESTED}, {o.RISK}, z AS (SELECT song, e.stem AS stem, score, phase_safety_factor, transient_safety_factor, r8.effective, r8.intensity, {named}, CASE WHEN score >= 0.22 THEN {o.clip('1 - score * 0.38', 0.70, 0.94)} ELSE 1.0::DOUBLE END AS reduction FROM r8 JOIN e USING (track)),
        y AS (SELECT * REPLACE ({', '.join(f'{o._CLAMP[p](less.get(p, p))} AS {p}' for p in o.PARAMETERS)}), least(intensity, {amount}) * reduction AS strength FROM z)
        SELECT song, stem, {', '.join(f'round({o.role(p)}, 6) + 0.0 AS {p}' for p in o.PARAMETERS)}, round(least(strength, CASE stem {caps} END), 6) + 0.0 AS strength, round(reduction, 6) + 0.0 AS reduction FROM y"""


def recommendation_advice() -> str:
    s = requested()
    reasons = [
        case(("len(targets) > 1", "blended_targets")), "'target_' || first", case(("noise_floor_db > -45", "noisy_source"), ("first IN ('hifi_clean', 'warm_analog')", "natural_texture")),
        case(("low_energy < 0.18 AND first <> 'voice_focus'", "weak_low_band"), ("heavy", "controlled_bass"), ("low_energy > 0.45 AND first = 'restore'", "kept_low_end"), ("low_energy > 0.45 OR first = 'voice_focus'", "reduced_low_band")),
        case(("mid_energy > 0.72", "mid_heavy")), case(("high_energy < 0.12", "dull_source"), ("spectral_flatness > 0.08 AND first <> 'hifi_bright'", "hissing_source")),
        case(("r8.lufs < -28", "low_loudness"), ("crest_db > 18", "wide_dynamics")), case(("list_contains(quality_flags, 'clipping_detected')", "clipping")), case(("ready.sr < 32000", "low_sample_rate")), "'stereo_safe'",
        case(("fragile", "phase_sensitive")), case(("abs(r8.effective - amount) < 0.015", ""), ("r8.effective < amount", "amount_reduced"), ("TRUE", "amount_increased")),
        case((f"least({', '.join(f'{f}_factor' for f in o.BUDGET_LIMITS)}) < 0.999", "budget_limited")), case(("harmonic_factor < 0.98", "harmonics_reduced")), case(("ready.sr >= 32000", "fast_denoise")),
    ]
    signed = lambda name, p: f"CASE WHEN ready.{p} <> 0 THEN printf('{name} %+.1f dB', ready.{p}) END"
    line = [
        "mode || ' mode'", "printf('denoise intensity %.2f', ready.intensity)", signed("low", "low_boost_db"), signed("mid", "mid_cut_db"), signed("high", "high_boost_db"),
        "CASE WHEN ready.compress_ratio > 1.01 THEN printf('%.1f:1 compression', ready.compress_ratio) END", "printf('target %.1f LUFS', ready.target_lufs)",
        *(f"CASE WHEN ready.{p}_amount > 0.01 THEN printf('{p} %.2f', ready.{p}_amount) END" for p in ("exciter", "saturation")), "CASE WHEN len(quality_flags) > 0 THEN 'flags: ' || array_to_string(list_sort(quality_flags), ', ') END",
    ]
    return f"""WITH {', '.join(s.parts)} SELECT track, ready.target, mode, array_to_string(list_filter([{', '.join(reasons)}], lambda x: x IS NOT NULL), ',') AS reasons,
        CASE WHEN manual_dsp THEN 'manual fine-tuning on top of the target, with strict safety' ELSE concat_ws('; ', {', '.join(line)}) END AS advice FROM ready JOIN r8 USING (track)"""


def process_payload() -> str:
    name = "'track ' || j.track || '.wav'"
    return f"""{o.COMPARED}, {o.CHECKS} SELECT j.track, {name} AS filename, '/api/download/' || url_encode({name}) || '?name=' || url_encode({name}) AS download_url, v.overall, round(v.score, 6) + 0.0 AS score, 7 AS n_checks,
        string_split(v.statuses, ',')[4] AS stereo_status, round(a.lufs - b.lufs, 6) + 0.0 AS delta_lufs, CASE WHEN a.clipping_ratio <= 0.0005 AND a.peak_db <= -1.5 + 0.2 THEN 'true' ELSE 'false' END AS clipping_safe FROM j JOIN v USING (track)"""


def stem_guards() -> str:
    s, sr, source, done = driven(), 8_000.0, ["a", "b"], ["da", "db"]
    vocals = [s.sibilance(x, d, 24_000.0)[0] for x, d in zip(source, done)]
    bass = s.band_balance(source, s.low_bass(source, done, sr)[0], sr)
    drums = s.transients(source, done, sr)[0]
    other = [s.smooth_top(d, sr, "0.08::DOUBLE") for d in done]
    # the raw stems sum up to four fifths of the one channel and all of the other
    rest = [s.new("[v - 0.8 * v for v in a]"), s.new("[v - v for v in b]")]
    parts = []
    for x, low, bands, high in zip(s.mid_side(rest), ((140.0, 0.035), (150.0, 0.025)), (((180.0, 1100.0, 0.20), (1100.0, 6200.0, 0.38)), ((180.0, 900.0, 0.38), (900.0, 7800.0, 0.86))), ((6200.0, 0.28), (7800.0, 0.88))):
        terms = [(s.low(x, sr, low[0]), low[1]), (s.high(x, sr, high[0]), high[1]), *((s.band(x, sr, p, min(q, sr * 0.45)), w) for p, q, w in bands)]
        parts.append(s.new(f"[{' + '.join(f'{c}[i] * {w}' for c, w in terms)} for i in range(1, {N + 1})]"))
    most, now = s.new(f"{s.width(*s.mid_side(source))} * 1.45"), s.width(*parts)
    gain = s.new(f"CASE WHEN {now} > {most} AND {now} > 1e-9 THEN {o.clip(f'{most} / greatest({now}, 1e-9)', 0.45, 1.0)} ELSE 1.0::DOUBLE END")
    shaped = s.left_right([parts[0], s.new(f"[v * {gain} for v in {parts[1]}]")])
    level = lambda x: s.new(f"sqrt(({o.lmean(x[0], 'v * v')} + {o.lmean(x[1], 'v * v')}) / 2)")
    whole, lost, own = level(source), level(rest), level(shaped)
    blend = s.new(o.clip(f"0.03 + {o.clip('1 - m', 0.12, 0.95)} * 0.22", 0.03, 0.25))
    by = s.new(f"CASE WHEN {whole} > 1e-9 AND {lost} > {whole} * 0.003 AND {own} > 1e-9 THEN least({blend}, {whole} * greatest(0.08::DOUBLE, {blend} * 0.5) / greatest({own}, 1e-9)) ELSE 0.0::DOUBLE END")
    kept = s.low_bass(source, [s.new(each(f"%1 + %2 * {by}", d, x)) for d, x in zip(done, shaped)], sr)[0]
    out = s.safe(s.loudness_match(source, s.width_match(source, kept), sr, "-1.2")[0], sr, "-1.2::DOUBLE", "TRUE")
    return s.sql(vocals=o.lrms(vocals[0]), bass=o.lrms(bass[0]), drums=o.lrms(drums[1]), other=o.lrms(other[0]), residual_rms=o.lrms(shaped[0]), residual_gain=by, kept_rms=o.lrms(kept[1]), final_peak=s.true_peak(out), final_rms=o.lrms(out[0]))
