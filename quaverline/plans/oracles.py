"""SQL that DuckDB runs on the same tables, written from the definitions and independently of the DataFrame plans."""

from __future__ import annotations

from ..functions.tables import BOUNDS, BUDGET_LIMITS, PARAMETERS, PRESETS, STEM_GAINS, STEM_ROLES, TARGET_ALIASES, TARGETS, TWEAKS


def _list(name: str, items: list[str]) -> str:
    return f"{name} IN ({', '.join(repr(i) for i in items)})"


def db(x: str) -> str:
    return f"(20 * log10(greatest({x}, 1e-9)))"


def lu(x: str) -> str:
    return f"(-0.691 + 10 * log10(greatest({x}, 1e-18)))"


def lsum(x: str, f: str = "v") -> str:
    return f"coalesce(list_sum([{f} for v in {x}]), 0.0::DOUBLE)"


def lmean(x: str, f: str = "v") -> str:
    return f"({lsum(x, f)} / len({x}))"


def lrms(x: str) -> str:
    return f"sqrt({lmean(x, 'v * v')})"


def clip(x: str, low: float | None, high: float | None) -> str:
    x = x if low is None else f"greatest({x}, {low}::DOUBLE)"
    return x if high is None else f"least({x}, {high}::DOUBLE)"


#: Each user's events as a track, from 0.
EVENT = "e AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value / 100.0::DOUBLE AS x FROM events)"

#: Vectors 2i and 2i + 1 as channels of track i.
PAIR = """p AS (
    SELECT a.vec_id // 2 AS track, [v::DOUBLE for v in a.embedding] AS l, [v::DOUBLE for v in b.embedding] AS r
    FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1
)"""


def _gated(e: str) -> str:
    """Integrated loudness of a list of block energies; all tracks here are loud enough for a block to pass."""
    loud = f"[b for b in {e} if {lu('b')} > -70]"
    return f"""CASE WHEN len({loud}) = 0 THEN NULL ELSE {lu(f"coalesce(list_avg([b for b in {loud} if {lu('b')} > {lu(f'list_avg({loud})')} - 10]), list_avg({loud}))")} END"""


def record(source: str = "p", name: str = "rec", power: bool = True, mono: bool = False) -> str:
    """The analysis record of (track, l, r) with 64 samples at 64 Hz, in steps; of ``mono`` tracks r is l again."""
    blocks = lambda e: f"[list_sum({e}[o + 1:o + 26]) / 26 for o in range(0, 39, 6)]"
    frames = lambda c: f"[sqrt(list_sum([v * v for v in {c}[o + 1:o + 16]]) / 16) for o in range(0, 49, 4)]"
    cross = lambda c: f"(list_sum([CASE WHEN ({c}[i] < 0) <> ({c}[i - 1] < 0) THEN 1.0::DOUBLE ELSE 0.0 END for i in range(2, 65)]) / 64)"
    bin_of = lambda c: f"(list_sum([{c}[n + 1] * cos(2 * pi() * k * n / 64) for n in range(0, 64)]) ** 2 + list_sum([{c}[n + 1] * sin(2 * pi() * k * n / 64) for n in range(0, 64)]) ** 2)"
    band = lambda a, b: f"(list_sum(power[{a + 1}:{b}]) / list_sum(power))"
    return f"""{name}_a AS (
        SELECT track, l, r, list_concat(l, r) AS x, [(l[i] + r[i]) / 2 for i in range(1, 65)] AS m, [(l[i] - r[i]) / 2 for i in range(1, 65)] AS s,
               [l[i] * l[i]{'' if mono else ' + r[i] * r[i]'} for i in range(1, 65)] AS e,
               [({bin_of('l')} + {bin_of('r')}) / 2 for k in range(0, 33)] AS power
        FROM {source}
    ), {name}_b AS (
        SELECT track, 64 AS sr, {1 if mono else 2} AS channels, 1.0::DOUBLE AS duration, {lrms('x')} AS rms, list_max([abs(v) for v in x]) AS peak,
               {blocks('e')} AS be, {blocks('[v * v for v in m]')} AS bm, {blocks('[v * v for v in s]')} AS bs,
               {db(f"list_aggregate({frames('l')}, 'quantile_cont', 0.1)" if mono else f"list_aggregate(list_concat({frames('l')}, {frames('r')}), 'quantile_cont', 0.1)")} AS noise_floor_db,
               (list_avg(l) + list_avg(r)) / 2 AS dc_offset, greatest(abs(list_avg(l)), abs(list_avg(r))) AS max_channel_dc_offset,
               {lmean('x', 'CASE WHEN abs(v) >= 0.98 THEN 1.0::DOUBLE ELSE 0.0 END')} AS clipping_ratio,
               {lmean('x', 'CASE WHEN abs(v) <= 10 ** (-2.5) THEN 1.0::DOUBLE ELSE 0.0 END')} AS silence_ratio,
               ({cross('l')} + {cross('r')}) / 2 AS zero_crossing_rate,
               {'0.0::DOUBLE' if mono else clip(f"{lrms('s')} / ({lrms('m')} + 1e-9)", 0.0, 4.0)} AS stereo_width,
               {'1.0::DOUBLE' if mono else clip(f"(list_sum([l[i] * r[i] for i in range(1, 65)]) / 64) / (({lrms('l')} + 1e-9) * ({lrms('r')} + 1e-9))", -1.0, 1.0)} AS phase_correlation,
               {band(1, 8)} AS low_energy, {band(8, 20)} AS mid_energy, {band(20, 32)} AS high_energy,
               list_sum([(k - 1) * power[k] for k in range(1, 34)]) / list_sum(power) AS spectral_centroid_hz,
               list_min([k - 1 for k in range(1, 34) if list_sum(power[1:k]) >= 0.85 * list_sum(power)])::DOUBLE AS spectral_rolloff_hz,
               exp(list_avg([ln(sqrt(greatest(v, 1e-18))) for v in power])) / (list_avg([sqrt(greatest(v, 1e-18)) for v in power]) + 1e-18) AS spectral_flatness
        FROM {name}_a
    ), {name}_c AS (
        SELECT *, {_gated('be')} AS lufs, {_gated('bm')} AS mid_lufs, {'-180.691::DOUBLE' if mono else _gated('bs')} AS side_lufs, {db('peak')} AS peak_db, {db('peak / greatest(rms, 1e-9)')} AS crest_db,
               greatest(low_energy + mid_energy + high_energy, 1e-9) AS tot
        FROM {name}_b
    ), {name} AS (
        SELECT * EXCLUDE (be, bm, bs, tot), peak_db - noise_floor_db AS dynamic_range_db, low_energy / tot AS low, mid_energy / tot AS mid, high_energy / tot AS high,
               {clip(f'''100 - 100 * (greatest(low_energy / tot - 0.42, 0) * 1.4 + greatest(high_energy / tot - 0.38, 0) + greatest(0.24 - mid_energy / tot, 0) * 1.6
                   + abs(low_energy / tot - 0.30) * 0.9 + abs(mid_energy / tot - 0.42) * 0.7 + abs(high_energy / tot - 0.28) * 0.8)''', 0.0, 100.0)} AS band_separation_score,
               list_filter([CASE WHEN clipping_ratio > 0.001 THEN 'clipping_detected' END, CASE WHEN max_channel_dc_offset > 0.01 THEN 'dc_offset' END,
                   CASE WHEN noise_floor_db > -45 THEN 'high_noise_floor' END, CASE WHEN high_energy < 0.08 THEN 'dull_high_end' END, CASE WHEN lufs < -28 THEN 'very_low_loudness' END,
                   CASE WHEN lufs > -10 THEN 'hot_loudness' END, CASE WHEN silence_ratio > 0.35 THEN 'large_silence_sections' END], lambda f: f IS NOT NULL) AS quality_flags
        FROM {name}_c
    )"""


RECORD = f"WITH {PAIR}, {record()}"


def rounded(columns: list[str], tail: str) -> str:
    """The columns, doubles to six digits. ``name!`` stays as it is."""
    out = [c[:-1] if c.endswith("!") else f"round({c}, 6) + 0.0 AS {c}" for c in columns]
    return f"SELECT {', '.join(out)} {tail}"


NUMBERS = "rms peak peak_db crest_db lufs noise_floor_db dynamic_range_db dc_offset max_channel_dc_offset clipping_ratio silence_ratio zero_crossing_rate stereo_width phase_correlation mid_lufs side_lufs low_energy mid_energy high_energy spectral_centroid_hz spectral_rolloff_hz spectral_flatness band_separation_score".split()

#: The requests that go with tracks: target, amount and JSON by the track's number.
REQUESTS = ["hifi_clean", "voice", "restore, loud", "bass_boost,bass", "bright", "hifi_bright", "warm_analog", "auto,archive,low", "loud_modern", "", "voice_focus,hifi_bright"]
MANUALS = ['{"compress_delta": 0.4, "target_lufs_delta": -3}', "no json", '{"lowcut_hz": 500, "high_boost_db": -9.5}', '{"manual_mode": "fine_tune"}', None]

#: Rates that tracks are said to have, and which requests match the source and let denoising be.
RATES = [8_000, 44_100, 22_050, 48_000, 96_000]
SR = f"([{', '.join(map(str, RATES))}])[track % {len(RATES)} + 1]"
MATCHED, DENOISED = "(track % 4 = 1)", "(track % 3 <> 0)"


def _pick(items: list, key: str) -> str:
    values = ", ".join("NULL" if i is None else "'" + i + "'" for i in items)
    return f"([{values}])[{key} % {len(items)} + 1]"


_ALIAS = " ".join(f"WHEN trim(t) = '{a}' THEN '{b}'" for a, b in TARGET_ALIASES.items())


def targets_of(request: str) -> str:
    """Known targets of a request in order; the first of equals stays."""
    parts = f"list_transform(string_split(CASE WHEN {request} = '' OR {request} IS NULL THEN 'hifi_clean' ELSE {request} END, ','), lambda t: CASE {_ALIAS} ELSE trim(t) END)"
    known = f"list_filter({parts}, lambda t: {_list('t', TARGETS)})"
    distinct = f"list_filter({known}, lambda t, i: list_position({known}, t) = i)"
    return f"CASE WHEN len({known}) = 0 THEN ['hifi_clean'] ELSE {distinct} END"


_PRESETS = ", ".join(f"('{t}', {', '.join(f'{v}::DOUBLE' for v in PRESETS[t])})" for t in TARGETS)
PRESET_TABLE = f"presets AS (SELECT * FROM (VALUES {_PRESETS}) v(name, {', '.join(PARAMETERS)}))"
REQUEST_TABLE = f"""q AS (SELECT track, {targets_of('request')} AS targets, least(amount, 1.0) AS amount, manual FROM (
    SELECT track, {_pick(REQUESTS, 'track')} AS request, (track % 12) / 10.0::DOUBLE AS amount, {_pick(MANUALS, 'track')} AS manual FROM p))"""
BLEND = f"b AS (SELECT q.track, {', '.join(f'avg({p}) AS {p}' for p in PARAMETERS)} FROM q, unnest(q.targets) u(t) JOIN presets ON name = t GROUP BY q.track)"

_HAS = lambda f: f"list_contains(quality_flags, '{f}')"
_RULES = [
    (_HAS("high_noise_floor"), 0.07, 0, 0.20), (_HAS("dull_high_end"), 0.06, 0, 0.16), (_HAS("very_low_loudness"), 0.04, 0, 0.10), ("FALSE", 0.03, 0, 0.10),
    (f"{_HAS('clipping_detected')} OR {_HAS('hot_loudness')}", -0.07, 0.18, 0), ("band_separation_score >= 72", -0.05, 0, 0), ("band_separation_score < 45", 0.04, 0, 0.12),
    ("crest_db BETWEEN 8 AND 17 AND len(quality_flags) = 0", -0.05, 0, 0), ("crest_db > 20", 0.03, 0, 0.08), ("crest_db < 7", -0.05, 0.12, 0), ("phase_correlation < 0.18", -0.08, 0.20, 0),
    ("stereo_width > 1.15", -0.04, 0.10, 0), ("list_contains(targets, 'restore')", -0.04, 0, 0), ("list_contains(targets, 'loud_modern')", 0.03, 0, 0), ("list_contains(targets, 'bass_boost') AND low_energy > 0.44", -0.04, 0.10, 0),
]


def _rules(k: int) -> str:
    return " + ".join(f"CASE WHEN {r[0]} THEN {r[k]}::DOUBLE ELSE 0 END" for r in _RULES if r[k])


ADAPTIVE = f"""ad AS (
    SELECT rec.*, q.targets, q.amount, q.manual, {clip(_rules(2), 0, 1)} AS risk_score, {clip(_rules(3), 0, 1)} AS enhancement_need, {clip(_rules(1), -0.18, 0.14)} AS change FROM rec JOIN q USING (track)
), am AS (
    SELECT *, CASE WHEN amount <= 0.02 THEN amount WHEN amount <= 0.2 THEN least({clip('amount + change', 0, 1)}, amount + 0.05) ELSE {clip('amount + change', 0, 1)} END AS effective,
           CASE WHEN amount <= 0.02 THEN 'bypass' WHEN risk_score >= 0.28 THEN 'fragile' WHEN enhancement_need >= 0.3 THEN 'needs_recovery' WHEN change < -0.04 THEN 'already_polished' ELSE 'balanced' END AS source_condition
    FROM ad
)"""

#: Parameters of the recommendation at 64 Hz: the sample rate is always low, so high_end rules for other rates don't come up.
_OWN = {
    "restore": {"high_boost_db": (None, 1.2), "compress_ratio": (None, 1.8)},
    "hifi_clean": {"high_boost_db": (0.4, 1.8), "compress_ratio": (None, 1.8)},
    "hifi_bright": {"high_boost_db": (2.2, None), "mid_cut_db": (None, -0.4)},
    "warm_analog": {"low_boost_db": (0.8, None), "high_boost_db": (None, -0.4), "compress_ratio": (1.25, 1.8)},
    "loud_modern": {"compress_ratio": (2.6, None), "high_boost_db": (1.0, None)},
    "bass_boost": {"lowcut_hz": (None, 38.0), "low_boost_db": (1.4, 3.2), "compress_ratio": (1.35, 2.1), "high_boost_db": (-0.2, 0.8)},
    "voice_focus": {"lowcut_hz": (100.0, None), "low_boost_db": (None, -1.0), "high_boost_db": (1.4, None)},
}


def _own(p: str) -> str:
    cases = " ".join(f"WHEN len(targets) = 1 AND first = '{t}' THEN {clip(p, *r[p])}" for t, r in _OWN.items() if p in r)
    return f"CASE {cases} ELSE {p} END" if cases else p


_CLAMP = {p: (lambda x, p=p: clip(x, *BOUNDS[p][:2])) for p in PARAMETERS}
RECOMMEND = f"""r1 AS (
    SELECT am.*, targets[1] AS first, b.* EXCLUDE (track), (phase_correlation < 0.2) AS fragile, (list_contains(targets, 'bass_boost') AND low_energy > 0.45) AS heavy FROM am JOIN b USING (track)
), r2 AS (
    SELECT * EXCLUDE ({', '.join(PARAMETERS)}),
        CASE WHEN low_energy < 0.18 AND first <> 'voice_focus' THEN lowcut_hz WHEN heavy THEN greatest(lowcut_hz, 38) WHEN low_energy > 0.45 AND first = 'restore' THEN greatest(lowcut_hz, 35)
             WHEN low_energy > 0.45 OR first = 'voice_focus' THEN greatest(lowcut_hz, CASE WHEN first = 'voice_focus' THEN 100 ELSE 45 END) ELSE lowcut_hz END AS lowcut_hz,
        CASE WHEN low_energy < 0.18 AND first <> 'voice_focus' THEN greatest(low_boost_db, 2) WHEN heavy THEN {clip('low_boost_db', 0.8, 1.8)} WHEN low_energy > 0.45 AND first = 'restore' THEN least(low_boost_db, 0)
             WHEN low_energy > 0.45 OR first = 'voice_focus' THEN least(low_boost_db, -1) ELSE low_boost_db END AS low_boost_db,
        CASE WHEN mid_energy > 0.72 THEN least(mid_cut_db, -1.5::DOUBLE) ELSE mid_cut_db END AS mid_cut_db,
        CASE WHEN high_energy < 0.12 THEN greatest(high_boost_db, 2) WHEN spectral_flatness > 0.08 AND first <> 'hifi_bright' THEN least(high_boost_db, -1) ELSE high_boost_db END AS high_boost_db,
        CASE WHEN lufs < -28 THEN greatest(compress_ratio, 2.2::DOUBLE) WHEN crest_db > 18 THEN greatest(compress_ratio, 1.8::DOUBLE) ELSE compress_ratio END AS compress_ratio, target_lufs, limiter_ceiling_db,
        CASE WHEN fragile THEN least(exciter_amount, 0.1::DOUBLE) ELSE exciter_amount END AS exciter_amount, CASE WHEN fragile THEN least(saturation_amount, 0.08::DOUBLE) ELSE saturation_amount END AS saturation_amount,
        greatest(CASE first WHEN 'restore' THEN 0.65 WHEN 'warm_analog' THEN 0.45 WHEN 'loud_modern' THEN 0.6 WHEN 'voice_focus' THEN 0.75 ELSE 0.55 END, CASE WHEN noise_floor_db > -45 THEN 0.65 ELSE 0 END)::DOUBLE AS strong
    FROM r1
), r3 AS (SELECT * REPLACE (CASE WHEN {_HAS('clipping_detected')} THEN {clip('compress_ratio', 1.4, 2.2)} ELSE compress_ratio END AS compress_ratio) FROM r2
), r4 AS (SELECT * REPLACE ({', '.join(f'{_CLAMP[p](_own(p))} AS {p}' for p in PARAMETERS)}) FROM r3
), r5 AS (
    SELECT * REPLACE (20 + (lowcut_hz - 20) * effective AS lowcut_hz, low_boost_db * effective AS low_boost_db, mid_cut_db * effective AS mid_cut_db, high_boost_db * effective AS high_boost_db,
        1 + (compress_ratio - 1) * effective AS compress_ratio, {clip('lufs', -24, -10)} + (target_lufs - {clip('lufs', -24, -10)}) * effective AS target_lufs,
        exciter_amount * effective AS exciter_amount, saturation_amount * effective AS saturation_amount) FROM r4
), r6 AS (
    SELECT *, greatest(abs(low_boost_db), abs(mid_cut_db), abs(high_boost_db)) / 6 * effective AS tone, (compress_ratio - 1) / 3 * effective AS dynamics, greatest(exciter_amount, saturation_amount) * effective AS harmonics,
        least(0.15::DOUBLE, 0.04 * (len(targets) - 1)) * effective AS stereo, least(0.35::DOUBLE, 0.45 * effective) AS stem FROM r5
), r7 AS (
    SELECT *, {', '.join(f'CASE WHEN {f} <= {v} OR {f} <= 1e-9 THEN 1.0::DOUBLE ELSE {v} / {f} END AS {f}_factor' for f, v in BUDGET_LIMITS.items())},
        {clip("1 - (CASE WHEN noise_floor_db > -48 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN spectral_flatness > 0.08 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN peak_db > -2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN high_energy > 0.36 THEN 0.12::DOUBLE ELSE 0 END)", 0.45, 1)} AS harmonic_factor
    FROM r6
), r8 AS (
    SELECT * REPLACE (low_boost_db * tone_factor AS low_boost_db, mid_cut_db * tone_factor AS mid_cut_db, high_boost_db * tone_factor AS high_boost_db, 1 + (compress_ratio - 1) * dynamics_factor AS compress_ratio,
        exciter_amount * harmonics_factor * harmonic_factor AS exciter_amount, saturation_amount * harmonics_factor * harmonic_factor AS saturation_amount),
        {clip('CASE WHEN fragile THEN least(strong, 0.55::DOUBLE) ELSE strong END * effective', 0, 1)} AS intensity, array_to_string(targets, '+') AS target,
        0.72 - least(0.04 * len(quality_flags), 0.18::DOUBLE) AS confidence
    FROM r7
)"""
REQUESTED = f"WITH {PAIR}, {record()}, {PRESET_TABLE}, {REQUEST_TABLE}, {BLEND}, {ADAPTIVE}, {RECOMMEND}"

#: A simple processing: gain and saturation of each channel by the track's number.
DONE = """done AS (SELECT track, list_transform(l, lambda v: 0.8 * (1 + track % 4) * tanh(v * (1 + track % 3)) / tanh(1 + track % 3)) AS l, list_transform(r, lambda v: 0.7 * (1 + track % 4) * tanh(v * (1 + track % 3)) / tanh(1 + track % 3)) AS r FROM p)"""
COMPARED = f"WITH {PAIR}, {record()}, {DONE}, {record('done', 'aft')}, j AS (SELECT rec.track, rec AS b, aft AS a FROM rec JOIN aft USING (track))"

_D = lambda n: f"(a.{n} - b.{n})"
MODE = "(j.track % 2 = 1)"  # match the source
TARGET = _pick(["hifi_clean", "loud_modern", "hifi_bright+voice_focus"], "j.track")
_CREST = f"CASE WHEN contains({TARGET}, 'loud_modern') THEN 6.0::DOUBLE ELSE 4.5 END"
_STATUS = lambda p, r: f"CASE WHEN {p} THEN 'pass' WHEN {r} THEN 'review' ELSE 'fail' END"
DRIFT = f"""list_filter([
    CASE WHEN b.stereo_width > 0.08 AND a.stereo_width < b.stereo_width * 0.72 AND {_D('stereo_width')} < -0.1 THEN 'stereo_width_loss' END,
    CASE WHEN b.stereo_width > 0.08 AND a.stereo_width > b.stereo_width * 1.55 AND {_D('stereo_width')} > 0.18 THEN 'stereo_width_overexpansion' END,
    CASE WHEN a.phase_correlation < -0.1 OR ({_D('phase_correlation')} < -0.3 AND a.phase_correlation < 0.25) THEN 'phase_correlation_loss' END,
    CASE WHEN {_D('band_separation_score')} < -12 THEN 'band_separation_loss' END, CASE WHEN -{_D('crest_db')} > {_CREST} THEN 'transient_flattening' END,
    CASE WHEN {_D('high_energy')} > 0.22 AND {_D('spectral_flatness')} > 0.035 AND NOT contains({TARGET}, 'hifi_bright') THEN 'high_band_harshness' END,
    CASE WHEN {MODE} AND abs({_D('lufs')}) > 2.25 THEN 'source_loudness_drift' END,
    CASE WHEN a.clipping_ratio > 0.0005 OR a.peak_db > -1.5 + 0.15 THEN 'headroom_risk' END], lambda f: f IS NOT NULL)"""
_LOUD = f"CASE WHEN {MODE} THEN {_D('lufs')} ELSE a.lufs + 16 END"
CHECKS = f"""k AS (SELECT j.track, a, b, abs({_D('stereo_width')}) AS w, abs({_D('phase_correlation')}) AS f, [
    {_STATUS(f'abs({_LOUD}) <= CASE WHEN {MODE} THEN 1.25 ELSE 1.5 END', f'abs({_LOUD}) <= CASE WHEN {MODE} THEN 2.25 ELSE 2.8 END')},
    {_STATUS('a.peak_db + 1.5 <= 0.05', 'a.peak_db + 1.5 <= 0.2')}, {_STATUS('a.clipping_ratio <= 0.0005', 'a.clipping_ratio <= 0.0015')},
    {_STATUS(f"abs({_D('stereo_width')}) <= 0.18 AND abs({_D('phase_correlation')}) <= 0.22", f"abs({_D('stereo_width')}) <= 0.3 AND abs({_D('phase_correlation')}) <= 0.35")},
    {_STATUS(f"{_D('band_separation_score')} >= -6", f"{_D('band_separation_score')} >= -12")}, {_STATUS(f"-{_D('crest_db')} <= {_CREST}", f"-{_D('crest_db')} <= {_CREST} + 2")},
    CASE WHEN {_D('high_energy')} > 0.22 AND {_D('spectral_flatness')} > 0.035 AND NOT contains({TARGET}, 'hifi_bright') THEN 'fail' WHEN {_D('high_energy')} > 0.16 AND {_D('spectral_flatness')} > 0.025 THEN 'review' ELSE 'pass' END] AS st,
    greatest({_D('lufs')} - CASE WHEN {MODE} THEN 1 ELSE 3 END, 0) * 4.5 + greatest(abs({_D('phase_correlation')}) - 0.18, 0) * 18 + greatest(-{_D('crest_db')} - {_CREST}, 0) * 2 + greatest({_D('high_energy')} - 0.14, 0) * 22 AS penalties,
    greatest({_D('band_separation_score')}, 0) * 0.18 + CASE WHEN a.peak_db <= -1.35 THEN 4 ELSE 0 END + CASE WHEN abs({_D('stereo_width')}) <= 0.12 AND abs({_D('phase_correlation')}) <= 0.16 THEN 3 ELSE 0 END AS bonuses
    FROM j), v AS (
    SELECT track, array_to_string(st, ',') AS statuses, penalties::DOUBLE AS penalties, bonuses::DOUBLE AS bonuses,
        {clip("100 * list_sum([w * CASE s WHEN 'pass' THEN 1.0::DOUBLE WHEN 'review' THEN 0.55 ELSE 0 END for w, s in list_zip([0.12, 0.19, 0.16, 0.16, 0.13, 0.13, 0.11], st)]) + bonuses - penalties", 0, 100)} AS score,
        CASE WHEN list_contains(st, 'fail') THEN 'fail' WHEN len([s for s in st if s = 'review']) <= 1 THEN 'pass' ELSE 'review' END AS overall
    FROM k)""".replace(
    "list_sum([w * CASE s WHEN 'pass' THEN 1.0::DOUBLE WHEN 'review' THEN 0.55 ELSE 0 END for w, s in list_zip([0.12, 0.19, 0.16, 0.16, 0.13, 0.13, 0.11], st)])",
    "list_sum([([0.12, 0.19, 0.16, 0.16, 0.13, 0.13, 0.11])[i]::DOUBLE * CASE st[i] WHEN 'pass' THEN 1.0::DOUBLE WHEN 'review' THEN 0.55 ELSE 0 END for i in range(1, 8)])",
)

#: Five vectors in a row as stems of one track, and the record of each as a track of two equal channels.
STEM_NAMES = "(['vocals', 'instrumental', 'drums', 'bass', 'other'])[vec_id % 5 + 1]"
STEM = f"s AS (SELECT vec_id // 5 AS track, {STEM_NAMES} AS stem, n - 1 AS n, embedding[n]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) t(n))"
STEM_GAIN = "CASE stem " + " ".join(f"WHEN '{s}' THEN {g}::DOUBLE" for s, (g, _, _) in STEM_GAINS.items()) + " END"
RISK = f"""k AS (SELECT rec.*, track // 5 AS song, (['vocals', 'instrumental', 'drums', 'bass', 'other'])[track % 5 + 1] AS stem FROM rec),
r AS (SELECT *, {clip('''CASE WHEN spectral_flatness > 0.12 THEN 0.24::DOUBLE WHEN spectral_flatness > 0.08 THEN 0.12 ELSE 0 END + CASE WHEN noise_floor_db > -42 THEN 0.22::DOUBLE WHEN noise_floor_db > -50 THEN 0.1 ELSE 0 END
        + CASE WHEN crest_db < 6 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN stem IN ('vocals', 'other') AND stereo_width > 1.25 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN phase_correlation < 0.05 THEN 0.18::DOUBLE ELSE 0 END
        + CASE WHEN stem = 'vocals' AND high_energy > 0.42 THEN 0.1::DOUBLE ELSE 0 END''', 0, 1)} AS artifact,
        {clip('(spectral_flatness - 0.055) * 2.5 + greatest(noise_floor_db + 54, 0) / 34', 0, 1)} AS bleed, {clip('(8.5 - crest_db) / 8.5', 0, 1)} AS transient_smear,
        {clip('(0.22 - phase_correlation) / 0.52 + greatest(stereo_width - 1.25, 0) * 0.18', 0, 1)} AS phase_instability, {clip('abs(band_separation_score - 58) / 70', 0, 1)} AS residual_mismatch FROM k),
e AS (SELECT *, {clip('artifact * 0.34 + bleed * 0.22 + transient_smear * 0.16 + phase_instability * 0.18 + residual_mismatch * 0.1', 0, 1)} AS score,
        {clip('1 - phase_instability * 0.55', 0.35, 1)} AS phase_safety_factor, {clip('1 - transient_smear * 0.45', 0.45, 1)} AS transient_safety_factor FROM r)"""
RISKS = f"WITH {PAIR}, {record()}, {RISK}"


def role(p: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {clip(p, *r[p])}" for s, (_, r) in STEM_ROLES.items() if p in r)
    return _CLAMP[p](f"CASE stem {cases} ELSE {p} END" if cases else p)


def tuned(p: str) -> str:
    tweak = {name: (key, a, b) for name, key, a, b in TWEAKS}
    low, high, default = BOUNDS[p]
    number = lambda k: f"try_cast(json_extract_string(ok, '{k}') AS DOUBLE)"
    if p == "limiter_ceiling_db":
        fine, plain = f"least(coalesce({number(p)}, base.{p}), -1.5)", f"coalesce({number(p)}, {default})"
        return f"least(-1.5, CASE WHEN fine THEN {clip(fine, low, high)} ELSE {clip(plain, low, high)} END)::DOUBLE"
    key, a, b = tweak[p]
    return f"CASE WHEN fine THEN {clip(f'base.{p} + {clip(f'coalesce({number(key)}, 0)', a, b)}', low, high)} ELSE {clip(f'coalesce({number(p)}, {default})', low, high)} END"
