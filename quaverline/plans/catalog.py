"""Registered queries over the input tables, each with SQL where SQL can express it.

There is no audio among the tables: each user's events, pairs of vectors and the sorted line items serve as series (see
``sources.signals``). Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalars import decibels, mean, num, rms, rounded
from ..functions.tables import LIGHT_PRESETS, PARAMETERS, STEM_GAINS, STEM_ORDER, STEM_ROLES, TWEAKS
from ..operators import features, guards, kernels, light, mastering, spectral, stem_audio, stems
from ..operators.analysis import FRAMES, analyze, with_record
from ..session import table
from ..sources import signals
from . import oracles as o
from . import signal_sql as q
from . import long, reports, rules, validation  # noqa: F401, long registers its queries
from .registry import ORACLE, QUERIES, query  # noqa: F401

#: For queries whose SQL has the true peak, or that have no SQL.
PEAKED = replace(FRAMES, true_peak=True)
def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.event_tracks(table(spark, sf_dir, "events"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.vector_tracks(table(spark, sf_dir, "embeddings"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the sample peak for the true peak, which SQL can't find."""
    return analyze(_pairs(spark, sf_dir)).withColumn("true_peak_db", F.col("peak_db"))


def _pick(items: list, key: str) -> Column:
    return F.element_at(F.array(*(F.lit(i) for i in items)), (F.col(key) % len(items) + 1).cast("int"))


# Level, loudness and frames of long series


_STATS = ["cnt!", "rms", "peak", "dc_offset", "clipping_ratio", "silence_ratio", "peak_db", "crest_db", "lufs"]


def _stats_sql(source: str, key: str) -> str:
    one = lambda rule: f"avg(CASE WHEN {rule} THEN 1.0::DOUBLE ELSE 0.0 END)"
    return f"""WITH x AS ({source}), g AS (SELECT {key}, count(*) AS cnt, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, avg(x) AS dc_offset,
        {one('abs(x) >= 0.98')} AS clipping_ratio, {one('abs(x) <= 10 ** (-2.5)')} AS silence_ratio FROM x GROUP BY {key}),
        s AS (SELECT *, {o.db('peak')} AS peak_db, {o.db('peak / greatest(rms, 1e-9)')} AS crest_db, {o.db('rms')} - 0.691 AS lufs FROM g) """ + o.rounded([f"{key}!", *_STATS], "FROM s")


_STEMS = "SELECT event_type AS stem, (value - avg(value) OVER w) / greatest(max(abs(value)) OVER w, 1e-9) AS x FROM events WINDOW w AS (PARTITION BY event_type)"


@query(_stats_sql(_STEMS, "stem"))
def signal_stats_by_stem(spark, sf_dir):
    return rounded(features.level_stats(signals.event_stems(table(spark, sf_dir, "events")), ["stem"]))


@query(_stats_sql("SELECT l_returnflag AS stem, l_extendedprice / 100000.0::DOUBLE AS x FROM lineitem", "stem"))
def lineitem_stats_by_stem(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return rounded(features.level_stats(items.select(F.col("l_returnflag").alias("stem"), (F.col("l_extendedprice") / 100000.0).alias("x")), ["stem"]))


@query(f"WITH {o.EVENT} SELECT track, n, round(x, 6) + 0.0 AS x FROM e")
def event_series(spark, sf_dir):
    return rounded(_tracks(spark, sf_dir))


@query(f"WITH {o.EVENT}, c AS (SELECT track, CASE WHEN (x - 0.5 < 0) <> (lag(x) OVER (PARTITION BY track ORDER BY n) - 0.5 < 0) THEN 1.0::DOUBLE ELSE 0.0 END AS c FROM e) SELECT track, count(*) AS cnt, round(avg(c), 6) + 0.0 AS zero_crossing_rate FROM c GROUP BY track")
def zero_crossing_rate(spark, sf_dir):
    centred = _tracks(spark, sf_dir).withColumn("x", F.col("x") - 0.5)
    return rounded(features.zero_crossings(centred, ["track"]))


_FRAMES_SQL = "f AS (SELECT track, f, sqrt(avg(x * x)) AS rms, count(*) AS c FROM e, unnest(range(greatest(CAST(ceil((n - 15) / 4.0) AS BIGINT), 0), n // 4 + 1)) t(f) GROUP BY track, f HAVING count(*) = 16)"


@query(f"WITH {o.EVENT}, {_FRAMES_SQL} SELECT track, f, round(rms, 6) + 0.0 AS rms FROM f")
def framed_rms(spark, sf_dir):
    return rounded(features.framed_rms(_tracks(spark, sf_dir), ["track"], 16, 4))


@query(f"WITH {o.EVENT}, {_FRAMES_SQL} SELECT track, count(*) AS frames, round({o.db('quantile_cont(rms, 0.1)')}, 6) + 0.0 AS noise_floor_db FROM f GROUP BY track")
def noise_floor(spark, sf_dir):
    return rounded(features.noise_floor(_tracks(spark, sf_dir), ["track"], 16, 4))


@query(
    f"""WITH {o.EVENT}, b AS (SELECT track, b, avg(x * x) AS e FROM e, unnest(range(greatest(CAST(ceil((n - 25) / 6.0) AS BIGINT), 0), n // 6 + 1)) t(b) GROUP BY track, b HAVING count(*) = 26),
    g AS (SELECT *, {o.lu('avg(e) OVER (PARTITION BY track)')} - 10 AS gate FROM b WHERE {o.lu('e')} > -70)
    SELECT track, count(*) AS blocks, round({o.lu(f"coalesce(avg(e) FILTER (WHERE {o.lu('e')} > gate), avg(e))")}, 6) + 0.0 AS lufs FROM g GROUP BY track"""
)
def gated_loudness(spark, sf_dir):
    return rounded(features.gated_loudness(_tracks(spark, sf_dir), ["track"], 26, 6))


@query(
    f"""WITH {o.EVENT}, {_FRAMES_SQL}, a AS (SELECT *, quantile_cont(rms, 0.65) OVER (PARTITION BY track) AS least FROM f),
    k AS (SELECT track, f, row_number() OVER (PARTITION BY track ORDER BY f) - 1 AS pos, count(*) OVER (PARTITION BY track) AS cnt FROM a WHERE rms >= least),
    m AS (SELECT track, f * 4 AS centre FROM k WHERE pos = cnt // 2), z AS (SELECT track, max(n) + 1 AS length FROM e GROUP BY track)
    SELECT track, greatest(least(coalesce(centre, length // 2) - 10, length - 20), 0) AS start, least(greatest(least(coalesce(centre, length // 2) - 10, length - 20), 0) + 20, length) AS stop FROM z LEFT JOIN m USING (track)"""
)
def active_segment(spark, sf_dir):
    return features.active_segment(_tracks(spark, sf_dir), ["track"], 20, 16, 4).select("track", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query(f"WITH {o.EVENT} SELECT track, n // 8 AS segment, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high FROM e GROUP BY ALL")
def waveform_peaks(spark, sf_dir):
    return rounded(features.waveform_peaks(_tracks(spark, sf_dir), ["track"], 8))


@query(f"WITH {o.EVENT} SELECT track, n, round(x, 6) + 0.0 AS x, round(min(least(1.0::DOUBLE, 0.5 / (abs(x) + 1e-12))) OVER (PARTITION BY track ORDER BY n ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING), 6) + 0.0 AS gain FROM e")
def look_ahead_gain(spark, sf_dir):
    return rounded(features.look_ahead_gain(_tracks(spark, sf_dir), ["track"], 0.5, 8))


_MEDIAN = f"""{o.EVENT}, m AS (SELECT *, list_sort([coalesce(lag(x, 2) OVER w, 0), coalesce(lag(x) OVER w, 0), x, coalesce(lead(x) OVER w, 0), coalesce(lead(x, 2) OVER w, 0)])[3] AS median,
    lag(x) OVER w AS before, lead(x) OVER w AS after, lead(x, 2) OVER w AS edge FROM e WINDOW w AS (PARTITION BY track ORDER BY n))"""


@query(f"WITH {_MEDIAN} SELECT track, n, round(x, 6) + 0.0 AS x, round(median, 6) + 0.0 AS median, round(x - median, 6) + 0.0 AS residual FROM m")
def median_residual(spark, sf_dir):
    return rounded(features.median_residual(_tracks(spark, sf_dir), ["track"]))


@query(
    f"""WITH {_MEDIAN}, s AS (SELECT *, abs(x - median) AS residual, coalesce(abs(x - before), 0) AS slope FROM m),
    t AS (SELECT *, greatest((quantile_cont(residual, 0.5) OVER (PARTITION BY track) + 1e-9) * 12, 0.055) AS threshold, (quantile_cont(slope, 0.95) OVER (PARTITION BY track) + 1e-9) * 1.15 AS steep FROM s)
    SELECT track, n, round(x, 6) + 0.0 AS x, round((before + after) / 2, 6) + 0.0 AS repaired FROM t WHERE residual > threshold AND slope >= steep AND n > 1 AND edge IS NOT NULL"""
)
def click_candidates(spark, sf_dir):
    return rounded(features.click_candidates(_tracks(spark, sf_dir), ["track"]))


@query(f"WITH {o.EVENT}, g AS (SELECT *, avg(x) OVER (PARTITION BY track ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM e) SELECT track, n, round(greatest(least(5 * smooth * 0.24, 1), -1), 6) + 0.0 AS x FROM g WHERE n >= 2 AND n < (SELECT max(n) FROM e z WHERE z.track = g.track) - 1")
def five_tap_filter(spark, sf_dir):
    """The placeholder model: five equal taps of 0.24 and a hard clip, where all five samples are there."""
    rows = features.tapped(_tracks(spark, sf_dir), ["track"], [0.24] * 5)
    return rounded(rows.withColumn("x", F.greatest(F.least(F.col("x"), num(1.0)), num(-1.0))))


# Records of stereo tracks


@query(o.RECORD + " " + o.rounded(["track!", *o.NUMBERS], "FROM rec"))
def analysis_record(spark, sf_dir):
    return rounded(analyze(_pairs(spark, sf_dir)).select("track", *o.NUMBERS))


@query(f"WITH {o.PAIR}, q AS (SELECT track, l, l AS r FROM p), {o.record('q', mono=True)} " + o.rounded(["track!", "channels!", *o.NUMBERS], "FROM rec"))
def mono_record(spark, sf_dir):
    """The left channels as mono tracks."""
    mono = _pairs(spark, sf_dir).withColumn("r", F.lit(None).cast("array<double>"))
    return rounded(analyze(mono).select("track", "channels", *o.NUMBERS))


@query(o.RECORD + " SELECT track, array_to_string(quality_flags, ',') AS flags, len(quality_flags) AS n_flags FROM rec")
def quality_flags(spark, sf_dir):
    return analyze(_pairs(spark, sf_dir)).select("track", F.array_join("quality_flags", ",").alias("flags"), F.size("quality_flags").cast("long").alias("n_flags"))


@query(o.RECORD + " SELECT track, round(stereo_width, 6) + 0.0 AS stereo_width, round(phase_correlation, 6) + 0.0 AS phase_correlation FROM rec")
def stereo_image(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir).select("track", *(c.alias(n) for n, c in features.stereo_image(F.col("l"), F.col("r")).items())))


@query(f"WITH {o.PAIR}, s AS (SELECT track, i - 1 AS n, (l[i] + r[i]) / 2 AS mid, (l[i] - r[i]) / 2 AS side FROM p, unnest(range(1, 65)) t(i)) SELECT track, n, round(mid, 6) + 0.0 AS mid, round(side, 6) + 0.0 AS side, round(mid + side, 6) + 0.0 AS l FROM s")
def mid_side(spark, sf_dir):
    mid, side = features.mid_side(F.col("l"), F.col("r"))
    back = features.left_right(mid, side)[0]
    each = _pairs(spark, sf_dir).select("track", F.posexplode(F.arrays_zip(mid.alias("mid"), side.alias("side"), back.alias("l"))).alias("n", "s"))
    return rounded(each.select("track", F.col("n").cast("long").alias("n"), "s.mid", "s.side", "s.l"))


@query(o.RECORD + " SELECT track, round(low_energy, 6) + 0.0 AS low_energy, round(mid_energy, 6) + 0.0 AS mid_energy, round(high_energy, 6) + 0.0 AS high_energy, round(band_separation_score, 6) + 0.0 AS score, round(low, 6) + 0.0 AS low, round(mid, 6) + 0.0 AS mid, round(high, 6) + 0.0 AS high FROM rec")
def band_separation(spark, sf_dir):
    rec = analyze(_pairs(spark, sf_dir))
    return rounded(rec.select("track", "low_energy", "mid_energy", "high_energy", F.col("band_separation_score").alias("score"), "band_balance.*"))


@query(
    """WITH v AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS x FROM embeddings),
    d AS (SELECT vec_id, label, k, list_sum([x[n + 1] * cos(2 * pi() * k * n / 64) for n in range(0, 64)]) ** 2 + list_sum([x[n + 1] * sin(2 * pi() * k * n / 64) for n in range(0, 64)]) ** 2 AS p FROM v, unnest(range(0, 33)) t(k))
    SELECT label, k AS bin, count(*) AS cnt, round(avg(p), 6) + 0.0 AS power FROM d GROUP BY label, k"""
)
def spectrum_by_label(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    bins = spectral.power_spectrum(vectors, ["x"]).select("label", F.posexplode("power").alias("bin", "p"))
    return rounded(bins.groupBy("label", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("cnt"), F.avg("p").alias("power")))


@query(f"WITH {o.PAIR}, g AS (SELECT track, list_max([abs(v) for v in list_concat(l, r)]) AS peak, l, r FROM p) SELECT track, round(peak, 6) + 0.0 AS peak, round(list_max([abs(v * least(1.0::DOUBLE, 0.2 / peak)) for v in list_concat(l, r)]), 6) + 0.0 AS guarded, round(list_max([abs(v / peak * 0.98) for v in l]), 6) + 0.0 AS normalized FROM g")
def peak_guard(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("track", F.concat("l", "r").alias("x"), "l").withColumn("peak", F.array_max(F.transform("x", F.abs)))
    top = lambda values, gain: F.array_max(F.transform(values, lambda v: F.abs(v * gain)))
    return rounded(rows.select("track", "peak", top("x", F.least(num(1.0), num(0.2) / F.col("peak"))).alias("guarded"), top("l", num(0.98) / F.col("peak")).alias("normalized")))


@query(
    f"WITH {o.PAIR}, d AS (SELECT track, 0.05 * (track % 8) AS a, l FROM p), s AS (SELECT track, a, l, [CASE WHEN a > 0 THEN v * (1 - a) + tanh(v * (1 + 5 * a)) / tanh(1 + 5 * a) * a ELSE v END for v in l] AS y FROM d) SELECT track, round({o.lrms('l')}, 6) + 0.0 AS before_rms, round({o.lrms('y')}, 6) + 0.0 AS after_rms FROM s"
)
def saturation(spark, sf_dir):
    """The waveshaper as columns; amounts by the track's number."""
    a = F.col("a")
    rows = _pairs(spark, sf_dir).withColumn("a", (F.col("track") % 8) * 0.05)
    shaped = F.transform("l", lambda v: F.when(a > 0, v * (1 - a) + F.tanh(v * (1 + 5 * a)) / F.tanh(1 + 5 * a) * a).otherwise(v))
    return rounded(rows.select("track", rms(F.col("l")).alias("before_rms"), rms(shaped).alias("after_rms")))


# Names, addresses and options


_NAME = "concat(p_type, '/', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END, CASE p_partkey % 4 WHEN 0 THEN ':a?.WAV' WHEN 1 THEN ' .mp3' WHEN 2 THEN '.tar.flac' ELSE '. _' END)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("name", F.expr(_NAME))


_BASE = "regexp_extract(name, '([^/]*)$', 1)"
_CLEAN = lambda x, n: f"regexp_replace(left(regexp_replace({x}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), {n}), '^[ ._]+|[ ._]+$', '', 'g')"
_OR = lambda x, d: f"CASE WHEN trim({x}) = '' THEN '{d}' ELSE trim({x}) END"
_STEM = f"regexp_replace({_BASE}, '([^.])\\.[^.]*$', '\\1')"
_SAFE = f"SELECT *, CASE WHEN {_CLEAN(_OR(_STEM, 'audio'), 80)} = '' THEN 'audio' ELSE {_CLEAN(_OR(_STEM, 'audio'), 80)} END AS stem, CASE WHEN {_CLEAN(_OR(_BASE, 'download.wav'), 140)} = '' THEN 'download.wav' ELSE {_CLEAN(_OR(_BASE, 'download.wav'), 140)} END AS file FROM n"
_NAMES = f"n AS (SELECT p_partkey, {_NAME} AS name FROM part), s AS ({_SAFE})"


@query(f"WITH {_NAMES} SELECT p_partkey, stem, file, lower(regexp_extract(name, '[^./](\\.[^./]*)$', 1)) AS ext, lower(regexp_extract(name, '[^./](\\.[^./]*)$', 1)) IN ('.wav', '.mp3', '.m4a', '.flac') AS supported FROM s")
def safe_names(spark, sf_dir):
    name = F.col("name")
    return _named(spark, sf_dir).select("p_partkey", text.safe_stem(name).alias("stem"), text.safe_file_name(name).alias("file"), text.extension(name).alias("ext"), text.is_supported(name).alias("supported"))


@query(f"WITH {_NAMES} SELECT p_partkey, '/api/download/' || url_encode({_BASE}) || '?name=' || url_encode(file) AS url FROM s")
def download_urls(spark, sf_dir):
    return _named(spark, sf_dir).select("p_partkey", text.download_url(F.col("name"), F.col("name")).alias("url"))


@query(f"WITH {_NAMES}, r AS (SELECT p_partkey, stem, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, CASE WHEN k = 1 THEN stem || '.wav' ELSE printf('%s_%02d.wav', stem, k) END AS archive_name FROM r")
def batch_names(spark, sf_dir):
    """Names inside an archive; later ones of the same name get their number among them."""
    rows = _named(spark, sf_dir).select("p_partkey", text.safe_stem(F.col("name")).alias("stem"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("p_partkey")))
    return rows.select("p_partkey", F.when(F.col("k") == 1, F.concat("stem", F.lit(".wav"))).otherwise(F.format_string("%s_%02d.wav", "stem", "k")).alias("archive_name"))


_RATES = ["source", "auto", "48000", " 96000 ", "22050", "x", "", "SOURCE"]
_BITS = ["16", "24", "32", " 16", ""]


@query(
    f"""WITH x AS (SELECT p_partkey, {o._pick(_RATES, 'p_partkey')} AS rate, {o._pick(_BITS, 'p_partkey')} AS bits, CAST(8000 * (1 + p_partkey % 9) AS INTEGER) AS sr FROM part),
    y AS (SELECT *, lower(trim(CASE WHEN rate = '' THEN 'auto' ELSE rate END)) AS o, CASE WHEN sr < 32000 THEN 44100 ELSE sr END AS d FROM x)
    SELECT p_partkey, CAST(CASE WHEN o = 'source' THEN sr WHEN try_cast(o AS INTEGER) IN (44100, 48000, 96000) THEN try_cast(o AS INTEGER) ELSE d END AS INTEGER) AS sample_rate, CASE WHEN trim(bits) IN ('16', '24') THEN trim(bits) ELSE '24' END AS bit_depth FROM y"""
)
def output_format(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(_RATES, "p_partkey").alias("rate"), _pick(_BITS, "p_partkey").alias("bits"), (8000 * (1 + F.col("p_partkey") % 9)).cast("int").alias("sr"))
    return rows.select("p_partkey", text.sample_rate(F.col("rate"), F.col("sr"), text.default_sample_rate(F.col("sr"))).alias("sample_rate"), text.bit_depth(F.col("bits")).alias("bit_depth"))


_MODES, _QUALITIES = ["off", "2stem", " 4STEM ", "", "x"], ["fast", "Balanced", "precision", "", "x", " fast"]


@query(
    f"""WITH x AS (SELECT p_partkey, lower(trim({o._pick(_MODES, 'p_partkey')})) AS m, lower(trim({o._pick(_QUALITIES, 'p_partkey')})) AS q, p_partkey % 2 = 0 AS allowed FROM part),
    y AS (SELECT p_partkey, CASE WHEN m IN ('off', '2stem', '4stem') THEN m ELSE 'off' END AS mode, CASE WHEN q = 'fast' THEN q WHEN q = 'precision' AND allowed THEN q ELSE 'balanced' END AS quality FROM x)
    SELECT *, CASE quality WHEN 'fast' THEN '--overlap 0.10' WHEN 'precision' THEN '-n htdemucs_ft --overlap 0.35' ELSE '--overlap 0.25' END AS options,
        CAST(CASE WHEN mode = 'off' THEN 0 WHEN mode = '2stem' THEN CASE WHEN quality = 'fast' THEN 1 ELSE 2 END ELSE CASE quality WHEN 'fast' THEN 2 WHEN 'precision' THEN 8 ELSE 3 END END AS INTEGER) AS least,
        CAST(CASE WHEN mode = 'off' THEN 1 WHEN mode = '2stem' THEN CASE WHEN quality = 'fast' THEN 3 ELSE 5 END ELSE CASE quality WHEN 'fast' THEN 5 WHEN 'precision' THEN -1 ELSE 7 END END AS INTEGER) AS most FROM y"""
)
def stem_options(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", text.stem_mode(_pick(_MODES, "p_partkey")).alias("mode"), text.stem_quality(_pick(_QUALITIES, "p_partkey"), F.col("p_partkey") % 2 == 0).alias("quality"))
    rows = rows.withColumn("minutes", text.stem_minutes(F.col("mode"), F.col("quality")))
    return rows.select("p_partkey", "mode", "quality", F.array_join(text.separator_options(F.col("quality")), " ").alias("options"), "minutes.least", F.coalesce("minutes.most", F.lit(-1)).alias("most"))


_REPORT = "SELECT p_partkey, s AS stem, t AS kind FROM part, (VALUES ('vocals', 1), ('instrumental', 2), ('drums', 3), ('bass', 4), ('other', 5)) v(s, i), (VALUES ('raw', 0), ('enhanced', 1)) w(t, j) WHERE (p_partkey + i) % 3 > 0 AND (p_partkey + i + j) % 4 > 0"


@query(f"SELECT p_partkey, count(*) AS n, string_agg(kind || '_' || stem, ',' ORDER BY list_position(['vocals', 'instrumental', 'drums', 'bass', 'other'], stem), kind DESC) AS downloads FROM ({_REPORT}) GROUP BY p_partkey")
def stem_downloads(spark, sf_dir):
    """Rows for the raw and enhanced file of each stem that has one, in a fixed order, and a payload of them."""
    key = F.col("p_partkey")
    one = lambda s, i: F.when((key + i) % 3 > 0, F.struct(F.lit(i).alias("rank"), F.lit(s).alias("stem"), F.when((key + i) % 4 > 0, F.lit(f"{s}_raw.wav")).alias("raw"), F.when((key + i + 1) % 4 > 0, F.lit(f"{s}_new.wav")).alias("enhanced")))
    report = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_compact(F.array(*(one(s, i + 1) for i, s in enumerate(STEM_ORDER))))).alias("s"))
    files = report.select("p_partkey", "s.rank", "s.stem", F.expr("stack(2, 0, 'raw', s.raw, 1, 'enhanced', s.enhanced) AS (place, kind, file)")).filter("file is not null")
    rows = files.groupBy("p_partkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "place", F.concat("kind", F.lit("_"), "stem").alias("id")))).alias("d"))
    return rows.select("p_partkey", "n", F.array_join(F.transform("d", lambda x: x["id"]), ",").alias("downloads"))


# Rules


def _requests(rows: DataFrame) -> DataFrame:
    """Target, amount, manual parameters, volume mode and denoising asked for, and the rate that each track is said to have."""
    mode = F.when(F.col("track") % 4 == 1, "match_source").otherwise("target")
    asked = {"request": _pick(o.REQUESTS, "track"), "amount": (F.col("track") % 12) / num(10.0), "manual": _pick(o.MANUALS, "track"), "volume_mode": mode, "use_denoise": F.col("track") % 3 != 0}
    return rows.withColumns(asked | ({"sr": _pick(o.RATES, "track")} if "sr" in rows.columns else {}))


_REQ = f"WITH {o.PAIR}, {o.PRESET_TABLE}, {o.REQUEST_TABLE}, {o.BLEND}"


@query(f"{_REQ} SELECT track, array_to_string(targets, '+') AS target, round(1.0::DOUBLE / len(targets), 6) AS weight, {', '.join(f'round(b.{p}, 6) + 0.0 AS {p}' for p in PARAMETERS)}, (list_has_all(targets, ['restore', 'loud_modern']) OR list_has_all(targets, ['hifi_bright', 'warm_analog']) OR list_has_all(targets, ['bass_boost', 'voice_focus'])) AS opposed FROM q JOIN b USING (track)")
def target_blend(spark, sf_dir):
    rows = rules.with_targets(_requests(_pairs(spark, sf_dir).select("track")))
    return rounded(rows.select("track", F.array_join("targets", "+").alias("target"), "weight", *(F.col(f"preset_{p}").alias(p) for p in PARAMETERS), "opposed"))


@query(f"{_REQ} SELECT track, array_to_string(CASE WHEN len(targets) >= 2 THEN targets[1:3] ELSE list_filter([targets[1], 'hifi_clean', 'warm_analog', 'bass_boost', 'hifi_bright'], lambda t, i: list_position([targets[1], 'hifi_clean', 'warm_analog', 'bass_boost', 'hifi_bright'], t) = i)[1:3] END, ',') AS previews FROM q")
def preview_targets(spark, sf_dir):
    rows = rules.with_targets(_requests(_pairs(spark, sf_dir).select("track")))
    return rows.select("track", F.array_join(text.preview_targets(F.col("targets")), ",").alias("previews"))


@query(f"WITH {o.PAIR}, {o.record()}, {o.REQUEST_TABLE}, {o.ADAPTIVE} SELECT track, round(effective, 6) + 0.0 AS effective, round(effective - amount, 6) + 0.0 AS adjustment, round(risk_score, 6) + 0.0 AS risk_score, round(enhancement_need, 6) + 0.0 AS enhancement_need, source_condition FROM am")
def adaptive_amount(spark, sf_dir):
    rows = rules.with_targets(_requests(_records(spark, sf_dir))).withColumn("amount", F.least("amount", num(1.0)))
    return rounded(rules.adaptive_amount(rows).select("track", "effective", "adjustment", "risk_score", "enhancement_need", "source_condition"))


@query(f"{o.REQUESTED} SELECT track, target, CASE WHEN {o.SR} < 32000 THEN 'upsample' ELSE 'denoise' END AS mode, round(intensity, 6) + 0.0 AS intensity, {', '.join(f'round({o._CLAMP[p](p)}, 6) + 0.0 AS {p}' for p in PARAMETERS)}, round(confidence, 6) + 0.0 AS confidence, CAST(CASE WHEN {o.SR} < 32000 THEN 44100 ELSE {o.SR} END AS INTEGER) AS output_sr FROM r8")
def recommendation(spark, sf_dir):
    rows = rules.recommend(_requests(_records(spark, sf_dir)))
    return rounded(rows.select("track", "target", "mode", "intensity", *(F.col(f"dsp_params.{p}") for p in PARAMETERS), "confidence", "output_sr"))


@query(f"{o.REQUESTED} SELECT track, round(tone_factor, 6) + 0.0 AS tone, round(dynamics_factor, 6) + 0.0 AS dynamics, round(harmonics_factor, 6) + 0.0 AS harmonics, round(stereo_factor, 6) + 0.0 AS stereo, round(stem_factor, 6) + 0.0 AS stem, round(harmonic_factor, 6) + 0.0 AS harmonic_factor FROM r8")
def dsp_budget(spark, sf_dir):
    rows = rules.recommend(_requests(_records(spark, sf_dir)))
    return rounded(rows.select("track", "reductions.*", "harmonic_factor"))


@query(q.manual_parameters())
def manual_parameters(spark, sf_dir):
    rows = rules.for_request(_requests(_records(spark, sf_dir))).filter("manual_dsp")
    return rounded(rows.select("track", *(F.col(f"dsp_params.{p}") for p in PARAMETERS)))


@query(q.request_modes())
def request_modes(spark, sf_dir):
    """What the request changes in the recommendation: denoising, volume mode and manual parameters."""
    rows = rules.for_request(_requests(_records(spark, sf_dir)))
    return rounded(rows.select("track", "mode", "volume_mode", "output_sr", "manual_dsp", "dsp_params.target_lufs", "dsp_params.limiter_ceiling_db"))


@query(q.recommendation_advice())
def recommendation_advice(spark, sf_dir):
    """Reasons and advice in words."""
    rows = rules.for_request(_requests(_records(spark, sf_dir)))
    return rows.select("track", "target", "mode", F.array_join("reasons", ",").alias("reasons"), "advice")


# Before and after


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records before and after a simple processing that SQL can follow: gain and saturation by the track's number."""
    drive, gain = 1 + F.col("track") % 3, 1 + F.col("track") % 4
    done = lambda c, g: F.transform(c, lambda v: g * gain * F.tanh(v * drive) / F.tanh(drive))
    both = _pairs(spark, sf_dir).withColumns({"out_l": done("l", num(0.8)), "out_r": done("r", num(0.7))})
    rows = with_record(with_record(both, "before", keep=["track", "out_l", "out_r"]), "after", ("out_l", "out_r"), keep=["track", "before"])
    mode = F.when(F.col("track") % 2 == 1, "match_source").otherwise("target")
    sample_peaks = {n: F.col(n).withField("true_peak_db", F.col(f"{n}.peak_db")) for n in ("before", "after")}
    return rows.withColumns(sample_peaks | {"target": _pick(["hifi_clean", "loud_modern", "hifi_bright+voice_focus"], "track"), "volume_mode": mode})


@query(f"{o.COMPARED}, d AS (SELECT j.track, {o.DRIFT} AS f FROM j) SELECT track, array_to_string(f, ',') AS flags, CASE WHEN len(f) = 0 THEN 'none' WHEN list_has_any(f, ['headroom_risk', 'phase_correlation_loss', 'transient_flattening', 'high_band_harshness']) OR len(f) >= 3 THEN 'severe' ELSE 'warning' END AS severity FROM d")
def quality_drift(spark, sf_dir):
    found = _compared(spark, sf_dir).withColumn("flags", validation.drift_flags(F.col("target"), F.col("volume_mode"), num(-1.5)))
    return found.select("track", F.array_join("flags", ",").alias("flags"), validation.drift_severity(F.col("flags")).alias("severity"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation(_compared(spark, sf_dir), F.col("target"), F.col("volume_mode"), num(-16.0), num(-1.5))


@query(f"{o.COMPARED}, {o.CHECKS} SELECT track, statuses, round(penalties, 6) + 0.0 AS penalties, round(bonuses, 6) + 0.0 AS bonuses, round(score, 6) + 0.0 AS score, overall FROM v")
def quality_validation(spark, sf_dir):
    statuses = F.array_join(F.transform("checks", lambda c: c["status"]), ",")
    return rounded(_validated(spark, sf_dir).select("track", statuses.alias("statuses"), "penalties", "bonuses", "score", "overall"))


@query(f"{o.COMPARED}, {o.CHECKS}, z AS (SELECT *, row_number() OVER (PARTITION BY track // 5 ORDER BY round(score, 6) DESC, track) AS k FROM v) SELECT track // 5 AS request, track, round(score, 6) + 0.0 AS score FROM z WHERE k = 1")
def best_target(spark, sf_dir):
    """Five tracks in a row stand for the candidates of one request."""
    rows = rounded(_validated(spark, sf_dir).select(F.floor(F.col("track") / 5).cast("long").alias("request"), "track", "score"))
    return validation.best(rows, ["request"], "score", "track").select("request", "track", "score")


_DELTAS = ["lufs", "peak_db", "noise_floor_db", "crest_db", "high_energy", "stereo_width", "phase_correlation", "band_separation_score"]


@query(
    f"""{o.COMPARED} SELECT j.track, {', '.join(f'round(a.{n} - b.{n}, 6) + 0.0 AS {n}' for n in _DELTAS)}, abs(a.lufs - b.lufs) <= CASE WHEN {o.MODE} THEN 1.25 ELSE 1 END AS volume_matched,
    round(least(1.0::DOUBLE, 10 ** ((least(a.lufs, b.lufs) - b.lufs) / 20)), 6) AS original_gain, round(least(1.0::DOUBLE, 10 ** ((least(a.lufs, b.lufs) - a.lufs) / 20)), 6) AS enhanced_gain,
    round({o.clip('100 - (abs(a.stereo_width - b.stereo_width) * 120 + abs(a.phase_correlation - b.phase_correlation) * 80)', 0, 100)}, 6) + 0.0 AS stereo_preservation_score FROM j"""
)
def comparison_report(spark, sf_dir):
    rows = validation.comparison(_compared(spark, sf_dir), F.col("volume_mode"), num(-1.5))
    flat = rows.select("track", *(F.col(f"delta.{n}") for n in _DELTAS), "summary.volume_matched", "summary.original_gain", "summary.enhanced_gain", "summary.stereo_preservation_score")
    return rounded(flat)


@query(
    f"""{o.COMPARED}, s AS (SELECT j.track, a.rms AS ar, b.rms AS br, a.lufs AS al, b.lufs AS bl, a.peak AS ap FROM j) SELECT track, round({o.clip('bl - al', -18, 8)}, 6) + 0.0 AS desired_db, round(least({o.clip('bl - al', -18, 8)}, {o.db('10 ** (-1.5 / 20) / ap')}), 6) + 0.0 AS gain_db FROM s"""
)
def loudness_match_gain(spark, sf_dir):
    """Gain towards the source's loudness as far as the sample peak leaves room."""
    rows = _compared(spark, sf_dir)
    wanted = F.greatest(F.least(-validation.delta("lufs"), num(8.0)), num(-18.0))
    return rounded(rows.select("track", wanted.alias("desired_db"), F.least(wanted, decibels(num(10 ** (-1.5 / 20)) / F.col("after.peak"))).alias("gain_db")))


# Stems


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumns({"song": F.floor(F.col("track") / 5).cast("long"), "stem": _pick(STEM_ORDER, "track")})
    return stems.risk_entries(rows)


_SUBSCORES = ["artifact", "bleed", "transient_smear", "phase_instability", "residual_mismatch", "score", "phase_safety_factor", "transient_safety_factor"]


@query(f"{o.RISKS} SELECT song, stem, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _SUBSCORES)} FROM e")
def stem_risk_entries(spark, sf_dir):
    return rounded(_risks(spark, sf_dir).select("song", "stem", *_SUBSCORES))


@query(
    f"""{o.RISKS} SELECT song, stem, concat_ws(', ', CASE WHEN spectral_flatness > 0.12 THEN 'high spectral flatness' WHEN spectral_flatness > 0.08 THEN 'moderate spectral flatness' END,
    CASE WHEN noise_floor_db > -42 THEN 'high stem noise floor' WHEN noise_floor_db > -50 THEN 'moderate stem noise floor' END, CASE WHEN crest_db < 6 THEN 'flat stem dynamics' END,
    CASE WHEN stem IN ('vocals', 'other') AND stereo_width > 1.25 THEN 'wide diffuse stem image' END, CASE WHEN phase_correlation < 0.05 THEN 'phase-sensitive stem' END,
    CASE WHEN stem = 'vocals' AND high_energy > 0.42 AND NOT ((spectral_flatness > 0.08) AND (noise_floor_db > -50) AND (crest_db < 6) AND (stereo_width > 1.25) AND (phase_correlation < 0.05)) THEN 'vocal stem has strong high-band bleed' END) AS reasons FROM e"""
)
def stem_risk_reasons(spark, sf_dir):
    return _risks(spark, sf_dir).select("song", "stem", F.array_join(stems.artifact_reasons(), ", ").alias("reasons"))


@query(f"{o.RISKS} SELECT song, count(*) AS stems, round(avg(score), 6) + 0.0 AS average, round(max(score), 6) + 0.0 AS max, CASE WHEN avg(score) < 0.45 THEN 'allow' WHEN avg(score) <= 0.65 THEN 'attenuate' ELSE 'fallback' END AS decision, CASE WHEN avg(score) > 0.65 THEN '2stem' ELSE '4stem' END AS mode FROM e GROUP BY song")
def stem_risk_map(spark, sf_dir):
    rows = stems.risk_map(_risks(spark, sf_dir), ["song"])
    return rounded(rows.withColumn("mode", stems.fallback_mode(F.lit("4stem"), F.col("average"))))


@query(f"{o.RISKS} SELECT song, stem, round({o.clip('CASE WHEN stem = $$vocals$$ THEN 0.36 ELSE 0.45 END * CASE WHEN stem IN ($$vocals$$, $$instrumental$$) THEN 1 ELSE 0.92 END * 0.6::DOUBLE * (1 - score) ** 2 * phase_safety_factor * transient_safety_factor', 0, 0.45)}, 6) + 0.0 AS amount FROM e")
def stem_safe_amount(spark, sf_dir):
    return rounded(_risks(spark, sf_dir).select("song", "stem", stems.safe_amount(num(0.6)).alias("amount")))


@query(
    f"""{o.REQUESTED}, z AS (SELECT track, {o._pick(STEM_ORDER, 'track')} AS stem, effective, {', '.join(f'{o._CLAMP[p](p)} AS {p}' for p in PARAMETERS)} FROM r8)
    SELECT track, stem, {', '.join(f'round({o.role(p)}, 6) + 0.0 AS {p}' for p in PARAMETERS)}, round(least(effective, CASE stem {' '.join(f"WHEN '{s}' THEN {c}" for s, (c, _) in STEM_ROLES.items())} END), 6) + 0.0 AS strength FROM z"""
)
def stem_role_tuning(spark, sf_dir):
    rows = rules.recommend(_requests(_records(spark, sf_dir))).withColumns({"stem": _pick(STEM_ORDER, "track"), "strength": F.col("effective")})
    tuned = stems.role_tuned(rows)
    return rounded(tuned.select("track", "stem", *(F.col(f"dsp_params.{p}") for p in PARAMETERS), "strength"))


@query(q.stem_recommendation())
def stem_recommendation(spark, sf_dir):
    """Conservative parameters and strength of each stem, by its risk."""
    rows = rules.recommend(_requests(_risks(spark, sf_dir))).withColumn("strength", F.col("intensity"))
    tuned = stems.role_tuned(stems.conservative(rows))
    return rounded(tuned.select("song", "stem", *(F.col(f"dsp_params.{p}") for p in PARAMETERS), "strength", "reduction"))


def _stem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.vector_stems(table(spark, sf_dir, "embeddings")).select("track", "stem", F.posexplode("x").alias("n", "x"))


@query(f"WITH {o.STEM} SELECT track, n, round(sum(x * {o.STEM_GAIN}), 6) + 0.0 AS mix FROM s GROUP BY track, n")
def stem_mix(spark, sf_dir):
    return rounded(stems.mix(_stem_samples(spark, sf_dir).withColumn("n", F.col("n").cast("long")), ["track"]))


@query(f"WITH {o.STEM}, w AS (SELECT *, sum(x) OVER (PARTITION BY track, n) - x AS others FROM s) SELECT track, stem, round(sqrt(avg(others * others)), 6) + 0.0 AS reference_rms FROM w GROUP BY track, stem")
def all_but_one(spark, sf_dir):
    rows = stems.others(_stem_samples(spark, sf_dir), ["track"])
    return rounded(rows.groupBy("track", "stem").agg(F.sqrt(F.avg(F.col("others") * F.col("others"))).alias("reference_rms")))


@query(
    f"""WITH {o.STEM}, m AS (SELECT track, n, sum(x) AS src, sum(x * {o.STEM_GAIN}) AS mix FROM s GROUP BY track, n), r AS (SELECT track, sqrt(avg(src * src)) AS source_rms, sqrt(avg((src - mix) ** 2)) AS residual_rms FROM m GROUP BY track)
    SELECT track, round(source_rms, 6) + 0.0 AS source_rms, round(residual_rms, 6) + 0.0 AS residual_rms, round(residual_rms / source_rms, 6) + 0.0 AS source_ratio, round({o.clip(f"0.03 + {o.clip('1 - residual_rms / source_rms', 0.12, 0.95)} * 0.22", 0.03, 0.25)}, 6) + 0.0 AS blend FROM r"""
)
def residual_ratio(spark, sf_dir):
    """The plain sum of the stems as source, their weighted sum as mix; the ratio stands for the risk."""
    samples = _stem_samples(spark, sf_dir)
    source = samples.groupBy("track", "n").agg(F.sum("x").alias("x"))
    rows = stems.residual(stems.mix(samples, ["track"]), source, ["track"])
    return rounded(rows.withColumn("blend", stems.residual_blend(F.col("source_ratio"))))


_GA, _LA = STEM_GAINS["vocals"][:2]


@query(
    f"""WITH x AS (SELECT a.vec_id // 2 AS track, a.embedding[n]::DOUBLE AS a, b.embedding[n]::DOUBLE AS b FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1, unnest(range(1, 65)) t(n)),
    s AS (SELECT track, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * (0.9 * a + b + 0.1 * a * b)) AS ay, sum(b * (0.9 * a + b + 0.1 * a * b)) AS yb FROM x GROUP BY track),
    g AS (SELECT track, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ga, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS gb FROM s)
    SELECT track, round({o.clip('ga', _GA * 10 ** (-_LA / 20), _GA * 10 ** (_LA / 20))}, 6) + 0.0 AS gain_a, round({o.clip('gb', _GA * 10 ** (-_LA / 20), _GA * 10 ** (_LA / 20))}, 6) + 0.0 AS gain_b FROM g"""
)
def fitted_stem_gains(spark, sf_dir):
    """Least-squares gains of two stems against a source that holds a little of their product besides."""
    rows = _pairs(spark, sf_dir).select("track", F.inline(F.arrays_zip(F.col("l").alias("a"), F.col("r").alias("b"))))
    rows = rows.withColumn("y", F.col("a") * 0.9 + F.col("b") + F.col("a") * F.col("b") * 0.1)
    return rounded(stems.fitted_gains(rows, "a", "b", "y", ["track"]).select("track", "gain_a", "gain_b"))


@query(f"WITH {o.EVENT}, z AS (SELECT t.track, u.n FROM (SELECT DISTINCT track FROM e) t, unnest(range(0, 40 + t.track % 50)) u(n)), g AS (SELECT track, n, coalesce(x, 0) AS x FROM z LEFT JOIN e USING (track, n)) SELECT track, count(*) AS length, round(sum(x), 6) + 0.0 AS total FROM g GROUP BY track")
def fitted_length(spark, sf_dir):
    """Each series cut or continued with zeros to a length of its own."""
    samples = _tracks(spark, sf_dir)
    lengths = samples.select("track").distinct().withColumn("length", (40 + F.col("track") % 50).cast("int"))
    rows = stems.aligned(samples, lengths, ["track"])
    return rounded(rows.groupBy("track").agg(F.count("*").alias("length"), F.sum("x").alias("total")))


@query(f"WITH {o.PAIR}, m AS (SELECT track, i - 1 AS n, l[i] AS a, r[i] AS b FROM p, unnest(range(1, 65)) t(i)) SELECT track, n, round((a + b) / 2, 6) + 0.0 AS mono, round(a, 6) + 0.0 AS first, round(b, 6) + 0.0 AS third FROM m")
def fixed_channels(spark, sf_dir):
    """Two channels as one, and as three."""
    samples = signals.long_form(_pairs(spark, sf_dir))
    one = stems.with_channels(samples, ["track"], 1).select("track", "n", F.col("x").alias("mono"))
    three = stems.with_channels(samples, ["track"], 3).groupBy("track", "n").agg(F.max(F.when(F.col("channel") == 0, F.col("x"))).alias("first"), F.max(F.when(F.col("channel") == 2, F.col("x"))).alias("third"))
    return rounded(one.join(three, ["track", "n"]).withColumn("n", F.col("n").cast("long")))


# Kernels: recursions, filters and spectra


def _kernel(spark: SparkSession, sf_dir: str, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    rows = signals.vector_tracks(table(spark, sf_dir, "embeddings"), gain=3.0).withColumn("amount", (F.col("track") % 8) / num(8.0))
    return rounded(mastering.map_tracks(rows, ["l", "r"], ["amount"], {n: "double" for n in names}, fn).select("track", *names))


@query(
    f"""WITH RECURSIVE {o.PAIR}, g AS (SELECT track, i, least(1.0::DOUBLE, 0.2 / (abs(3 * l[i]) + 1e-12)) AS t FROM p, unnest(range(1, 65)) u(i)),
    r(track, i, c) AS (SELECT track, 0::BIGINT, 1.0::DOUBLE FROM p UNION ALL SELECT g.track, g.i, g.t + (r.c - g.t) * CASE WHEN g.t < r.c THEN exp(-0.5::DOUBLE) ELSE exp(-0.05::DOUBLE) END FROM r JOIN g ON g.track = r.track AND g.i = r.i + 1)
    SELECT track, round(min(c) FILTER (WHERE i > 0), 6) + 0.0 AS least, round(max(c) FILTER (WHERE i = 64), 6) + 0.0 AS last FROM r GROUP BY track"""
)
def attack_release(spark, sf_dir):
    """The state-dependent one-pole recursion, against a recursive query."""

    def fn(left, right, amount):
        c = kernels.envelope(np.minimum(1.0, 0.2 / (np.abs(left) + 1e-12)), 1.0, float(np.exp(-0.5)), float(np.exp(-0.05)))
        return {"least": c.min(axis=-1), "last": c[:, -1]}

    return _kernel(spark, sf_dir, fn, ["least", "last"])


@query(q.k_weighted_loudness())
def k_weighted_loudness(spark, sf_dir):
    """Tracks shorter than a block, and of a few blocks."""
    fn = lambda a, b, m: {"lufs": kernels.integrated_loudness([a, b], 400.0), "gated_lufs": kernels.integrated_loudness([a, b], 101.0), "true_peak_db": kernels.db(kernels.true_peak([a, b]))}
    return _kernel(spark, sf_dir, fn, ["lufs", "gated_lufs", "true_peak_db"])


@query(q.compressor())
def compressor(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a, b, m: {"rms": kernels.rms(kernels.compress(a, 2_000.0, 1 + 3 * m)), "crest_db": kernels.crest([kernels.compress(a, 2_000.0, 1 + 3 * m)])}, ["rms", "crest_db"])


@query(q.limiter())
def limiter(spark, sf_dir):
    def fn(a, b, m):
        out = kernels.limit([a, b], -6 * m - 1, 2_000.0)
        return {"peak": kernels.sample_peak(out), "rms": kernels.rms(out[0])}

    return _kernel(spark, sf_dir, fn, ["peak", "rms"])


@query(q.output_safety())
def output_safety(spark, sf_dir):
    """Loudness towards a target, limiter, trim, and the last safety, plain and strict."""

    def fn(a, b, m):
        sr, ceiling = 8_000.0, -1.2 - m
        out, gain = guards.loudness_set((a, b), sr, -14 + 12 * m, ceiling)
        loud = kernels.limit(list(out), ceiling, sr)
        cut, by = kernels.trimmed(loud, kernels.true_peak(loud), ceiling)
        plain, strict = guards.safe(out, sr, ceiling), guards.safe(out, sr, np.minimum(ceiling, mastering.MANUAL_CEILING), True)
        return {"gain_db": gain, "limited_peak": kernels.sample_peak(loud), "cut_db": by, "cut_rms": kernels.rms(cut[0]), "safe_peak": kernels.true_peak(list(plain)), "strict_peak": kernels.true_peak(list(strict)), "strict_rms": kernels.rms(strict[0])}

    return _kernel(spark, sf_dir, fn, ["gain_db", "limited_peak", "cut_db", "cut_rms", "safe_peak", "strict_peak", "strict_rms"])


@query(q.spectral_gate())
def spectral_gate(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a, b, m: {"rms": kernels.rms(kernels.gate(a, m, 32, 8)), "cleaned_rms": kernels.rms(kernels.bleed_cleaned(a, b, 8_000.0, 32, 8))}, ["rms", "cleaned_rms"])


@query(q.tone_and_harmonics())
def tone_and_harmonics(spark, sf_dir):
    def fn(a, b, m):
        shaped = kernels.shape(kernels.high_pass(a, 8_000.0, 80.0), 8_000.0, 6 * m, -3 * m, 3 * m)
        excited = kernels.excite(kernels.saturate(shaped, m), 48_000.0, m)
        finer = kernels.resampled(a, 8_000.0, 12_000.0)
        return {"shaped_rms": kernels.rms(shaped), "excited_rms": kernels.rms(kernels.smooth_top(excited, 48_000.0, m)), "resampled_rms": kernels.rms(finer), "resampled_peak": kernels.sample_peak([finer])}

    return _kernel(spark, sf_dir, fn, ["shaped_rms", "excited_rms", "resampled_rms", "resampled_peak"])


@query(q.click_repair())
def click_repair(spark, sf_dir):
    def fn(a, b, m):
        fixed, count = kernels.repair_clicks(a)
        return {"clicks": count.astype(float), "rms": kernels.rms(fixed), "onset": kernels.onset_mask(a, 8_000.0).mean(axis=-1)}

    return _kernel(spark, sf_dir, fn, ["clicks", "rms", "onset"])


# Each guard on a copy that was driven, narrowed and tilted: what it leaves


def _guard_query(spark: SparkSession, sf_dir: str, fn: Callable[[guards.Stereo, guards.Stereo, np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    return _kernel(spark, sf_dir, lambda a, b, m: fn((a, b), (np.tanh(2 * a) * (1 + m[:, None]), np.tanh(2 * b)), m), names)


@query(q.comparison_guards("levels"))
def comparison_guards(spark, sf_dir):
    """Balance, width, low bass, tone and the equaliser that follows the source, for each of its targets."""

    def fn(source, done, m):
        sr = 8_000.0
        low, gain = guards.low_bass(source, done, sr)
        out = {"balance": kernels.rms(guards.channel_balance(source, done)[0]), "width": guards.width(*guards.mid_side(guards.width_match(source, done)))}
        out |= {"low_bass_db": gain, "low_bass_rms": kernels.rms(low[0]), "tone": kernels.rms(guards.band_balance(source, done, sr)[0])}
        equalised = lambda target: kernels.rms(guards.dynamic_eq(source[0], done[0], sr, 32, 8, target))
        return out | {"dynamic_eq": equalised(""), "dynamic_eq_bright": equalised("hifi_bright"), "dynamic_eq_bass": equalised("bass_boost")}

    return _guard_query(spark, sf_dir, fn, ["balance", "width", "low_bass_db", "low_bass_rms", "tone", "dynamic_eq", "dynamic_eq_bright", "dynamic_eq_bass"])


@query(q.comparison_guards("bands"))
def band_guards(spark, sf_dir):
    """Widths band by band, the scaled change and the tilt between the channels."""

    def fn(source, done, m):
        sr = 8_000.0
        delta = guards.delta(source, done, sr, m)
        tilted, drift = guards.tilt(source, done, 12_000.0)
        return {"bands": guards.width(*guards.mid_side(guards.band_widths(source, done, sr))), "delta": kernels.sample_peak(list(delta)), "delta_rms": kernels.rms(delta[1]), "tilt_db": drift, "tilted": kernels.rms(tilted[0])}

    return _guard_query(spark, sf_dir, fn, ["bands", "delta", "delta_rms", "tilt_db", "tilted"])


@query(q.comparison_guards("onsets"))
def onset_guards(spark, sf_dir):
    """Harshness, sibilance, onsets in all and by band, and the source's loudness."""

    def fn(source, done, m):
        (a, da), sr = (source[0], done[0]), 8_000.0
        harsh, cut = guards.harshness(a, da, 20_000.0)
        crisp, loss = guards.transients(source, done, sr)
        matched, gain = guards.loudness_match(source, done, sr, np.full(len(m), -1.5))
        out = {"harshness_db": cut, "harshness_rms": kernels.rms(harsh), "bright_db": guards.harshness(a, da, 20_000.0, True)[1], "sibilance_db": guards.sibilance(a, da, 24_000.0)[1]}
        out |= {"transient_db": loss, "transient_rms": kernels.rms(crisp[0]), "band_transients": kernels.rms(guards.band_transients(a, da, sr))}
        return out | {"matched_db": gain, "matched_peak": kernels.sample_peak(list(matched))}

    return _guard_query(spark, sf_dir, fn, ["harshness_db", "harshness_rms", "bright_db", "sibilance_db", "transient_db", "transient_rms", "band_transients", "matched_db", "matched_peak"])


@query(q.stem_guards())
def stem_guards(spark, sf_dir):
    """Each role's guard, the shaped residual and how much of it is kept, and the finished remix."""

    def fn(source, done, m):
        sr = 8_000.0
        roles = {r: stem_audio.role_guard(r, source, done, 24_000.0 if r == "vocals" else sr) for r in ("vocals", "bass", "drums", "other")}
        raw_sum = (source[0] * 0.8, source[1])
        shaped = stem_audio.shaped_residual(tuple(s - r for s, r in zip(source, raw_sum)), source, sr)
        kept, gain = stem_audio.residual_kept(done, raw_sum, source, m, sr)
        out = stem_audio.finished(source, kept, sr)
        found = {"vocals": roles["vocals"][0], "bass": roles["bass"][0], "drums": roles["drums"][1], "other": roles["other"][0], "residual_rms": shaped[0], "kept_rms": kept[1], "final_rms": out[0]}
        return {n: kernels.rms(x) for n, x in found.items()} | {"residual_gain": gain, "final_peak": kernels.true_peak(list(out))}

    return _guard_query(spark, sf_dir, fn, ["vocals", "bass", "drums", "other", "residual_rms", "residual_gain", "kept_rms", "final_peak", "final_rms"])


def _sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with their record, as a struct ``before`` and as columns."""
    return with_record(_pairs(spark, sf_dir), "before", scale=PEAKED).select("*", "before.*")


def _mastered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastering.mastered(rules.for_request(_requests(_sounds(spark, sf_dir))))


@query(q.mastering_chain())
def mastering_chain(spark, sf_dir):
    """The whole chain with each track's own recommendation: level and true peak before and after."""
    rows = _mastered(spark, sf_dir)
    return rounded(rows.select("track", "target", "mode", "true_peak_db", "true_peak_out_db", rms(F.concat("out_l", "out_r")).alias("rms_out"), (mean(F.col("out_l")) + mean(F.col("out_r"))).alias("dc_out")))


@query(q.chain_steps(mastering.STEPS))
def chain_steps(spark, sf_dir):
    """What the chain did to each track, in words."""
    return _mastered(spark, sf_dir).select("track", F.array_join("steps", "; ").alias("steps"))


def _drift() -> Column:
    return validation.drift_flags(F.col("target"), F.col("volume_mode"), F.col("dsp_params.limiter_ceiling_db"))


def _guarded(done: DataFrame, *keep: str) -> DataFrame:
    """What the chain did is analysed again; where it drifted, some of the source is blended back, levelled and analysed once more."""
    grown = F.when(F.col("low_side_growth") == 1, F.array(F.lit("low_bass_side_growth"))).otherwise(F.array().cast("array<string>"))
    known = [*keep, "target", "volume_mode", "dsp_params", "l", "r", "out_l", "out_r", "before"]
    rows = mastering.with_low_side_growth(with_record(done, "after", ("out_l", "out_r"), PEAKED, known))
    rows = rows.withColumn("flags", F.concat(_drift(), grown)).withColumn("severity", validation.drift_severity(F.col("flags")))
    return with_record(mastering.guarded(rows.drop("after")), "after", ("out_l", "out_r"), PEAKED)


@query(q.post_quality_guard())
def post_quality_guard(spark, sf_dir):
    """The guard after the chain."""
    drift, rows = _drift(), _guarded(_mastered(spark, sf_dir), "track")
    rows = rows.withColumn("after_flags", F.when(F.col("blend") > 0, drift).otherwise(F.array().cast("array<string>")))
    return rounded(rows.select("track", F.array_join("flags", ",").alias("flags"), "severity", "blend", rms(F.concat("out_l", "out_r")).alias("rms_out"), F.array_join("after_flags", ",").alias("after_flags"), "guarded_peak_db"))


@query()
def target_previews(spark, sf_dir):
    """Up to five targets for each track through the chain and the guard after it; the one with the highest validation score."""
    rows = _sounds(spark, sf_dir)
    asked = rules.with_targets(_requests(rows)).select(*rows.columns, "amount", F.lit("target").alias("volume_mode"), F.posexplode(text.preview_targets(F.col("targets"), 5)).alias("position", "request"))
    known = _guarded(mastering.mastered(rules.recommend(asked)), "track", "position")
    scored = validation.validation(known, F.col("target"), F.lit("target"), F.col("dsp_params.target_lufs"), F.col("dsp_params.limiter_ceiling_db"), guarded=F.col("blend") > 0)
    return rounded(validation.best(scored, ["track"]).select("track", "target", "score", "overall"))


@query()
def stem_remix(spark, sf_dir):
    """Five stems a song through their chains and back together, with what no stem holds."""
    rows = rules.for_request(stems.stem_requests(_requests(_risks(spark, sf_dir))))
    tuned = stems.role_tuned(stems.conservative(rows.withColumn("strength", F.col("intensity"))))
    sound = _pairs(spark, sf_dir).withColumns({"extra_l": F.transform("r", lambda v: v * 0.02), "extra_r": F.transform("l", lambda v: v * 0.02)})
    parts = tuned.select("track", "song", "stem", "score", "strength", "mode", "target", "dsp_params").join(sound, "track").drop("track").withColumnRenamed("song", "track")
    out = stem_audio.remixed(parts)
    return rounded(out.select("track", "stems", "residual_gain", rms(F.concat("out_l", "out_r")).alias("rms_out"), F.array_max(F.transform(F.concat("out_l", "out_r"), F.abs)).alias("peak_out")))


# The light client, files and reports


_LIGHT = ", ".join(f"('{t}', {i}, {v[5]}::DOUBLE)" for i, (t, v) in enumerate(LIGHT_PRESETS.items()))


@query(
    f"""WITH {o.PAIR}, a AS (SELECT track, list_concat(l, r) AS x, l, r FROM p), b AS (SELECT track, x, {o.lrms('x')} AS rms, list_max([abs(v) for v in x]) AS peak, sqrt(list_sum([((l[i] - r[i]) / 2) ** 2 for i in range(1, 65)]) / greatest(list_sum([((l[i] + r[i]) / 2) ** 2 for i in range(1, 65)]), 1e-12)) AS width FROM a),
    c AS (SELECT *, {o.db('rms')} - 0.691 AS lufs, {o.db('peak / greatest(rms, 1e-9)')} AS crest, goal FROM b JOIN (VALUES {_LIGHT}) t(name, k, goal) ON k = track % 7),
    d AS (SELECT *, {o.clip('goal - lufs', -14, 8)} AS desired, least({o.clip('goal - lufs', -14, 8)}, {o.db('10 ** (-1.0 / 20) / greatest(peak, 1e-9)')}) AS gain FROM c)
    SELECT track, name AS target, round(lufs, 6) + 0.0 AS lufs, round(crest, 6) + 0.0 AS crest, round(width, 6) + 0.0 AS width, round(gain, 6) + 0.0 AS gain_db, gain < desired - 0.05 AS limited FROM d"""
)
def light_record(spark, sf_dir):
    """The light client's record, with ungated loudness, and the gain towards its target."""
    x, left, right = F.concat("l", "r"), F.col("l"), F.col("r")
    mid, side = features.mid_side(left, right)
    rows = _pairs(spark, sf_dir).select("track", rms(x).alias("rms"), F.array_max(F.transform(x, F.abs)).alias("peak"), F.sqrt(mean(side, lambda v: v * v) * 64 / F.greatest(mean(mid, lambda v: v * v) * 64, num(1e-12))).alias("width"))
    rows = rows.withColumns({"target": _pick(list(LIGHT_PRESETS), "track"), "goal": _pick([v[5] for v in LIGHT_PRESETS.values()], "track"), "lufs": decibels(F.col("rms")) - 0.691, "crest": decibels(F.col("peak") / F.greatest("rms", num(1e-9)))})
    rows = rows.withColumn("desired", F.greatest(F.least(F.col("goal") - F.col("lufs"), num(8.0)), num(-14.0)))
    rows = rows.withColumn("gain_db", F.least("desired", decibels(num(10 ** (-1.0 / 20)) / F.greatest("peak", num(1e-9)))))
    return rounded(rows.select("track", "target", "lufs", "crest", "width", "gain_db", (F.col("gain_db") < F.col("desired") - 0.05).alias("limited")))


@query(
    f"""WITH {o.PAIR}, a AS (SELECT track, list_max([abs(v) for v in l]) AS peak, l FROM p), b AS (SELECT track, peak, CASE WHEN peak <= 0.2 THEN l ELSE [greatest(least(tanh(v / 0.2 * (peak / 0.2)) / tanh(peak / 0.2) * 0.2, 0.2), -0.2) for v in l] END AS y FROM a)
    SELECT track, round(peak, 6) + 0.0 AS peak, round(list_max([abs(v) for v in y]), 6) + 0.0 AS limited_peak, round({o.lrms('y')}, 6) + 0.0 AS limited_rms FROM b"""
)
def soft_limit(spark, sf_dir):
    """The light client's limiter: a waveshaper that bends the harder, the further the peak is above the ceiling."""
    ceiling, drive = 0.2, F.col("peak") / 0.2
    rows = _pairs(spark, sf_dir).select("track", "l", F.array_max(F.transform("l", F.abs)).alias("peak"))
    bent = F.transform("l", lambda v: F.greatest(F.least(F.tanh(v / ceiling * drive) / F.tanh(drive) * ceiling, num(ceiling)), num(-ceiling)))
    rows = rows.withColumn("y", F.when(F.col("peak") <= ceiling, F.col("l")).otherwise(bent))
    return rounded(rows.select("track", "peak", F.array_max(F.transform("y", F.abs)).alias("limited_peak"), rms(F.col("y")).alias("limited_rms")))


_DRIVES = ", ".join(f"({i}, {v[6]}::DOUBLE)" for i, v in enumerate(LIGHT_PRESETS.values()))


@query(
    f"""WITH {o.PAIR}, a AS (SELECT track, l, 1 + drive * ((track % 12) / 10.0::DOUBLE) * 8 AS d FROM p JOIN (VALUES {_DRIVES}) t(k, drive) ON k = track % 7),
    b AS (SELECT track, d, unnest(l) AS x FROM a), c AS (SELECT *, (greatest(least(x, 1), -1) + 1) / 2 * 2047 AS pos FROM b), e AS (SELECT *, least(floor(pos), 2046) AS j FROM c),
    y AS (SELECT track, d, (1 - (pos - j)) * tanh((j * 2 / 2048 - 1) * d) / tanh(d) + (pos - j) * tanh(((j + 1) * 2 / 2048 - 1) * d) / tanh(d) AS y FROM e)
    SELECT track, round(any_value(d), 6) + 0.0 AS drive, round(sqrt(avg(y * y)), 6) + 0.0 AS shaped_rms, round(max(abs(y)), 6) + 0.0 AS shaped_peak FROM y GROUP BY track"""
)
def drive_curve(spark, sf_dir):
    """The light client's waveshaper, at the drive of a preset and an amount."""
    rows = _pairs(spark, sf_dir).select("track", "l", (1.0 + _pick([v[6] for v in LIGHT_PRESETS.values()], "track") * (F.col("track") % 12 / num(10.0)) * 8.0).alias("drive"))
    rows = rows.withColumn("y", features.driven(F.col("l"), F.col("drive")))
    return rounded(rows.select("track", "drive", rms(F.col("y")).alias("shaped_rms"), F.array_max(F.transform("y", F.abs)).alias("shaped_peak")))


_LIGHTS = ", ".join(f"({i}, '{t}', {v[5]}::DOUBLE, {v[6]}::DOUBLE)" for i, (t, v) in enumerate(LIGHT_PRESETS.items()))
_POS = "((greatest(least(v, 1), -1) + 1) / 2 * 2047)"
_LOW = f"least(floor({_POS}), 2046)"
_DRIVEN = lambda c: f"list_transform({c}, lambda v: (1 - ({_POS} - {_LOW})) * tanh(({_LOW} * 2 / 2048 - 1) * d) / tanh(d) + ({_POS} - {_LOW}) * tanh((({_LOW} + 1) * 2 / 2048 - 1) * d) / tanh(d))"


@query(
    f"""WITH {o.PAIR}, a AS (SELECT track, name, goal, l, r, (track % 12) / 10.0::DOUBLE AS amount, track % 2 = 0 AS matched, CASE WHEN track % 3 <> 0 THEN -1.0::DOUBLE ELSE -0.3 END AS top_db, 1 + drive * ((track % 12) / 10.0::DOUBLE) * 8 AS d FROM p JOIN (VALUES {_LIGHTS}) t(k, name, goal, drive) ON k = track % 7),
    b AS (SELECT * EXCLUDE (goal), {o.db(o.lrms('list_concat(l, r)'))} - 0.691 AS before, list_concat({_DRIVEN('l')}, {_DRIVEN('r')}) AS x, goal FROM a),
    c AS (SELECT *, CASE WHEN matched THEN before ELSE goal END AS aim, {o.db(o.lrms('x'))} - 0.691 AS lufs, greatest(list_max([abs(v) for v in x]), 1e-9) AS peak FROM b),
    e AS (SELECT *, greatest(least(aim - lufs, 8), -14) AS wanted, least(greatest(least(aim - lufs, 8), -14), {o.db('10 ** (top_db / 20) / peak')}) AS gain FROM c),
    y AS (SELECT *, [v * 10 ** (gain / 20) for v in x] AS y FROM e), z AS (SELECT *, list_max([abs(v) for v in y]) AS top, {o.db(o.lrms('y'))} - 0.691 AS after, {o.lmean('y', 'CASE WHEN abs(v) >= 0.98 THEN 1.0::DOUBLE ELSE 0.0 END')} AS clipped FROM y)
    SELECT track, name AS target, round(gain, 6) + 0.0 AS gain_db, gain < wanted - 0.05 AS limited, round({o.lrms('y')}, 6) + 0.0 AS out_rms, round(top, 6) + 0.0 AS out_peak,
    concat_ws('; ', printf('loudness changed by %+.1f LUFS, peak %.1f dBFS', round(after - before, 6) + 0.0, {o.db('top')}), printf('amount %.0f%%, goal %.1f LUFS, gain %+.1f dB', amount * 100, aim, gain), CASE WHEN gain < wanted - 0.05 THEN 'gain held back for headroom' ELSE 'gain within the headroom' END,
    CASE WHEN clipped > 0.0005 THEN 'high peaks in the output' ELSE 'low clipping risk' END, CASE name WHEN 'voice_focus' THEN 'less bass for clearer speech' WHEN 'bass_boost' THEN 'more bass under the limiter' END) AS lines FROM z"""
)
def light_chain(spark, sf_dir):
    """The light client's waveshaper, gain and limiter, and its report."""
    asked = {"target": _pick(list(LIGHT_PRESETS), "track"), "amount": (F.col("track") % 12) / num(10.0), "match": F.col("track") % 2 == 0, "safe": F.col("track") % 3 != 0}
    rows = light.processed(_pairs(spark, sf_dir).withColumns(asked))
    return rounded(rows.select("track", "target", "gain_db", "limited", rms(F.concat("out_l", "out_r")).alias("out_rms"), F.array_max(F.transform(F.concat("out_l", "out_r"), F.abs)).alias("out_peak"), F.array_join("lines", "; ").alias("lines")))


@query("WITH f AS (SELECT p_brand, repeat('sub/', CAST(p_partkey % 3 AS INTEGER)) || p_name || '/' || CASE p_partkey % 2 WHEN 0 THEN 'Vocals.WAV' ELSE 'no_vocals.wav' END AS path FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(path), path) AS k FROM f WHERE lower(regexp_extract(path, '([^/]*)$', 1)) = 'vocals.wav') SELECT p_brand, path FROM r WHERE k = 1")
def separator_file(spark, sf_dir):
    """The file of a stem in a folder tree: name in any case, shortest path first."""
    part = F.col("p_partkey")
    path = F.concat(F.repeat(F.lit("sub/"), (part % 3).cast("int")), "p_name", F.lit("/"), F.when(part % 2 == 0, "Vocals.WAV").otherwise("no_vocals.wav"))
    rows = table(spark, sf_dir, "part").select("p_brand", path.alias("path")).filter(F.lower(text.base_name(F.col("path"))) == "vocals.wav")
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.length("path"), "path"))
    return rows.withColumn("k", rank).filter("k = 1").drop("k")


@query(f"WITH {_NAMES}, z AS (SELECT p_brand, s.name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY part.p_partkey) AS k, lower(regexp_extract(s.name, '[^./](\\.[^./]*)$', 1)) IN ('.wav', '.mp3', '.m4a', '.flac') AS ok FROM s JOIN part USING (p_partkey)) SELECT p_brand, count(*) AS files, bool_and(ok) AS all_supported, CAST(sum(p_size) AS BIGINT) AS total, string_agg(name, '|' ORDER BY k) FILTER (WHERE k <= 8) AS first_names, greatest(count(*) - 8, 0) AS more FROM z GROUP BY p_brand")
def upload_summary(spark, sf_dir):
    """Of each batch: number, total size, whether all are supported, the first eight names and how many there are besides."""
    ranked = _named(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    rows = ranked.groupBy("p_brand").agg(
        F.count("*").alias("files"),
        F.bool_and(text.is_supported(F.col("name"))).alias("all_supported"),
        F.sum("p_size").alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= 8, F.struct("k", "name")))).alias("n"),
    )
    return rows.select("p_brand", "files", "all_supported", "total", F.array_join(F.transform("n", lambda x: x["name"]), "|").alias("first_names"), F.greatest(F.col("files") - 8, F.lit(0)).alias("more"))


@query(f"{o.COMPARED}, {o.CHECKS}, w AS (SELECT track, overall, list_filter([CASE WHEN string_split(statuses, ',')[i] <> 'pass' THEN (['loudness', 'true_peak', 'clipping', 'stereo', 'separation', 'transients', 'harshness'])[i] || ':' || string_split(statuses, ',')[i] END for i in range(1, 8)], lambda x: x IS NOT NULL)[1:2] AS n FROM v) SELECT track, concat_ws(' | ', 'validation ' || overall, CASE WHEN len(n) > 0 THEN array_to_string(n, ', ') END) AS line FROM w")
def report_line(spark, sf_dir):
    """One line of a validation: the overall verdict and the first two checks that didn't pass."""
    open_ = F.slice(F.transform(F.filter("checks", lambda c: c["status"] != "pass"), lambda c: F.concat(c["id"], F.lit(":"), c["status"])), 1, 2)
    return _validated(spark, sf_dir).select("track", F.concat_ws(" | ", F.concat(F.lit("validation "), "overall"), F.when(F.size(open_) > 0, F.array_join(open_, ", "))).alias("line"))


_DETAILS = f"""[CASE WHEN {o.MODE} THEN 'source match' ELSE 'target' END || printf(' delta %+.1f LU', {o._LOUD}), 'ceiling -1.5 dBTP', printf('ratio %.5f', a.clipping_ratio),
    printf('width %+.2f, phase %+.2f', {o._D('stereo_width')}, {o._D('phase_correlation')}), printf('score delta %+.1f', {o._D('band_separation_score')}), printf('crest loss %.1f dB', -{o._D('crest_db')}),
    printf('high %+.2f, flatness %+.3f', {o._D('high_energy')}, {o._D('spectral_flatness')})]"""
_LABELS = "[" + ", ".join(repr(x) for x in reports.LABELS.values()) + "]"


@query(
    f"""{o.COMPARED}, {o.CHECKS}, w AS (SELECT j.track, st, v.score, v.overall, {_DETAILS.replace('a.', 'j.a.').replace('b.', 'j.b.')} AS d, greatest(j.a.lufs - j.b.lufs - CASE WHEN {o.MODE} THEN 1 ELSE 3 END, 0) AS loud FROM j JOIN k USING (track) JOIN v USING (track)),
    n AS (SELECT *, [({_LABELS})[i] || ': ' || d[i] for i in range(1, 8) if st[i] <> 'pass'][1:2] AS weak FROM w)
    SELECT track, array_to_string(d, '; ') AS details, round(loud, 6) + 0.0 AS excessive_loudness_gain, false AS protected, overall || printf(' %.0f / 100: ', score) || CASE WHEN len(weak) > 0 THEN array_to_string(weak, ' / ') ELSE 'all checks stable' END AS line FROM n"""
)
def validation_lines(spark, sf_dir):
    """The checks' details, and the line that a report shows."""
    rows = _validated(spark, sf_dir)
    line = reports.validation_line(F.col("checks"), F.col("score"), F.col("overall"))
    return rounded(rows.select("track", F.array_join(F.transform("checks", lambda c: c["detail"]), "; ").alias("details"), "risk.excessive_loudness_gain", F.col("protected_by_quality_guard").alias("protected"), line.alias("line")))


@query(
    f"""{o.COMPARED}, {o.CHECKS} SELECT j.track, concat_ws('; ', CASE WHEN abs(j.a.lufs - j.b.lufs) <= CASE WHEN {o.MODE} THEN 1.25 ELSE 1 END THEN 'volume matched' ELSE printf('level changed by %+.1f dB', j.a.lufs - j.b.lufs) END,
    CASE WHEN j.a.peak_db <= -1 THEN 'headroom safe' ELSE 'check headroom' END, CASE WHEN j.a.clipping_ratio <= 0.0005 AND j.a.peak_db <= -1.5 + 0.2 THEN 'low clipping risk' ELSE 'check clipping' END,
    CASE WHEN abs(j.a.stereo_width - j.b.stereo_width) <= 0.2 AND abs(j.a.phase_correlation - j.b.phase_correlation) <= 0.25 THEN 'stereo preserved' ELSE 'stereo changed' END, printf('validation %.0f (%s)', v.score, v.overall)) AS line
    FROM j JOIN v USING (track)"""
)
def summary_lines(spark, sf_dir):
    rows = validation.comparison(_validated(spark, sf_dir), F.col("volume_mode"), num(-1.5))
    return rows.select("track", reports.summary_line(F.col("summary"), F.col("delta.lufs"), F.col("score"), F.col("overall")).alias("line"))


@query(
    f"""{o.REQUESTED}, t AS (SELECT *, floor(amount * 100 + 0.5) AS asked, floor(effective * 100 + 0.5) AS used, list_filter([{', '.join(f"CASE WHEN {f}_factor < 0.999 THEN printf('{f} %.0f%%', {f}_factor * 100) END" for f in o.BUDGET_LIMITS)}], lambda x: x IS NOT NULL) AS limited FROM r8)
    SELECT track, printf('%d%% to %d%% (%+d%%): %s', CAST(asked AS INTEGER), CAST(used AS INTEGER), CAST(used - asked AS INTEGER), source_condition) AS adaptive,
        CASE WHEN len(limited) > 0 THEN 'limited: ' || array_to_string(limited, ' / ') ELSE 'within budget' END AS budget, printf('harmonics at %.0f%%', harmonic_factor * 100) AS harmonics FROM t"""
)
def recommendation_lines(spark, sf_dir):
    rows = rules.recommend(_requests(_records(spark, sf_dir)).withColumn("amount", F.least("amount", num(1.0))))
    lines = reports.adaptive_line(F.col("amount"), F.col("effective"), F.col("source_condition")), reports.budget_line(F.col("reductions")), reports.harmonic_line(F.col("harmonic_factor"))
    return rows.select("track", *(c.alias(n) for c, n in zip(lines, ("adaptive", "budget", "harmonics"))))


@query(f"{o.RISKS} SELECT song, printf('average %.2f, highest %.2f: ', avg(score), max(score)) || CASE WHEN avg(score) < 0.45 THEN 'allow' WHEN avg(score) <= 0.65 THEN 'attenuate' ELSE 'fallback' END AS line FROM e GROUP BY song")
def stem_risk_lines(spark, sf_dir):
    rows = stems.risk_map(_risks(spark, sf_dir), ["song"])
    return rows.select("song", reports.stem_risk_line(F.col("average"), F.col("max"), F.col("decision")).alias("line"))


@query(f"SELECT song, {' || '.join(chr(39) + (' / ' if i else '') + n + ' ' + chr(39) + f' || printf({chr(39)}%.2f{chr(39)}, {n})' for i, n in enumerate(long.q.STEMS))} || printf(', error less by %.0f%%', error_reduction * 100) AS line FROM ({ORACLE['song_gains']})")
def remix_lines(spark, sf_dir):
    rows = QUERIES["song_gains"](spark, sf_dir)
    return rows.select("song", reports.remix_line(F.col("applied"), {n: F.col(n) for n in long.q.STEMS}, F.col("error_reduction")).alias("line"))


@query(f"SELECT track, CASE severity WHEN 'none' THEN 'no drift' ELSE severity || ': source blended by ' || CASE severity WHEN 'severe' THEN '35' ELSE '15' END || '% / ' || replace(flags, ',', ', ') END AS line FROM ({ORACLE['quality_drift']})")
def guard_lines(spark, sf_dir):
    found = _compared(spark, sf_dir).withColumn("flags", validation.drift_flags(F.col("target"), F.col("volume_mode"), num(-1.5)))
    return found.select("track", reports.guard_line(validation.drift_severity(F.col("flags")), F.col("flags")).alias("line"))


_CONTROLS = {key: f"((p_partkey * {7 + 2 * i} % 41) - 20) / {div}" for i, (_, key, _, _) in enumerate(TWEAKS) for div in [1 if "hz" in key else 4 if "db" in key or "lufs" in key else 50]}


@query(f"SELECT p_partkey, p_partkey % 3 <> 0 AS enabled, CASE WHEN p_partkey % 3 <> 0 THEN 'fine_tune' END AS mode, CASE WHEN p_partkey % 3 <> 0 THEN -1.5::DOUBLE END AS ceiling_db, {', '.join(f'CASE WHEN p_partkey % 3 <> 0 THEN round(({e})::DOUBLE, 6) + 0.0 END AS {k}' for k, e in _CONTROLS.items())} FROM part")
def manual_requests(spark, sf_dir):
    """Manual controls as the JSON that a request carries, read again."""
    rows = table(spark, sf_dir, "part")
    values = {k: F.expr(e).cast("double") for k, e in _CONTROLS.items()}
    asked = rows.select("p_partkey", rules.manual_request(F.col("p_partkey") % 3 != 0, values).alias("raw"))
    read = F.from_json("raw", "manual_mode string, limiter_ceiling_db double, " + ", ".join(f"{k} double" for k in values))
    return rounded(asked.select("p_partkey", F.col("raw").isNotNull().alias("enabled"), read["manual_mode"].alias("mode"), read["limiter_ceiling_db"].alias("ceiling_db"), *(read[k].alias(k) for k in values)))


@query(q.process_payload())
def process_payload(spark, sf_dir):
    """The nested report of each track as JSON, without numbers that JSON lacks, and some of what a reader gets from it."""
    rows = validation.comparison(_validated(spark, sf_dir), F.col("volume_mode"), num(-1.5))
    name = F.concat(F.lit("track "), F.col("track").cast("string"), F.lit(".wav"))
    body = F.struct(text.download_url(name, name).alias("download_url"), name.alias("filename"), F.struct("overall", "score", "checks", "delta", "summary").alias("report"))
    sent = rows.select("track", F.to_json(body).alias("payload"))
    get = lambda path: F.get_json_object("payload", f"$.{path}")
    return rounded(sent.select(
        "track", get("filename").alias("filename"), get("download_url").alias("download_url"), get("report.overall").alias("overall"), get("report.score").cast("double").alias("score"),
        F.json_array_length(get("report.checks")).alias("n_checks"), get("report.checks[3].status").alias("stereo_status"), get("report.delta.lufs").cast("double").alias("delta_lufs"), get("report.summary.clipping_safe").alias("clipping_safe"),
    ))


assert FRAMES.sr == 64  # the SQL is written for it
