"""Rules just below, at and above their thresholds, and text functions on odd input."""

import pytest
from pyspark.sql import functions as F

from quaverline.functions import text
from quaverline.functions.scalars import clip, finite, json_safe, smoothstep
from quaverline.operators import stems
from quaverline.plans import rules, validation

BASE = {
    "sr": 48_000, "channels": 2, "duration": 10.0, "crest_db": 12.0, "lufs": -16.0, "noise_floor_db": -60.0, "low_energy": 0.3, "mid_energy": 0.4, "high_energy": 0.3, "spectral_flatness": 0.01,
    "true_peak_db": -3.0, "band_separation_score": 60.0, "phase_correlation": 0.8, "stereo_width": 0.5, "quality_flags": [], "request": "hifi_clean", "amount": 0.5,
}
SCHEMA = "sr int, channels int, duration double, crest_db double, lufs double, noise_floor_db double, low_energy double, mid_energy double, high_energy double, spectral_flatness double, true_peak_db double, band_separation_score double, phase_correlation double, stereo_width double, quality_flags array<string>, request string, amount double"


def recommended(spark, *changes):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = spark.createDataFrame([tuple((BASE | c)[n] for n in names) for c in changes], SCHEMA)
    return rules.recommend(rows.coalesce(1)).collect()


def test_adaptive_thresholds(spark):
    changes = [{}, {"band_separation_score": 71.9}, {"band_separation_score": 72.0}, {"crest_db": 7.9}, {"crest_db": 20.1}, {"crest_db": 6.9}, {"phase_correlation": 0.17}, {"amount": 0.02}, {"amount": None}, {"amount": 0.2, "quality_flags": ["high_noise_floor"]}]
    got = [round(r.adjustment, 6) for r in recommended(spark, *changes)]
    assert got == [-0.05, -0.05, -0.10, 0.0, 0.03, -0.05, -0.13, 0.0, -0.05, 0.05]


def test_source_rules(spark):
    rows = recommended(spark, {"low_energy": 0.17}, {"low_energy": 0.18}, {"low_energy": 0.46}, {"low_energy": 0.46, "request": "bass_boost"}, {"high_energy": 0.11}, {"noise_floor_db": -44.9}, {"sr": 31_999})
    assert ["weak_low_band" in r.reasons for r in rows] == [True, False, False, False, False, False, False]
    assert "reduced_low_band" in rows[2].reasons and "controlled_bass" in rows[3].reasons and "dull_source" in rows[4].reasons and "noisy_source" in rows[5].reasons
    assert rows[6].mode == "upsample" and rows[6].output_sr == 44_100 and rows[0].output_sr == 48_000
    assert rows[0].dsp_params.low_boost_db > 0 > rows[2].dsp_params.low_boost_db


def test_advice_text(spark):
    (row,) = recommended(spark, {"request": "loud_modern", "amount": 1.0, "quality_flags": ["hot_loudness", "dc_offset"]})
    assert row.advice.startswith("denoise mode; denoise intensity 0.") and row.advice.endswith("flags: dc_offset, hot_loudness") and ":1 compression" in row.advice


def test_manual_request(spark):
    base = {p: F.lit(1.0) for p in rules.PARAMETERS} | {"target_lufs": F.lit(-16.0), "limiter_ceiling_db": F.lit(-1.0), "lowcut_hz": F.lit(40.0)}
    raw = [None, "", "{", "[]", "{}", '{"compress_delta": 9}', '{"lowcut_hz": 500, "limiter_ceiling_db": -0.1}', '{"manual_mode": "fine_tune", "limiter_ceiling_db": -2.5}']
    by_hand, params = rules.manual(base, F.col("raw"))
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(by_hand.alias("ok"), *(c.alias(n) for n, c in params.items())).collect()
    assert [r.ok for r in rows] == [False, False, False, False, True, True, True, True]
    assert rows[5].compress_ratio == 3.0 and rows[5].limiter_ceiling_db == -1.5
    assert rows[6].lowcut_hz == 200.0 and rows[6].limiter_ceiling_db == -1.5 and rows[7].limiter_ceiling_db == -2.5 and rows[0].limiter_ceiling_db == -1.0


def test_stem_risk_falls_back(spark):
    noisy = [(1, s, 0.18, -34.0, 4.5, -0.05, 1.6, 0.3, 20.0, 2) for s in ("vocals", "drums", "bass", "other")]
    rows = spark.createDataFrame(noisy, "track int, stem string, spectral_flatness double, noise_floor_db double, crest_db double, phase_correlation double, stereo_width double, high_energy double, band_separation_score double, channels int")
    entries = stems.risk_entries(rows)
    (found,) = stems.risk_map(entries, ["track"]).collect()
    assert found.average > 0.5 and found.stems == 4
    assert entries.select(F.max(stems.safe_amount(F.lit(0.6)))).first()[0] < 0.12
    assert [r[0] for r in spark.createDataFrame([("4stem", 0.66), ("4stem", 0.65), ("2stem", 0.72), ("2stem", 0.73)], "m string, a double").select(stems.fallback_mode(F.col("m"), F.col("a"))).collect()] == ["2stem", "4stem", "2stem", "off"]


def test_best_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 7.0), (1, 2, 7.0)], "k int, position int, score double")
    assert validation.best(rows, ["k"]).collect()[0].position == 1


def test_scalars(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (0.25,)], "v double")
    assert [r[0] for r in df.select(finite(F.col("v"), 9.0)).collect()] == [9.0, 9.0, 9.0, 0.25]
    assert [r[0] for r in df.select(json_safe(F.col("v"))).collect()] == [None, None, None, 0.25]
    assert [r[0] for r in spark.range(3).select(smoothstep(F.col("id").cast("double"), 0.0, 2.0)).collect()] == [0.0, 0.5, 1.0]
    assert spark.range(1).select(clip(F.lit(5.0), None, 2.0), validation.playback_gain(F.lit(float("nan")))).first() == (2.0, 1.0)


@pytest.mark.parametrize(
    "name, stem, file, ext",
    [(None, "audio", "download.wav", ""), ("", "audio", "download.wav", ""), ("a/b/c.WAV", "c", "c.WAV", ".wav"), ("x:y?.mp3", "x_y", "x_y_.mp3", ".mp3"), ("...", "audio", "download.wav", ""), (" spaced .flac", "spaced", "spaced .flac", ".flac"), ("n" * 200 + ".wav", "n" * 80, "n" * 140, ".wav")],
)
def test_names(spark, name, stem, file, ext):
    row = spark.createDataFrame([(name,)], "n string").select(text.safe_stem(F.col("n")), text.safe_file_name(F.col("n")), text.extension(F.col("n"))).first()
    assert tuple(row) == (stem, file, ext)


def test_targets(spark):
    asked = [None, "", "voice, bass ,voice_focus", "x", "restore,archive,loud"]
    rows = spark.createDataFrame([(a,) for a in asked], "r string").select(text.targets(F.col("r"))).collect()
    assert [r[0] for r in rows] == [["hifi_clean"], ["hifi_clean"], ["voice_focus", "bass_boost"], ["hifi_clean"], ["restore", "loud_modern"]]
