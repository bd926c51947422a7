"""Sound files through reading, records, recommendation, the chain and the report, at the rate and length of audio."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverline.operators import guards, kernels, stems
from quaverline.operators.analysis import Scale, analyze
from quaverline.plans import files
from quaverline.plans import validation as v
from quaverline.sources import wav

SR, LENGTH = 48_000, 96_000
SCALE = Scale(sr=SR)
#: Highest true peak that codecs stand, in dB, and how far a measurement may be off.
SAFE, SLACK = -1.4, 0.08


def source() -> np.ndarray:
    t = np.arange(LENGTH) / SR
    tone = lambda hz, phase=0.0: np.sin(2 * np.pi * hz * t + phase)
    return np.array([0.14 * tone(90) + 0.055 * tone(1200) + 0.018 * tone(7200), 0.13 * tone(92, 0.2) + 0.05 * tone(1180, 0.3) - 0.016 * tone(7200)])


def table(spark, sounds: dict):
    return spark.createDataFrame([(n, *(c.tolist() for c in x)) for n, x in sounds.items()], "name string, l array<double>, r array<double>")


@pytest.fixture(scope="module")
def sounds(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('sounds')}/in"
    assert wav.write(table(spark, {"soft": source(), "loud": 3 * source()}), root, SR).count() == 2
    return wav.stereo(wav.read(spark, root), SR, LENGTH).cache()


@pytest.fixture(scope="module")
def done(spark, sounds, tmp_path_factory):
    tweaks = '{"manual_mode":"fine_tune","target_lufs_delta":8,"compress_delta":2,"exciter_delta":0.2,"saturation_delta":0.2}'
    asked = [("soft", "hifi_clean,bass_boost", 0.55, None, "match_source", True), ("loud", "loud_modern", 1.0, tweaks, "target", True)]
    requests = spark.createDataFrame(asked, "track string, request string, amount double, manual string, volume_mode string, use_denoise boolean")
    path = f"{tmp_path_factory.mktemp('done')}/done"
    files.processed(sounds, requests, SCALE).write.parquet(path)
    return spark.read.parquet(path)


def test_files_to_report(done):
    rows = {r.track: r for r in files.report(done, SCALE).collect()}
    for r in done.collect():
        y = np.array([r.out_l, r.out_r])
        assert y.shape == (2, LENGTH) and np.isfinite(y).all()
        found = rows[r.track]
        assert found.after.true_peak_db <= SAFE + SLACK
        assert found.after.true_peak_db == pytest.approx(float(kernels.db(kernels.true_peak([y[:1], y[1:]]))[0]), abs=1e-6)
        assert 0 <= found.score <= 100 and len(found.checks) == 7
    assert rows["loud"].manual_dsp and not rows["soft"].manual_dsp


def test_records_are_weighted(sounds):
    got = {r.track: r.lufs for r in analyze(sounds, SCALE).collect()}
    for name, gain in (("soft", 1), ("loud", 3)):
        want = kernels.integrated_loudness([c[None] for c in gain * source()], SR)[0]
        assert got[name] == pytest.approx(float(want), abs=0.01)


def test_risky_stems_fall_back(spark, sounds):
    noisy = {"spectral_flatness": 0.18, "noise_floor_db": -34.0, "crest_db": 4.5, "phase_correlation": -0.05, "stereo_width": 1.6}
    record = analyze(sounds.filter("track = 'soft'"), SCALE).withColumns({k: F.lit(x) for k, x in noisy.items()})
    four = record.withColumn("stem", F.explode(F.array(*map(F.lit, ("vocals", "drums", "bass", "other")))))
    entries = stems.risk_entries(four).withColumn("reasons", stems.artifact_reasons())
    found = stems.risk_map(entries, ["track"]).first()
    assert found.average > 0.65 and found.decision == "fallback"
    vocals = entries.filter("stem = 'vocals'").select(stems.safe_amount(F.lit(0.6)).alias("amount"), "reasons").first()
    assert vocals.amount < 0.12
    assert vocals.reasons == ["high spectral flatness", "high stem noise floor", "flat stem dynamics", "wide diffuse stem image", "phase-sensitive stem"]


def test_too_loud_is_not_perfect(spark, sounds):
    y = guards.safe(tuple(2.6 * c[None] for c in source()), float(SR), np.array([-1.2]), True)
    louder = table(spark, {"soft": np.array([c[0] for c in y])}).withColumnRenamed("name", "track")
    rows = v.compared(analyze(sounds.filter("track = 'soft'"), SCALE), analyze(louder, SCALE), ["track"])
    found = v.validation(rows, F.lit("hifi_clean"), F.lit("match_source"), F.col("before.lufs"), F.lit(-1.5)).first()
    assert found.penalties > 0 and found.score <= 95


def test_mono_files(spark, tmp_path):
    """A mono file is measured and mastered as one channel: its loudness is that of one, and it ends at its target."""
    t = np.arange(LENGTH) / SR
    tone = 0.2 * np.sin(2 * np.pi * 997 * t) * (1 + 0.3 * np.sin(2 * np.pi * 3 * t))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "tone.wav").write_bytes(wav.encode(tone[None], SR))
    mono = wav.stereo(wav.read(spark, f"file://{tmp_path}/one"), SR, LENGTH)
    record = analyze(mono, SCALE).first()
    alone = float(kernels.integrated_loudness([tone[None]], SR)[0])
    assert record.channels == 1 and record.lufs == pytest.approx(alone, abs=1e-3) and record.mid_lufs == record.lufs
    assert (record.stereo_width, record.phase_correlation) == (0.0, 1.0) and record.side_lufs == pytest.approx(-180.691)
    requests = spark.createDataFrame([("tone", "hifi_clean", 0.3, None, "target", False)], "track string, request string, amount double, manual string, volume_mode string, use_denoise boolean")
    files.processed(mono, requests, SCALE).write.parquet(f"{tmp_path}/done")
    found = spark.read.parquet(f"{tmp_path}/done").first()
    assert found.out_r is None and len(found.out_l) == LENGTH
    after = float(kernels.integrated_loudness([np.array([found.out_l])], SR)[0])
    assert after == pytest.approx(found.dsp_params.target_lufs, abs=0.3)
    checked = files.report(spark.read.parquet(f"{tmp_path}/done"), SCALE).first()
    assert checked.after.channels == 1 and "stereo_width_loss" not in checked.flags


def test_low_rates_end_at_the_output_rate(spark, tmp_path):
    """A source below 32 kHz comes out at 44.1 kHz, safe there, with its tone where it was."""
    sr, n = 22_050, 44_100
    t = np.arange(n) / sr
    x = np.array([0.3 * np.sin(2 * np.pi * 441 * t), 0.28 * np.sin(2 * np.pi * 441 * t + 0.2)])
    tracks = spark.createDataFrame([("low", *(c.tolist() for c in x))], "track string, l array<double>, r array<double>")
    requests = spark.createDataFrame([("low", "hifi_clean", 0.3, None, "target", False)], "track string, request string, amount double, manual string, volume_mode string, use_denoise boolean")
    files.processed(tracks, requests, Scale(sr=sr)).write.parquet(f"{tmp_path}/done")
    done = spark.read.parquet(f"{tmp_path}/done")
    found = done.first()
    assert found.output_sr == 44_100 and len(found.out_l) == len(found.out_r) == 2 * n
    y = np.array([found.out_l, found.out_r])
    assert float(kernels.db(kernels.true_peak([y[:1], y[1:]]))[0]) <= SAFE + SLACK
    spectrum = np.abs(np.fft.rfft(y[0]))
    assert abs(np.argmax(spectrum) * 44_100 / len(y[0]) - 441) < 1
    row = files.report(done, Scale(sr=sr)).first()
    assert (row.before.sr, row.after.sr) == (sr, 44_100)
    assert row.after.lufs == pytest.approx(float(kernels.integrated_loudness([y[:1], y[1:]], 44_100)[0]), abs=1e-6)
