"""Records of tracks of odd shapes, and of several lengths in one call."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverline.operators import mastering
from quaverline.operators.analysis import FRAMES, analyze, with_record

SCHEMA = "track long, l array<double>, r array<double>, rms string"
SCALE = replace(FRAMES, true_peak=True)


def tone(n, hz=5):
    return (0.5 * np.sin(2 * np.pi * hz * np.arange(n) / 64)).tolist()


def test_lengths_mix(spark):
    rows = [(1, tone(64), tone(64, 9), "x"), (2, tone(200), tone(200), None), (3, tone(64, 7), tone(64), "x"), (4, tone(3), tone(3), "x")]
    together = {r.track: r for r in analyze(spark.createDataFrame(rows, SCHEMA).coalesce(1), SCALE).collect()}
    for row in rows:
        alone = analyze(spark.createDataFrame([row], SCHEMA), SCALE).first().asDict(True)
        for name, value in together[row[0]].asDict(True).items():
            assert value == (pytest.approx(alone[name], abs=1e-9) if isinstance(value, float | dict) else alone[name])
    assert together[2].duration == 200 / 64 and together[2].spectral_centroid_hz == pytest.approx(5, abs=0.3)
    assert together[4].noise_floor_db == pytest.approx(20 * math.log10(np.sqrt(np.mean(np.square(tone(3))))))


def test_odd_tracks_have_nulls(spark):
    rows = [(1, None, tone(64), "x"), (2, [], [], "x"), (3, tone(64), tone(63), "x"), (3, tone(64), tone(63), "x"), (4, [0.0] * 64, [0.0] * 64, "x")]
    got = analyze(spark.createDataFrame(rows, SCHEMA)).orderBy("track").collect()
    assert [r.track for r in got] == [1, 2, 3, 3, 4]
    assert all(r.rms is None and r.lufs is None and r.sr == 64 and r.quality_flags == [] for r in got[:4])
    assert got[4].rms == 0 and got[4].spectral_centroid_hz == 0 and got[4].silence_ratio == 1 and not math.isnan(got[4].lufs)
    assert analyze(spark.createDataFrame([], SCHEMA)).count() == 0


def test_record_beside_clashing_names(spark):
    rows = spark.createDataFrame([(1, tone(64), tone(64), "mine")], SCHEMA)
    found = with_record(rows, "record").first()
    assert found["rms"] == "mine" and found.record.rms == pytest.approx(0.5 / math.sqrt(2))


def test_calls_of_few_samples_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i, tone(64, i), tone(64, i + 1), "x") for i in range(1, 20)], SCHEMA).coalesce(1)
    fn = lambda a, b: {"both": a + b, "most": (a * b).max(axis=-1)}
    run = lambda: mastering.map_tracks(rows, ["l", "r"], [], {"both": "array<double>", "most": "double"}, fn, keep=["track"]).orderBy("track").collect()
    whole = run()
    monkeypatch.setattr(mastering, "CALL_SAMPLES", 100)
    assert run() == whole
    want = rows.select("track", F.zip_with("l", "r", lambda a, b: a + b).alias("both")).orderBy("track").collect()
    assert [r.both for r in whole] == [r.both for r in want]


def test_a_call_on_tracks_is_small_however_many_a_batch_has(spark):
    rows = spark.range(6_000, numPartitions=1).select(F.col("id").alias("track"), F.when(F.col("id") % 1_000 != 7, F.array_repeat(F.col("id") * 1.0, 64 - F.col("id").cast("int") % 2)).alias("l"))
    fn = lambda l: {"held": np.full(len(l), float(l.size)), "twice": l * 2}
    found = mastering.map_tracks(rows, ["l"], [], {"held": "double", "twice": "array<double>"}, fn, keep=["track"]).collect()
    assert sorted(r.track for r in found) == list(range(6_000)) and sum(r.held is None for r in found) == 6
    assert max(r.held or 0 for r in found) <= mastering.CALL_SAMPLES <= 100_000
    assert all(r.twice is None if r.track % 1_000 == 7 else r.twice == [r.track * 2.0] * (64 - r.track % 2) for r in found)
