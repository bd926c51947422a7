import numpy as np
import pytest

from quaverline.sources import signals, wav
from quaverline.streaming.levels import windowed_levels


@pytest.mark.parametrize("bits", [16, 24])
def test_wav_round_trip(spark, tmp_path, bits):
    rng = np.random.default_rng(3)
    tracks = spark.createDataFrame([(f"t{i}", rng.uniform(-1, 1, 50).tolist(), rng.uniform(-1, 1, 50).tolist()) for i in range(5)] + [("loud", [2.0] * 50, [float("nan")] * 50)], "name string, l array<double>, r array<double>")
    written = wav.write(tracks, f"file://{tmp_path}/w", 48_000, bits).collect()
    assert len(written) == 6
    (tmp_path / "w" / "note.txt").write_text("not a sound")
    found = {r.path.rsplit("/", 1)[1][:-4]: r for r in wav.read(spark, f"file://{tmp_path}/w").collect()}
    for r in tracks.collect():
        got = found[r.name]
        assert (got.sr, got.frames, got.bits) == (48_000, 50, bits)
        want = np.clip(np.nan_to_num(np.array([r.l, r.r])), -1, 1)
        assert np.abs(np.array(got.channels) - want).max() < 2.0 / 2 ** (bits - 1)


def test_index_across_buckets(spark):
    rows = spark.createDataFrame([(t, d * 10 + k, t * 100 - d) for t in (1, 2) for d in range(4) for k in range(3 + t)], "track int, at int, v int")
    from pyspark.sql import functions as F

    got = signals.indexed(rows, ["track"], ["at"], F.floor(F.col("at") / 10)).orderBy("track", "at").collect()
    for t in (1, 2):
        assert [r.n for r in got if r.track == t] == list(range(4 * (3 + t)))


def test_packed_and_long_forms(spark):
    tracks = spark.createDataFrame([(7, [1.0, 2.0], [3.0, 4.0])], "track long, l array<double>, r array<double>")
    long = signals.long_form(tracks)
    assert sorted(map(tuple, long.collect())) == [(7, 0, 0, 1.0), (7, 0, 1, 2.0), (7, 1, 0, 3.0), (7, 1, 1, 4.0)]
    assert sorted((r.channel, r.x) for r in signals.packed(long, ("track", "channel")).collect()) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value AS x")
    events.write.parquet(f"{tmp_path}/in")
    stream = windowed_levels(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), ["event_type"], "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    want = windowed_levels(events, ["event_type"], "1 day")
    key = lambda r: (r.event_type, r.start)
    assert sorted(map(key, spark.table("levels").collect())) == sorted(map(key, want.collect())) and want.count() > 5
