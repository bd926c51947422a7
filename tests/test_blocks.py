"""Blocks, chunks, scans, filters, recursions and selection of long series against whole tracks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaverline.operators import blocks, kernels, long_filters, long_spectra, recursions, selection, stems
from quaverline.operators.scan import affine_starts

SIZE = 1_000
SR = 8_000.0


@pytest.fixture(scope="module")
def tracks():
    rng = np.random.default_rng(5)
    lengths = {1: 10_437, 2: 3_000, 3: 1_003, 4: 999, 5: 40, 6: 12, 7: 1, 8: 2}
    t = {k: np.arange(n) for k, n in lengths.items()}
    return {k: np.sin(t[k] / 9) * 0.6 * (1 + np.sin(t[k] / 700)) + rng.normal(0, 0.25, n) for k, n in lengths.items()}


@pytest.fixture(scope="module")
def chunks(spark, tracks):
    rows = [(k, c, x[c * SIZE : (c + 1) * SIZE].tolist()) for k, x in tracks.items() for c in range(-(-len(x) // SIZE))]
    return spark.createDataFrame(rows, "track int, c long, x array<double>").repartition(5).cache()


def whole(df, column="x"):
    out: dict = {}
    for r in sorted(df.select("track", "c", column).collect(), key=lambda r: (r.track, r.c)):
        out.setdefault(r.track, []).extend(r[column])
    return {k: np.array(v) for k, v in out.items()}


def close(got, want, tolerance=1e-9):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].shape == want[k].shape and np.abs(got[k] - want[k]).max() <= tolerance, k


def test_chunks_and_back(spark, tracks, chunks):
    long = spark.createDataFrame([(k, i, float(v)) for k, x in tracks.items() if k > 1 for i, v in enumerate(x)], "track int, n long, x double")
    close(whole(blocks.chunked(long, ["track"], SIZE)), {k: x for k, x in tracks.items() if k > 1}, 0)
    back = blocks.samples_of(chunks.filter("track > 2"), ["track"], SIZE).orderBy("track", "n").collect()
    assert [(r.track, r.n) for r in back] == [(k, i) for k, x in tracks.items() if k > 2 for i in range(len(x))]


def test_calls_on_chunks_are_bounded(spark):
    rows = spark.range(300, numPartitions=1).select(F.col("id").alias("c"), F.array_repeat(F.col("id") * 1.0, 4_000 + F.col("id").cast("int") % 2).alias("x"))
    run = lambda x: {"held": np.full(len(x), x.size), "twice": x * 2}
    found = blocks.map_chunks(rows, ["x"], [], {"held": "long", "twice": "array<double>"}, run, ["c"]).collect()
    assert sorted(r.c for r in found) == list(range(300)) and max(r.held for r in found) <= blocks.CALL_SAMPLES
    assert all(r.twice == [r.c * 2.0] * (4_000 + r.c % 2) for r in found)


def test_halos(tracks, chunks):
    for r in blocks.with_halo(chunks, ["track"], before=3, after=5).collect():
        x, at = tracks[r.track], r.c * SIZE
        assert r.left == x[max(at - 3, 0) : at].tolist() and r.right == x[at + SIZE : at + SIZE + 5].tolist() and len(r.x) == min(SIZE, len(x) - at)


def test_blocks_see_their_neighbours(spark):
    rows = spark.createDataFrame([(t, n, float(n * n % 17)) for t in (1, 2) for n in range(60)], "track int, n long, x double")
    near = blocks.haloed(rows, before=2, after=3, size=7)
    summed = near.withColumn("s", F.sum("x").over(blocks.in_order(["track"]).rowsBetween(-2, 3)))
    got = {(r.track, r.n): r.s for r in blocks.own_rows(summed, 7).collect()}
    x = [float(n * n % 17) for n in range(60)]
    assert got == {(t, n): sum(x[max(n - 2, 0) : n + 4]) for t in (1, 2) for n in range(60)}


def test_scan_over_blocks(spark):
    rng = np.random.default_rng(2)
    maps = {(t, c): (rng.normal(0, 0.5, (2, 2)), rng.normal(0, 1, 2)) for t in "ab" for c in range(23)}
    df = spark.createDataFrame([(t, c, m.ravel().tolist(), p.tolist()) for (t, c), (m, p) in maps.items()], "track string, c long, move array<double>, push array<double>").repartition(4)
    for reverse in (False, True):
        got = {(r.track, r.c): r.start for r in affine_starts(df, ["track"], [1.0, -1.0], reverse, block=5).collect()}
        for t in "ab":
            s = np.array([1.0, -1.0])
            for c in range(22, -1, -1) if reverse else range(23):
                assert np.allclose(got[t, c], s, atol=1e-12)
                s = maps[t, c][0] @ s + maps[t, c][1]


def test_filters_equal_whole_tracks(tracks, chunks):
    one = lambda f: {k: f(x[None])[0] for k, x in tracks.items()}
    close(whole(long_filters.k_weighted(chunks, ["track"], SR)), one(lambda x: kernels.k_weighted(x, SR)))
    close(whole(long_filters.low_pass(chunks, ["track"], SR, 300.0, SIZE)), one(lambda x: kernels.low_pass(x, SR, 300.0)))
    close(whole(long_filters.high_pass(chunks, ["track"], SR, 60.0, SIZE)), one(lambda x: kernels.high_pass(x, SR, 60.0)))
    close(whole(long_filters.band_pass(chunks, ["track"], SR, 200.0, 900.0, SIZE)), one(lambda x: kernels.band_pass(x, SR, 200.0, 900.0)))
    close(whole(long_filters.high_pass(chunks, ["track"], SR, 10.0, SIZE)), tracks, 0)
    with pytest.raises(ValueError):
        long_filters.zero_phase(chunks, ["track"], kernels.butterworth(SR, None, 300.0), 18)


def test_envelopes_equal_the_loop(tracks, chunks):
    for fall, rise in ((0.5, 0.9995), (0.999, 0.9), (0.97, 0.97)):
        want = {k: kernels.envelope(np.abs(x)[None], 0.3, fall, rise)[0] for k, x in tracks.items()}
        goals = chunks.withColumn("x", F.transform("x", F.abs))
        close(whole(recursions.envelope(goals, ["track"], 0.3, fall, rise)), want, 1e-12)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=40), st.floats(-2, 2), st.floats(0.1, 0.99), st.floats(0.1, 0.99))
def test_ends_and_their_slopes(goals, start, fall, rise):
    x = np.array([goals])
    end, slope = recursions.ends(x, np.array([start]), fall, rise)
    assert np.isclose(end[0], kernels.envelope(x, start, fall, rise)[0, -1]) and 0 < slope[0] < 1


def test_compressor_and_limiter_equal_whole_tracks(tracks, chunks):
    want = {k: kernels.compress(2 * x[None], SR, np.array([3.0]))[0] for k, x in tracks.items()}
    loud = chunks.withColumn("x", F.transform("x", lambda v: v * 2.0))
    even = blocks.chunked(blocks.samples_of(loud, ["track"], SIZE), ["track"], 960)
    close(whole(recursions.compress(even, ["track"], 3.0, SR, 960)), want, 1e-11)
    with pytest.raises(ValueError):
        recursions.compress(loud, ["track"], 3.0, SR, SIZE)
    stereo = chunks.select("track", "c", F.col("x").alias("l"), F.transform("x", lambda v: v * F.when(F.col("track") == 2, 0.01).otherwise(0.7)).alias("r"))
    stereo = stereo.withColumn("l", F.transform("l", lambda v: v * F.when(F.col("track") == 2, 0.01).otherwise(1.0)))
    got = recursions.limit(stereo, ["track"], -6.0, SR)
    both = {k: (x * (0.01 if k == 2 else 1.0), x * (0.01 if k == 2 else 0.7)) for k, x in tracks.items()}
    want = {k: kernels.limit([l[None], r[None]], np.array([-6.0]), SR) for k, (l, r) in both.items()}
    close(whole(got, "l"), {k: v[0][0] for k, v in want.items()}, 1e-11)
    close(whole(got, "r"), {k: v[1][0] for k, v in want.items()}, 1e-11)


@given(st.lists(st.one_of(st.floats(allow_nan=False), st.just(-0.0)), min_size=2, max_size=50))
def test_keys_keep_the_order(values):
    x = np.array(values)
    keys = selection.order_keys(x)
    by = np.argsort(keys.view(np.uint64), kind="stable")
    assert (np.diff(x[by]) >= 0).all() or np.isinf(x).any()
    assert (selection.doubles(keys) == x).all()
    assert selection.order_keys(np.array([np.nan])).view(np.uint64)[0] > keys.view(np.uint64).max()


def test_percentiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(4)
    groups = {"many": rng.normal(0, 1e3, 4_000), "ties": rng.integers(0, 3, 900).astype(float), "same": np.full(700, -2.5), "few": np.array([3.0, 1.0]), "one": np.array([7.0]), "wide": np.exp(rng.uniform(-600, 600, 800)) * rng.choice([-1, 1], 800)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("few", None), ("none", None)], "track string, v double").repartition(6)
    shares = {"a": 0.1, "b": 0.5, "c": 0.95, "d": 0.0, "e": 1.0}
    for small in (500, 10_000):
        got = {r.track: r for r in selection.percentiles(rows, ["track"], "v", shares, small).collect()}
        assert got.keys() == groups.keys()
        for k, x in groups.items():
            assert got[k].cnt == len(x)
            assert np.allclose([got[k][n] for n in shares], np.percentile(x, [100 * s for s in shares.values()]), rtol=1e-12, atol=0)


def test_resampling_equals_whole_tracks(tracks, chunks):
    for sr, to in ((8_000.0, 6_000.0), (8_000.0, 12_000.0), (8_000.0, 11_040.0)):
        want = {k: kernels.resampled_polyphase(x[None], sr, to)[0] for k, x in tracks.items()}
        got = long_spectra.resampled(chunks, ["track"], sr, to, SIZE)
        close(whole(got), want, 1e-12)
        out = SIZE * int(to) // int(sr)
        assert {len(r.x) for r in got.filter("track = 1 and c < 10").collect()} == {out}
    with pytest.raises(ValueError):
        long_spectra.resampled(chunks, ["track"], 48_000.0, 44_100.0, SIZE)


def test_resampling_keeps_tones():
    t = np.arange(4_800)
    for to in (44_100, 96_000):
        y = kernels.resampled_polyphase(np.sin(2 * np.pi * 997 * t / 48_000)[None], 48_000, to)[0]
        want = np.sin(2 * np.pi * 997 * np.arange(len(y)) / to)
        assert len(y) == -(-4_800 * to // 48_000) and np.abs(y - want)[100:-100].max() < 2e-4
    high = kernels.resampled_polyphase(np.sin(2 * np.pi * 15_000 * t / 48_000)[None], 48_000, 24_000)[0]
    assert np.abs(high[100:-100]).max() < 1e-3  # above half the new rate


def test_true_peak_of_chunks(tracks, chunks):
    bank = kernels.polyphase_bank(4, 1, cut=1.0)
    reach = bank.shape[1] // 2
    for r in long_spectra.true_peak(chunks, ["track"]).collect():
        x = tracks[r.track]
        want = np.abs(kernels.polyphase(np.pad(x, (reach, reach + 1)), bank, 1, 4 * len(x))).max()
        assert abs(r.true_peak - want) < 1e-12 and r.true_peak >= np.abs(x).max() - 1e-12


@pytest.mark.parametrize("small", [20_000, 10])
def test_gate_equals_whole_tracks(tracks, chunks, small):
    want = {k: kernels.gate(x[None], np.array([0.8]), 64, 20)[0] for k, x in tracks.items()}
    close(whole(long_spectra.gate(chunks, ["track"], 0.8, 64, 20, SIZE, small)), want)
    close(whole(long_spectra.gate(chunks, ["track"], 0.0, 64, 20, SIZE)), tracks, 0)
    with pytest.raises(ValueError):
        long_spectra.gate(chunks, ["track"], 0.8, 64, 30, SIZE)


def test_gains_of_many_stems(spark):
    rng = np.random.default_rng(8)
    names = ["vocals", "drums", "bass", "other", "instrumental"]
    songs = {k: rng.normal(0, 1, (5, n)) for k, n in ((1, 4_000), (2, 500), (3, 20), (4, 300))}
    songs[2][4] = 0.0  # an absent stem
    goals = {k: np.array([0.93, 0.99, 0.5, 1.0, 0.95]) @ x for k, x in songs.items()}
    goals[4] = goals[4] * 0
    rows = spark.createDataFrame([(k, *map(float, x[:, i]), float(goals[k][i])) for k, x in songs.items() for i in range(x.shape[1])], "song int, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(5)
    got = {r.song: r for r in stems.gains_from_gram(stems.gram(rows, {n: F.col(n) for n in names}, F.col("y"), ["song"]), names, ["song"]).collect()}
    for k, x in songs.items():
        own = [i for i in range(5) if np.abs(x[i]).max() > 0]
        solved = np.linalg.lstsq(x[own].T, goals[k], rcond=None)[0]
        default, limit, _ = (np.array(v) for v in zip(*(stems.STEM_GAINS[names[i]] for i in own)))
        gain = np.clip(solved, default * 10 ** (-limit / 20), default * 10 ** (limit / 20))
        applied = x.shape[1] >= 8 * len(own) and np.abs(goals[k]).max() > 0
        assert got[k].applied == applied
        gain = gain if applied else default
        assert np.allclose([got[k][names[i]] for i in own], gain, atol=1e-9) and all(got[k][names[i]] is None for i in range(5) if i not in own)
        base, now = (np.sqrt(np.mean((g @ x[own] - goals[k]) ** 2)) for g in (default, gain))
        assert abs(got[k].error_reduction - (np.clip((base - now) / base, -1, 1) if applied else 0.0)) < 1e-9
