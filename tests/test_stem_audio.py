"""The remix of many songs at a time against each song by itself."""

import numpy as np

from quaverline.functions.tables import PARAMETERS
from quaverline.operators import mastering, stem_audio

FIELDS = "stem string, l array<double>, r array<double>, extra_l array<double>, extra_r array<double>, score double, strength double, mode string, target string"
SCHEMA = f"track long, {FIELDS}, dsp_params struct<{', '.join(f'{p}: double' for p in PARAMETERS)}>"
LEVELS = {"lowcut_hz": 30.0, "compress_ratio": 1.6, "target_lufs": -14.0, "limiter_ceiling_db": -1.8, "exciter_amount": 0.05, "saturation_amount": 0.04}


def songs(count: int) -> list[tuple]:
    rng, rows = np.random.default_rng(3), []
    for song in range(count):
        names = ("vocals", "drums", "bass") if song % 3 else ("vocals", "other")
        for i, stem in enumerate(names):
            sound = [rng.normal(0, 0.2, 64 if song % 4 else 80).tolist() for _ in range(4)]
            mode, target = ("denoise", None, "normal")[(song + i) % 3], ("hifi_bright", "bass_boost", "restore", None)[(song + i) % 4]
            rows.append((song, stem, *sound, 0.1 * i, 0.2 + 0.01 * song, mode, target, tuple(LEVELS.get(p, 0.5) for p in PARAMETERS)))
    return rows


def test_songs_remixed_together_equal_each_alone_in_any_order_of_stems(spark):
    rows = songs(14)
    read = lambda part: {r.track: r for r in stem_audio.remixed(spark.createDataFrame(part, SCHEMA)).collect()}
    together, turned = read(rows), read(rows[::-1])
    assert together.keys() == set(range(14)) and {r.stems for r in together.values()} == {2, 3}
    for t, r in together.items():
        assert turned[t] == r
    for t in (0, 1, 4):
        (alone,) = read([x for x in rows if x[0] == t]).values()
        for c in ("residual_gain", "out_l", "out_r"):
            assert np.abs(np.array(alone[c]) - np.array(together[t][c])).max() <= 1e-9, (t, c)


def test_songs_of_a_kind_share_the_calls_of_the_chain(monkeypatch):
    calls, chain = [], mastering.master
    monkeypatch.setattr(mastering, "master", lambda x, *args, **ways: calls.append(len(x[0])) or chain(x, *args, **ways))
    rng = np.random.default_rng(4)
    given = {stem: (rng.normal(0, 0.2, (50, 64)), rng.normal(0, 0.2, (50, 64))) for stem in ("vocals", "drums")}
    told = {n: np.full(50, LEVELS.get(n, 0.3)) for n in (*PARAMETERS, "strength", "denoise", "bass_boost", "hifi_bright")}
    out, gain = stem_audio._remix(given, dict.fromkeys(given, told), (np.zeros((50, 64)), np.zeros((50, 64))), np.full(50, 0.2), mastering.SHORT)
    assert calls == [50, 50] and out[0].shape == (50, 64) and gain.shape == (50,)
