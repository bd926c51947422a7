"""WAV and FLAC as a source and a sink of long tracks."""

import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaverline.operators import kernels
from quaverline.sources import flac, sound

CHUNK = 1_000


def wav(x, sr, bits, code=1, junk=b""):
    scale = {8: lambda v: np.round(v * 127 + 128).astype(np.uint8), 16: lambda v: np.round(v * 32767).astype("<i2"), 32: lambda v: v.astype("<f4"), 64: lambda v: v.astype("<f8")}
    data = np.ascontiguousarray(scale[bits](x.T)).tobytes()
    width = len(x) * bits // 8
    form = struct.pack("<HHIIHH", code, len(x), sr, sr * width, width, bits)
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + (b"LIST" + struct.pack("<I", len(junk)) + junk + b"\0" * (len(junk) % 2) if junk else b"") + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Writer:
    def __init__(self):
        self.text = []

    def put(self, value, n):
        if n:
            self.text.append(format(value & ((1 << n) - 1), f"0{n}b"))

    def raw(self):
        s = "".join(self.text)
        s += "0" * (-len(s) % 8)
        return int("1" + s, 2).to_bytes(len(s) // 8 + 1, "big")[1:]


def rice(w, residual, order, parts, k, wide=False):
    w.put(1 if wide else 0, 2)
    w.put(parts, 4)
    size = (len(residual) + order) >> parts
    at = 0
    for i in range(1 << parts):
        count = size - (order if i == 0 else 0)
        part = residual[at : at + count]
        at += count
        if k is None:  # plain numbers
            w.put(31 if wide else 15, 5 if wide else 4)
            n = max(int(v).bit_length() + 1 for v in [*part, 0])
            w.put(n, 5)
            for v in part:
                w.put(int(v), n)
            continue
        w.put(k, 5 if wide else 4)
        for v in part:
            u = int(v) << 1 if v >= 0 else (-int(v) << 1) - 1
            w.text.append("0" * (u >> k) + "1")
            w.put(u, k)


def subframe(w, x, depth, how):
    wasted = how.get("wasted", 0)
    x, depth = x >> wasted, depth - wasted
    kind = {"constant": 0, "verbatim": 1, "fixed": 8 + how.get("order", 0), "lpc": 31 + how.get("order", 0)}[how["kind"]]
    w.put(0, 1)
    w.put(kind, 6)
    w.put(1 if wasted else 0, 1)
    if wasted:
        w.put(1, wasted)
    if how["kind"] == "constant":
        return w.put(int(x[0]), depth)
    if how["kind"] == "verbatim":
        for v in x:
            w.put(int(v), depth)
        return None
    order = how["order"]
    for v in x[:order]:
        w.put(int(v), depth)
    if how["kind"] == "fixed":
        residual = np.diff(x, n=order)
    else:
        weights, shift = how["weights"], how["shift"]
        w.put(11, 4)
        w.put(shift, 5)
        for c in weights:
            w.put(c, 12)
        residual = np.array([x[i] - (sum(int(c) * int(x[i - 1 - j]) for j, c in enumerate(weights)) >> shift) for i in range(order, len(x))])
    return rice(w, residual, order, how.get("parts", 0), how.get("k", 4), how.get("wide", False))


def number(v):
    if v < 0x80:
        return bytes([v])
    n = 2
    while v >> (5 * n + 1):
        n += 1
    return bytes([(0xFF << (8 - n) & 0xFF) | v >> 6 * (n - 1), *(0x80 | v >> 6 * i & 0x3F for i in range(n - 2, -1, -1))])


def encode(x, sr, bits, block, how, stereo=None, variable=False, known=True):
    """Whole numbers (channels, samples) as FLAC; ``how(frame, channel)`` says how each subframe is coded."""
    out, longest = [], 0
    for f, at in enumerate(range(0, x.shape[1], block)):
        part = x[:, at : at + block].astype(np.int64)
        head = bytes([0xFF, 0xF9 if variable else 0xF8, 0x70, ((stereo or len(x) - 1) << 4) | {8: 1, 16: 4, 24: 6}[bits] << 1]) + number(at if variable else f) + struct.pack(">H", part.shape[1] - 1)
        w = Writer()
        left = part
        if stereo == 8:
            left = np.array([part[0], part[0] - part[1]])
        elif stereo == 9:
            left = np.array([part[0] - part[1], part[1]])
        elif stereo == 10:
            left = np.array([part[0] + part[1] >> 1, part[0] - part[1]])
        for c, y in enumerate(left):
            side = (stereo, c) in ((8, 1), (9, 0), (10, 1))
            subframe(w, y, bits + side, how(f, c))
        frame = head + bytes([flac.crc8(head)]) + w.raw()
        frame += struct.pack(">H", flac.crc16(frame))
        longest = max(longest, len(frame))
        out.append(frame)
    info = struct.pack(">HH", block, block) + b"\0\0\0" + longest.to_bytes(3, "big") * known + b"\0\0\0" * (not known)
    info += ((sr << 44) | (len(x) - 1) << 41 | (bits - 1) << 36 | (x.shape[1] if known else 0)).to_bytes(8, "big") + b"\0" * 16
    return b"fLaC" + b"\x04\0\0\x05abcde" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(out)


def ways(f, c):
    lpc = {"kind": "lpc", "order": 3, "weights": [1500, -700, 100], "shift": 10, "k": 9, "wide": True}
    return [{"kind": "fixed", "order": 2, "k": 7, "parts": 2}, lpc, {"kind": "verbatim"}, {"kind": "fixed", "order": 0, "k": None}, {"kind": "fixed", "order": 4, "k": 8}][(f + c) % 5]


def reader(raw):
    return lambda at, n: raw[at : at + n]


def tone(n, seed=0, channels=2, peak=12_000):
    rng = np.random.default_rng(seed)
    return np.round(np.array([np.sin(np.arange(n) / (17 + 5 * c)) * peak for c in range(channels)]) + rng.normal(0, 60, (channels, n))).astype(np.int64)


@pytest.mark.parametrize("stereo, variable, known", [(None, False, True), (8, True, True), (9, False, False), (10, True, False)])
def test_flac_equals_its_samples(stereo, variable, known):
    x = tone(5_000)
    raw = encode(x, 44_100, 16, 576, ways, stereo, variable, known)
    stream = flac.header(reader(raw))
    assert (stream.sr, stream.channels, stream.bits, stream.frames) == (44_100, 2, 16, 5_000 * known)
    for cut in (len(raw), 1_000, 137):
        got = [f for lo in range(0, len(raw), cut) for f in flac.decoded(reader(raw), stream, lo, min(lo + cut, len(raw)))]
        assert [n for n, _ in got] == list(range(0, 5_000, 576))
        assert (np.concatenate([y for _, y in got], axis=1) * 32_768 == x).all()


def test_flac_depths_constants_and_wasted_bits():
    for bits, x in ((24, tone(900, 1, 1, 4_000_000)), (8, tone(300, 2, 3, 50) // 2), (16, np.full((1, 700), -5)), (16, tone(640, 3, 1, 3_000) << 2)):
        how = (lambda f, c: {"kind": "constant"}) if (x == x[0, 0]).all() else (lambda f, c: {"kind": "fixed", "order": 1, "k": 10, "wasted": 2}) if not (x & 3).any() else (lambda f, c: {"kind": "fixed", "order": 3, "k": 12})
        raw = encode(x, 8_000, bits, 256, how)
        got = np.concatenate([y for _, y in flac.decoded(reader(raw), flac.header(reader(raw)), 0, len(raw))], axis=1)
        assert (got * 2 ** (bits - 1) == x).all()


def test_damaged_and_cut_flac():
    x = tone(3_000)
    raw = bytearray(encode(x, 8_000, 16, 500, ways))
    stream = flac.header(reader(bytes(raw)))
    raw[stream.start + 40] ^= 1  # a checksum tells
    got = dict(flac.decoded(reader(bytes(raw)), stream, 0, len(raw)))
    assert sorted(got) == [500, 1_000, 1_500, 2_000, 2_500] and (got[500] * 32_768 == x[:, 500:1_000]).all()
    got = dict(flac.decoded(reader(bytes(raw[:-7])), stream, 0, len(raw) - 7))
    assert sorted(got) == [500, 1_000, 1_500, 2_000]
    for bad in (b"", b"RIFF", b"fLaC\x80\0\0\x04abcd"):
        with pytest.raises((ValueError, EOFError)):
            flac.header(reader(bad))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-2_000, 2_000), min_size=5, max_size=60), st.integers(0, 4))
def test_differences_and_back(values, order):
    x = np.array(values)
    assert (flac.integrated(x[:order], np.diff(x, n=order)) == x).all()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("sounds")
    sounds = {"long": (tone(10_500) / 32_768, 48_000), "mono": (tone(400, 5, 1) / 32_768, 44_100), "six": (tone(1_000, 6, 6) / 32_768, 48_000)}
    (root / "sub").mkdir()
    (root / "long.wav").write_bytes(wav(sounds["long"][0], 48_000, 16, junk=b"a note"))
    (root / "mono.wav").write_bytes(wav(sounds["mono"][0], 44_100, 8))
    (root / "sub" / "six.WAV").write_bytes(wav(sounds["six"][0], 48_000, 32, code=3))
    (root / "sub" / "twin.flac").write_bytes(encode(tone(10_500), 48_000, 16, 512, ways, 10))
    (root / "empty.wav").write_bytes(wav(np.zeros((2, 0)), 8_000, 16))
    (root / "notes.txt").write_text("no sound")
    return root, sounds


def joined(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.path, r.channel, r.c)):
        out.setdefault((os.path.basename(r.path), r.channel), []).extend(r.x)
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("part_bytes", [1 << 20, 5_000])
def test_files_of_any_kind(spark, folder, part_bytes):
    root, sounds = folder
    rows = sound.read(spark, f"file://{root}", chunk=CHUNK, part_bytes=part_bytes)
    assert part_bytes > 5_000 or rows.rdd.getNumPartitions() > 8
    pieces = [r for r in rows.filter("kind = 'wav'").collect()]
    assert all(r.n % CHUNK == 0 and len(r.x) == min(CHUNK, r.frames - r.n) for r in pieces)
    got = joined(sound.chunks(rows, CHUNK).collect())
    assert sorted({k for k, _ in got}) == ["long.wav", "mono.wav", "six.WAV", "twin.flac"] and len(got) == 11
    for c in (0, 1):
        assert np.abs(got["long.wav", c] - sounds["long"][0][c]).max() < 1 / 32_000
        assert (got["twin.flac", c] * 32_768 == tone(10_500)[c]).all()
    assert np.abs(got["mono.wav", 0] - sounds["mono"][0][0]).max() < 1 / 100
    for c in range(6):
        assert np.abs(got["six.WAV", c] - sounds["six"][0][c]).max() < 1e-6


def test_headers_alone(spark, folder):
    rows = {os.path.basename(r.path): r for r in sound.read(spark, f"file://{folder[0]}", samples=False).collect()}
    assert {k: (r.kind, r.sr, r.channels, r.bits, r.frames) for k, r in rows.items()} == {
        "long.wav": ("wav", 48_000, 2, 16, 10_500), "mono.wav": ("wav", 44_100, 1, 8, 400), "six.WAV": ("wav", 48_000, 6, 32, 1_000),
        "twin.flac": ("flac", 48_000, 2, 16, 10_500), "empty.wav": ("wav", 8_000, 2, 16, 0),
    }
    assert all(r.x is None for r in rows.values())
    heads = sound.read(spark, f"file://{folder[0]}", samples=False)  # one table asked in several ways
    assert [heads.filter(f).count() for f in ("sr = 48000", "true", "sr < 48000", "kind = 'flac'", "true")] == [3, 5, 2, 1, 5]
    some = sound.read(spark, f"file://{folder[0]}").filter((F.col("sr") == 48_000) & (F.col("frames") > 5_000) & (F.col("channel") == 1))
    assert {os.path.basename(r.path) for r in some.select("path").distinct().collect()} == {"long.wav", "twin.flac"}


def test_what_is_read_of_a_file(folder, monkeypatch):
    """Headers without samples, and nothing but headers of files that filters drop, on any part."""
    count = {"bytes": 0}
    opened = sound.reading

    def counting(path):
        read, close = opened(path)

        def counted(at, n):
            raw = read(at, n)
            count["bytes"] += len(raw)
            return raw

        return counted, close

    monkeypatch.setattr(sound, "reading", counting)
    size = sum(n for _, n in sound.list_files(f"file://{folder[0]}"))
    for options, tests, share in (({"samples": "false"}, [], 0.02), ({}, [("sr", "=", 1)], 0.02), ({}, [("channels", ">", 5)], 0.4), ({}, [], 1.1)):
        reader = sound.SoundReader({"path": f"file://{folder[0]}"} | options)
        reader.tests = tests
        count["bytes"] = 0
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert count["bytes"] <= share * size, (options, tests)
        assert bool(rows) == (tests != [("sr", "=", 1)])


def test_odd_wave_files(tmp_path):
    whole = wav(tone(100) / 32_768, 8_000, 16)
    assert sound.wave_header(reader(whole[:-100]), len(whole) - 100).frames == 75  # cut short
    assert sound.wave_header(reader(wav(tone(10) / 32_768, 8_000, 64, code=3)), 10**6).bits == 64
    for bad in (b"", b"RIFF\0\0\0\0WAVE", whole[:20] + b"\x07\0" + whole[22:], b"RIFF\0\0\0\0WAVEdata\0\0\0\0"):
        with pytest.raises((ValueError, EOFError)):
            sound.wave_header(reader(bad), len(bad))


def tracks(spark, sounds):
    rows = [(n, c, i, x[c, i * CHUNK : (i + 1) * CHUNK].tolist()) for n, x in sounds.items() for c in range(len(x)) for i in range(-(-x.shape[1] // CHUNK))]
    return spark.createDataFrame(rows, "name string, channel int, c long, x array<double>").repartition(5)


@pytest.mark.parametrize("bits", [16, 24])
def test_sink_writes_what_the_source_reads(spark, tmp_path, bits):
    sounds = {"soft": tone(5_300, 1) / 32_768, "loud/er": 4 * tone(2_000, 2) / 32_768, "bad": np.array([[np.nan, 0.5, np.inf]] * 2)}
    sound.write(tracks(spark, sounds), f"file://{tmp_path}/out", 48_000, 2, bits)
    assert sorted(os.listdir(tmp_path / "out")) == ["bad.wav", "loud_er.wav", "soft.wav"]
    got = joined(sound.chunks(sound.read(spark, f"file://{tmp_path}/out", chunk=CHUNK), CHUNK).collect())
    step, top = 3 / 2 ** (bits - 1), 10 ** (-0.3 / 20)
    for n, x in sounds.items():
        clean = np.where(np.isfinite(x), x, 0)
        clean = clean * min(1, top / np.abs(clean).max())
        for c in (0, 1):
            assert np.abs(got[n.replace("/", "_") + ".wav", c] - clean[c]).max() <= step
    again = (tmp_path / "out" / "soft.wav").read_bytes()
    sound.write(tracks(spark, {"soft": sounds["soft"]}), f"file://{tmp_path}/again", 48_000, 2, bits)
    assert (tmp_path / "again" / "soft.wav").read_bytes() == again


def test_dither_stays_within_a_step_of_the_loop():
    x = tone(5_000)[:1] / 32_768
    noisy = sound.quantised(x, 16, (1, 2))
    rows = np.pad(x, [(0, 0), (0, -5_000 % sound.STRETCH)])
    rng = np.random.default_rng([1, 2])
    shape = (rows.shape[1] // sound.STRETCH, sound.STRETCH)
    noise = (rng.random(shape) - rng.random(shape)).reshape(1, -1) / 32_768
    error, out = 0.0, []
    for v in (rows + noise)[0]:
        wanted = v + error * 0.62
        out.append(round(float(np.clip(wanted, -1, 1)) * 32_767))
        error = wanted - out[-1] / 32_767
    assert np.abs(noisy[0] - np.array(out[:5_000])).max() <= 1
    assert kernels.dithered(x, np.random.default_rng(0)).shape == x.shape


def test_failed_write_leaves_no_file(spark, tmp_path):
    bad = tracks(spark, {"fine": tone(3_000) / 32_768, "mono": tone(2_500, 3, 1) / 32_768})
    with pytest.raises(Exception, match="channels"):
        sound.write(bad, f"file://{tmp_path}/out", 48_000, 2)
    assert not (tmp_path / "out").exists() or not [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")]
    writer = sound.SoundWriter({"path": f"file://{tmp_path}/raw", "sr": "8000", "channels": "1", "bits": "16"})

    class Row:
        name, frames, pcm = "a", 2, b"\0\0\0\0"

    def rows():
        yield Row
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(rows())
    assert os.listdir(tmp_path / "raw") == []
    first = writer.write(iter([Row]))
    writer.abort([first, None])
    assert os.listdir(tmp_path / "raw") == []
    writer.commit([writer.write(iter([Row])), None])
    assert os.listdir(tmp_path / "raw") == ["a.wav"]
