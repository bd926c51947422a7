"""Sound files as a Spark data source: WAV and FLAC as rows of samples, and whole WAV files or none as a sink.

Reading plans parts by bytes from the list of files alone; each task reads the headers of its files, drops files by the filters
that Spark pushes down (rate, channels, bits, frames, kind, path) before any sample is read, and decodes what starts in its part.
With the option samples=false only headers are read, a row for each file. Rows of a WAV file hold a chunk each; a FLAC frame's
samples are cut at chunks, and ``chunks`` joins them.

Writing fits each track's peak under the ceiling, adds noise-shaped dither for 16 bits and appends its chunks to a file of its own,
which gets its name when the job commits; a failed or repeated task leaves nothing under a name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators import kernels as k
from ..operators.blocks import CHUNK
from . import flac

SCHEMA = "path string, kind string, sr int, channels int, bits int, frames long, channel int, n long, x array<double>"
HEADER = ("path", "kind", "sr", "channels", "bits", "frames")
#: Bytes of a file that one task decodes, about.
PART_BYTES = 32 << 20
#: Highest sample of a written file, in dB.
CEILING_DB = -0.3
#: Samples of a stretch whose dither starts from no error.
STRETCH = 1_024
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("sr", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("channel", pa.int32()), ("n", pa.int64()), ("x", pa.list_(pa.float64()))])


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def list_files(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files under ``path`` that end in .wav or .flac, in order."""
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    base = path if "://" in path else f"file://{path}"
    prefix = base[: len(base) - len(root)] if base.endswith(root) else base.split("://")[0] + "://"
    names = (f for f in found if f.type == fs.FileType.File and f.extension.lower() in ("wav", "flac") and not f.base_name.startswith((".", "_")))
    return sorted((prefix + f.path, f.size) for f in names)


def reading(path: str) -> tuple[Callable[[int, int], bytes], Callable[[], None]]:
    """``read(place, n)`` of a file, and how to close it."""
    system, name = _system(path)
    f = system.open_input_file(name)

    def read(place: int, n: int) -> bytes:
        f.seek(place)
        return f.read(n)

    return read, f.close


@dataclass
class Wave:
    """What a WAV header says; ``code`` is 1 for whole numbers and 3 for floating ones."""

    sr: int
    channels: int
    bits: int
    frames: int
    start: int
    code: int

    @property
    def width(self) -> int:
        return self.channels * self.bits // 8


def wave_header(read: Callable[[int, int], bytes], size: int) -> Wave:
    """Of a file of ``size`` bytes; data that should go on beyond its end ends there."""
    head = read(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while True:
        piece = read(at, 8)
        if len(piece) < 8:
            raise EOFError("a WAV file without data")
        name, length = piece[:4], int.from_bytes(piece[4:], "little")
        if name == b"fmt ":
            form = read(at + 8, min(length, 40))
        elif name == b"data":
            break
        at += 8 + length + length % 2
    if form is None:
        raise ValueError("a WAV file without a format")
    code, channels, sr, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if code == 0xFFFE and len(form) >= 26:
        code = int.from_bytes(form[24:26], "little")
    if code not in (1, 3) or bits not in ((8, 16, 24, 32) if code == 1 else (32, 64)) or not channels:
        raise ValueError(f"WAV samples of format {code} with {bits} bits aren't read")
    return Wave(sr, channels, bits, min(length, size - at - 8) // (channels * bits // 8), at + 8, code)


def wave_samples(raw: bytes, w: Wave) -> np.ndarray:
    """Samples by channel, whole numbers within -1 and 1."""
    if w.code == 3:
        return np.frombuffer(raw, f"<f{w.bits // 8}").reshape(-1, w.channels).T.astype(float)
    cells = np.frombuffer(raw, np.uint8).reshape(-1, w.channels, w.bits // 8)
    if w.bits == 8:
        return ((cells[:, :, 0].astype(float) - 128) / 128).T
    wide = np.zeros((*cells.shape[:2], 4), np.uint8)
    wide[:, :, 4 - w.bits // 8 :] = cells
    return (wide.view("<i4")[:, :, 0] / 2.0**31).T


class Parts(InputPartition):
    """(address, bytes, first byte, byte after the last) of each piece of a task."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


def planned(files: list[tuple[str, int]], part_bytes: int) -> list[Parts]:
    """Large files in several parts, small ones together, without opening any."""
    out, held, size = [], [], 0
    for path, n in files:
        for lo in range(0, max(n, 1), part_bytes):
            piece = (path, n, lo, min(lo + part_bytes, n))
            if held and size + piece[3] - lo > part_bytes:
                out.append(Parts(held))
                held, size = [], 0
            held.append(piece)
            size += piece[3] - lo
    return [*out, Parts(held)] if held else out


class SoundReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.samples = str(options.get("samples", "true")).lower() != "false"
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER and type(f) in kinds:
                self.tests.append((name, kinds[type(f)], f.value))
            elif not (name in HEADER[:5] and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> Sequence[Parts]:
        return planned(list_files(self.path), self.part_bytes) or [Parts([])]

    def wanted(self, header: dict) -> bool:
        how = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(header[name] is not None and how[op](header[name], value) for name, op, value in self.tests)

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        for path, size, lo, hi in partition.pieces:
            if not self.samples and lo:
                continue  # the header is in the first piece
            read, close = reading(path)
            try:
                yield from self.rows(path, read, size, lo, hi)
            finally:
                close()

    def rows(self, path: str, read: Callable[[int, int], bytes], size: int, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        if read(0, 4) == b"fLaC":
            kind, info = "flac", flac.header(read)
        else:
            kind, info = "wav", wave_header(read, size)
        frames = info.frames if kind == "wav" or info.frames else None
        header = dict(zip(HEADER, (path, kind, info.sr, info.channels, info.bits, frames)))
        if not self.wanted(header):
            return
        if not self.samples:
            yield pa.RecordBatch.from_pylist([header | {"channel": None, "n": None, "x": None}], _ARROW)
            return
        pieces = self.wave_pieces(read, info, lo, hi) if kind == "wav" else self.flac_pieces(read, info, lo, hi)
        for n, x in pieces:
            columns = [[header[c]] * len(x) for c in HEADER] + [list(range(len(x))), [n] * len(x), pa.array(list(x), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, _ARROW.types)], schema=_ARROW)

    def wave_pieces(self, read, w: Wave, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        """Chunks whose first byte lies in the part; the header's bytes belong to the first one."""
        step = self.chunk * w.width
        c = max(0, -(-(lo - w.start) // step)) if lo else 0
        while c * self.chunk < w.frames and (w.start + c * step < hi or c * step == 0 and lo == 0):
            count = min(self.chunk, w.frames - c * self.chunk)
            yield c * self.chunk, wave_samples(read(w.start + c * step, count * w.width), w)
            c += 1

    def flac_pieces(self, read, stream: flac.Stream, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        for n, x in flac.decoded(read, stream, lo, hi):
            at = 0
            while at < x.shape[1]:
                upto = min(x.shape[1], at + self.chunk - (n + at) % self.chunk)
                yield n + at, x[:, at:upto]
                at = upto


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SoundWriter(DataSourceWriter):
    """Appends rows (name, frames, pcm), which come in order and a name at a time, to files; see ``write``."""

    def __init__(self, options: dict):
        self.path, self.sr, self.channels, self.bits = options["path"], int(options["sr"]), int(options["channels"]), int(options["bits"])
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Written:
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, str]] = []
        now, stream = None, None
        try:
            for row in iterator:
                if row.name != now:
                    if stream:
                        stream.close()
                    now = row.name
                    done.append((f"{root}/.{uuid.uuid4().hex}.part", f"{root}/{now}.wav"))
                    stream = system.open_output_stream(done[-1][0])
                    stream.write(wave_head(self.sr, self.channels, self.bits, row.frames))
                stream.write(bytes(row.pcm))
            if stream:
                stream.close()
        except BaseException:
            if stream:
                stream.close()
            self._remove([part for part, _ in done])
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for part, name in (f for m in messages if m for f in m.files):
            system.move(part, name)

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([part for m in messages if m for part, _ in m.files])

    def _remove(self, parts: list[str]) -> None:
        from pyarrow import fs

        system, _ = _system(self.path)
        for part in parts:
            if system.get_file_info(part).type == fs.FileType.File:
                system.delete_file(part)


class SoundSource(DataSource):
    """``spark.read.format("sound").load(path)``, options samples, chunk and partbytes; ``write`` is the way to save."""

    @classmethod
    def name(cls) -> str:
        return "sound"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SoundReader:
        return SoundReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SoundWriter:
        return SoundWriter(dict(self.options))


def wave_head(sr: int, channels: int, bits: int, frames: int) -> bytes:
    width = channels * bits // 8
    return b"RIFF" + struct.pack("<I", min(36 + frames * width, 0xFFFFFFFF)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, sr, sr * width, width, bits) + b"data" + struct.pack("<I", min(frames * width, 0xFFFFFFFF))


def read(spark: SparkSession, path: str, samples: bool = True, chunk: int = CHUNK, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of samples under ``path``, or with ``samples`` false a row for each file; filters on the header are pushed down.

    The filter that holds for all rows makes Spark plan each query's filters anew: one without any would meet those of the last.
    """
    spark.dataSource.register(SoundSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("sound").options(samples=str(samples).lower(), chunk=str(chunk), partbytes=str(part_bytes)).load(path)
    return rows.filter(F.col("path").isNotNull())


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, sr, channel, c, x): what ``read`` gave as the chunks that long operators take; a FLAC file's parts are joined."""
    parts = rows.groupBy("path", "sr", "channel", F.floor(F.col("n") / chunk).alias("c")).agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s"))
    return parts.select("path", "sr", "channel", "c", F.flatten(F.transform("s", lambda p: p["x"])).alias("x"))


def quantised(x: np.ndarray, bits: int, seed: Sequence[int]) -> np.ndarray:
    """Whole numbers of channels (channels, samples). 16 bits get triangular noise and error feedback, which starts from no error
    every ``STRETCH`` samples: an error is half a step at most, so the numbers stay within a step of one long recursion."""
    if bits == 16:
        n = x.shape[-1]
        rows = np.pad(x, [(0, 0), (0, -n % STRETCH)]).reshape(-1, STRETCH)
        x = k.dithered(rows, np.random.default_rng(list(seed))).reshape(len(x), -1)[:, :n]
    return np.round(np.clip(x, -1, 1) * (2 ** (bits - 1) - 1)).astype("<i4")


def write(tracks: DataFrame, path: str, sr: int, channels: int, bits: int = 24, ceiling_db: float = CEILING_DB) -> None:
    """Writes (name, channel, c, x), chunks of ``channels`` channels from 0 on, as a WAV file for each name.

    What isn't finite is silence. A track whose peak is above the ceiling is scaled down as a whole. The dither's noise follows from
    name and chunk, so a repeated task writes the same bytes.
    """
    if bits not in (16, 24):
        raise ValueError("16 or 24 bits")
    tracks.sparkSession.dataSource.register(SoundSource)
    clean = tracks.select(F.regexp_replace(F.col("name").cast("string"), r"[/\\\x00]", "_").alias("name"), "channel", "c", F.transform("x", lambda v: F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), 0.0).otherwise(v)).alias("x"))
    whole = clean.groupBy("name", "c").agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("s"))
    facts = clean.groupBy("name").agg(F.max(F.array_max(F.transform("x", F.abs))).alias("peak"), F.sum(F.when(F.col("channel") == 0, F.size("x"))).alias("frames"))
    ceiling = 10 ** (ceiling_db / 20)
    gain = F.when((F.col("peak") > ceiling) & (F.col("peak") > 1e-9), ceiling / F.col("peak")).otherwise(1.0)
    rows = whole.select("name", "c", F.transform("s", lambda p: p["x"]).alias("x")).join(facts.select("name", "frames", gain.alias("gain")), "name")

    def run(batches):
        for batch in batches:
            pcm = []
            for name, c, x, gain in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if len(x) != channels:
                    raise ValueError(f"{name} has {len(x)} channels in chunk {c}, not {channels}")
                whole = quantised(np.array(x) * gain, bits, (zlib.crc32(name.encode()), c)).T
                pcm.append(np.ascontiguousarray(whole).view(np.uint8).reshape(*whole.shape, 4)[:, :, : bits // 8].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(pcm, pa.binary())], ["name", "c", "frames", "pcm"])

    made = rows.select("name", "c", "x", "frames", "gain").mapInArrow(run, "name string, c long, frames long, pcm binary")
    ordered = made.repartition("name").sortWithinPartitions("name", "c").select("name", "frames", "pcm")
    ordered.write.format("sound").options(sr=str(sr), channels=str(channels), bits=str(bits)).mode("append").save(path)
