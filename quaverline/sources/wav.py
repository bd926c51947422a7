"""PCM WAV files: reading through Spark's binary file source, writing one file for each track."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension

SCHEMA = "path string, sr int, frames long, bits int, channels array<array<double>>"


def decode(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(sample rate, bits, samples by channel within -1 and 1) of 8, 16, 24 or 32 bit PCM."""
    with wave.open(io.BytesIO(raw)) as w:
        width, data = w.getsampwidth(), np.frombuffer(w.readframes(w.getnframes()), np.uint8).reshape(-1, w.getnchannels(), w.getsampwidth())
        sr = w.getframerate()
    if width == 1:
        return sr, 8, ((data[:, :, 0].astype(float) - 128) / 128).T
    cells = np.zeros((*data.shape[:2], 4), np.uint8)
    cells[:, :, 4 - width :] = data
    return sr, 8 * width, (cells.view("<i4")[:, :, 0] / 2**31).T


def encode(channels: np.ndarray, sr: int, bits: int = 24) -> bytes:
    """16 or 24 bit PCM; values beyond -1 and 1 are clipped, what isn't finite is silence."""
    clean = np.clip(np.nan_to_num(channels, nan=0.0, posinf=0.0, neginf=0.0), -1, 1)
    whole = np.round(clean * (2 ** (bits - 1) - 1)).astype("<i4").T
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(bits // 8)
        w.setframerate(sr)
        w.writeframes(np.ascontiguousarray(whole).view(np.uint8).reshape(*whole.shape, 4)[:, :, : bits // 8].tobytes())
    return out.getvalue()


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each WAV file under ``path``; files of other kinds aren't opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    chosen = files.filter(extension(F.col("path")) == ".wav").select("path", "content")

    def run(batches):
        for batch in batches:
            for name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                sr, bits, x = decode(raw)
                yield pa.RecordBatch.from_pydict({"path": [name], "sr": pa.array([sr], pa.int32()), "frames": pa.array([x.shape[1]], pa.int64()), "bits": pa.array([bits], pa.int32()), "channels": pa.array([x.tolist()], pa.list_(pa.list_(pa.float64())))})

    return chosen.mapInArrow(run, SCHEMA)


def stereo(files: DataFrame, sr: int, frames: int) -> DataFrame:
    """(track, l, r) of the files of one rate and length; track is the file's name without its ending.

    The r of a mono file is null; of more than two channels the first two count. Other rates and lengths need a call of their own.
    """
    name = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")
    right = F.get("channels", F.lit(1))
    chosen = files.filter((F.col("sr") == sr) & (F.col("frames") == frames))
    return chosen.select(name.alias("track"), F.get("channels", F.lit(0)).alias("l"), right.alias("r"))


def write(tracks: DataFrame, path: str, sr: int, bits: int = 24) -> DataFrame:
    """Writes (name, l, r) as files under ``path`` of any file system that Arrow knows; returns (name, file, bytes), lazily.

    A retried task writes the same file again under its final name only when it is whole.
    """

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                raw = encode(np.array([left, right]), sr, bits)
                with system.open_output_stream(f"{root}/.{name}.part") as f:
                    f.write(raw)
                system.move(f"{root}/.{name}.part", f"{root}/{name}.wav")
                yield pa.RecordBatch.from_pydict({"name": [name], "file": [f"{path}/{name}.wav"], "bytes": pa.array([len(raw)], pa.int64())})

    return tracks.select(F.col("name").cast("string"), "l", "r").mapInArrow(run, "name string, file string, bytes long")
