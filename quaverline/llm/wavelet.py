"""Token ids as wavelet matrices: one file per shard, succinct bit-planes with rank and select.

A shard holds whole documents in ascending order. Its ids are stored as bit-planes from the highest bit down; each plane
is stably parted by its bit before the next. Planes are cut into chunks that are compressed one by one; a directory holds
each chunk's place in the file and the ones before it, so rank is a lookup and a count within one chunk. The file supports
access, counting and the k-th occurrence of an id without any other copy of the ids, reading only the chunks it needs.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, texts

MAGIC = b"QWM2"
#: Bytes of one chunk of a bit-plane.
CHUNK = 8_192
#: Ids of one shard, about; a shard ends with a document.
SHARD_TOKENS = 1_000_000
#: Chunks that an open file keeps at hand.
OPEN_CHUNKS = 256


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


class WaveletMatrix:
    """Bit-planes of a sequence of ids below ``2 ** levels``; ``chunk(level, k)`` gives the k-th chunk of a plane and
    ``ones[level]`` how many ones are before each chunk, and in all."""

    def __init__(self, n: int, levels: int, zeros: list[int], ones: np.ndarray, chunk: Callable[[int, int], np.ndarray]):
        self.n, self.levels, self.zeros, self.ones, self.chunk = n, levels, zeros, ones, chunk

    @classmethod
    def build(cls, ids: np.ndarray, levels: int = 16) -> WaveletMatrix:
        x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes = [], []
        for k in range(levels - 1, -1, -1):
            bit = (x & x.dtype.type(1 << k)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low = np.compress(~bit, x)
            zeros.append(len(low))
            if k:
                x = np.concatenate([low, np.compress(bit, x)])
        count = -(-len(planes[0]) // CHUNK)
        ones = np.zeros((levels, count + 1), np.int64)
        for level, p in enumerate(planes):
            if count:
                ones[level, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(p), np.arange(count) * CHUNK, dtype=np.int64))
        return cls(len(ids), levels, zeros, ones, lambda level, k: planes[level][k * CHUNK : (k + 1) * CHUNK])

    def bit(self, level: int, i: int) -> int:
        at = i >> 3
        return int(self.chunk(level, at // CHUNK)[at % CHUNK] >> (i & 7)) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones before position i."""
        k, rest = divmod(i, 8 * CHUNK)
        if not rest:
            return int(self.ones[level, k])
        bits, whole = self.chunk(level, k), rest >> 3
        ones = int(self.ones[level, k]) + int(np.bitwise_count(bits[:whole]).sum())
        return ones + (int(bits[whole] & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else 0)

    def select(self, level: int, one: int, k: int) -> int:
        """Position of the k-th (from 0) bit that equals ``one``."""
        ones = self.ones[level]
        before = ones if one else np.minimum(np.arange(len(ones)) * 8 * CHUNK, self.n) - ones
        at = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.chunk(level, at), bitorder="little")
        return at * 8 * CHUNK + int(np.flatnonzero(bits == one)[k - int(before[at])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            b = self.bit(level, i)
            value = value << 1 | b
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if b else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the ids equal to ``token`` at positions lo to hi - 1 stand after the last plane."""
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            if lo >= hi:
                break
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` at positions lo to hi - 1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest bit up, each by one stable merge."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            plane = np.concatenate([np.zeros(0, np.uint8), *(self.chunk(level, k) for k in range(self.ones.shape[1] - 1))])
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            merged = np.empty(self.n, kind)
            merged[np.flatnonzero(~bit)] = out[:z]
            merged[np.flatnonzero(bit)] = out[z:] | kind(1 << (self.levels - 1 - level))
            out = merged
        return out

    def to_bytes(self, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
        """The file: magic, JSON header with its length, document table, directory (ones before and end of each chunk,
        plane by plane), chunks. A chunk that compression doesn't make smaller stands as it is."""
        head = json.dumps({"n": self.n, "levels": self.levels, "docs": len(doc_ids), "zeros": self.zeros, "chunk": CHUNK}).encode()
        codec, parts = _codec(), []
        for level in range(self.levels):
            for k in range(self.ones.shape[1] - 1):
                raw = self.chunk(level, k).tobytes()
                packed = codec.compress(raw, asbytes=True)
                parts.append(packed if len(packed) < len(raw) else raw)
        ends = np.cumsum([len(p) for p in parts], dtype="<i8")
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), self.ones.astype("<i8").tobytes(), ends.tobytes(), *parts])

    @classmethod
    def open(cls, read: Callable[[int, int], bytes]) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
        """The matrix, document ids and lengths of a file of which ``read(offset, size)`` gives bytes; chunks are read when needed."""
        start = read(0, 8)
        if start[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = struct.unpack_from("<I", start, 4)[0]
        head = json.loads(read(8, size))
        n, levels, docs, step = head["n"], head["levels"], head["docs"], head["chunk"]
        count = -(-n // (8 * step))
        words = np.frombuffer(read(8 + size, 8 * (2 * docs + levels * (2 * count + 1))), "<i8")
        doc_ids, lengths = words[:docs], words[docs : 2 * docs]
        ones = words[2 * docs : 2 * docs + levels * (count + 1)].reshape(levels, count + 1)
        ends = np.append(0, words[2 * docs + levels * (count + 1) :])
        first, last, codec = 8 + size + 8 * len(words), -(-n // 8) - (count - 1) * step, _codec()

        @lru_cache(maxsize=OPEN_CHUNKS)
        def chunk(level: int, k: int) -> np.ndarray:
            i, whole = level * count + k, step if k < count - 1 else last
            raw = read(first + int(ends[i]), int(ends[i + 1] - ends[i]))
            return np.frombuffer(raw if len(raw) == whole else codec.decompress(raw, decompressed_size=whole, asbytes=True), np.uint8)

        return cls(n, levels, head["zeros"], ones, chunk), doc_ids, lengths

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
        return cls.open(lambda at, size: raw[at : at + size])


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The byte-level tokenizer's split of texts within Latin-1, the commonest case first: no other starts like it.
_PIECE = re.compile(f" [{_LETTER}]+|[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+")
#: Characters that libraries may or may not take for white space.
_DOUBTFUL = b"\x1c\x1d\x1e\x1f\x85\xa0"
#: Pieces after which a worker process starts a new memo. It keeps the one before, from which pieces that occur again are
#: taken over, so frequent ones stay.
MEMO_PIECES = 300_000


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else one from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Ids of the pieces of the tokenizer's split, as bytes. The tokenizer's own model encodes a piece it hasn't met."""

    def __init__(self, path: str):
        super().__init__()
        tok = tokenizer(path)
        self.model, self.before = tok.model, {}
        self.raw = [i.to_bytes(4, "little") for i in range(tok.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            letters = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_byte_letters())
            raw = self.raw
            ids = b"".join([raw[t.id] for t in self.model.tokenize(letters)])
        self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > MEMO_PIECES:
            self.before = dict(self)
            self.clear()


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    """One for each worker process."""
    return Pieces(path)


def _simple(text: str) -> bool:
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(raw.translate(None, _DOUBTFUL)) == len(raw)


def encode_all(docs: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts as the tokenizers library gives them, special tokens taken as text.

    The pieces of its split don't influence each other and most recur, so each is encoded once and looked up from then on.
    A text with characters past Latin-1 goes through the library's own split.
    """
    memo, out = _pieces(path), []
    for text in docs:
        if _simple(text):
            memo.trim()
            out.append(np.frombuffer(b"".join(map(memo.__getitem__, _PIECE.findall(text))), np.uint32))
        else:
            out.append(np.array(tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
    return out


def _write(path: str, raw: bytes) -> None:
    """Whole or not at all: a retried task writes the same bytes under the same name."""
    import uuid

    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    temp = f"{os.path.dirname(name)}/_{uuid.uuid4().hex}"
    with system.open_output_stream(temp) as f:
        f.write(raw)
    system.move(temp, name)


def _read(path: str) -> bytes:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as f:
        return f.read()


@contextmanager
def opened(path: str) -> Iterator[tuple[WaveletMatrix, np.ndarray, np.ndarray]]:
    """Matrix, document ids and lengths of one file, which is read by offset as far as they are used."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        yield WaveletMatrix.open(lambda at, size: f.read_at(size, at))


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encodes whole texts and writes shards in ascending doc_id order; returns (part, shard, file, docs, tokens).

    The tokenizer takes the strings of special tokens in a text as text. A null text is empty and has the end id alone. Rows with equal ids keep no set order among themselves; a null id comes first.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    system, root = fs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)
    n = partitions or 2 * shuffle_partitions(spark)
    ordered = texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    levels = max(1, (tokenizer(tokenizer_path).get_vocab_size() - 1).bit_length())

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, sizes, parts, held, shard = [], [], [], 0, 0

        def flush():
            nonlocal ids, sizes, parts, held, shard
            raw = WaveletMatrix.build(np.concatenate(parts), levels).to_bytes(np.array(ids, np.int64), np.array(sizes, np.int64))
            file = f"{path}/shard-{part:07d}-{shard:05d}.qwm"
            _write(file, raw)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [file], "docs": [len(ids)], "tokens": [held]})
            ids, sizes, parts, held, shard = [], [], [], 0, shard + 1
            return row

        for batch in batches:
            names, whole = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(names), 256):
                for doc_id, x in zip(names[at : at + 256], encode_all([t or "" for t in whole[at : at + 256]], tokenizer_path)):
                    ids.append(np.iinfo(np.int64).min if doc_id is None else doc_id)
                    sizes.append(len(x) + 1)
                    parts += [x, np.array([end_id], np.uint32)]
                    held += len(x) + 1
                    if held >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    return ordered.mapInArrow(run, "part int, shard int, file string, docs long, tokens long")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a written manifest.

    ``start`` counts the ids of all documents before. Only the totals of the partitions, one row for each, reach the driver.
    """
    totals = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("tokens")).collect())
    starts, at = [], 0
    for part, tokens in totals:
        starts.append((part, at))
        at += tokens
    spark = shards.sparkSession
    bases = spark.createDataFrame(starts or [(-1, 0)], "part int, base long")
    files = shards.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("shard", "file"))).alias("files")).join(bases, "part")
    none = np.iinfo(np.int64).min

    def run(batches):
        for batch in batches:
            for files, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in files:
                    matrix, doc_ids, lengths = WaveletMatrix.from_bytes(_read(f["file"]))
                    ids = matrix.decode().astype("<u4")
                    ends = np.cumsum(lengths)
                    begins = ends - lengths
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if i == none else i for i in doc_ids.tolist()], pa.int64()),
                            "start": pa.array(begins + base),
                            "n_tokens": pa.array(lengths),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )
                    base += matrix.n

    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return files.select("files", "base").repartition(max(1, len(starts)), F.xxhash64("base")).mapInArrow(run, out)


def token_files(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Writes the shards of ``docs`` to the shared folder and describes each document from what is read back.

    An empty table gives no rows; repeated rows are stored and described as often as they occur.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "wavelet")
    manifest = write_shards(docs, tokenizer_path, path, **how)
    table = f"{path}-manifest"
    manifest.write.parquet(table)
    return read_shards(spark.read.schema(manifest.schema).parquet(table))


def _asked(tokens: DataFrame) -> list[int]:
    """Distinct ids asked for; there are no more than the vocabulary has."""
    return sorted(r[0] for r in tokens.select(F.col("token").cast("long").alias("token")).filter("token >= 0").distinct().collect())


def count_tokens(shards: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, count): occurrences of each distinct id of ``tokens`` (column token) in the files of a written manifest.

    Each file is asked by rank, without decoding. Null and negative ids don't count, an id that no file holds has 0.
    """
    spark = shards.sparkSession
    wanted = spark.sparkContext.broadcast(_asked(tokens))

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with opened(file) as (matrix, _, _):
                    yield pa.RecordBatch.from_pydict({"token": pa.array(wanted.value, pa.int64()), "count": pa.array([matrix.count(t) for t in wanted.value], pa.int64())})

    found = shards.select("file").mapInArrow(run, "token long, count long")
    none = spark.createDataFrame([(t, 0) for t in wanted.value], "token long, count long")
    return found.unionAll(none).groupBy("token").agg(F.sum("count").alias("count"))


def find_tokens(shards: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, doc_id, place): every occurrence of the ids of ``tokens`` (column token), by select; ``place`` counts from a
    document's start. Null and negative ids, and ids that no file holds, give no rows."""
    wanted = shards.sparkSession.sparkContext.broadcast(_asked(tokens))
    none = np.iinfo(np.int64).min

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with opened(file) as (matrix, doc_ids, lengths):
                    ends = np.cumsum(lengths)
                    for t in wanted.value:
                        count = matrix.count(t)
                        for at in range(0, count, 4_096):
                            places = np.array([matrix.locate(t, k) for k in range(at, min(at + 4_096, count))])
                            doc = np.searchsorted(ends, places, side="right")
                            ids = [None if i == none else i for i in doc_ids[doc].tolist()]
                            yield pa.RecordBatch.from_pydict({"token": pa.array([t] * len(ids), pa.int64()), "doc_id": pa.array(ids, pa.int64()), "place": places - (ends - lengths)[doc]})

    return shards.select("file").mapInArrow(run, "token long, doc_id long, place long")
