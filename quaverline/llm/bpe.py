"""Byte-level BPE encoding and decoding with a local rank file.

tiktoken encodes. Long texts are first cut at safe boundaries: before white space that follows something else. No match
of the split pattern holds white space behind another character, so a cut there never parts a match, and the pieces'
ids joined are the ids of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Characters after which a text is cut at the next safe boundary.
CHUNK = 20_000
_BOUNDARY = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """One encoder for each worker process; the rank file lies on every machine."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """``text`` in pieces of at least ``size`` characters that end at safe boundaries; in one if it has none."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _BOUNDARY.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def encode(text: str, path: str, pattern: str) -> list[int]:
    enc = encoding(path, pattern)
    if len(text) <= CHUNK:
        return enc.encode_ordinary(text)
    return [i for piece in chunks(text) for i in enc.encode_ordinary(piece)]


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """Raw bytes: ids that end within a character decode as well."""
    return encoding(path, pattern).decode_bytes(ids)


def encode_table(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """(doc_id, keep..., ids array<int>) of whole texts, one row for each row; a null text counts as empty."""
    fields = docs.select(*keep).schema

    def run(batches):
        for batch in batches:
            ids = [encode(t or "", path, pattern) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", *(f.name for f in fields), "ids"])

    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids array<int>"])
    return texts(docs, *keep).mapInArrow(run, schema)


def decode_table(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of a table of ids."""

    def run(batches):
        for batch in batches:
            raw = [decode(i or [], path, pattern) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, *keep: str) -> DataFrame:
    """Encodes every whole text and decodes the ids again, in one pass without a shuffle.

    (doc_id, keep..., n_tokens, ids_sha256, decoded_sha256): digests of the decimal ids joined by commas and of the
    decoded bytes. Null and empty texts have no ids; repeated rows give repeated rows; an empty table gives no rows.
    """
    fields = docs.select(*keep).schema

    def run(batches):
        enc = encoding(path, pattern)
        digits = [str(i).encode() for i in range(enc.n_vocab)]
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text or "", path, pattern)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(b",".join([digits[i] for i in ids])).hexdigest())
                of_bytes.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
            columns = [batch.column(0), *batch.columns[2:], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f.name for f in fields), "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    return texts(docs, *map(F.col, keep)).mapInArrow(run, schema)
