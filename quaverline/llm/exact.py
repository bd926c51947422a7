"""Exact dedup in two passes over a Bloom filter, so that only rows whose hash may repeat are shuffled.

A text counts without its white space; its SHA-256 stands for it from the first scan on. In the first pass map tasks send
the leading eight bytes of the digests as byte strings, dealt into buckets of hash values. Each bucket runs its hashes
through one Bloom filter of what was seen; those that it knows already go into a second filter, of what may repeat. In the
second pass every row asks the second filter: rows that it doesn't know are the only ones of their text and pass straight
through, without a shuffle. The others are grouped by their digest, which is exact: the filters' errors only cost a row's trip.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import runs
from .common import binary, joined_back, shuffle_partitions, stored, texts

#: Hashes of one bucket, about: its filter of seen ones takes 12 bits for each.
BUCKET_HASHES = 2_000_000
BITS_PER_HASH = 12
PROBES = 5
#: Hashes that a map task folds at a time.
BATCH_HASHES = 500_000
#: Most bytes of filters that are broadcast. 64 MB know 44 million repeated hashes; beyond that all rows are grouped by digest,
#: as 60 bytes a row on the move are then less than a scan for each 64 MB.
FILTER_BYTES = 64 << 20


def squeezed(text: str | None) -> bytes:
    """UTF-8 without the six characters ``[\\x20\\x09-\\x0D]``, at which ``bytes.split`` parts."""
    return b"".join(text.encode("utf-8", "surrogatepass").split()) if text else b""


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, digest) of each row: code points of the original text, SHA-256 of the squeezed one."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            digests = pa.array([hashlib.sha256(squeezed(t)).digest() for t in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or "") for t in rows], pa.int64()), digests], ["doc_id", "n_points", "digest"])

    return texts(docs).mapInArrow(run, "doc_id long, n_points long, digest binary")


def leading(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest as a number."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)
    return np.ascontiguousarray(raw[:, :8]).view(">u8").ravel().astype(np.uint64)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Ascending with the hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def places(h: np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits of a filter of ``bits`` bits that each hash sets, one probe after the other."""
    with np.errstate(over="ignore"):
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        at, step = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(PROBES):
        yield ((at + np.uint64(i) * step) % np.uint64(bits) if np.isscalar(bits) else (at + np.uint64(i) * step) % bits).astype(np.int64)


def knows(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for p in places(h, 8 * len(bits)):
        found &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return found


def learn(bits: np.ndarray, h: np.ndarray) -> None:
    for p in places(h, 8 * len(bits)):
        np.bitwise_or.at(bits, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))


def filter_for(n: int) -> np.ndarray:
    return np.zeros(max(8, -(-n * BITS_PER_HASH // 8)), np.uint8)


def repeat_filters(rows: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, bits): a filter of the hashes that more than one row may have, for each bucket that has any."""

    def send(batches):
        held: list[np.ndarray] = []
        size = 0

        def fold() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            bucket = bucket_of(h, n_buckets)
            starts = runs(bucket)
            ends = np.append(starts[1:], len(h))
            cut = list(zip(starts.tolist(), ends.tolist()))
            out = {"bucket": pa.array(bucket[starts], pa.int32()), "hashes": [binary(h[a:b]) for a, b in cut], "again": [binary(np.packbits(times[a:b] > 1)) for a, b in cut]}
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            if batch.num_rows:
                held.append(leading(batch.column(0)))
                size += batch.num_rows
            if size >= BATCH_HASHES:
                yield fold()
                held.clear()
                size = 0
        if held:
            yield fold()

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        seen, repeated = filter_for(sum(map(len, parts))), []
        for h, again in zip(parts, table.column("again").to_pylist()):
            known = knows(seen, h) | np.unpackbits(np.frombuffer(again, np.uint8), count=len(h)).astype(bool)
            repeated.append(h[known])
            learn(seen, h)
        hashes = np.unique(np.concatenate(repeated))
        bits = filter_for(len(hashes))
        learn(bits, hashes)
        some = [binary(bits)] if len(hashes) else []
        return pa.table({"bucket": table.column("bucket").slice(0, len(some)), "bits": pa.array(some, pa.binary())})

    sent = rows.select("digest").mapInArrow(send, "bucket int, hashes binary, again binary")
    return sent.groupBy("bucket").applyInArrow(meet, "bucket int, bits binary")


def marked(rows: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """``rows`` with ``maybe``: whether the filters know the row's hash. Their size has been checked."""
    found = filters.select("bucket", "bits").collect()
    sizes = np.zeros(n_buckets, np.int64)
    for b, bits in found:
        sizes[b] = len(bits)
    by_bucket = sorted((b, bytes(bits)) for b, bits in found)
    shared = rows.sparkSession.sparkContext.broadcast((sizes, np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(x for _, x in by_bucket), np.uint8)))

    def run(batches):
        sizes, starts, bits = shared.value
        for batch in batches:
            known = np.zeros(batch.num_rows, bool)
            if batch.num_rows:
                h = leading(batch.column("digest"))
                bucket = bucket_of(h, n_buckets)
                at = np.flatnonzero(sizes[bucket])
                bucket, h, asked = bucket[at], h[at], np.ones(len(at), bool)
                for p in places(h, (8 * sizes[bucket]).astype(np.uint64)):
                    asked &= (bits[starts[bucket] + (p >> 3)] >> (p & 7).astype(np.uint8) & 1).astype(bool)
                known[at] = asked
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known)], ["doc_id", "n_points", "digest", "maybe"])

    return rows.select("doc_id", "n_points", "digest").mapInArrow(run, "doc_id long, n_points long, digest binary, maybe boolean")


def exact_duplicates(docs: DataFrame, filter_bytes: int = FILTER_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row; equal texts are those that agree without white space.

    Of a group the row with the most code points in its original text stays, then the one with the smallest doc_id. Null and
    empty texts and those of white space alone are equal. A row without a doc_id comes after those that have one, and so stays
    only where a group has no other of its length; keep_id is then null. Repeated rows of the doc_id that stays, as long as it,
    stay with it, since nothing tells them apart; each counts in group_size. An empty table gives no rows.
    """
    rows = stored(signatures(docs), "signatures")
    n_buckets = max(shuffle_partitions(docs.sparkSession), -(-rows.count() // bucket_hashes))
    filters = stored(repeat_filters(rows, n_buckets), "filters")
    size = filters.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    if size <= filter_bytes:
        asked = stored(marked(rows, filters, n_buckets), "asked")
        alone, suspects = asked.filter(~F.col("maybe")), asked.filter("maybe").drop("maybe")
    else:
        alone, suspects = None, rows
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("turned")))  # the smallest doc_id is the largest turned
    groups = suspects.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))
    groups = groups.select("digest", "group_size", F.col("best.n_points").alias("most"), F.bitwise_not("best.turned").alias("keep_id"))
    found = joined_back(suspects, stored(groups, "groups"), "digest", "group_size")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("most"))
    out = found.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "digest")
    if alone is not None:
        out = out.unionAll(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever else those are named.

    Rows that share a doc_id stay or go together: they stay if one of them does. Rows without a doc_id stay, as nothing can
    name them.
    """
    found = exact_duplicates(docs, **how).filter("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("_kept")).filter("not _kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
