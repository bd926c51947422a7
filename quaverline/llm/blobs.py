"""Hashes on the move as byte strings.

An operator that brings equal hashes of all documents together would send a row for each; here a map task sends one row
for each bucket of hash values and batch, with the hashes and the ids of their owners inside. Sorting and counting
within a bucket is numpy's, dealing the buckets to tasks is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import binary

SCHEMA = "bucket int, hashes binary, owners binary, sizes binary"
ARROW = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary())])
#: Low bytes of a hash that are sent; the bucket stands for the high ones.
WIDTH = 7


def spread(ids: np.ndarray, n: int) -> np.ndarray:
    """A group from 0 to n - 1 for each id."""
    with np.errstate(over="ignore"):
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((hashes >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


def pack(hashes: np.ndarray, owners: np.ndarray, n: int, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, bytes, bytes, bytes]]:
    """For ascending ``hashes``: bucket, order of its entries, hashes, owners and how many hashes each owner has."""
    for b, lo, hi in stretches(buckets(hashes, n)):
        to = lo + np.argsort(owners[lo:hi], kind="stable")
        ids, sizes = np.unique(owners[lo:hi], return_counts=True)
        yield b, to, binary(hashes[to].view(np.uint8).reshape(-1, 8)[:, :width]), binary(ids), binary(sizes.astype(np.uint32))


def unpack(hashes: list[bytes], owners: list[bytes], sizes: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (without their high byte) and owners in the order sent."""
    low = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, width)
    h = np.zeros((len(low), 8), np.uint8)
    h[:, :width] = low
    ids = np.repeat(np.frombuffer(b"".join(owners), np.int64), np.frombuffer(b"".join(sizes), np.uint32))
    return h.view(np.uint64).ravel(), ids


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def stretches(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value with where its run starts and ends; values that don't occur cost nothing."""
    starts = runs(sorted_values)
    ends = np.append(starts[1:], len(sorted_values))
    return zip(sorted_values[starts].tolist(), starts.tolist(), ends.tolist())
