"""Prefix scan over the chunks of a track: the state in which each chunk starts.

A chunk that changes a small state by an affine map, ``s -> move s + push``, is two small arrays, whatever its length. Maps are
composed in blocks, the blocks of a track in one short pass, and then the chunks of each block from its start. A block has
``SCAN`` chunks, so a track of 10^12 samples is 15,000 blocks; samples themselves never move.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks of one block of a scan.
SCAN = 1_024


def _steps(table: pa.Table, order: str, reverse: bool):
    by = np.argsort(table.column(order).to_numpy())
    by = by[::-1] if reverse else by
    pushes = np.array([table.column("push")[int(i)].as_py() for i in by])
    m = pushes.shape[1]
    moves = np.array([table.column("move")[int(i)].as_py() for i in by]).reshape(-1, m, m)
    return by, moves, pushes


def _keys_of(table: pa.Table, keys: Sequence[str], n: int) -> dict[str, pa.Array]:
    return {k: pa.array([table.column(k)[0].as_py()] * n, table.column(k).type) for k in keys}


def affine_starts(maps: DataFrame, keys: Sequence[str], first: Sequence[float], reverse: bool = False, block: int = SCAN) -> DataFrame:
    """(keys..., c, start) from (keys..., c, move, push): the state before each chunk, ``first`` before the first one.

    ``move`` is a square matrix by rows. With ``reverse`` the last chunk is the first one.
    """
    keys, first = list(keys), np.asarray(first, float)
    types = {f.name: f.dataType.simpleString() for f in maps.schema}
    text = "".join(f"`{k}` {types[k]}, " for k in keys)
    placed = maps.select(*keys, "c", "move", "push", F.floor(F.col("c") / block).alias("b"))

    def composed(table: pa.Table) -> pa.Table:
        _, moves, pushes = _steps(table, "c", reverse)
        move, push = np.eye(pushes.shape[1]), np.zeros(pushes.shape[1])
        for m, p in zip(moves, pushes):
            move, push = m @ move, m @ push + p
        return pa.table(_keys_of(table, keys, 1) | {"b": table.column("b").slice(0, 1), "move": pa.array([move.ravel()]), "push": pa.array([push])})

    def walked(order: str, begin: bool):
        def run(table: pa.Table) -> pa.Table:
            by, moves, pushes = _steps(table, order, reverse)
            now = np.asarray(table.column("begin")[0].as_py()) if begin else first
            starts = []
            for m, p in zip(moves, pushes):
                starts.append(now)
                now = m @ now + p
            return pa.table(_keys_of(table, keys, len(by)) | {order: table.column(order).take(pa.array(by)), "start": pa.array(starts, pa.list_(pa.float64()))})

        return run

    blocks = placed.groupBy(*keys, "b").applyInArrow(composed, text + "b long, move array<double>, push array<double>")
    begins = blocks.groupBy(*keys).applyInArrow(walked("b", False), text + "b long, start array<double>").withColumnRenamed("start", "begin")
    return placed.join(begins, [*keys, "b"]).groupBy(*keys, "b").applyInArrow(walked("c", True), text + "c long, start array<double>")
