"""Recursions whose step depends on their state, over the chunks of long tracks.

One-pole smoothing with an attack and a release follows ``now -> goal + (now - goal) * rate``, the rate by whether the goal is
below. All chunks run at the same time from guessed starts, and note where they end and how much of a change of the start is
left there: the product of their rates. As each step is the lesser (or the greater) of two straight lines, a chunk's end is a
concave (or convex) function of its start, made of straight pieces; so the starts that follow from all these lines, one prefix
scan, are Newton's next guess, and the guesses reach the true starts after a few rounds. Only chunks whose start was wrong
run again. A step of numpy takes one sample of every chunk of a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import kernels as k
from .blocks import CHUNK, last_chunks, map_chunks, with_halo
from .scan import affine_starts

#: Starts that differ by less have met.
MEET = 1e-13
ROUNDS = 100


def ends(target: np.ndarray, start: np.ndarray, fall: float, rise: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each row ends, and what is left there of a small change of its start."""
    goals, now, fell = np.ascontiguousarray(target.T), start.astype(float), np.zeros(len(target), np.int64)
    for goal in goals:
        below = goal < now
        fell += below
        now = goal + (now - goal) * np.where(below, fall, rise)
    return now, fall**fell * rise ** (target.shape[-1] - fell)


def starts_of(chunks: DataFrame, keys: Sequence[str], first: float, fall: float, rise: float) -> DataFrame:
    """(keys..., c, start): the state before each chunk of goals ``x``, ``first`` before a track's first."""
    keep = [*keys, "c"]

    def run(x, start):
        end, slope = ends(x, start, fall, rise)
        return {"move": slope[:, None], "push": (end - slope * start)[:, None], "used": start}

    def lines(rows: DataFrame) -> DataFrame:
        return map_chunks(rows, ["x"], ["start"], {"move": "array<double>", "push": "array<double>", "used": "double"}, run, keep)

    guess = F.when(F.col("c") == 0, F.lit(float(first))).otherwise(F.col("x")[0])
    known = stored(lines(chunks.withColumn("start", guess)), "lines")
    for _ in range(ROUNDS):
        found = stored(affine_starts(known, keys, [first]).withColumn("start", F.col("start")[0]), "starts")
        wrong = known.join(found, keep).filter(F.abs(F.col("start") - F.col("used")) > MEET)
        again = wrong.select(*keep, "start")
        if again.isEmpty():
            return found
        known = stored(known.join(again, keep, "left_anti").unionByName(lines(chunks.join(again, keep))), "lines")
    raise RuntimeError("starts did not settle")


def envelope(chunks: DataFrame, keys: Sequence[str], first: float, fall: float, rise: float) -> DataFrame:
    """(keys..., c, x) smoothed, equal to ``kernels.envelope`` of each whole track."""
    found = starts_of(chunks, keys, first, fall, rise)
    keep = [*keys, "c"]
    return map_chunks(chunks.join(found, keep), ["x"], ["start"], {"x": "array<double>"}, lambda x, s: {"x": k.envelope(x, s, fall, rise)}, keep)


def limit(chunks: DataFrame, keys: Sequence[str], ceiling_db: float, sr: float) -> DataFrame:
    """(keys..., c, l, r) of stereo chunks under the linked look-ahead limiter; tracks below the ceiling stay as they are."""
    keep, ceiling, ahead = [*keys, "c"], 10 ** (ceiling_db / 20), 2 * max(1, round(sr * 0.004))
    own = map_chunks(chunks, ["l", "r"], [], {"x": "array<double>", "peak": "double"}, lambda l, r: _needed(l, r, ceiling), keep)
    needed = stored(own, "gains")
    hot = needed.groupBy(*keys).agg((F.max("peak") > ceiling).alias("hot"))

    def least(x, right):
        both = np.concatenate([x, right, np.repeat((right if right.shape[-1] else x)[:, -1:], ahead - right.shape[-1], axis=-1)], axis=-1)
        return {"x": _sliding_min(both, ahead + 1)}

    targets = stored(map_chunks(with_halo(needed, keys, after=ahead), ["x", "right"], [], {"x": "array<double>"}, least, keep), "targets")
    gains = envelope(targets, keys, 1.0, k.decay(1, sr, 0.0015), k.decay(1, sr, 0.090)).withColumnRenamed("x", "gain")
    met = chunks.select(*keep, "l", "r").join(gains, keep).join(stored(hot, "hot"), list(keys)).withColumn("hot", F.col("hot").cast("double"))
    out = lambda l, r, g, h: {n: np.where(h[:, None] > 0, np.clip(x * g, -ceiling, ceiling), x) for n, x in (("l", l), ("r", r))}
    return map_chunks(met, ["l", "r", "gain"], ["hot"], {"l": "array<double>", "r": "array<double>"}, out, keep)


def _needed(l: np.ndarray, r: np.ndarray, ceiling: float) -> dict[str, np.ndarray]:
    linked = np.maximum(np.abs(l), np.abs(r))
    return {"x": np.minimum(1.0, ceiling / (linked + 1e-12)), "peak": linked.max(axis=-1)}


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, by doubling stretches."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:, : out.shape[-1] - have], out[:, have:])
        have *= 2
    n = x.shape[-1] - width + 1
    return np.minimum(out[:, :n], out[:, width - have : width - have + n])


def compress(chunks: DataFrame, keys: Sequence[str], ratio: float, sr: float, size: int = CHUNK) -> DataFrame:
    """(keys..., c, x) under the soft-knee compressor of ``kernels.compress``; chunks hold whole blocks of 4 ms."""
    keep, block = [*keys, "c"], max(32, int(sr * 0.004))
    if size % block:
        raise ValueError(f"chunks of {size} samples don't hold whole blocks of {block}")
    if ratio <= 1.01:
        return chunks.select(*keep, "x")
    wanted = stored(map_chunks(chunks, ["x"], [], {"x": "array<double>"}, lambda x: {"x": -k.wanted_cut(x, block, np.full(len(x), ratio))}, keep), "cuts")
    smooth = stored(envelope(wanted, keys, 0.0, k.decay(block, sr, 0.018), k.decay(block, sr, 0.16)), "cuts")
    near = with_halo(smooth, keys, after=1, column="x").select(*keep, F.col("x").alias("gain"), "right")
    met = chunks.join(near, keep).join(stored(last_chunks(chunks, keys, size=size), "lengths"), list(keys))

    def gained(x, gain, right, length):
        # from each block's gain to the next one's, of this chunk or the next; a track's last block keeps its own
        after = np.concatenate([gain[:, 1:], right if right.shape[-1] else gain[:, -1:]], axis=-1)
        at = np.arange(x.shape[-1])
        mixed = gain[:, at // block] + (after - gain)[:, at // block] * (at % block / block)
        return {"x": np.where((length > block)[:, None], x * 10 ** (mixed / 20), x)}

    return map_chunks(met, ["x", "gain", "right"], ["length"], {"x": "array<double>"}, gained, keep)
