"""Recursive filters over the chunks of long tracks, in as many tasks as there are chunks.

A filter's state is all that a chunk needs of those before it. Each chunk is run from silence once; what it adds to the state,
with the power of the state's own motion, is an affine map. ``scan.affine_starts`` turns the maps into the state in which each
chunk starts, and the chunks are run again from there. Filtering back and forth does the same from the other end, the tracks'
ends continued by their point reflection, as in ``kernels``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import K_HIGHPASS_HZ
from ..session import stored
from . import kernels as k
from .blocks import CHUNK, last_chunks, map_chunks
from .scan import affine_starts

Coefficients = tuple[np.ndarray, np.ndarray]
_MAP = {"move": "array<double>", "push": "array<double>"}


def states_of(chain: Sequence[Coefficients]) -> int:
    return sum(len(b) - 1 for b, _ in chain)


def run_chain(chain: Sequence[Coefficients], x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters one after the other from a joint state; the output and the state after it."""
    ends, at = [], 0
    for c in chain:
        m = len(c[0]) - 1
        x, end = k.run_filter(c, x, start[..., at : at + m], end=True)
        ends.append(end)
        at += m
    return x, np.concatenate(ends, axis=-1)


def _affine(chain: Sequence[Coefficients], x: np.ndarray) -> dict[str, np.ndarray]:
    """How the state goes through each chunk: what becomes of each unit of it without samples, and of none with them."""
    m = states_of(chain)
    move = run_chain(chain, np.zeros((m, x.shape[-1])), np.eye(m))[1].T
    return {"move": np.broadcast_to(move.ravel(), (len(x), m * m)), "push": run_chain(chain, x, np.zeros((len(x), m)))[1]}


def filtered(chunks: DataFrame, keys: Sequence[str], *chain: Coefficients) -> DataFrame:
    """(keys..., c, x) after the filters of ``chain``, causal and from silence; ``chunks`` are read twice."""
    keep = [*keys, "c"]
    maps = map_chunks(chunks, ["x"], [], _MAP, lambda x: _affine(chain, x), keep)
    starts = stored(affine_starts(maps, keys, np.zeros(states_of(chain))), "states")
    return map_chunks(chunks.join(starts, keep), ["x", "start"], [], {"x": "array<double>"}, lambda x, s: {"x": run_chain(chain, x, s)[0]}, keep)


def edges(chunks: DataFrame, keys: Sequence[str], pad: int, size: int = CHUNK) -> DataFrame:
    """(keys..., last, length, pad, head, tail): each track's reflected continuations of ``pad`` samples, or of one less than it has."""
    last = stored(last_chunks(chunks, keys, size=size), "lengths")
    x, near = F.col("x"), F.col("c") >= F.col("last") - 1
    ends = chunks.join(last, list(keys)).filter((F.col("c") == 0) | near)
    some = ends.groupBy(*keys, "last", "length").agg(
        F.max(F.when(F.col("c") == 0, F.slice(x, 1, pad + 1))).alias("head"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(near, F.struct("c", x.alias("x"))))), lambda p: p["x"])).alias("tail"),
    )
    own = F.least(F.lit(pad), F.col("length") - 1).cast("int")
    head, tail = F.col("head"), F.reverse("tail")
    turned = lambda first, rest: F.transform(rest, lambda v: 2.0 * first - v)
    return some.select(
        *keys, "last", "length", own.alias("pad"),
        F.reverse(turned(head[0], F.slice(head, F.lit(2), own))).alias("head"), turned(tail[0], F.slice(tail, F.lit(2), own)).alias("tail"),
    )


def zero_phase(chunks: DataFrame, keys: Sequence[str], coefficients: Coefficients, size: int = CHUNK) -> DataFrame:
    """(keys..., c, x) forward and back, equal to ``kernels.zero_phase`` of each whole track.

    A chunk must be longer than the continuation, 6 samples for each coefficient. A track of one sample is filtered once.
    """
    keep, pad = [*keys, "c"], 6 * len(coefficients[0])
    if pad >= size:
        raise ValueError(f"chunks of {size} samples are too short for continuations of {pad}")
    found = stored(edges(chunks, keys, pad, size), "edges")
    met = chunks.join(found, list(keys))
    none = F.array().cast("array<double>")
    head, tail = F.when(F.col("c") == 0, F.col("head")).otherwise(none), F.when(F.col("c") == F.col("last"), F.col("tail")).otherwise(none)
    padded = met.select(*keep, F.concat(head, "x", tail).alias("x"), F.size(head).cast("long").alias("skip"), F.size(F.col("x")).cast("long").alias("take"), F.col("pad").cast("long").alias("pad"))
    zero = np.zeros(len(coefficients[0]) - 1)
    maps = map_chunks(padded, ["x"], [], _MAP, lambda x: _affine([coefficients], x), keep)
    starts = stored(affine_starts(maps, keys, zero), "states")

    def forth(x, s):
        y = k.run_filter(coefficients, x, start=s)
        return {"y": y} | _affine([coefficients], y[:, ::-1])

    forward = stored(map_chunks(padded.join(starts, keep), ["x", "start"], [], {"y": "array<double>"} | _MAP, forth, [*keep, "skip", "take", "pad"]), "forward")
    ends = stored(affine_starts(forward, keys, zero, reverse=True), "states")

    def back(y, s, skip, take, pad):
        out, both = [], k.run_filter(coefficients, y[:, ::-1], start=s)[:, ::-1]
        for row, once, i, n, p in zip(both, y, skip, take, pad):
            out.append((row if p else once)[i : i + n])
        return {"x": out}

    return map_chunks(forward.join(ends, keep), ["y", "start"], ["skip", "take", "pad"], {"x": "array<double>"}, back, keep)


def _held(chunks: DataFrame, done: DataFrame, keys: Sequence[str], least: int, size: int, otherwise: str) -> DataFrame:
    """``done``, and where a track has less than ``least`` samples its chunk as it was, or zeros; such a track is one chunk."""
    if size < least:
        raise ValueError(f"chunks of {size} samples are shorter than {least}")
    short = lambda df: (F.col("c") == 0) & (F.size("x") < least)
    kept = chunks.filter(short(chunks)).select(*keys, "c", F.col("x") if otherwise == "same" else F.transform("x", lambda v: v * 0.0).alias("x"))
    return done.filter(~short(done)).unionByName(kept)


def low_pass(chunks: DataFrame, keys: Sequence[str], sr: float, hz: float, size: int = CHUNK) -> DataFrame:
    done = zero_phase(chunks, keys, k.butterworth(sr, None, float(np.clip(hz, 20.0, sr * 0.45))), size)
    return _held(chunks, done, keys, 16, size, "zero")


def high_pass(chunks: DataFrame, keys: Sequence[str], sr: float, hz: float, size: int = CHUNK) -> DataFrame:
    """Nothing to do up to 20 Hz."""
    if hz <= 20.0:
        return chunks.select(*keys, "c", "x")
    return _held(chunks, zero_phase(chunks, keys, k.butterworth(sr, float(min(hz, sr * 0.45)), None), size), keys, 8, size, "same")


def band_pass(chunks: DataFrame, keys: Sequence[str], sr: float, low: float, high: float, size: int = CHUNK) -> DataFrame:
    low = float(np.clip(low, 20.0, sr * 0.45))
    high = float(np.clip(high, low + 50.0, max(low + 50.0, sr * 0.48)))
    if high <= low + 20.0 or high >= sr / 2:
        return chunks.select(*keys, "c", F.transform("x", lambda v: v * 0.0).alias("x"))
    return _held(chunks, zero_phase(chunks, keys, k.butterworth(sr, low, high), size), keys, 16, size, "zero")


def k_weighted(chunks: DataFrame, keys: Sequence[str], sr: float) -> DataFrame:
    """The loudness weighting at any rate: a shelf, then a high-pass."""
    return filtered(chunks, keys, k.shelf(sr), k.butterworth(sr, float(np.clip(K_HIGHPASS_HZ, 10.0, sr * 0.45)), None))
