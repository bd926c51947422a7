"""Long series in bounded pieces: blocks of rows with the rows around them, and chunks of samples with their neighbours' ends.

Nothing here needs a whole track in one task. A block is for column expressions: rows near an edge are repeated in the next
block, so a window over (track, block) sees what a window over the track would. A chunk, (keys..., c, x), holds ``CHUNK``
samples of a track as one array, the last one the rest, and is for numpy over Arrow batches, whose bytes Spark bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples of one chunk.
CHUNK = 65_536
#: Samples, of all columns of an argument together, that one call of a function on chunks works on at most, unless a chunk has more.
CALL_SAMPLES = 500_000
#: Rows of one block.
BLOCK = 50_000
_TYPES = {"double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}


def haloed(rows: DataFrame, before: int = 0, after: int = 0, size: int = BLOCK, place: str = "n") -> DataFrame:
    """``rows`` with ``_block``; one that the ``before`` rows behind or the ``after`` rows ahead of another block reach into is in
    that block as well. Both are ``size`` at most."""
    own, at = F.floor(F.col(place) / size), F.col(place) % size
    near = [own]
    if before:
        near.append(F.when(at >= size - before, own + 1))
    if after:
        near.append(F.when((at < after) & (own > 0), own - 1))
    return rows.withColumn("_block", F.explode(F.array_compact(F.array(*near))) if before or after else own)


def own_rows(rows: DataFrame, size: int = BLOCK, place: str = "n") -> DataFrame:
    """Each row once, in its own block."""
    return rows.filter(F.col("_block") == F.floor(F.col(place) / size)).drop("_block")


def in_order(keys: Sequence[str], place: str = "n"):
    """The window of a block of ``haloed``."""
    return Window.partitionBy(*keys, "_block").orderBy(place)


def chunked(samples: DataFrame, keys: Sequence[str], size: int = CHUNK, columns: Sequence[str] = ("x",)) -> DataFrame:
    """(keys..., c, columns...) of a long form whose places start at 0 and have no gaps; one shuffle."""
    rows = samples.groupBy(*keys, F.floor(F.col("n") / size).alias("c")).agg(F.array_sort(F.collect_list(F.struct("n", *columns))).alias("s"))
    field = lambda name: F.transform("s", lambda v: v[name].cast("double")).alias(name)
    return rows.select(*keys, "c", *map(field, columns))


def samples_of(chunks: DataFrame, keys: Sequence[str], size: int = CHUNK, columns: Sequence[str] = ("x",)) -> DataFrame:
    """(keys..., n, columns...): the long form again."""
    each = chunks.select(*keys, "c", F.posexplode(F.arrays_zip(*columns)).alias("_i", "_s"))
    return each.select(*keys, (F.col("c") * size + F.col("_i")).alias("n"), *(F.col(f"_s.{name}").alias(name) for name in columns))


def with_halo(chunks: DataFrame, keys: Sequence[str], before: int = 0, after: int = 0, column: str = "x") -> DataFrame:
    """(keys..., c, column, left, right): the last ``before`` samples of the chunk before and the first ``after`` of the next one.

    Neither may be longer than a chunk; at a track's ends they are shorter or empty. One shuffle.
    """
    part = lambda c, side, x: F.struct(c.alias("c"), F.lit(side).alias("side"), x.alias("x"))
    x, c = F.col(column), F.col("c")
    parts = [part(c, 0, x)]
    if before:
        parts.append(F.when(F.size(x) >= before, part(c + 1, -1, F.slice(x, F.lit(-before), F.lit(before)))))
    if after:
        parts.append(F.when(c > 0, part(c - 1, 1, F.slice(x, F.lit(1), F.lit(after)))))
    each = chunks.select(*keys, F.explode(F.array_compact(F.array(*parts))).alias("p")).select(*keys, "p.*")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("x")))
    none = F.array().cast("array<double>")
    met = each.groupBy(*keys, "c").agg(side(0).alias(column), F.coalesce(side(-1), none).alias("left"), F.coalesce(side(1), none).alias("right"))
    return met.filter(F.col(column).isNotNull())


def last_chunks(chunks: DataFrame, keys: Sequence[str], column: str = "x", size: int = CHUNK) -> DataFrame:
    """(keys..., last, length): each track's last chunk and its number of samples."""
    top = chunks.groupBy(*keys).agg(F.max(F.struct("c", F.size(column).alias("n"))).alias("top"))
    return top.select(*keys, F.col("top.c").alias("last"), (F.col("top.c") * size + F.col("top.n")).alias("length"))


def _cells(values: Sequence, kind: str) -> pa.Array:
    """A column of numbers or of arrays."""
    if not kind.startswith("array"):
        return pa.array(values, _TYPES[kind])
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(values)), pa.float64()))


def map_chunks(chunks: DataFrame, arrays: Sequence[str], scalars: Sequence[str], out: dict[str, str], fn: Callable[..., dict[str, np.ndarray]], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the columns of ``out``, which ``fn`` computes from arrays of shape (chunks, samples) and from scalars.

    Chunks of an Arrow batch whose arrays are equally long are worked on together, up to ``CALL_SAMPLES`` at a time, and passed on
    at once. So beside the batch, whose bytes Spark bounds, a task holds what a few calls take, however many chunks it has.
    """
    read = chunks.select(*keep, *(F.col(c).alias(f"_{i}") for i, c in enumerate((*arrays, *scalars))))
    types = {f.name: f.dataType.simpleString() for f in read.schema}
    fixed = len(keep)

    def run(batches):
        for batch in batches:
            lists = [batch.column(fixed + i) for i in range(len(arrays))]
            flat = [c.values.to_numpy(zero_copy_only=False) for c in lists]
            starts = [c.offsets.to_numpy()[:-1] for c in lists]
            sizes = np.stack([np.diff(c.offsets.to_numpy()) for c in lists]) if lists else np.zeros((1, batch.num_rows), int)
            single = [batch.column(fixed + len(arrays) + i).to_numpy(zero_copy_only=False) for i in range(len(scalars))]
            for shape in np.unique(sizes, axis=1).T:
                same, step = np.flatnonzero((sizes == shape[:, None]).all(axis=0)), max(CALL_SAMPLES // max(int(shape.sum()), 1), 1)
                for rows in (same[i : i + step] for i in range(0, len(same), step)):
                    args = [x[s[rows, None] + np.arange(n)] for x, s, n in zip(flat, starts, shape)]
                    found = fn(*args, *(s[rows] for s in single))
                    kept = [c.take(pa.array(rows)) for c in batch.columns[:fixed]]
                    yield pa.RecordBatch.from_arrays([*kept, *(_cells(found[c], t) for c, t in out.items())], [*keep, *out])

    return read.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{c}` {t}" for c, t in out.items())]))
