"""Spectral features of packed tracks. The transform is numpy's over Arrow batches; see ``measures`` for what a record has of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, num


def power_spectrum(tracks: DataFrame, channels: list[str], name: str = "power") -> DataFrame:
    """Adds the power of each frequency bin, averaged over ``channels`` of equal length. Tracks may differ in length."""
    fields = tracks.schema
    at = [tracks.columns.index(c) for c in channels]

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in at)):
                cells = np.array(row, float)
                out.append((np.abs(np.fft.rfft(cells, axis=1)) ** 2).mean(axis=0) if cells.size else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*(f.name for f in fields), name])

    return tracks.mapInArrow(run, f"{schema_text(tracks)}, `{name}` array<double>")


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def separation(low: Column, mid: Column, high: Column) -> tuple[Column, Column]:
    """Score of how well three bands keep apart, 0 to 100, and their shares."""
    whole = F.greatest(low + mid + high, num(1e-9))
    a, b, c = low / whole, mid / whole, high / whole
    over = lambda v: F.greatest(v, num(0.0))
    masked = over(a - 0.42) * 1.4 + over(c - 0.38) + over(0.24 - b) * 1.6
    uneven = F.abs(a - 0.30) * 0.9 + F.abs(b - 0.42) * 0.7 + F.abs(c - 0.28) * 0.8
    return clip(100.0 - (masked + uneven) * 100.0, 0.0, 100.0), F.struct(a.alias("low"), b.alias("mid"), c.alias("high"))
