"""Level, loudness, stereo and frame features.

Functions of samples in the long form are aggregates with partial aggregation, windows over blocks of a track, and exact
selection; no track is in one task. Those of the packed form are array expressions inside one narrow stage.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, decibels, mean, num, peak, rms
from ..session import stored
from .blocks import BLOCK, haloed, in_order, own_rows
from .selection import SMALL, order_statistics, percentiles


def level_stats(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, level, peak, crest, DC offset, clipping and silence of each group; one partial aggregate."""
    x = F.col("x")
    share = lambda rule: F.avg(F.when(rule, num(1.0)).otherwise(num(0.0)))
    stats = samples.groupBy(*keys).agg(
        F.count("*").alias("cnt"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.max(F.abs(x)).alias("peak"),
        F.avg(x).alias("dc_offset"),
        share(F.abs(x) >= 0.98).alias("clipping_ratio"),
        share(F.abs(x) <= 10 ** (-50 / 20)).alias("silence_ratio"),
    )
    level = F.greatest(F.col("rms"), num(1e-9))
    return stats.withColumns({"peak_db": decibels(F.col("peak")), "crest_db": decibels(F.col("peak") / level), "lufs": decibels(F.col("rms")) - 0.691})


def crest(values: Column) -> Column:
    return decibels(peak(values) / F.greatest(rms(values), num(1e-9)))


def stereo_image(left: Column, right: Column) -> dict[str, Column]:
    """Width and uncentred correlation of two channels, cut to the shorter."""
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    level = lambda f: F.sqrt(mean(both, lambda p: f(p) * f(p)))
    mid = level(lambda p: (p["a"] + p["b"]) * 0.5) + 1e-9
    side = level(lambda p: (p["a"] - p["b"]) * 0.5)
    cross = mean(both, lambda p: p["a"] * p["b"]) / ((level(lambda p: p["a"]) + 1e-9) * (level(lambda p: p["b"]) + 1e-9))
    return {"stereo_width": clip(side / mid, 0.0, 4.0), "phase_correlation": clip(cross, -1.0, 1.0)}


def mid_side(left: Column, right: Column) -> tuple[Column, Column]:
    return F.zip_with(left, right, lambda a, b: (a + b) * 0.5), F.zip_with(left, right, lambda a, b: (a - b) * 0.5)


def left_right(mid: Column, side: Column) -> tuple[Column, Column]:
    return F.zip_with(mid, side, lambda m, s: m + s), F.zip_with(mid, side, lambda m, s: m - s)


def loudness(energy: Column) -> Column:
    return -0.691 + 10.0 * F.log10(F.greatest(energy, num(1e-18)))


def framed(samples: DataFrame, keys: Sequence[str], frame: int, hop: int) -> DataFrame:
    """(keys..., f, e): the mean of squares of each whole frame of ``frame`` samples every ``hop``; ``n`` is the place in the track.

    Samples are summed by panes of the two lengths' common divisor, one partial aggregate; a frame is a sum over the panes from
    its first one, in a window over blocks of panes. So what moves are panes, and no sample moves for each frame that holds it.
    """
    pane = math.gcd(frame, hop)
    ahead = frame // pane
    size = max(BLOCK, ahead)
    panes = samples.groupBy(*keys, F.floor(F.col("n") / pane).alias("n")).agg(F.count("*").alias("cnt"), F.sum(F.col("x") * F.col("x")).alias("e"))
    over = in_order(keys).rowsBetween(0, ahead - 1)
    summed = haloed(panes, after=ahead - 1, size=size).withColumns({"cnt": F.sum("cnt").over(over), "e": F.sum("e").over(over)})
    whole = own_rows(summed, size).filter((F.col("n") % (hop // pane) == 0) & (F.col("cnt") == frame))
    return whole.select(*keys, F.floor(F.col("n") / (hop // pane)).alias("f"), (F.col("e") / frame).alias("e"))


def gated_loudness(samples: DataFrame, keys: Sequence[str], block: int, hop: int) -> DataFrame:
    """Integrated loudness of long series: (keys..., blocks, lufs). Both gates are aggregates over the blocks."""
    loud = framed(samples, keys, block, hop).filter(loudness(F.col("e")) > -70.0)
    gates = loud.groupBy(*keys).agg(F.count("*").alias("blocks"), F.avg("e").alias("every"))
    passed = F.avg(F.when(loudness(F.col("e")) > loudness(F.col("every")) - 10.0, F.col("e")))
    return loud.join(gates, list(keys)).groupBy(*keys, "blocks").agg(loudness(F.coalesce(passed, F.avg("e"))).alias("lufs"))


def framed_rms(samples: DataFrame, keys: Sequence[str], frame: int, hop: int) -> DataFrame:
    """(keys..., f, rms) of whole frames of ``frame`` samples every ``hop``."""
    return framed(samples, keys, frame, hop).select(*keys, "f", F.sqrt("e").alias("rms"))


def noise_floor(samples: DataFrame, keys: Sequence[str], frame: int, hop: int, small: int = SMALL) -> DataFrame:
    """Level of the quietest tenth of frames, in dB."""
    found = percentiles(framed_rms(samples, keys, frame, hop), keys, "rms", {"quiet": 0.1}, small)
    return found.select(*keys, F.col("cnt").alias("frames"), decibels(F.col("quiet")).alias("noise_floor_db"))


def zero_crossings(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of samples whose sign differs from that of the sample before."""
    before = F.lag("x").over(in_order(keys))
    rows = own_rows(haloed(samples, before=1).withColumn("cross", F.when((F.col("x") < 0) != (before < 0), num(1.0)).otherwise(num(0.0))))
    return rows.groupBy(*keys).agg(F.count("*").alias("cnt"), F.avg("cross").alias("zero_crossing_rate"))


def waveform_peaks(samples: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Least and greatest sample of each stretch of ``size``."""
    return samples.groupBy(*keys, F.floor(F.col("n") / size).alias("segment")).agg(F.min("x").alias("low"), F.max("x").alias("high"))


def active_segment(samples: DataFrame, keys: Sequence[str], seconds: int, frame: int, hop: int, small: int = SMALL) -> DataFrame:
    """(keys..., start, stop) of a stretch of ``seconds`` samples around the middle one of the loudest third of frames."""
    frames = stored(framed_rms(samples, keys, frame, hop), "frames")  # read several times, and far fewer than samples
    return middle_segment(frames, percentiles(frames, keys, "rms", {"least": 0.65}, small), samples, keys, seconds, hop, small)


def middle_segment(frames: DataFrame, bars: DataFrame, samples: DataFrame, keys: Sequence[str], seconds: int, hop: int, small: int = SMALL) -> DataFrame:
    """The same from frames and each track's ``least`` level of an active one."""
    active = frames.join(bars, list(keys)).filter("rms >= least")
    middle = order_statistics(active, keys, "f", {"middle": lambda n: F.floor(n / 2)}, small).select(*keys, (F.col("middle") * hop).cast("long").alias("centre"))
    length = samples.groupBy(*keys).agg((F.max("n") + 1).alias("length"))
    start = F.greatest(F.least(F.coalesce("centre", F.floor(F.col("length") / 2)) - seconds // 2, F.col("length") - seconds), F.lit(0))
    return length.join(middle, list(keys), "left").select(*keys, start.alias("start"), F.least(start + seconds, F.col("length")).alias("stop"))


def look_ahead_gain(samples: DataFrame, keys: Sequence[str], ceiling: float, ahead: int) -> DataFrame:
    """Adds the least gain that the samples up to ``ahead`` further on need to stay under ``ceiling``."""
    own = F.least(num(1.0), ceiling / (F.abs("x") + 1e-12))
    size = max(BLOCK, ahead)
    return own_rows(haloed(samples, after=ahead, size=size).withColumn("gain", F.min(own).over(in_order(keys).rowsBetween(0, ahead))), size)


def _with_median(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = in_order(keys)
    near = F.array(*(F.coalesce(F.lag("x", -d).over(order), num(0.0)) for d in (-2, -1, 0, 1, 2)))
    return blocks.withColumn("median", F.element_at(F.array_sort(near), 3)).withColumn("residual", F.col("x") - F.col("median"))


def median_residual(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the median of five samples around each and what is left of it; beyond the ends are zeros."""
    return own_rows(_with_median(haloed(samples, before=2, after=2), keys))


def click_candidates(samples: DataFrame, keys: Sequence[str], least: float = 0.055, times: float = 12.0, small: int = SMALL) -> DataFrame:
    """Samples that stand out of their median and their slope: (keys..., n, x, repaired)."""
    order = in_order(keys)
    rows = _with_median(haloed(samples, before=2, after=2), keys).withColumns({"before": F.lag("x").over(order), "after": F.lead("x").over(order), "edge": F.lead("x", 2).over(order)})
    rows = own_rows(rows).withColumns({"residual": F.abs("residual"), "slope": F.coalesce(F.abs(F.col("x") - F.col("before")), num(0.0))})
    rows = stored(rows.select(*keys, "n", "x", "residual", "slope", "before", "after", "edge"), "slopes")  # so that the windows run once
    bars = percentiles(rows, keys, "residual", {"typical": 0.5}, small).join(percentiles(rows, keys, "slope", {"steep": 0.95}, small).drop("cnt"), list(keys))
    threshold, steep = F.greatest((F.col("typical") + 1e-9) * times, num(least)), (F.col("steep") + 1e-9) * 1.15
    chosen = (F.col("residual") > threshold) & (F.col("slope") >= steep) & (F.col("n") > 1) & F.col("edge").isNotNull()
    return rows.filter(F.col("residual") > least).join(bars, list(keys)).filter(chosen).select(*keys, "n", "x", ((F.col("before") + F.col("after")) * 0.5).alias("repaired"))


def tapped(samples: DataFrame, keys: Sequence[str], taps: Sequence[float]) -> DataFrame:
    """(keys..., n, x) weighted by an odd number of taps around each sample, where all of them are there."""
    reach, order = len(taps) // 2, in_order(keys)
    size = max(BLOCK, reach)
    near = [F.lag("x", reach - i).over(order) * t if i < reach else F.lead("x", i - reach).over(order) * t if i > reach else F.col("x") * t for i, t in enumerate(taps)]
    summed = haloed(samples, before=reach, after=reach, size=size).withColumn("x", functools.reduce(lambda a, b: a + b, near))
    return own_rows(summed, size).filter(F.col("x").isNotNull()).select(*keys, "n", "x")


def driven(samples: Column, drive: Column, points: int = 2_048) -> Column:
    """Samples bent by a hyperbolic tangent of ``drive`` that is tabled at ``points`` places and read between them by straight lines.

    As the table's last place stands for ``1 - 2 / points``, the curve leans a little to one side.
    """
    tabled = lambda k: F.tanh((k * 2.0 / points - 1.0) * drive) / F.tanh(drive)

    def bent(v: Column) -> Column:
        at = (F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)) + 1.0) / 2.0 * (points - 1)
        low = F.least(F.floor(at).cast("double"), F.lit(points - 2.0))
        return (1.0 - (at - low)) * tabled(low) + (at - low) * tabled(low + 1.0)

    return F.transform(samples, bent)
