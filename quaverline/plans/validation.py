"""Before/after comparison: drift flags, validation with a score, the comparison report, and the best of several candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import amplitude, clip, finite, flags, num
from ..functions.tables import CHECK_WEIGHTS, CODEC_CEILING_DB, SEVERE_FLAGS, STATUS_WORTH
from .reports import LABELS, figure


def _after(name: str) -> Column:
    return F.col(f"after.{name}")


def _before(name: str) -> Column:
    return F.col(f"before.{name}")


def delta(name: str) -> Column:
    return _after(name) - _before(name)


def compared(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each track with both records as structs; an inner equi-join on the keys."""
    a = before.select(*keys, F.struct(*(c for c in before.columns if c not in keys)).alias("before"))
    b = after.select(*keys, F.struct(*(c for c in after.columns if c not in keys)).alias("after"))
    return a.join(b, keys)


def drift_flags(target: Column, volume_mode: Column, ceiling_db: Column) -> Column:
    """Names of what got worse by more than it may."""
    stereo = _before("channels") >= 2
    width, phase = delta("stereo_width"), delta("phase_correlation")
    most_crest = F.when(F.contains(target, F.lit("loud_modern")), num(6.0)).otherwise(num(4.5))
    return flags(
        ("stereo_width_loss", stereo & (_before("stereo_width") > 0.08) & (_after("stereo_width") < _before("stereo_width") * 0.72) & (width < -0.10)),
        ("stereo_width_overexpansion", stereo & (_before("stereo_width") > 0.08) & (_after("stereo_width") > _before("stereo_width") * 1.55) & (width > 0.18)),
        ("phase_correlation_loss", stereo & ((_after("phase_correlation") < -0.10) | ((phase < -0.30) & (_after("phase_correlation") < 0.25)))),
        ("band_separation_loss", delta("band_separation_score") < -12.0),
        ("transient_flattening", -delta("crest_db") > most_crest),
        ("high_band_harshness", (delta("high_energy") > 0.22) & (delta("spectral_flatness") > 0.035) & ~F.contains(target, F.lit("hifi_bright"))),
        ("source_loudness_drift", (volume_mode == "match_source") & (F.abs(delta("lufs")) > 2.25)),
        ("headroom_risk", (_after("clipping_ratio") > 0.0005) | (_after("true_peak_db") > ceiling_db + 0.15)),
    )


def drift_severity(found: Column) -> Column:
    """none, warning or severe; with how much of the source to blend back."""
    severe = F.arrays_overlap(found, F.array(*map(F.lit, SEVERE_FLAGS))) | (F.size(found) >= 3)
    return F.when(F.size(found) == 0, "none").when(severe, "severe").otherwise("warning")


def _status(passes: Column, reviews: Column) -> Column:
    return F.when(passes, "pass").when(reviews, "review").otherwise("fail")


def validation(rows: DataFrame, target: Column, volume_mode: Column, target_lufs: Column, ceiling_db: Column, stem_risk: Column | None = None, guarded: Column | None = None) -> DataFrame:
    """Adds ``checks`` (array of id, label, value, unit, status, detail), ``score``, ``overall``, ``penalties``, ``bonuses``, ``risk`` (a
    struct of both, the gain in loudness that is too much, and what stems cost) and ``protected_by_quality_guard``, false if
    ``guarded`` isn't given."""
    matched = volume_mode == "match_source"
    loud = F.when(matched, delta("lufs")).otherwise(_after("lufs") - target_lufs)
    width, phase = F.abs(delta("stereo_width")), F.abs(delta("phase_correlation"))
    crest_loss = -delta("crest_db")
    most_crest = F.when(F.contains(target, F.lit("loud_modern")), num(6.0)).otherwise(num(4.5))
    high, flat = delta("high_energy"), delta("spectral_flatness")
    peak_over = _after("true_peak_db") - ceiling_db
    sep = delta("band_separation_score")
    mono = _after("channels") < 2
    checks = {
        "loudness": (loud, "LU", _status(F.abs(loud) <= F.when(matched, 1.25).otherwise(1.5), F.abs(loud) <= F.when(matched, 2.25).otherwise(2.8))),
        "true_peak": (_after("true_peak_db"), "dBTP", _status(peak_over <= 0.05, peak_over <= 0.20)),
        "clipping": (_after("clipping_ratio"), "", _status(_after("clipping_ratio") <= 0.0005, _after("clipping_ratio") <= 0.0015)),
        "stereo": (delta("stereo_width"), "", _status(mono | ((width <= 0.18) & (phase <= 0.22)), (width <= 0.30) & (phase <= 0.35))),
        "separation": (sep, "pt", _status(sep >= -6.0, sep >= -12.0)),
        "transients": (-crest_loss, "dB", _status(crest_loss <= most_crest, crest_loss <= most_crest + 2.0)),
        "harshness": (high, "", F.when((high > 0.22) & (flat > 0.035) & ~F.contains(target, F.lit("hifi_bright")), "fail").when((high > 0.16) & (flat > 0.025), "review").otherwise("pass")),
    }
    details = {
        "loudness": F.concat(F.when(matched, F.lit("source match")).otherwise(F.lit("target")), figure(" delta %+.1f LU", loud, 1)),
        "true_peak": figure("ceiling %.1f dBTP", ceiling_db, 1),
        "clipping": figure("ratio %.5f", _after("clipping_ratio"), 5),
        "stereo": F.concat(figure("width %+.2f, ", delta("stereo_width"), 2), figure("phase %+.2f", delta("phase_correlation"), 2)),
        "separation": figure("score delta %+.1f", sep, 1),
        "transients": figure("crest loss %.1f dB", crest_loss, 1),
        "harshness": F.concat(figure("high %+.2f, ", high, 2), figure("flatness %+.3f", flat, 3)),
    }
    check = lambda k, v, u, s: F.struct(F.lit(k).alias("id"), F.lit(LABELS[k]).alias("label"), v.alias("value"), F.lit(u).alias("unit"), s.alias("status"), details[k].alias("detail"))
    rows = rows.withColumn("checks", F.array(*(check(k, *c) for k, c in checks.items())))
    worth = F.create_map(*(x for s, w in STATUS_WORTH.items() for x in (F.lit(s), num(w))))
    weight = F.create_map(*(x for k, w in CHECK_WEIGHTS.items() for x in (F.lit(k), num(w))))
    over = lambda v: F.greatest(v, num(0.0))
    weighted = F.aggregate("checks", num(0.0), lambda a, c: a + weight[c["id"]] * worth[c["status"]])
    risk = num(0.0) if stem_risk is None else F.coalesce(stem_risk, num(0.0)) * 12.0
    too_loud = over(delta("lufs") - F.when(matched, 1.0).otherwise(3.0))
    penalties = too_loud * 4.5 + over(phase - 0.18) * 18.0 + over(crest_loss - most_crest) * 2.0 + over(high - 0.14) * 22.0 + risk
    bonuses = over(sep) * 0.18 + F.when(_after("true_peak_db") <= CODEC_CEILING_DB + 0.05, num(4.0)).otherwise(num(0.0)) + F.when((width <= 0.12) & (phase <= 0.16), num(3.0)).otherwise(num(0.0))
    rows = rows.withColumns({"penalties": penalties, "bonuses": bonuses, "_weighted": weighted, "protected_by_quality_guard": F.lit(False) if guarded is None else guarded})
    rows = rows.withColumn("risk", F.struct(too_loud.alias("excessive_loudness_gain"), risk.alias("stem_artifact_penalty"), "penalties", "bonuses"))
    of = lambda s: F.size(F.filter("checks", lambda c: c["status"] == s))
    overall = F.when(of("fail") > 0, "fail").when(of("review") <= 1, "pass").otherwise("review")
    return rows.withColumns({"score": clip(F.col("_weighted") * 100.0 + F.col("bonuses") - F.col("penalties"), 0.0, 100.0), "overall": overall}).drop("_weighted")


def level_match(before_lufs: Column, after_lufs: Column) -> tuple[Column, Column]:
    """Playback gains that bring the louder of both down to the other."""
    least = F.least(before_lufs, after_lufs)
    return F.least(num(1.0), amplitude(least - before_lufs)), F.least(num(1.0), amplitude(least - after_lufs))


def playback_gain(value: Column) -> Column:
    return clip(finite(value, 1.0), 0.05, 1.0)


def comparison(rows: DataFrame, volume_mode: Column, ceiling_db: Column) -> DataFrame:
    """Adds ``delta`` and ``summary`` structs to rows with both records."""
    names = ["lufs", "peak_db", "noise_floor_db", "crest_db", "high_energy", "stereo_width", "phase_correlation", "true_peak_db", "band_separation_score"]
    mono = _after("channels") < 2
    width, phase = F.abs(delta("stereo_width")), F.abs(delta("phase_correlation"))
    original, enhanced = level_match(_before("lufs"), _after("lufs"))
    summary = {
        "volume_matched": F.abs(delta("lufs")) <= F.when(volume_mode == "match_source", 1.25).otherwise(1.0),
        "clipping_safe": (_after("clipping_ratio") <= 0.0005) & (_after("true_peak_db") <= ceiling_db + 0.2),
        "headroom_safe": _after("true_peak_db") <= -1.0,
        "stereo_preserved": mono | ((width <= 0.2) & (phase <= 0.25)),
        "stereo_preservation_score": F.when(mono, num(100.0)).otherwise(clip(100.0 - (width * 120.0 + phase * 80.0), 0.0, 100.0)),
        "original_gain": original,
        "enhanced_gain": enhanced,
    }
    return rows.withColumns({"delta": F.struct(*(delta(n).alias(n) for n in names)), "summary": F.struct(*(c.alias(n) for n, c in summary.items()))})


def best(rows: DataFrame, keys: list[str], score: str = "score", position: str = "position") -> DataFrame:
    """The candidate with the highest score of each key; the first one of equals."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), position))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
