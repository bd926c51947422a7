"""Stems: groups of series that add up to a track. Risk of each, safe strength, mixing, and fitting gains to the source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, num
from ..functions.tables import PARAMETERS, STEM_CAP, STEM_GAINS, STEM_ROLES, STEM_TARGETS, VOCAL_STEM_CAP
from ..plans.rules import clamp, flat, of, opened, packed, without


def _over(value: Column) -> Column:
    return F.greatest(value, num(0.0))


def _artifact_rules() -> list[list[tuple[Column, float, str]]]:
    """Groups of rules on the record and the name of a stem; of two in a group the first one counts."""
    c = F.col
    # Condition, risk and reason
    return [
        [(c("spectral_flatness") > 0.12, 0.24, "high spectral flatness"), (c("spectral_flatness") > 0.08, 0.12, "moderate spectral flatness")],
        [(c("noise_floor_db") > -42.0, 0.22, "high stem noise floor"), (c("noise_floor_db") > -50.0, 0.10, "moderate stem noise floor")],
        [(c("crest_db") < 6.0, 0.12, "flat stem dynamics")],
        [(c("stem").isin("vocals", "other") & (c("stereo_width") > 1.25), 0.12, "wide diffuse stem image")],
        [((c("channels") >= 2) & (c("phase_correlation") < 0.05), 0.18, "phase-sensitive stem")],
        [((c("stem") == "vocals") & (c("high_energy") > 0.42), 0.10, "vocal stem has strong high-band bleed")],
    ]


def _first(group: list[tuple[Column, Column]], default: Column) -> Column:
    found = F.when(*group[0])
    for rule, value in group[1:]:
        found = found.when(rule, value)
    return found.otherwise(default)


def artifact_risk() -> Column:
    """From the record and the name of a stem, additive rules."""
    return clip(sum((_first([(r, num(risk)) for r, risk, _ in g], num(0.0)) for g in _artifact_rules()), num(0.0)), 0.0, 1.0)


def artifact_reasons() -> Column:
    """What the artifact risk comes from, in words; five reasons at most are named."""
    found = [_first([(r, F.lit(why)) for r, _, why in g], F.lit(None).cast("string")) for g in _artifact_rules()]
    return F.slice(F.array_compact(F.array(*found)), 1, 5)


def risk_entries(records: DataFrame) -> DataFrame:
    """Adds the five sub-scores of each stem, their weighted ``score`` and two safety factors."""
    c = F.col
    rows = records.withColumns(
        {
            "artifact": artifact_risk(),
            "bleed": clip((c("spectral_flatness") - 0.055) * 2.5 + _over(c("noise_floor_db") + 54.0) / 34.0, 0.0, 1.0),
            "transient_smear": clip((8.5 - c("crest_db")) / 8.5, 0.0, 1.0),
            "phase_instability": clip((0.22 - c("phase_correlation")) / 0.52 + _over(c("stereo_width") - 1.25) * 0.18, 0.0, 1.0),
            "residual_mismatch": clip(F.abs(c("band_separation_score") - 58.0) / 70.0, 0.0, 1.0),
        }
    )
    weights = {"artifact": 0.34, "bleed": 0.22, "transient_smear": 0.16, "phase_instability": 0.18, "residual_mismatch": 0.10}
    return rows.withColumns(
        {
            "score": clip(sum((c(n) * w for n, w in weights.items()), num(0.0)), 0.0, 1.0),
            "phase_safety_factor": clip(1.0 - c("phase_instability") * 0.55, 0.35, 1.0),
            "transient_safety_factor": clip(1.0 - c("transient_smear") * 0.45, 0.45, 1.0),
        }
    )


def risk_map(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Average and highest risk of each track's stems and what follows: allow, attenuate or fall back."""
    rows = entries.groupBy(*keys).agg(F.count("*").alias("stems"), F.avg("score").alias("average"), F.max("score").alias("max"))
    return rows.withColumn("decision", F.when(F.col("average") < 0.45, "allow").when(F.col("average") <= 0.65, "attenuate").otherwise("fallback"))


def fallback_mode(mode: Column, average: Column) -> Column:
    """Mode to go on with: four stems fall back to two above 0.65, two to none above 0.72."""
    return F.when((mode == "4stem") & (average > 0.65), "2stem").when((mode == "2stem") & (average > 0.72), "off").otherwise(mode)


def safe_amount(adaptive: Column) -> Column:
    """Highest strength for a stem, from its risk entry and the adaptive amount."""
    c = F.col
    base = F.when(c("stem") == "vocals", num(VOCAL_STEM_CAP)).otherwise(num(STEM_CAP))
    weight = F.when(c("stem").isin("vocals", "instrumental"), num(1.0)).otherwise(num(0.92))
    left = 1.0 - clip(c("score"), 0.0, 1.0)
    return clip(base * weight * adaptive * left * left * clip(c("phase_safety_factor"), 0.25, 1.0) * clip(c("transient_safety_factor"), 0.35, 1.0), 0.0, STEM_CAP)


def stem_requests(rows: DataFrame) -> DataFrame:
    """Requests of the songs as requests of their stems: each towards its own target, no stronger than a stem may be, at the
    loudness it had and without manual parameters."""
    towards = F.col("request")
    for stem, target in STEM_TARGETS.items():
        towards = F.when(F.col("stem") == stem, F.lit(target)).otherwise(towards)
    return rows.withColumns({"request": towards, "amount": F.least("amount", num(STEM_CAP)), "volume_mode": F.lit("match_source"), "manual": F.lit(None).cast("string")})


def role_tuned(rows: DataFrame) -> DataFrame:
    """``dsp_params`` and ``strength`` within the range of each stem's role."""
    rows, params = opened(rows, "dsp_params", "_in_"), of("_in_")
    for p in PARAMETERS:
        tuned = params[p]
        for stem, (_, ranges) in STEM_ROLES.items():
            if p in ranges:
                tuned = F.when(F.col("stem") == stem, clip(params[p], *ranges[p])).otherwise(tuned)
        params[p] = tuned
    most = F.create_map(*(x for s, (cap, _) in STEM_ROLES.items() for x in (F.lit(s), num(cap))))
    rows = flat(rows.withColumn("strength", F.least(F.col("strength"), F.coalesce(most[F.col("stem")], num(STEM_CAP)))), "_out_", clamp(params))
    return without(rows.withColumn("dsp_params", packed(of("_out_"))), "_in_", "_out_")


def conservative(rows: DataFrame) -> DataFrame:
    """A stem's parameters taken back: ceiling, compression and harmonics, more so at a risk ``score`` of 0.22 or above."""
    c, cut = F.col, F.col("reduction")
    least = F.when(c("score") >= 0.22, clip(1.0 - c("score") * 0.38, 0.70, 0.94)).otherwise(num(1.0))
    rows, p = opened(rows.withColumn("reduction", least), "dsp_params", "_in_"), of("_in_")
    p["limiter_ceiling_db"] = F.least(p["limiter_ceiling_db"], num(-1.8))
    p["compress_ratio"] = 1.0 + (p["compress_ratio"] - 1.0) * 0.7 * cut
    for n in ("exciter_amount", "saturation_amount"):
        p[n] = p[n] * 0.55 * cut
    rows = flat(rows.withColumn("strength", F.least(c("strength"), safe_amount(c("effective"))) * cut), "_out_", clamp(p))
    return without(rows.withColumn("dsp_params", packed(of("_out_"))), "_in_", "_out_")


def gains() -> Column:
    return F.create_map(*(x for s, (g, _, _) in STEM_GAINS.items() for x in (F.lit(s), num(g))))


def mix(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted sum of aligned stems: (keys..., n, mix). ``samples`` has keys, stem, n and x; one partial aggregate."""
    return samples.groupBy(*keys, "n").agg(F.sum(F.col("x") * F.coalesce(gains()[F.col("stem")], num(0.95))).alias("mix"))


def others(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., stem, n, x, others): the sum of all other stems at each place."""
    whole = samples.groupBy(*keys, "n").agg(F.sum("x").alias("_all"))
    return samples.join(whole, [*keys, "n"]).withColumn("others", F.col("_all") - F.col("x")).drop("_all")


def aligned(samples: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Every place from 0 to ``length`` - 1 of each key: longer series are cut, shorter ones end in zeros."""
    spine = lengths.select(*keys, F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("n"))
    return spine.join(samples.withColumn("n", F.col("n").cast("int")), [*keys, "n"], "left").withColumn("x", F.coalesce("x", num(0.0)))


def with_channels(samples: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Exactly ``count`` channels: one is the mean, more repeat the last one or leave out the rest."""
    if count == 1:
        return samples.groupBy(*keys, "n").agg(F.avg("x").alias("x")).withColumn("channel", F.lit(0))
    last = samples.groupBy(*keys).agg(F.max("channel").alias("_last"))
    wanted = last.select(*keys, "_last", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_to")).withColumn("channel", F.least("_to", "_last"))
    return samples.join(wanted, [*keys, "channel"]).withColumn("channel", F.col("_to")).drop("_to", "_last")


def residual(mixed: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., source_rms, residual_rms, source_ratio) of what the stems leave out of the source."""
    both = source.select(*keys, "n", F.col("x").alias("s")).join(mixed.select(*keys, "n", F.col("mix").alias("m")), [*keys, "n"], "left")
    left = F.col("s") - F.coalesce("m", num(0.0))
    rows = both.groupBy(*keys).agg(F.sqrt(F.avg(F.col("s") * F.col("s"))).alias("source_rms"), F.sqrt(F.avg(left * left)).alias("residual_rms"))
    return rows.withColumn("source_ratio", F.when(F.col("source_rms") > 1e-9, F.col("residual_rms") / F.col("source_rms")).otherwise(num(0.0)))


def residual_blend(average_risk: Column) -> Column:
    """How much of the residual to put back."""
    return clip(0.03 + clip(1.0 - average_risk, 0.12, 0.95) * 0.22, 0.03, 0.25)


def fitted_gains(rows: DataFrame, a: str, b: str, y: str, keys: list[str]) -> DataFrame:
    """Least-squares gains of two stems against the source, in closed form from five sums, held near their defaults.

    ``a``, ``b`` and ``y`` are columns of aligned samples.
    """
    c, (ga, la, _), (gb, lb, _) = F.col, STEM_GAINS["vocals"], STEM_GAINS["instrumental"]
    s = rows.groupBy(*keys).agg(*(F.sum(c(p) * c(q)).alias(n) for n, p, q in (("aa", a, a), ("ab", a, b), ("bb", b, b), ("ay", a, y), ("by", b, y), ("yy", y, y))))
    det = c("aa") * c("bb") - c("ab") * c("ab")
    solved = lambda x, d: F.when(F.abs(det) > 1e-12, x / det).otherwise(num(d))
    hold = lambda v, g, limit: clip(v, g * 10 ** (-limit / 20), g * 10 ** (limit / 20))
    s = s.withColumns({"gain_a": hold(solved(c("ay") * c("bb") - c("by") * c("ab"), ga), ga, la), "gain_b": hold(solved(c("by") * c("aa") - c("ay") * c("ab"), gb), gb, lb)})
    error = lambda g, h: F.sqrt(_over(c("yy") - 2.0 * (g * c("ay") + h * c("by")) + g * g * c("aa") + h * h * c("bb") + 2.0 * g * h * c("ab")))
    s = s.withColumns({"base_error": error(num(ga), num(gb)), "fitted_error": error(c("gain_a"), c("gain_b"))})
    return s.select(*keys, "gain_a", "gain_b", F.when(c("base_error") <= 1e-9, num(0.0)).otherwise(clip((c("base_error") - c("fitted_error")) / c("base_error"), -1.0, 1.0)).alias("error_reduction"))




def gram(rows: DataFrame, stems: dict[str, Column], goal: Column, keys: list[str]) -> DataFrame:
    """(keys..., cnt, products, with_goal, goal_energy): sums of products of aligned samples, by partial aggregation.

    ``products`` holds the pairs of ``stems`` in order, each pair once; a song's samples meet nowhere.
    """
    names = list(stems)
    wide = rows.select(*keys, *(F.coalesce(c, num(0.0)).alias(f"_{i}") for i, c in enumerate(stems.values())), F.coalesce(goal, num(0.0)).alias("_y"))
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    pairs = [s(f"_{i}", f"_{j}") for i in range(len(names)) for j in range(i, len(names))]
    return wide.groupBy(*keys).agg(F.count("*").alias("cnt"), F.array(*pairs).alias("products"), F.array(*(s(f"_{i}", "_y") for i in range(len(names)))).alias("with_goal"), s("_y", "_y").alias("goal_energy"))


def gains_from_gram(sums: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys..., applied, names..., error_reduction): least-squares gains of any number of stems, held near their defaults.

    A stem without any energy is absent and has no gain. Where the goal is silent or too short for so many stems the defaults stay.
    One small matrix a track is solved, many tracks at once.
    """
    types = {f.name: f.dataType.simpleString() for f in sums.schema}
    upper = np.triu_indices(len(names))
    default, most, _ = (np.array(v) for v in zip(*(STEM_GAINS.get(n, STEM_GAINS["other"]) for n in names)))

    def run(batches):
        for batch in batches:
            at = len(keys)
            count, whole = (batch.column(at + i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 3))
            g = np.zeros((batch.num_rows, len(names), len(names)))
            g[:, upper[0], upper[1]] = np.array(batch.column(at + 1).to_pylist()).reshape(batch.num_rows, -1)
            g = g + np.transpose(np.triu(g, 1), (0, 2, 1))
            b = np.array(batch.column(at + 2).to_pylist()).reshape(batch.num_rows, -1)
            there = np.diagonal(g, axis1=1, axis2=2) > 0
            solved = (np.linalg.pinv(g, hermitian=True) @ b[:, :, None])[:, :, 0]
            applied = (count >= 8 * there.sum(axis=1)) & (np.sqrt(whole / np.maximum(count, 1)) > 1e-9) & there.any(axis=1)
            gain = np.where(applied[:, None], np.clip(solved, default * 10 ** (-most / 20), default * 10 ** (most / 20)), default)
            error = lambda v: np.sqrt(np.maximum(np.einsum("ti,tij,tj->t", v, g, v) - 2 * (v * b).sum(axis=1) + whole, 0))
            base = error(np.broadcast_to(default, gain.shape))
            less = np.where(applied & (base > 1e-9), np.clip((base - error(gain)) / np.maximum(base, 1e-300), -1, 1), 0.0)
            gains = [pa.array(gain[:, i], mask=~there[:, i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(applied), *gains, pa.array(less)], [*keys, "applied", *names, "error_reduction"])

    rows = sums.select(*keys, "cnt", "products", "with_goal", "goal_energy")
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "applied boolean", *(f"`{n}` double" for n in names), "error_reduction double"]))
