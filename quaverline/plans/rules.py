"""The recommendation engine: from analysis records and requests to bounded parameters, reasons and advice.

Everything is a projection over one row for each request, so it runs inside the scan's stage. Rules are tables of
(condition, effect) that become CASE chains; parameters live in a struct of nine doubles and ``normalize``.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scalars import clip, mean, num
from ..functions.tables import BOUNDS, BUDGET_LIMITS, MANUAL_CEILING_DB, OPPOSING_TARGETS, PARAMETERS, PRESETS, STEM_CAP, TARGETS, TWEAKS

Params = dict[str, Column]


def of(prefix: str) -> Params:
    """The parameters of one step, as ``flat`` leaves them."""
    return {p: F.col(f"{prefix}{p}") for p in PARAMETERS}


def flat(rows: DataFrame, prefix: str, params: Params) -> DataFrame:
    """A column for each parameter of a step. The optimizer computes such columns once however often the next step reads
    them; fields of a struct it would write out at every use."""
    return rows.withColumns({f"{prefix}{p}": params[p].cast("double") for p in PARAMETERS})


def opened(rows: DataFrame, struct: str, prefix: str) -> DataFrame:
    return flat(rows, prefix, {p: F.col(f"{struct}.{p}") for p in PARAMETERS})


def without(rows: DataFrame, *prefixes: str) -> DataFrame:
    return rows.drop(*(f"{x}{p}" for x in prefixes for p in PARAMETERS))


def packed(params: Params) -> Column:
    return F.struct(*(params[p].cast("double").alias(p) for p in PARAMETERS), F.lit(True).alias("normalize"))


def clamp(params: Params) -> Params:
    return {p: clip(params[p], *BOUNDS[p][:2]) for p in PARAMETERS}


def chain(start: Column, *rules: tuple[Column, Column]) -> Column:
    """The value of the first rule that holds, else ``start``."""
    found = None
    for rule, value in rules:
        found = F.when(rule, value) if found is None else found.when(rule, value)
    return start if found is None else found.otherwise(start)


def has(targets: Column, name: str) -> Column:
    return F.array_contains(targets, name)


def blend(targets: Column) -> Params:
    """Mean of the presets of the chosen targets, from a constant of seven rows."""
    presets = F.create_map(*(x for t in TARGETS for x in (F.lit(t), F.array(*map(num, PRESETS[t])))))
    rows = F.transform(targets, lambda t: presets[t])
    return {p: mean(rows, partial(F.element_at, extraction=i + 1)) for i, p in enumerate(PARAMETERS)}


def with_targets(requests: DataFrame) -> DataFrame:
    """Adds ``targets``, the blended preset (``preset_...``) and whether the targets pull against each other, from ``request``."""
    rows = requests.withColumn("targets", text.targets(F.col("request")))
    opposed = reduce(lambda a, b: a | b, (has(F.col("targets"), a) & has(F.col("targets"), b) for a, b in OPPOSING_TARGETS))
    return flat(rows.withColumns({"weight": 1.0 / F.size("targets"), "opposed": opposed}), "preset_", blend(F.col("targets")))


def adaptive_amount(rows: DataFrame) -> DataFrame:
    """Adds ``effective``, ``adjustment``, ``risk_score``, ``enhancement_need`` and ``source_condition`` from the record and ``amount``."""
    flagged = lambda f: F.array_contains("quality_flags", f)
    c = F.col
    crest, score, calm = c("crest_db"), c("band_separation_score"), F.size("quality_flags") == 0
    stereo = c("channels") >= 2
    # Condition, change of the amount, risk, need
    rules = [
        (flagged("high_noise_floor"), 0.07, 0.0, 0.20),
        (flagged("dull_high_end"), 0.06, 0.0, 0.16),
        (flagged("very_low_loudness"), 0.04, 0.0, 0.10),
        (flagged("low_sample_rate"), 0.03, 0.0, 0.10),
        (flagged("clipping_detected") | flagged("hot_loudness"), -0.07, 0.18, 0.0),
        (score >= 72.0, -0.05, 0.0, 0.0),
        (score < 45.0, 0.04, 0.0, 0.12),
        ((crest >= 8.0) & (crest <= 17.0) & calm, -0.05, 0.0, 0.0),
        (crest > 20.0, 0.03, 0.0, 0.08),
        (crest < 7.0, -0.05, 0.12, 0.0),
        (stereo & (c("phase_correlation") < 0.18), -0.08, 0.20, 0.0),
        (stereo & (c("stereo_width") > 1.15), -0.04, 0.10, 0.0),
        (has(c("targets"), "restore"), -0.04, 0.0, 0.0),
        (has(c("targets"), "loud_modern"), 0.03, 0.0, 0.0),
        (has(c("targets"), "bass_boost") & (c("low_energy") > 0.44), -0.04, 0.10, 0.0),
    ]
    added = lambda k: sum((F.when(r[0], num(r[k])).otherwise(num(0.0)) for r in rules if r[k]), num(0.0))
    asked = clip(c("amount"), 0.0, 1.0)
    change = clip(added(1), -0.18, 0.14)
    changed = clip(asked + change, 0.0, 1.0)
    effective = F.when(asked <= 0.02, asked).when(asked <= 0.20, F.least(changed, asked + 0.05)).otherwise(changed)
    condition = (
        F.when(asked <= 0.02, "bypass").when(c("risk_score") >= 0.28, "fragile").when(c("enhancement_need") >= 0.30, "needs_recovery").when(c("_change") < -0.04, "already_polished").otherwise("balanced")
    )
    rows = rows.withColumns({"effective": effective, "risk_score": clip(added(2), 0.0, 1.0), "enhancement_need": clip(added(3), 0.0, 1.0), "_change": change})
    return rows.withColumns({"adjustment": c("effective") - asked, "source_condition": condition}).drop("_change")


def scaled(params: Params, lufs: Column, amount: Column) -> Params:
    """Parameters moved from doing nothing (0) to their full value (1)."""
    a, source = clip(amount, 0.0, 1.0), clip(lufs, -24.0, -10.0)
    rest = {"lowcut_hz": num(20.0), "compress_ratio": num(1.0), "target_lufs": source, "limiter_ceiling_db": params["limiter_ceiling_db"]}
    return clamp({p: (r := rest.get(p, num(0.0))) + (params[p] - r) * a for p in PARAMETERS})


def budget(params: Params, n_targets: Column, amount: Column) -> tuple[Params, dict[str, Column]]:
    """Parameters within each family's share, and the factor of each family. Stereo and stem are only reported."""
    a = clip(amount, 0.0, 1.0)
    tone = F.greatest(*(F.abs(params[p]) / 6.0 for p in ("low_boost_db", "mid_cut_db", "high_boost_db")))
    used = {
        "tone": tone * a,
        "dynamics": F.greatest(num(0.0), (params["compress_ratio"] - 1.0) / 3.0) * a,
        "harmonics": F.greatest(params["exciter_amount"], params["saturation_amount"]) * a,
        "stereo": F.least(num(0.15), 0.04 * (n_targets - 1)) * a,
        "stem": F.least(num(0.35), STEM_CAP * a),
    }
    factor = {k: F.when((u <= BUDGET_LIMITS[k]) | (u <= 1e-9), num(1.0)).otherwise(BUDGET_LIMITS[k] / u) for k, u in used.items()}
    out = dict(params)
    for p, family in (("low_boost_db", "tone"), ("mid_cut_db", "tone"), ("high_boost_db", "tone"), ("exciter_amount", "harmonics"), ("saturation_amount", "harmonics")):
        out[p] = params[p] * factor[family]
    out["compress_ratio"] = 1.0 + (params["compress_ratio"] - 1.0) * factor["dynamics"]
    return clamp(out), factor


def harmonic_factor() -> Column:
    """How much of the harmonics a source with noise or little headroom takes."""
    c = F.col
    rules = [(c("noise_floor_db") > -48.0, 0.25), (c("spectral_flatness") > 0.08, 0.18), (c("true_peak_db") > -2.0, 0.20), (c("high_energy") > 0.36, 0.12)]
    return clip(1.0 - sum((F.when(r, num(w)).otherwise(num(0.0)) for r, w in rules), num(0.0)), 0.45, 1.0)


def manual(base: Params, raw: Column) -> tuple[Column, Params]:
    """Whether ``raw`` is a manual request in JSON, and the parameters that follow: ``base`` if it isn't.

    ``manual_mode`` fine_tune, or any change, is added to ``base``; otherwise the values in it are taken as they are.
    """
    names = [*PARAMETERS, *(t[1] for t in TWEAKS)]
    asked = F.from_json(raw, "manual_mode string, " + ", ".join(f"{n} double" for n in dict.fromkeys(names)))
    keys = F.json_object_keys(raw)
    fine = F.coalesce(asked["manual_mode"] == "fine_tune", F.lit(False)) | F.arrays_overlap(keys, F.array(*(F.lit(t[1]) for t in TWEAKS)))
    changes = {p: clip(F.coalesce(asked[key], num(0.0)), low, high) for p, key, low, high in TWEAKS}
    out = {}
    for p in PARAMETERS:
        low, high, default = BOUNDS[p]
        tuned = F.least(F.coalesce(asked[p], base[p]), num(MANUAL_CEILING_DB)) if p == "limiter_ceiling_db" else base[p] + changes[p]
        value = clip(F.when(fine, tuned).otherwise(F.coalesce(asked[p], num(default))), low, high)
        out[p] = F.when(keys.isNull(), base[p]).otherwise(F.least(value, num(MANUAL_CEILING_DB)) if p == "limiter_ceiling_db" else value)
    return keys.isNotNull(), out


def manual_request(enabled: Column, values: dict[str, Column]) -> Column:
    """The JSON of a manual request from the controls' values, null where they are off: changes within the manual ceiling."""
    fixed = {"manual_mode": F.lit("fine_tune"), "limiter_ceiling_db": num(MANUAL_CEILING_DB), "normalize": F.lit(True)}
    return F.when(enabled, F.to_json(F.struct(*(c.alias(n) for n, c in (fixed | values).items()))))


def recommend(rows: DataFrame) -> DataFrame:
    """Mode, intensity, parameters, confidence, reasons and advice for each row of a record with ``request`` and ``amount``.

    ``true_peak_db`` must be there. A null amount counts as 0.6.
    """
    c = F.col
    rows = with_targets(rows).withColumn("amount", clip(F.coalesce(c("amount"), num(0.6)), 0.0, 1.0))
    rows = adaptive_amount(rows)
    first, alone = F.element_at("targets", 1), F.size("targets") == 1
    flagged = lambda f: F.array_contains("quality_flags", f)
    only = lambda t: alone & (first == t)
    p = of("preset_")
    low, bass = c("low_energy"), has(c("targets"), "bass_boost")
    weak, voice = (low < 0.18) & (first != "voice_focus"), first == "voice_focus"
    strong_bass = ~weak & (low > 0.45) & bass
    strong_restore = ~weak & ~strong_bass & (low > 0.45) & (first == "restore")
    strong = ~weak & ~strong_bass & ~strong_restore & ((low > 0.45) | voice)
    noisy, dull = c("noise_floor_db") > -45, (c("high_energy") < 0.12) & ~flagged("low_sample_rate")
    hiss = ~dull & (c("spectral_flatness") > 0.08) & (first != "hifi_bright")
    faint, wide, clipped = c("lufs") < -28, ~(c("lufs") < -28) & (c("crest_db") > 18), flagged("clipping_detected")
    slow, stereo = c("sr") < 32_000, c("channels") >= 2
    fragile = stereo & (c("phase_correlation") < 0.2)

    base = chain(num(0.55), *((first == t, num(v)) for t, v in (("restore", 0.65), ("warm_analog", 0.45), ("loud_modern", 0.6), ("voice_focus", 0.75))))
    intensity = F.when(noisy, F.greatest(base, num(0.65))).when(first.isin("hifi_clean", "warm_analog"), F.least(base, num(0.55))).otherwise(base)
    intensity = F.when(fragile, F.least(intensity, num(0.55))).otherwise(intensity)

    # by the source
    p["lowcut_hz"] = chain(p["lowcut_hz"], (strong_bass, F.greatest(p["lowcut_hz"], num(38.0))), (strong_restore, F.greatest(p["lowcut_hz"], num(35.0))), (strong, F.greatest(p["lowcut_hz"], F.when(voice, num(100.0)).otherwise(num(45.0)))))
    b = p["low_boost_db"]
    p["low_boost_db"] = chain(b, (weak, F.greatest(b, num(2.0))), (strong_bass, clip(b, 0.8, 1.8)), (strong_restore, F.least(b, num(0.0))), (strong, F.least(b, num(-1.0))))
    p["mid_cut_db"] = F.when(c("mid_energy") > 0.72, F.least(p["mid_cut_db"], num(-1.5))).otherwise(p["mid_cut_db"])
    p["high_boost_db"] = chain(p["high_boost_db"], (dull, F.greatest(p["high_boost_db"], num(2.0))), (hiss, F.least(p["high_boost_db"], num(-1.0))))
    p["compress_ratio"] = chain(p["compress_ratio"], (faint, F.greatest(p["compress_ratio"], num(2.2))), (wide, F.greatest(p["compress_ratio"], num(1.8))))
    p["compress_ratio"] = F.when(clipped, clip(p["compress_ratio"], 1.4, 2.2)).otherwise(p["compress_ratio"])
    for name, most in (("exciter_amount", 0.1), ("saturation_amount", 0.08)):
        p[name] = F.when(fragile, F.least(p[name], num(most))).otherwise(p[name])
    # By the target, if it is the only one: range of each parameter
    own = {
        "restore": {"high_boost_db": (None, 1.2), "compress_ratio": (None, 1.8)},
        "hifi_clean": {"high_boost_db": (0.4, 1.8), "compress_ratio": (None, 1.8)},
        "hifi_bright": {"high_boost_db": (2.2, None), "mid_cut_db": (None, -0.4)},
        "warm_analog": {"low_boost_db": (0.8, None), "high_boost_db": (None, -0.4), "compress_ratio": (1.25, 1.8)},
        "loud_modern": {"compress_ratio": (2.6, None), "high_boost_db": (1.0, None)},
        "bass_boost": {"lowcut_hz": (None, 38.0), "low_boost_db": (1.4, 3.2), "compress_ratio": (1.35, 2.1), "high_boost_db": (-0.2, 0.8)},
        "voice_focus": {"lowcut_hz": (100.0, None), "low_boost_db": (None, -1.0), "high_boost_db": (1.4, None)},
    }
    for name in PARAMETERS:
        p[name] = chain(p[name], *((only(t), clip(p[name], *ranges[name])) for t, ranges in own.items() if name in ranges))

    rows = flat(rows.withColumns({"_intensity": intensity, "mode": F.when(slow, "upsample").otherwise("denoise"), "harmonic_factor": harmonic_factor()}), "_wanted_", clamp(p))
    rows = flat(rows, "_scaled_", scaled(of("_wanted_"), c("lufs"), c("effective")))
    within, factor = budget(of("_scaled_"), F.size("targets"), c("effective"))
    rows = flat(rows.withColumns({f"_reduced_{k}": f for k, f in factor.items()}), "_budget_", within)
    safe = of("_budget_")
    for name in ("exciter_amount", "saturation_amount"):
        safe[name] = safe[name] * c("harmonic_factor")
    limited = F.least(*(c(f"_reduced_{k}") for k in BUDGET_LIMITS)) < 0.999
    confidence = num(0.72) - F.least(F.size("quality_flags") * 0.04, num(0.18)) - F.when(c("duration") < 1.0, num(0.12)).otherwise(num(0.0))
    reasons = F.array_compact(
        F.array(
            F.when(~alone, "blended_targets"),
            F.concat(F.lit("target_"), first),
            F.when(noisy, "noisy_source").when(first.isin("hifi_clean", "warm_analog"), "natural_texture"),
            F.when(weak, "weak_low_band").when(strong_bass, "controlled_bass").when(strong_restore, "kept_low_end").when(strong, "reduced_low_band"),
            F.when(c("mid_energy") > 0.72, "mid_heavy"),
            F.when(dull, "dull_source").when(hiss, "hissing_source"),
            F.when(faint, "low_loudness").when(wide, "wide_dynamics"),
            F.when(clipped, "clipping"),
            F.when(slow, "low_sample_rate"),
            F.when(stereo, "stereo_safe"),
            F.when(fragile, "phase_sensitive"),
            F.when(c("duration") < 1.0, "short_source"),
            F.when(F.abs("adjustment") >= 0.015, F.when(c("adjustment") < 0, "amount_reduced").otherwise("amount_increased")),
            F.when(limited, "budget_limited"),
            F.when(c("harmonic_factor") < 0.98, "harmonics_reduced"),
            F.when(~slow, "fast_denoise"),
        )
    )
    rows = rows.withColumns(
        {
            "target": F.array_join("targets", "+"),
            "intensity": clip(c("_intensity") * c("effective"), 0.0, 1.0),
            "reductions": F.struct(*(c(f"_reduced_{k}").alias(k) for k in BUDGET_LIMITS)),
            "stereo_safe": stereo,
            "output_sr": F.when(slow, text.default_sample_rate(c("sr"))).otherwise(c("sr")).cast("int"),
            "confidence": clip(confidence, 0.1, 0.95),
            "reasons": reasons,
        }
    )
    rows = flat(rows, "dsp_", clamp(safe))
    rows = rows.withColumns({"dsp_params": packed(of("dsp_")), "advice": advice(of("dsp_"))})
    return without(rows, "_wanted_", "_scaled_", "_budget_", "preset_", "dsp_").drop("_intensity", *(f"_reduced_{k}" for k in BUDGET_LIMITS))


def shown(v: Column, digits: int) -> Column:
    """Rounded as its exact binary value says, half way to the even digit; formatting alone would round its shortest decimal form."""
    scale, unit = float(10**digits), 2.0**26
    high = F.floor(v * unit).cast("double") / unit  # so few bits that its multiples are exact, like those of the rest
    k = F.floor(high * scale).cast("double")
    over = (high * scale - k - 0.5) + (v - high) * scale
    near = (k + F.when((over > 0) | ((over == 0) & (k % 2 != 0)), 1.0).otherwise(0.0)) / scale
    return F.when(v < 0, -F.abs(near)).otherwise(near)


def advice(p: Params) -> Column:
    """One line of what will be done; parts that don't apply are null and vanish."""
    signed = lambda name, v: F.when(v != 0, F.format_string(f"{name} %+.1f dB", shown(v, 1)))
    return F.concat_ws(
        "; ",
        F.concat(F.col("mode"), F.lit(" mode")),
        F.format_string("denoise intensity %.2f", shown(F.col("intensity"), 2)),
        signed("low", p["low_boost_db"]),
        signed("mid", p["mid_cut_db"]),
        signed("high", p["high_boost_db"]),
        F.when(p["compress_ratio"] > 1.01, F.format_string("%.1f:1 compression", shown(p["compress_ratio"], 1))),
        F.format_string("target %.1f LUFS", shown(p["target_lufs"], 1)),
        F.when(p["exciter_amount"] > 0.01, F.format_string("exciter %.2f", shown(p["exciter_amount"], 2))),
        F.when(p["saturation_amount"] > 0.01, F.format_string("saturation %.2f", shown(p["saturation_amount"], 2))),
        F.when(F.size("quality_flags") > 0, F.concat(F.lit("flags: "), F.array_join(F.array_sort("quality_flags"), ", "))),
    )


def for_request(rows: DataFrame) -> DataFrame:
    """Recommendations with the request's ``volume_mode``, ``use_denoise`` and manual parameters (``manual``, JSON or null)."""
    c = F.col
    rows = opened(recommend(rows), "dsp_params", "_own_").withColumn("volume_mode", F.when(c("volume_mode") == "match_source", c("volume_mode")).otherwise("target"))
    matched = of("_own_") | {"target_lufs": F.when(c("volume_mode") == "match_source", clip(c("lufs"), -24.0, -8.0)).otherwise(c("_own_target_lufs"))}
    skipped = ~F.coalesce(c("use_denoise"), F.lit(True)) & (c("mode") == "denoise")
    rows = flat(rows.withColumn("mode", F.when(skipped, "none").otherwise(c("mode"))), "_base_", matched)
    by_hand, chosen = manual(of("_base_"), c("manual"))
    rows = flat(rows.withColumn("manual_dsp", by_hand), "_final_", chosen)
    line = F.when(c("manual_dsp"), "manual fine-tuning on top of the target, with strict safety").otherwise(advice(of("_final_")))
    return without(rows.withColumns({"dsp_params": packed(of("_final_")), "advice": line}), "_own_", "_base_", "_final_")
