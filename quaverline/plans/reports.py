"""Lines of a report, one for each of its parts, in words of one shape: what was found, then what it means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import num
from ..functions.tables import BUDGET_LIMITS
from .rules import shown

#: Labels of the checks.
LABELS = {
    "loudness": "Loudness match", "true_peak": "True peak headroom", "clipping": "Clipping risk", "stereo": "Stereo image",
    "separation": "Band separation", "transients": "Transient retention", "harshness": "Harshness control",
}


def figure(pattern: str, value: Column, digits: int) -> Column:
    """A number within words, rounded by its exact value."""
    return F.format_string(pattern, shown(value, digits))


def percent(value: Column) -> Column:
    return figure("%.0f%%", value * 100.0, 0)


def _or(rule: Column, yes: str, no: str) -> Column:
    return F.when(rule, F.lit(yes)).otherwise(F.lit(no))


def summary_line(summary: Column, lufs_delta: Column, score: Column, overall: Column) -> Column:
    return F.concat_ws(
        "; ",
        F.when(summary["volume_matched"], F.lit("volume matched")).otherwise(figure("level changed by %+.1f dB", lufs_delta, 1)),
        _or(summary["headroom_safe"], "headroom safe", "check headroom"),
        _or(summary["clipping_safe"], "low clipping risk", "check clipping"),
        _or(summary["stereo_preserved"], "stereo preserved", "stereo changed"),
        F.concat(figure("validation %.0f", score, 0), F.lit(" ("), overall, F.lit(")")),
    )


def validation_line(checks: Column, score: Column, overall: Column) -> Column:
    """Verdict and score, and the first two checks that didn't pass with their details."""
    weak = F.slice(F.transform(F.filter(checks, lambda c: c["status"] != "pass"), lambda c: F.concat(c["label"], F.lit(": "), c["detail"])), 1, 2)
    return F.concat(overall, figure(" %.0f / 100: ", score, 0), F.when(F.size(weak) > 0, F.array_join(weak, " / ")).otherwise(F.lit("all checks stable")))


def adaptive_line(amount: Column, effective: Column, condition: Column) -> Column:
    """Strength as asked for and as used, in whole percents."""
    asked, used = F.floor(amount * 100.0 + 0.5), F.floor(effective * 100.0 + 0.5)
    return F.concat(F.format_string("%d%% to %d%% (%+d%%): ", asked.cast("int"), used.cast("int"), (used - asked).cast("int")), condition)


def budget_line(factors: Column) -> Column:
    parts = F.array_compact(F.array(*(F.when(factors[f] < 0.999, F.concat(F.lit(f"{f} "), percent(factors[f]))) for f in BUDGET_LIMITS)))
    return F.when(F.size(parts) > 0, F.concat(F.lit("limited: "), F.array_join(parts, " / "))).otherwise(F.lit("within budget"))


def harmonic_line(factor: Column) -> Column:
    return F.concat(F.lit("harmonics at "), percent(factor))


def stem_risk_line(average: Column, highest: Column, decision: Column) -> Column:
    return F.concat(figure("average %.2f, ", average, 2), figure("highest %.2f: ", highest, 2), decision)


def remix_line(applied: Column, gains: dict[str, Column], less: Column) -> Column:
    """Gains of the stems that are there, and by how much they lessen the error against the source."""
    each = F.array_compact(F.array(*(F.when(g.isNotNull(), F.concat(F.lit(f"{n} "), figure("%.2f", g, 2))) for n, g in gains.items())))
    return F.when(applied, F.concat(F.array_join(each, " / "), F.lit(", error less by "), percent(less))).otherwise(F.lit("default gains"))


def guard_line(severity: Column, flags: Column) -> Column:
    """How much of the source a drift brings back, and which it was."""
    blend = F.when(severity == "severe", num(0.35)).otherwise(num(0.15))
    return F.when(severity == "none", F.lit("no drift")).otherwise(F.concat(severity, F.lit(": source blended by "), percent(blend), F.lit(" / "), F.array_join(flags, ", ")))
