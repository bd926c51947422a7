"""Names, addresses and request options as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import FILE_EXTENSIONS, SAMPLE_RATES, TARGET_ALIASES, TARGETS

_BLOCKED = r'[<>:"/\\|?*\x00-\x1f]'


def extension(name: Column) -> Column:
    """With its dot, in lower case; empty without one. A name that starts with its only dot has none."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^./](\.[^./]*)$", 1))


def is_supported(name: Column) -> Column:
    return extension(name).isin(FILE_EXTENSIONS)


def base_name(name: Column) -> Column:
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1)


def _clean(name: Column, length: int, fallback: str) -> Column:
    short = F.substring(F.regexp_replace(name, _BLOCKED, "_"), 1, length)
    trimmed = F.regexp_replace(short, r"^[ ._]+|[ ._]+$", "")
    return F.when(trimmed == "", F.lit(fallback)).otherwise(trimmed)


def _or(name: Column, fallback: str) -> Column:
    return F.when(F.trim(name) == "", F.lit(fallback)).otherwise(F.trim(name))


def safe_stem(name: Column, fallback: str = "audio") -> Column:
    """A file name without folder, extension and characters that file systems refuse, of 80 characters at most."""
    stem = F.regexp_replace(base_name(name), r"(?<=[^.])\.[^.]*$", "")
    return _clean(_or(stem, fallback), 80, fallback)


def safe_file_name(name: Column, fallback: str = "download.wav") -> Column:
    """The same with its extension, of 140 characters at most."""
    return _clean(_or(base_name(name), fallback), 140, fallback)


def _quoted(text: Column) -> Column:
    """Percent-encoded; of what form encoding leaves or changes, the space and two more characters differ."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def download_url(output: Column, name: Column) -> Column:
    return F.concat(F.lit("/api/download/"), _quoted(base_name(output)), F.lit("?name="), _quoted(safe_file_name(name)))


def bit_depth(option: Column) -> Column:
    value = F.trim(F.coalesce(option.cast("string"), F.lit("24")))
    return F.when(value.isin("16", "24"), value).otherwise(F.lit("24"))


def sample_rate(option: Column, source: Column, default: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(F.nullif(option, F.lit("")), F.lit("auto"))))
    asked = value.try_cast("int")
    return F.when(value == "source", source).when(asked.isin(SAMPLE_RATES), asked).otherwise(default).cast("int")


def default_sample_rate(source: Column) -> Column:
    return F.when(source < 32000, F.lit(44100)).otherwise(source).cast("int")


def _mode(value: Column, default: str, known: list[str]) -> Column:
    mode = F.lower(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit(default))))
    return F.when(mode.isin(known), mode).otherwise(F.lit(default))


def stem_mode(value: Column) -> Column:
    return _mode(value, "off", ["off", "2stem", "4stem"])


def stem_quality(value: Column, allow_precision: bool | Column = False) -> Column:
    mode = _mode(value, "balanced", ["fast", "balanced", "precision"])
    allowed = allow_precision if isinstance(allow_precision, Column) else F.lit(allow_precision)
    return F.when((mode == "precision") & ~allowed, F.lit("balanced")).otherwise(mode)


def separator_options(quality: Column) -> Column:
    """Arguments of the separator for a resolved quality."""
    words = lambda *w: F.array(*map(F.lit, w))
    return F.when(quality == "fast", words("--overlap", "0.10")).when(quality == "precision", words("-n", "htdemucs_ft", "--overlap", "0.35")).otherwise(words("--overlap", "0.25"))


def stem_minutes(mode: Column, quality: Column) -> Column:
    """The announced range of minutes; 1 without stems. An open end is null."""
    pair = lambda a, b: F.struct(F.lit(a).alias("least"), F.lit(b).cast("int").alias("most"))
    two = F.when(quality == "fast", pair(1, 3)).otherwise(pair(2, 5))
    four = F.when(quality == "fast", pair(2, 5)).when(quality == "precision", pair(8, None)).otherwise(pair(3, 7))
    return F.when(mode == "off", pair(0, 1)).when(mode == "2stem", two).otherwise(four)


def is_local_host(host: Column) -> Column:
    return F.coalesce(F.lower(host).rlike(r"^(localhost|::1|127(\.[0-9]{1,3}){3})$"), F.lit(False))


def targets(request: Column) -> Column:
    """Known targets of a comma-separated request, older names resolved, each once and in order; hifi_clean if there is none."""
    alias = F.create_map(*(F.lit(x) for pair in TARGET_ALIASES.items() for x in pair))
    parts = F.transform(F.split(F.coalesce(F.nullif(request, F.lit("")), F.lit("hifi_clean")), ","), lambda p: F.trim(p))
    known = F.filter(F.array_distinct(F.transform(parts, lambda p: F.coalesce(alias[p], p))), lambda p: p.isin(TARGETS))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("hifi_clean")))


def preview_targets(chosen: Column, most: int = 3) -> Column:
    """The chosen ones if there are two, else distinct defaults after them; ``most`` at most."""
    first = F.coalesce(F.get(chosen, F.lit(0)), F.lit("hifi_clean"))
    defaults = F.array_distinct(F.array(first, *(F.lit(t) for t in ("hifi_clean", "warm_analog", "bass_boost", "hifi_bright"))))
    return F.slice(F.when(F.size(chosen) >= 2, chosen).otherwise(defaults), 1, most)
