"""Fixed values of the recommendation rules, guards and stems, as plain tables."""

from __future__ import annotations

#: Listening targets in their order, and the parameters of each.
TARGETS = ["restore", "hifi_clean", "hifi_bright", "warm_analog", "loud_modern", "bass_boost", "voice_focus"]
PARAMETERS = ["lowcut_hz", "low_boost_db", "mid_cut_db", "high_boost_db", "compress_ratio", "target_lufs", "limiter_ceiling_db", "exciter_amount", "saturation_amount"]
PRESETS = {
    "restore": (35.0, 0.0, 0.0, 0.6, 1.2, -18.0, -1.5, 0.05, 0.02),
    "hifi_clean": (38.0, 0.4, 0.0, 1.0, 1.25, -16.0, -1.5, 0.08, 0.03),
    "hifi_bright": (40.0, 0.0, -0.6, 2.4, 1.25, -15.0, -1.7, 0.18, 0.02),
    "warm_analog": (35.0, 1.8, 0.0, -0.8, 1.45, -17.0, -1.5, 0.03, 0.16),
    "loud_modern": (38.0, 1.0, -0.3, 1.6, 2.8, -12.0, -1.2, 0.12, 0.1),
    "bass_boost": (30.0, 2.6, -0.4, 0.3, 1.7, -15.0, -1.7, 0.04, 0.08),
    "voice_focus": (110.0, -1.5, 0.8, 1.8, 1.8, -16.0, -1.5, 0.1, 0.04),
}
#: The presets of the light client (lowcut, low, mid, high, ratio, target, drive).
LIGHT_PRESETS = {
    "restore": (35.0, 0.0, 0.0, 0.6, 1.18, -18.0, 0.015),
    "hifi_clean": (38.0, 0.4, 0.0, 1.0, 1.22, -16.0, 0.025),
    "hifi_bright": (40.0, 0.0, -0.5, 2.2, 1.22, -15.0, 0.02),
    "warm_analog": (35.0, 1.4, 0.0, -0.7, 1.35, -17.0, 0.09),
    "loud_modern": (38.0, 0.8, -0.2, 1.4, 2.2, -12.5, 0.07),
    "bass_boost": (30.0, 2.3, -0.3, 0.2, 1.55, -15.0, 0.055),
    "voice_focus": (105.0, -1.2, 0.8, 1.5, 1.65, -16.0, 0.02),
}
#: Older names of targets.
TARGET_ALIASES = {
    "auto": "hifi_clean", "music": "hifi_clean", "natural": "hifi_clean", "archive": "restore",
    "loud": "loud_modern", "bass": "bass_boost", "low": "bass_boost", "voice": "voice_focus",
}
#: Lowest and highest value of each parameter, and its default.
BOUNDS = {
    "lowcut_hz": (20.0, 200.0, 80.0),
    "low_boost_db": (-6.0, 6.0, 0.0),
    "mid_cut_db": (-6.0, 6.0, 0.0),
    "high_boost_db": (-6.0, 6.0, 0.0),
    "compress_ratio": (1.0, 4.0, 1.0),
    "target_lufs": (-24.0, -10.0, -16.0),
    "limiter_ceiling_db": (-3.0, -0.8, -1.5),
    "exciter_amount": (0.0, 0.35, 0.0),
    "saturation_amount": (0.0, 0.35, 0.0),
}
#: Manual changes: parameter, key of the change, its lowest and highest value.
TWEAKS = [
    ("lowcut_hz", "lowcut_offset_hz", -80.0, 80.0),
    ("low_boost_db", "low_boost_delta_db", -6.0, 6.0),
    ("mid_cut_db", "mid_delta_db", -6.0, 6.0),
    ("high_boost_db", "high_boost_delta_db", -6.0, 6.0),
    ("compress_ratio", "compress_delta", -1.5, 2.0),
    ("target_lufs", "target_lufs_delta", -8.0, 8.0),
    ("exciter_amount", "exciter_delta", -0.35, 0.35),
    ("saturation_amount", "saturation_delta", -0.35, 0.35),
]
MANUAL_CEILING_DB = -1.5
#: Shares of each family of processing.
BUDGET_LIMITS = {"tone": 0.40, "dynamics": 0.30, "harmonics": 0.20, "stereo": 0.15, "stem": 0.35}
STEM_CAP = 0.45
VOCAL_STEM_CAP = 0.36
#: Remix gain, limit of a solved gain in dB, largest boost in dB when matched to the source.
STEM_GAINS = {
    "vocals": (0.95, 0.75, 2.0),
    "instrumental": (0.95, 0.75, 2.0),
    "drums": (0.92, 1.2, 1.4),
    "bass": (0.95, 1.0, 1.6),
    "other": (0.95, 0.75, 1.8),
}
#: Highest strength of a stem and the range of each parameter (None: open).
STEM_ROLES = {
    "vocals": (0.36, {"lowcut_hz": (115.0, None), "low_boost_db": (None, 0.0), "high_boost_db": (0.2, 0.85), "compress_ratio": (None, 1.28), "exciter_amount": (None, 0.018), "saturation_amount": (None, 0.012), "limiter_ceiling_db": (None, -2.0)}),
    "drums": (0.32, {"lowcut_hz": (None, 32.0), "low_boost_db": (-0.2, 0.7), "mid_cut_db": (-0.5, 0.3), "high_boost_db": (-0.1, 0.55), "compress_ratio": (None, 1.22), "exciter_amount": (None, 0.014), "saturation_amount": (None, 0.02), "limiter_ceiling_db": (None, -2.0)}),
    "bass": (0.38, {"lowcut_hz": (24.0, 34.0), "low_boost_db": (0.7, 2.1), "mid_cut_db": (-0.6, 0.2), "high_boost_db": (None, 0.15), "compress_ratio": (1.12, 1.55), "exciter_amount": (None, 0.01), "saturation_amount": (None, 0.03), "limiter_ceiling_db": (None, -2.1)}),
    "other": (0.30, {"lowcut_hz": (48.0, None), "low_boost_db": (-0.4, 0.35), "mid_cut_db": (-0.4, 0.2), "high_boost_db": (-0.2, 0.65), "compress_ratio": (None, 1.18), "exciter_amount": (None, 0.018), "saturation_amount": (None, 0.018), "limiter_ceiling_db": (None, -2.0)}),
    "instrumental": (0.40, {"high_boost_db": (None, 0.85), "compress_ratio": (None, 1.35), "exciter_amount": (None, 0.035), "saturation_amount": (None, 0.035), "limiter_ceiling_db": (None, -2.0)}),
}
STEM_ORDER = ["vocals", "instrumental", "drums", "bass", "other"]
#: What a stem is processed towards; others follow the song's own target.
STEM_TARGETS = {"vocals": "voice_focus", "drums": "restore", "bass": "bass_boost"}
#: Targets that pull against each other.
OPPOSING_TARGETS = [("restore", "loud_modern"), ("hifi_bright", "warm_analog"), ("bass_boost", "voice_focus")]
#: Weight of each check and worth of each status.
CHECK_WEIGHTS = {"loudness": 0.12, "true_peak": 0.19, "clipping": 0.16, "stereo": 0.16, "separation": 0.13, "transients": 0.13, "harshness": 0.11}
STATUS_WORTH = {"pass": 1.0, "review": 0.55, "fail": 0.0}
SEVERE_FLAGS = ["headroom_risk", "phase_correlation_loss", "transient_flattening", "high_band_harshness"]
CODEC_CEILING_DB = -1.4
FILE_EXTENSIONS = [".wav", ".mp3", ".m4a", ".flac"]
SAMPLE_RATES = [44100, 48000, 96000]
SILENCE_DB = -180.0
#: K-weighting shelf (Hz, dB, Q) and highpass (Hz).
K_SHELF = (1681.974450955533, 4.0, 0.7071752369554196)
K_HIGHPASS_HZ = 38.0
#: Bands of the stereo guards with the lowest and highest width relative to the source.
WIDTH_BANDS = [(20.0, 160.0, 0.0, 1.15), (160.0, 900.0, 0.72, 1.24), (900.0, 4200.0, 0.74, 1.30), (4200.0, 14000.0, 0.70, 1.35)]
DELTA_BANDS = [(20.0, 90.0, 0.0, 1.0), (90.0, 180.0, 0.0, 1.08), (180.0, 600.0, 0.72, 1.20), (600.0, 3500.0, 0.80, 1.18), (3500.0, 9000.0, 0.70, 1.12), (9000.0, 16000.0, 0.72, 1.32)]
#: Bands of the transient guard with their largest blend.
TRANSIENT_BANDS = [(45.0, 180.0, 0.075), (180.0, 1300.0, 0.115), (1300.0, 6200.0, 0.085)]
