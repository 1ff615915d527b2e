"""Configuration: a JSON document read on the driver, validated as a whole, and turned into typed settings."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

SCRIPTS = ("TrackAnalysis", "DUTAnalysis", "PadDUTAnalysis", "TimeResolution", "OscilloscopeAnalysis", "ExampleScript")


@dataclass(frozen=True)
class HitConfig:
    """Waveform feature extraction (modes Default, FixedThreshold, Fit, Mode1)."""

    mode: str = "Default"
    cfd_fraction: float = 0.3
    threshold: float = 100.0
    saturation_level: float = 2000.0
    time_pitch: float = 25.0
    time_window_start: float = -50.0
    time_window_end: float = 500.0


@dataclass(frozen=True)
class ClusterConfig:
    max_gap: int = 0
    min_cluster_size: int = 1
    max_cluster_size: int = 10
    time_window_ns: float = math.inf
    connectivity: int = 4

    def __post_init__(self) -> None:
        if not self.time_window_ns >= 0:
            raise ValueError("timeWindowNs must not be negative")
        if self.connectivity not in (4, 8):
            raise ValueError("connectivity must be 4 or 8")


@dataclass(frozen=True)
class PositionConfig:
    method: str = "ChargeWeighted"
    weight_source: str = "amp"
    weight_power: float = 1.0
    drift_velocity: float = 0.022
    gas_gap: float = 5.0
    time_offset: float = 0.0
    strip_time_slope: float = 0.0
    charge_centroid_x_error: float = 0.3

    def __post_init__(self) -> None:
        if self.weight_source not in ("amp", "charge"):
            raise ValueError("weightSource must be amp or charge")
        if self.weight_power < 0:
            raise ValueError("weightPower must not be negative")
        for name in ("drift_velocity", "gas_gap", "charge_centroid_x_error"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if self.method not in ("ChargeWeighted", "UTPC", "rawUTPC", "PadChargeWeighted"):
            object.__setattr__(self, "method", "ChargeWeighted")


@dataclass(frozen=True)
class TrackConfig:
    """Defaults are those of the tracking script, which differ from those of the bare algorithm (gate 5, chi2 25)."""

    resolution_x: float = 0.12
    resolution_y: float = 0.12
    gate_sigma: float = 3.0
    max_chi2_ndf: float = 10.0
    max_branches_per_layer: int = 3
    max_candidates: int = 4000
    max_tracks: int = 32
    conflict_search_nodes: int = 20000
    final_candidates: int = 80


@dataclass(frozen=True)
class AlignmentConfig:
    max_iterations: int = 30
    min_tracks: int = 20
    max_function_calls: int = 600
    max_shift_step: float = 0.2
    max_rotation_step: float = 0.001
    relative_loss_tolerance: float = 1e-4
    convergence_patience: int = 3
    huber_k: float = 2.5
    shift_tolerance: float = 1e-3
    rotation_tolerance: float = 1e-6


@dataclass(frozen=True)
class EfficiencyConfig:
    """The grid, exclusions (1-based columns and rows), matching margin, margin scan and accidental-match settings."""

    x_bins: int = 8
    x_min: float = 0.0
    x_max: float = 100.0
    y_bins: int = 7
    y_min: float = 0.0
    y_max: float = 100.0
    min_entries_per_bin: int = 1
    exclude_x: tuple[int, ...] = ()
    exclude_y: tuple[int, ...] = ()
    margin: float = 0.6
    scan_min: float = 0.0
    scan_max: float = 2.0
    scan_step: float = 0.05
    fake_enabled: bool = True
    fake_seed: int = 12345
    fake_partners: int = 20

    def __post_init__(self) -> None:
        for a, b in (("x_min", "x_max"), ("y_min", "y_max")):
            lo, hi = ordered_range(getattr(self, a), getattr(self, b))
            object.__setattr__(self, a, lo)
            object.__setattr__(self, b, hi)
        for name, n in (("exclude_x", self.x_bins), ("exclude_y", self.y_bins)):
            object.__setattr__(self, name, clean_bins(getattr(self, name), n))


@dataclass(frozen=True)
class StripAlignmentConfig:
    """The region of predictions, in local mm, that the alignment of a strip DUT uses."""

    x_min: float = 0.0
    x_max: float = 100.0
    y_min: float = 0.0
    y_max: float = 100.0


@dataclass(frozen=True)
class PadAlignmentConfig:
    parameters: tuple[str, ...] = ("dx", "dy", "rotZ")
    min_matches: int = 100
    huber_delta: float = -1.0
    max_translation: float = 20.0
    max_rotation: float = 0.05
    tolerance: float = 0.005
    max_function_calls: int = 100000
    max_passes: int = 3
    shift_convergence: float = 0.01
    rotation_convergence: float = 1e-4


@dataclass(frozen=True)
class TimingConfig:
    histogram_bins: int = 160
    tracker_ids: tuple[int, ...] = ()
    analyze_dut_timing: bool = False
    window_ns: float = 25.0
    window_step_ns: float = 0.5
    time_method: str = "XYMean"
    amplitude_weight_power: float = 1.0
    maximum_strip_amplitude: float = -1.0
    waveform: HitConfig = field(default_factory=lambda: HitConfig(mode="Fit"))

    def __post_init__(self) -> None:
        if self.tracker_ids and (len(self.tracker_ids) != 3 or len(set(self.tracker_ids)) != 3):
            raise ValueError("trackerIDs must be three distinct ids")
        if self.maximum_strip_amplitude == 0:
            raise ValueError("maximumStripAmplitude must not be zero")
        if self.amplitude_weight_power < 0:
            raise ValueError("amplitudeWeightPower must not be negative")
        object.__setattr__(self, "time_method", time_method(self.time_method))


@dataclass(frozen=True)
class ScopeConfig:
    cfd_fraction: float = 0.5
    min_pulse_amplitude: float = 0.1
    histogram_bins: int = 160
    max_waveform_files: int = -1
    event_id_window_ns: tuple[float, float] = (-100.0, 0.0)
    median_samples: int = 5
    signal_window_ns: tuple[float, float] = (-160.0, -80.0)

    def __post_init__(self) -> None:
        if not 0 < self.cfd_fraction < 1:
            raise ValueError("cfdFraction must lie between 0 and 1")
        if not self.min_pulse_amplitude > 0:
            raise ValueError("minPulseAmplitude must be positive")
        if self.median_samples % 2 == 0:
            raise ValueError("median samples must be odd")
        if self.signal_window_ns[1] > 0:
            raise ValueError("the signal window must end at or before 0")


@dataclass(frozen=True)
class EventBuilderConfig:
    """Coincidence trigger and event window of time-ordered hits."""

    trigger_detector: int = 0
    trigger_channels: tuple[int, int] = (3, 7)
    time_offsets_ns: tuple[float, float] = (0.0, -3.958)
    trigger_threshold: int = 300
    coincidence_window_ns: float = 50.0
    dead_time_ns: float = 0.0
    window_offset_ns: float = 0.0
    before_ns: float = 250.0
    after_ns: float = 250.0
    hit_threshold: int = 0
    detectors: tuple[int, ...] = (1, 2, 3, 10)

    def __post_init__(self) -> None:
        if len(self.trigger_channels) != 2 or self.trigger_channels[0] == self.trigger_channels[1]:
            raise ValueError("the trigger needs two distinct channels")
        if min(self.coincidence_window_ns, self.dead_time_ns, self.before_ns, self.after_ns) < 0:
            raise ValueError("windows must not be negative")


TIME_METHODS = ("XMean", "XMin", "YMean", "YMin", "XYMean", "XYMin", "XYWeighted")


def time_method(name: str) -> str:
    """The time method of that name, whatever its case."""
    for known in TIME_METHODS:
        if known.lower() == name.lower():
            return known
    raise ValueError(f"unknown time method {name}; known: {', '.join(TIME_METHODS)}")


def ordered_range(lo: float, hi: float) -> tuple[float, float]:
    """A range the right way round; equal ends are widened by 1."""
    if hi < lo:
        lo, hi = hi, lo
    return (lo, hi + 1) if lo == hi else (lo, hi)


def clean_bins(bins: Any, n: int) -> tuple[int, ...]:
    """Sorted distinct bin numbers within 1..n."""
    return tuple(sorted({int(b) for b in bins if 1 <= int(b) <= n}))


def settings(cls: type, given: dict[str, Any], aliases: dict[str, str] | None = None) -> Any:
    """A settings object from a JSON object: camelCase or snake_case keys, unknown keys ignored, null means default."""
    flat = {k.replace("_", "").lower(): v for k, v in given.items()}
    for alias, name in (aliases or {}).items():
        if (v := flat.get(alias.lower())) is not None:
            flat.setdefault(name.replace("_", "").lower(), v)
    out = {}
    for f in fields(cls):
        v = flat.get(f.name.replace("_", ""))
        if v is not None:
            out[f.name] = tuple(v) if isinstance(v, list) else v
    return cls(**out)


def load_config(base: str | Path) -> dict[str, Any]:
    """config.json of a run directory, or of its raw/ folder."""
    for path in (Path(base, "config.json"), Path(base, "raw", "config.json")):
        if path.is_file():
            return json.loads(path.read_text())
    raise FileNotFoundError(f"no config.json in {base} or its raw folder")


def validate(config: Any, scripts_known: tuple[str, ...] = SCRIPTS) -> list[str]:
    """Every problem of a configuration, with the path of its field; an empty list if there is none.

    scripts_known: the names of analyses, with those that user code has registered.
    """
    bad: list[str] = []
    if not isinstance(config, dict):
        return ["config: must be an object"]
    mode = config.get("mode", "analysis")
    if mode not in ("analysis", "display"):
        bad.append("mode: must be analysis or display")
    conversion = config.get("conversion")
    if conversion is not None:
        if not isinstance(conversion, dict):
            bad.append("conversion: must be an object")
        else:
            if not isinstance(conversion.get("type"), str):  # wanted even where the conversion is switched off
                bad.append("conversion.type: must be a string")
            for key in ("enabled", "overwrite"):
                if key in conversion and not isinstance(conversion[key], bool):
                    bad.append(f"conversion.{key}: must be a boolean")
    detectors = config.get("detectors")
    if not isinstance(detectors, list) or not detectors:
        bad.append("detectors: must be a list with at least one entry")
    else:
        seen = set()
        for i, d in enumerate(detectors):
            if not isinstance(d, dict):
                bad.append(f"detectors[{i}]: must be an object")
                continue
            if not isinstance(d.get("id"), int):
                bad.append(f"detectors[{i}].id: must be an integer")
            elif d["id"] in seen:
                bad.append(f"detectors[{i}].id: {d['id']} is used twice")
            else:
                seen.add(d["id"])
            if d.get("type") not in ("planar", "planar_pad", "cylinder"):
                bad.append(f"detectors[{i}].type: must be planar, planar_pad or cylinder")
            for key in ("position", "rotation"):
                v = d.get(key, [0, 0, 0])
                if not isinstance(v, list) or len(v) != 3 or not all(isinstance(x, int | float) for x in v):
                    bad.append(f"detectors[{i}].{key}: must be three numbers")
    scripts = config.get("scripts")
    if not isinstance(scripts, list) or not scripts:
        bad.append("scripts: must be a list with at least one entry")
    else:
        for i, s in enumerate(scripts):
            if not isinstance(s, dict) or s.get("name") not in scripts_known:
                bad.append(f"scripts[{i}].name: must be one of {', '.join(scripts_known)}")
        if mode == "analysis" and not any(isinstance(s, dict) and s.get("enabled", True) for s in scripts):
            bad.append("scripts: at least one must be enabled")
    return bad
