"""Raw readouts to calibrated hits to channel features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hodoscope.config import HitConfig
from hodoscope.functions import numerics
from hodoscope.functions.columns import falling_crossing, finite, rising_crossing
from hodoscope.schemas import CHANNEL_HITS

HIT_FIELDS = ("det", "plane", "id0", "id1", "chip", "channel", "adc", "adc_value", "hit_time_ns")


def flatten(events: DataFrame, names: dict[str, str], keep: tuple[str, ...] = ("entry",)) -> DataFrame:
    """One row per position of an event's parallel arrays; raw_idx is the position.

    names: array column of events by its hit-level name. Arrays of unequal length are an error, as is a missing one.
    """
    arrays = list(names.values())
    sizes = F.array_distinct(F.array(*[F.size(a) for a in arrays]))
    checked = F.when(F.size(sizes) == 1, F.col(arrays[0])).otherwise(F.raise_error(F.concat_ws(" ", F.lit("unequal arrays in entry"), F.col("entry"))))
    safe = events.withColumn(arrays[0], checked)
    zipped = F.arrays_zip(*[F.col(a).alias(n) for n, a in names.items()])
    each = safe.select(*keep, F.posexplode(zipped).alias("raw_idx", "h"))
    return each.select(*keep, "raw_idx", *[F.col(f"h.{n}").alias(n) for n in names])


def to_short(x: Column) -> Column:
    """Round half away from zero and clamp to 16 bits."""
    return F.greatest(F.least(F.round(x), F.lit(32767.0)), F.lit(-32768.0)).cast("short")


def with_calibration(hits: DataFrame, channels: DataFrame) -> DataFrame:
    """Left join with the calibration of (det, plane, id0, id1): pedestal 0, sigma -1, gain 1, polarity 1 where there is none."""
    known = F.broadcast(channels.select("det", "plane", "id0", "id1", "pedestal", "noise_sigma", "gain", "polarity"))  # one row a channel of the set-up
    both = hits.join(known, ["det", "plane", "id0", "id1"], "left")
    return both.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in (("pedestal", 0.0), ("noise_sigma", -1.0), ("gain", 1.0), ("polarity", 1))})


def calibrate(hits: DataFrame) -> DataFrame:
    """Apply pedestal, gain and polarity to waveforms (rounded to 16 bits) and to scalar values (not rounded)."""
    fix = lambda s: (s - F.col("pedestal")) * F.col("gain") * F.col("polarity")
    return hits.withColumns({"adc": F.transform("adc", lambda s: to_short(fix(s.cast("double")))), "adc_value": fix(F.col("adc_value"))})


def zero_suppress(hits: DataFrame, n_sigma: float = 3.0) -> DataFrame:
    """Drop waveforms whose maximum is at most n_sigma * sigma * |gain|, and empty ones; channels of unknown sigma stay."""
    low = F.array_max("adc") <= n_sigma * F.col("noise_sigma") * F.abs("gain")
    empty = F.coalesce(F.size("adc") == 0, F.lit(True))
    return hits.where(~((F.col("noise_sigma") >= 0) & (empty | F.coalesce(low, F.lit(True)))))


def read_hits(events: DataFrame, channels: DataFrame, names: dict[str, str], wanted: DataFrame | None = None, waveforms: bool = True) -> DataFrame:
    """The reader's chain: flatten, known ids, wanted detectors, calibration and, for waveforms, zero suppression."""
    rows = flatten(events, names).where("id0 >= 0")
    if wanted is not None:
        rows = rows.join(F.broadcast(wanted.select("det").distinct()), "det", "left_semi")
    for name, kind in (("adc", "array<short>"), ("adc_value", "double"), ("hit_time_ns", "double"), ("chip", "int"), ("channel", "int"), ("id1", "int")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(-1 if name == "id1" else None).cast(kind))
    rows = calibrate(with_calibration(rows, channels))
    return zero_suppress(rows) if waveforms else rows


def is_direct() -> Column:
    """A readout that comes digitised: amplitude and time are both there."""
    return finite(F.col("adc_value")) & finite(F.col("hit_time_ns"))


def direct_features(hits: DataFrame, c: HitConfig) -> DataFrame:
    """Features of digitised readouts."""
    v, zero = F.col("adc_value"), F.lit(0.0)
    return hits.where(is_direct()).select(
        "entry", "det", "plane", "id0", "id1", "raw_idx",
        v.alias("amp"), v.alias("charge"), zero.alias("peak_time"), F.col("hit_time_ns").alias("time"), zero.alias("rise_time"), zero.alias("width"), zero.alias("time_error"),
        (v >= c.saturation_level).alias("is_saturated"), (v >= c.threshold).alias("is_valid"),
    )


def waveform_features(hits: DataFrame, c: HitConfig) -> DataFrame:
    """Features of sampled waveforms by array expressions only (modes Default and FixedThreshold).

    The peak is the first largest sample above 0. Crossings are searched up to the peak for rises and after it for falls,
    and interpolated; missing ones are NULL. A hit without a time is invalid.
    """
    whole = float(int(c.threshold))  # the threshold is a whole number of ADC counts
    w = F.transform("adc", lambda s: s.cast("int"))
    base = hits.where(~is_direct()).withColumn("w", F.coalesce(w, F.array().cast("array<int>")))
    top = F.coalesce(F.array_max("w"), F.lit(0))
    base = base.withColumn("amp0", F.greatest(top, F.lit(0)))
    base = base.withColumn("peak0", F.when(F.col("amp0") > 0, F.array_position("w", F.col("amp0")).cast("int") - 1).otherwise(0))
    peak, amp, wave = F.col("peak0"), F.col("amp0"), F.col("w")
    base = base.withColumns({
        "r_thr": rising_crossing(wave, F.lit(whole), peak),
        "r_cfd": rising_crossing(wave, F.lit(c.cfd_fraction) * amp, peak),
        "r10": rising_crossing(wave, F.lit(0.10) * amp, peak),
        "r90": rising_crossing(wave, F.lit(0.90) * amp, peak),
        "f_thr": falling_crossing(wave, F.lit(whole), peak),
    })
    at = F.col("r_thr" if c.mode == "FixedThreshold" else "r_cfd") * c.time_pitch
    some = F.size("w") > 0
    valid = some & (amp >= c.threshold) & (amp <= c.saturation_level) & F.coalesce(at.between(c.time_window_start, c.time_window_end), F.lit(False))
    charge = F.aggregate(F.filter("w", lambda s: s > whole), F.lit(0).cast("double"), lambda acc, s: acc + s - whole)
    span = lambda a, b: F.when(F.col(b) >= F.col(a), (F.col(b) - F.col(a)) * c.time_pitch)
    return base.select(
        "entry", "det", "plane", "id0", "id1", "raw_idx",
        amp.cast("double").alias("amp"), charge.alias("charge"), (peak * c.time_pitch).cast("double").alias("peak_time"), at.alias("time"), span("r10", "r90").alias("rise_time"), span("r_thr", "f_thr").alias("width"), F.lit(0.0).alias("time_error"),
        (some & (amp > c.saturation_level)).alias("is_saturated"), valid.alias("is_valid"),
    )


def _shape(wave: np.ndarray, threshold: int) -> tuple[int, int, int, int]:
    """(peak amplitude, its sample, first sample over threshold or -1, summed samples over threshold)."""
    over = np.flatnonzero(wave > threshold)
    peak = int(wave.argmax()) if len(wave) and wave.max() > 0 else 0
    amp = int(wave[peak]) if len(wave) and wave.max() > 0 else 0
    return amp, peak, int(over[0]) if len(over) else -1, int(wave[over].sum()) if len(over) else 0


def fit_edge(wave: np.ndarray, c: HitConfig) -> dict:
    """Features from a sigmoid fitted to the leading edge: time at the constant fraction, error from the fit's errors."""
    amp, peak, first, charge = _shape(wave, int(c.threshold))
    ok = len(wave) > 0 and int(c.threshold) <= amp <= c.saturation_level
    out = {"amp": float(amp), "charge": float(charge), "peak_time": peak * c.time_pitch, "width": None, "is_saturated": amp > c.saturation_level}
    lo, hi = max(0, first - 5), min(len(wave) - 1, peak + 1)
    x = np.arange(lo, hi + 1, dtype=float)
    if not ok or len(x) < 4:
        return out | {"time": first * c.time_pitch, "rise_time": None, "time_error": None, "is_valid": False}
    # the edge's own width seeds the fit: a fixed wide seed would leave short edges to chance
    fits = [numerics.least_squares(numerics.sigmoid_edge, x, wave[lo : hi + 1].astype(float), np.array([amp, 0.0, (peak + first) / 2, tau])) for tau in (15.0, max(0.3, (peak - first) / 4))]
    fit = min(fits, key=lambda f: f.chi2 if np.isfinite(f.chi2) else np.inf)
    a, b, x0, tau = fit.params
    target = c.cfd_fraction * a + b
    ends = numerics.sigmoid_edge(np.array([lo, hi], float), fit.params)
    at = float(first)
    if ends.min() <= target <= ends.max() and 0 < c.cfd_fraction < 1:
        at = float(np.clip(x0 - tau * np.log(1 / c.cfd_fraction - 1), lo, hi))
    error = float(np.hypot(fit.errors[2], np.log(1 / c.cfd_fraction - 1) * fit.errors[3]))
    ns = at * c.time_pitch
    valid = fit.ok and c.time_window_start <= ns <= c.time_window_end
    return out | {"time": ns, "rise_time": float(tau * 2 * np.log(9.0) * c.time_pitch), "time_error": error * c.time_pitch if np.isfinite(error) else None, "is_valid": bool(valid)}


def fit_pulse(wave: np.ndarray, c: HitConfig) -> dict:
    """Features from a power-exponential pulse: constant-fraction times before and after its maximum."""
    amp, peak, first, charge = _shape(wave, int(c.threshold))
    ok = len(wave) > 0 and int(c.threshold) <= amp <= c.saturation_level
    out = {"amp": float(amp), "charge": float(charge), "peak_time": peak * c.time_pitch, "time_error": 0.0, "is_saturated": amp > c.saturation_level}
    none = {"time": None, "rise_time": None, "width": None, "is_valid": False}
    lo, hi = max(0, first - 5), min(len(wave) - 1, 30)
    x = np.arange(lo, hi + 1, dtype=float)
    if not ok or first < 0 or len(x) < 6:
        return out | none
    start = np.array([amp, first - 1.0, max(peak, 1) / max(first, 1), 0.0, 1.0])
    fit = numerics.least_squares(numerics.power_pulse, x, wave[lo : hi + 1].astype(float), start, steps=120)
    _, t0, tau, base, n = fit.params
    if not np.isfinite(fit.params).all() or n < 0 or tau < 0 or t0 < 0:
        return out | none
    top = t0 + n * tau
    with np.errstate(all="ignore"):
        height = float(fit.params[0] * (n * tau) ** n * np.exp(-n))
    if not np.isfinite(height):
        return out | none
    value = lambda t: numerics.power_pulse(t, fit.params)
    # halved side by side: the constant fraction before and after the maximum, and its complement before
    a, b = np.array([0.0, top, 0.0]), np.array([top, 100.0, top])
    level = np.array([c.cfd_fraction, c.cfd_fraction, 1 - c.cfd_fraction]) * height + base
    fa = value(a) - level
    for _ in range(80):
        m = (a + b) / 2
        fm = value(m) - level
        same = (fm < 0) == (fa < 0)
        a, b, fa = np.where(same, m, a), np.where(same, b, m), np.where(same, fm, fa)
    early, late, high = ((a + b) / 2).tolist()
    return out | {"time": early * c.time_pitch, "rise_time": (high - early) * c.time_pitch, "width": (late - early) * c.time_pitch, "is_valid": True}


FITTED = {"Fit": fit_edge, "Mode1": fit_pulse}


def fitted_features(hits: DataFrame, c: HitConfig) -> DataFrame:
    """Waveform features that need a non-linear fit, in Arrow batches; a small file's waveforms are dealt to all cores too."""
    names = [f.strip().split()[0] for f in CHANNEL_HITS.split(",")]
    fit = FITTED[c.mode]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [fit(np.asarray([] if w is None else w, float), c) for w in frame["adc"]]
            got = pd.DataFrame(rows, index=frame.index, columns=[n for n in names if n not in frame.columns])
            yield pd.concat([frame.drop(columns="adc"), got], axis=1)[names]

    spark = hits.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    waves = hits.where(~is_direct()).select("entry", "det", "plane", "id0", "id1", "raw_idx", "adc")
    return waves.repartition(parts).mapInPandas(run, CHANNEL_HITS)


def channel_hits(hits: DataFrame, c: HitConfig) -> DataFrame:
    """Features of every readout: digitised ones directly, waveforms by the configured mode."""
    waves = fitted_features(hits, c) if c.mode in FITTED else waveform_features(hits, c)
    return direct_features(hits, c).unionByName(waves)


def power_spectra(hits: DataFrame, samples: int = 26) -> DataFrame:
    """(det, plane, frequency, power): mean power spectrum of waveforms of at least `samples` samples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(d, p, k, float(v)) for d, p, w in zip(frame["det"], frame["plane"], frame["adc"]) if len(w) >= samples for k, v in enumerate(numerics.power_spectrum(np.asarray(w[:samples], float)))]
            yield pd.DataFrame(out, columns=["det", "plane", "frequency", "power"])

    each = hits.where("adc IS NOT NULL").select("det", "plane", "adc").mapInPandas(run, "det int, plane int, frequency int, power double")
    return each.groupBy("det", "plane", "frequency").agg(F.avg("power").alias("power"), F.count("*").alias("waveforms"))
