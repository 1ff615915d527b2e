"""Oscilloscope segments: serial event ids, pulse times, and the three-channel reference."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.config import ScopeConfig
from hodoscope.functions import numerics
from hodoscope.functions.columns import finite
from hodoscope.operators.timing import inverse_variance, three_corner_hat

#: A frame is a start bit, 16 id bits and a stop bit of 25 ns each.
FRAME_BITS, ID_BITS, BIT_SECONDS, LEAST_SWING = 18, 16, 25e-9, 0.2


def element(values: np.ndarray, f: float) -> float:
    """The sorted element at floor(f n), the last at most."""
    own = np.sort(values)
    return float(own[min(len(own) - 1, int(f * len(own)))]) if len(own) else math.nan


def smooth(wave: np.ndarray, window: int) -> np.ndarray:
    """Centred median of `window` samples, shrinking at the edges to the element at floor(n/2)."""
    r, n = window // 2, len(wave)
    if n <= 2 * r:
        return np.array([np.sort(wave[max(0, i - r) : i + r + 1])[len(wave[max(0, i - r) : i + r + 1]) // 2] for i in range(n)])
    out = np.empty(n)
    out[r : n - r] = np.sort(np.lib.stride_tricks.sliding_window_view(wave, 2 * r + 1), axis=1)[:, r]
    for i in (*range(r), *range(n - r, n)):
        near = np.sort(wave[max(0, i - r) : i + r + 1])
        out[i] = near[len(near) // 2]
    return out


def crossing(t: np.ndarray, a: np.ndarray, k: int, level: float) -> float:
    """Time at which the line from sample k-1 to k meets a level."""
    if not 0 < k < len(t):
        return math.nan
    rise = a[k] - a[k - 1]
    return float(t[k]) if rise == 0 else float(t[k - 1] + (level - a[k - 1]) / rise * (t[k] - t[k - 1]))


def decode_id(t: np.ndarray, a: np.ndarray, c: ScopeConfig) -> tuple[int, float] | None:
    """(event id, frame start in ns) of a serial frame, or None: level halfway between the 5 % and 95 % elements, first fall in the window."""
    if len(t) < FRAME_BITS:
        return None
    own = smooth(a, c.median_samples)
    lo, hi = element(own, 0.05), element(own, 0.95)
    level = (lo + hi) / 2
    if not math.isfinite(level) or hi - lo < LEAST_SWING:
        return None
    begin = max(1, int(np.searchsorted(t, c.event_id_window_ns[0] * 1e-9, "left")))
    end = int(np.searchsorted(t, c.event_id_window_ns[1] * 1e-9, "right"))
    falls = np.flatnonzero((own[begin - 1 : end - 1] > level) & (own[begin:end] <= level)) if end > begin else []
    if not len(falls):
        return None
    start = crossing(t, own, begin + int(falls[0]), level)
    at = start + (np.arange(FRAME_BITS) + 0.5) * BIT_SECONDS
    k = np.searchsorted(t, at, "left")
    if (k >= len(t)).any():
        return None
    left = np.maximum(k - 1, 0)
    k = np.where((k > 0) & (at - t[left] <= t[k] - at), left, k)
    bits = (own[k] < level).astype(int)
    if bits[0] != 1 or bits[-1] != 0:
        return None
    return int("".join(map(str, bits[1 : 1 + ID_BITS])), 2), start * 1e9


def pulse(t: np.ndarray, a: np.ndarray, frame_ns: float, c: ScopeConfig) -> tuple[str, float, float]:
    """(status, time in ns, amplitude) of a negative pulse in the window before a frame: fraction of the amplitude on the falling edge."""
    if len(t) < 10 or not math.isfinite(frame_ns):
        return "invalid", math.nan, math.nan
    begin = int(np.searchsorted(t, (frame_ns + c.signal_window_ns[0]) * 1e-9, "left"))
    end = int(np.searchsorted(t, (frame_ns + c.signal_window_ns[1]) * 1e-9, "right"))
    if begin < 2 or end <= begin + 1:
        return "invalid", math.nan, math.nan
    base = element(a[:begin], 0.5)
    low = begin + int(np.argmin(a[begin:end]))
    height = base - float(a[low])
    if not math.isfinite(height) or height < c.min_pulse_amplitude:
        return "below_amplitude", math.nan, height
    level = base - c.cfd_fraction * height
    k = np.arange(begin + 1, low + 1)
    falls = k[(a[k - 1] > level) & (a[k] <= level)]
    if not len(falls):
        return "no_crossing", math.nan, height
    when = crossing(t, a, int(falls[-1]), level) * 1e9
    return ("valid" if math.isfinite(when) else "no_crossing"), when, height


MEASURED = "file_index int, segment int, event_id long, frame_ns double, " + ", ".join(f"c{k}_status string, c{k}_time double, c{k}_amp double" for k in (1, 2, 3))


def measure(segments: DataFrame, c: ScopeConfig) -> DataFrame:
    """MEASURED rows from segments (file_index, segment, t0, dt, c1, c2, c3, c4 arrays): ids from channel 4, pulses from 1 to 3."""
    names = [f.strip().split()[0] for f in MEASURED.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                time = {k: r["t0"] + r["dt"] * np.arange(len(r[k])) for k in ("c1", "c2", "c3", "c4")}
                found = decode_id(time["c4"], np.asarray(r["c4"], float), c)
                row = [r["file_index"], r["segment"], *(found or (None, math.nan))]
                for k in ("c1", "c2", "c3"):
                    row += pulse(time[k], np.asarray(r[k], float), row[3], c)
                rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype({"event_id": "Int64"})

    return segments.select("file_index", "segment", "t0", "dt", "c1", "c2", "c3", "c4").mapInPandas(run, MEASURED)


def complete(measured: DataFrame) -> DataFrame:
    """Segments with an id and three valid pulses; times relative to the frame start."""
    ok = F.col("event_id").isNotNull()
    for k in (1, 2, 3):
        ok &= F.col(f"c{k}_status") == "valid"
    times = [(F.col(f"c{k}_time") - F.col("frame_ns")).alias(f"c{k}_time") for k in (1, 2, 3)]
    return measured.where(ok).select("event_id", F.col("frame_ns").alias("event_id_time"), *times, "c1_amp", "c2_amp", "c3_amp")


def status_counts(measured: DataFrame) -> DataFrame:
    """(channel, status, segments) and the distinct ids met, as channel 4."""
    each = measured.select(F.inline(F.array(*[F.struct(F.lit(k).alias("channel"), F.col(f"c{k}_status").alias("status")) for k in (1, 2, 3)])))
    ids = measured.select(F.lit(4).alias("channel"), F.lit("distinct_ids").alias("status"), F.col("event_id")).groupBy("channel", "status").agg(F.count_distinct("event_id").alias("segments"))
    return each.groupBy("channel", "status").agg(F.count("*").alias("segments")).unionByName(ids)


def reference_times(events: DataFrame, bins: int = 160) -> tuple[DataFrame, dict]:
    """events with reference_time, the inverse-variance mean of the three pulse times, and the fits it rests on."""
    widths, fits = [], {}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        d = events.select((F.col(f"c{a}_time") - F.col(f"c{b}_time")).alias("d")).where(finite(F.col("d")))
        fits[a, b] = core_width(d, "d", bins)
        widths.append(fits[a, b]["sigma"])
    variances = three_corner_hat(*widths)
    weights, resolution = inverse_variance(variances)
    value = sum((F.col(f"c{k}_time") * w for k, w in enumerate(weights, 1)), F.lit(0.0))
    return events.withColumn("reference_time", F.when(finite(F.lit(resolution)), value)), {"fits": fits, "variances": variances, "weights": weights, "resolution": resolution}


def core_width(df: DataFrame, value: str, bins: int) -> dict[str, float]:
    """Core Gaussian of a column: seeded by median and MAD, fitted to a histogram made in Spark."""
    mid = df.agg(F.percentile_approx(value, 0.5, 10000)).first()[0]
    if mid is None:
        return {"entries": 0, "mean": math.nan, "sigma": math.nan}
    mad = 1.4826 * (df.agg(F.percentile_approx(F.abs(F.col(value) - mid), 0.5, 10000)).first()[0] or 0.0) or 1e-9
    lo, width = mid - 6 * mad, 12 * mad / bins
    rows = df.withColumn("b", F.floor((F.col(value) - lo) / width).cast("int")).where(F.col("b").between(0, bins - 1)).groupBy("b").agg(F.count("*").alias("c")).collect()  # one row a bin
    counts = np.zeros(bins)
    for r in rows:
        counts[r["b"]] = r["c"]
    x = lo + (np.arange(bins) + 0.5) * width
    fit = numerics.counts_fit(counts, x, (counts.max(), mid, mad))
    if fit.ok:
        again = numerics.counts_fit(counts, x, tuple(fit.params), (fit.params[1] - 2.5 * fit.params[2], fit.params[1] + 2.5 * fit.params[2]))
        fit = again if again.ok else fit
    return {"entries": int(counts.sum()), "mean": float(fit.params[1]) if fit.ok else mid, "sigma": float(fit.params[2]) if fit.ok else mad}
