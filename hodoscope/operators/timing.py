"""Cluster times, three-detector resolutions, T0 matching, time-walk correction and timing-window efficiency."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hodoscope.functions import numerics
from hodoscope.functions.columns import clamp, finite, group_quantiles, profile


def combined_time(method: str, power: float = 1.0, time: str = "time", error: str = "time_error", amp: str = "amp", plane: str = "plane") -> Column:
    """Aggregate: one time from strip times. Planes 0 and 1 are x and y; means weigh by 1/error^2 where errors are there.

    XYWeighted weighs by amplitude to a power, and is a plain mean without positive amplitudes. NULL without valid times.
    """
    use = F.col(plane).isin(*([0] if method.startswith("XM") else [1] if method.startswith("YM") else [0, 1]))
    ok = use & finite(F.col(time))
    t = F.when(ok, F.col(time))
    if method.endswith("Min"):
        return F.min(t)
    if method == "XYWeighted":
        w = F.when(ok & finite(F.col(amp)) & (F.col(amp) > 0), F.pow(F.col(amp), F.lit(power)))
    else:
        w = F.when(ok & finite(F.col(error)) & (F.col(error) > 0), 1 / (F.col(error) * F.col(error)))
    w = F.when(finite(w), w)
    total = F.sum(w)
    return F.coalesce(F.when(total > 0, F.sum(w * t) / F.nullif(total, F.lit(0.0))), F.avg(t))


def cluster_times(strips: DataFrame, keys: list[str], method: str, power: float = 1.0) -> DataFrame:
    return strips.groupBy(*keys).agg(combined_time(method, power).alias("t"))


def veto(strips: DataFrame, keys: list[str], most: float) -> DataFrame:
    """Drop groups in which a strip's amplitude exceeds `most`; a limit of 0 or less vetoes nothing."""
    if most <= 0:
        return strips
    return strips.withColumn("__a", F.max("amp").over(Window.partitionBy(*keys))).where(~F.coalesce(F.col("__a") > most, F.lit(False))).drop("__a")


def three_corner_hat(s12: float, s13: float, s23: float) -> tuple[float, float, float]:
    """Variances of three clocks from the widths of their differences; negative results are possible and are kept."""
    a, b, c = s12 * s12, s13 * s13, s23 * s23
    return (a + b - c) / 2, (a + c - b) / 2, (b + c - a) / 2


def inverse_variance(variances: tuple[float, ...]) -> tuple[list[float], float]:
    """Weights and resolution of the combination; all NaN unless every variance is positive."""
    if any(not math.isfinite(v) or v <= 0 for v in variances):
        return [math.nan] * len(variances), math.nan
    total = sum(1 / v for v in variances)
    return [1 / v / total for v in variances], 1 / math.sqrt(total)


def hat_columns(s12: Column, s13: Column, s23: Column) -> dict[str, Column]:
    """three_corner_hat and inverse_variance as columns v1..v3, w1..w3, resolution (NULL unless all variances are positive)."""
    v = {"v1": (s12 * s12 + s13 * s13 - s23 * s23) / 2, "v2": (s12 * s12 + s23 * s23 - s13 * s13) / 2, "v3": (s13 * s13 + s23 * s23 - s12 * s12) / 2}
    good = (v["v1"] > 0) & (v["v2"] > 0) & (v["v3"] > 0)
    inv = {k: 1 / F.when(good, c) for k, c in v.items()}
    total = inv["v1"] + inv["v2"] + inv["v3"]
    return v | {f"w{k[1]}": c / total for k, c in inv.items()} | {"resolution": 1 / F.sqrt(total)}


def subtract_reference(sigma: Column, mean_variance: Column) -> Column:
    """Intrinsic width after the reference's mean variance is taken off; NULL if that leaves less than nothing."""
    left = sigma * sigma - mean_variance
    return F.when(left >= 0, F.sqrt(left))


def combine_trackers(times: DataFrame, ids: tuple[int, int, int], weights: list[float]) -> DataFrame:
    """(entry, track_index, t1, t2, t3, track_time): tracks timed by all three trackers, and their weighted time."""
    pick = [F.max(F.when(F.col("det") == i, F.col("t"))).alias(f"t{k}") for k, i in enumerate(ids, 1)]
    wide = times.where(F.col("det").isin(*ids)).groupBy("entry", "track_index").agg(*pick).dropna(subset=["t1", "t2", "t3"])
    return wide.withColumn("track_time", sum((F.col(f"t{k}") * w for k, w in enumerate(weights, 1)), F.lit(0.0)))


def unique_references(times: DataFrame) -> DataFrame:
    """Events with exactly one qualifying track."""
    return times.withColumn("__n", F.count("*").over(Window.partitionBy("entry"))).where("__n = 1").drop("__n")


def unambiguous(df: DataFrame, key: str, what: str) -> DataFrame:
    """Rows whose key stands for one value of `what` only."""
    good = df.groupBy(key).agg(F.count_distinct(what).alias("__n")).where("__n = 1").select(key)
    return df.join(good, key, "left_semi")


def external_t0(tracks: DataFrame, scope: DataFrame) -> DataFrame:
    """tracks with the scope's reference time by raw event id; ids that are ambiguous on either side do not match.

    Ids are compared as they are: a 16-bit scope id never meets a larger raw id.
    """
    own = unambiguous(tracks, "raw_event_id", "entry").select("raw_event_id").distinct()
    ref = scope.where(finite(F.col("reference_time"))).groupBy("event_id").agg(F.count("*").alias("n"), F.first("reference_time").alias("external_t0")).where("n = 1")
    known = ref.join(own, ref["event_id"] == own["raw_event_id"], "left_semi").select(F.col("event_id").alias("raw_event_id"), "external_t0")
    return tracks.join(known, "raw_event_id", "left").withColumn("has_external_t0", F.col("external_t0").isNotNull())


def dut_strips(rows: DataFrame, references: DataFrame, members: DataFrame) -> DataFrame:
    """Strip timings of matched DUT clusters with the event's unique reference: by hit_flag bits 1 (x) and 2 (y), pads by any.

    A raw hit counts once for a DUT row, even if two clusters hold it.
    """
    x = rows.where(F.col("hit_flag").bitwiseAND(1) != 0).select("entry", "det", F.col("cluster_x").alias("cluster_idx"))
    y = rows.where(F.col("hit_flag").bitwiseAND(2) != 0).select("entry", "det", F.col("cluster_y").alias("cluster_idx"))
    chosen = x.union(y).where("cluster_idx IS NOT NULL").distinct()
    return chosen.join(references, "entry").join(members, ["entry", "det", "cluster_idx"]).dropDuplicates(["entry", "det", "raw_idx"])


def track_with_dut(tracks: DataFrame, duts: DataFrame) -> DataFrame:
    """Track timings with each DUT's time; one row with NULLs where there is no DUT time."""
    return tracks.join(duts.select("entry", "track_index", F.col("det").alias("dut_id"), F.col("t").alias("dut_time")), ["entry", "track_index"], "left").withColumn("dut_minus_track", F.col("dut_time") - F.col("track_time"))


def robust_range(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, high): the 0.5 % and 99.5 % elements; equal ends are pushed apart by 1."""
    both = group_quantiles(df, keys, value, {"low": (0.005, "floor_fn1"), "high": (0.995, "floor_fn1")})
    flat = ~(F.col("high") > F.col("low"))
    return both.select(*keys, F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))


def fit_width(df: DataFrame, value: str, bins: int = 160) -> dict[str, float]:
    """Gaussian of a residual within six rms of its mean, from a histogram made in Spark; moments where the fit fails."""
    ok = df.where(finite(F.col(value)))
    n, mean, rms = ok.agg(F.count("*"), F.avg(value), F.stddev_pop(value)).first()
    if not n:
        return {"entries": 0, "mean": math.nan, "sigma": math.nan, "sigma_error": math.nan}
    rms = rms or 1e-9
    lo, hi = mean - 6 * rms, mean + 6 * rms
    at = F.floor((F.col(value) - lo) / ((hi - lo) / bins)).cast("int")
    rows = ok.withColumn("b", at).where(F.col("b").between(0, bins - 1)).groupBy("b").agg(F.count("*").alias("c")).collect()  # one row a bin
    counts = np.zeros(bins)
    for r in rows:
        counts[r["b"]] = r["c"]
    fit = numerics.counts_fit(counts, lo + (np.arange(bins) + 0.5) * (hi - lo) / bins, (counts.max(), mean, rms))
    if not fit.ok:
        return {"entries": n, "mean": mean, "sigma": rms, "sigma_error": rms / math.sqrt(2 * n)}
    return {"entries": n, "mean": float(fit.params[1]), "sigma": float(fit.params[2]), "sigma_error": float(fit.errors[2])}


def time_walk(samples: DataFrame, amp: str, res: str, least: int = 20, bins: int = 100) -> dict | None:
    """Cubic of the residual over amplitude, of zero mean over the samples: {entries, low, high, parameter}, or None.

    The cubic is fitted to a profile made in Spark; its mean needs only the sums of the powers of the clamped amplitude.
    """
    ok = samples.where(finite(F.col(amp)) & finite(F.col(res))).withColumn("__all", F.lit(0))
    n = ok.count()
    if n < least:
        return None
    (a,), (r,) = (robust_range(ok, ["__all"], c).select("low", "high").collect() for c in (amp, res))
    rows = profile(ok, [], amp, res, (a["low"], a["high"], bins), (r["low"], r["high"])).collect()  # one row a bin
    width = (a["high"] - a["low"]) / bins
    x = np.array([a["low"] + (p["bin"] - 0.5) * width for p in rows])
    p = numerics.cubic_fit(x, np.array([p["mean"] for p in rows], float), np.array([p["error"] or 0.0 for p in rows], float))
    if p is None:
        return None
    v = clamp(F.col(amp), a["low"], a["high"])
    sums = ok.agg(*[F.avg(v**k) for k in (1, 2, 3)]).first()
    p = p.copy()
    p[0] -= p[0] + sum(float(c) * m for c, m in zip(p[1:], sums))
    return {"entries": n, "low": a["low"], "high": a["high"], "parameter": [float(c) for c in p]}


def amplitude_map(strips: DataFrame, keys: list[str], amp: str, res: str, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """(2-D counts, profile) of a residual over amplitude per key, each axis over its robust range cut into `bins`."""
    span = [robust_range(strips, keys, c).select(*keys, F.col("low").alias(f"{n}0"), F.col("high").alias(f"{n}1")) for n, c in (("a", amp), ("r", res))]
    own = strips.join(F.broadcast(span[0].join(span[1], keys)), keys).where(F.col(amp).between(F.col("a0"), F.col("a1")) & F.col(res).between(F.col("r0"), F.col("r1")))
    at = lambda v, n: F.least(F.floor((F.col(v) - F.col(f"{n}0")) / (F.col(f"{n}1") - F.col(f"{n}0")) * bins) + 1, F.lit(bins)).cast("int")
    own = own.withColumns({"bin_x": at(amp, "a"), "bin_y": at(res, "r")})
    counts = own.groupBy(*keys, "bin_x", "bin_y").agg(F.count("*").alias("count"))
    return counts, own.groupBy(*keys, "bin_x").agg(F.count("*").alias("count"), F.avg(res).alias("mean"), (F.stddev_pop(res) / F.sqrt(F.count("*"))).alias("error"))


def walk_column(amp: Column, walk: dict) -> Column:
    x, p = clamp(amp, walk["low"], walk["high"]), walk["parameter"]
    return F.when(finite(amp), F.lit(p[0]) + x * (F.lit(p[1]) + x * (F.lit(p[2]) + x * F.lit(p[3]))))


def corrected_times(strips: DataFrame, keys: list[str], walk: dict, method: str, power: float = 1.0) -> DataFrame:
    """Cluster times after the amplitude correction of each strip; strips without a correction take no part."""
    fixed = strips.withColumn("time", F.col("time") - walk_column(F.col("amp"), walk))
    return fixed.groupBy(*keys).agg(combined_time(method, power).alias("t"))


def window_efficiency(residuals: DataFrame, value: str, denominators: DataFrame, window: float, step: float, keys: list[str], most_bins: int = 20000) -> DataFrame:
    """Best fixed window per key: its start, count and efficiency; the first of equal maxima.

    Starts lie at the middles of equal steps from one window before the robust range to its end. Instead of joining starts
    with residuals, each residual is counted at the first and after the last start that hold it, and running sums over the
    starts (at most `most_bins` a key) give the counts. denominators: keys, denominator.
    """
    ok = residuals.where(finite(F.col(value)))
    span = robust_range(ok, keys, value).select(*keys, (F.col("low") - window).alias("lo"), F.col("high").alias("hi"))
    span = span.withColumn("bins", F.greatest(F.lit(1), F.least(F.lit(most_bins), F.ceil((F.col("hi") - F.col("lo")) / step).cast("int"))))
    span = span.withColumn("step", (F.col("hi") - F.col("lo")) / F.col("bins"))
    rows = ok.join(F.broadcast(span), keys)
    # start(b) = lo + (b + 0.5) step; held if start <= v <= start + window
    first = F.greatest(F.ceil((F.col(value) - window - F.col("lo")) / F.col("step") - 0.5), F.lit(0))
    last = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("step") - 0.5), F.col("bins") - 1)
    held = rows.withColumns({"first": first, "last": last}).where("first <= last")
    edges = held.select(*keys, F.inline(F.array(F.struct(F.col("first").alias("b"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("b"), F.lit(-1).alias("d")))))
    jumps = edges.groupBy(*keys, "b").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counts = jumps.withColumn("count", F.sum("d").over(w)).join(F.broadcast(span), keys).where("b < bins")
    best = counts.groupBy(*keys).agg(F.max_by(F.struct("count", "b"), F.struct("count", -F.col("b"))).alias("m"), F.first("lo").alias("lo"), F.first("step").alias("step"))
    out = best.select(*keys, F.col("m.count").alias("numerator"), (F.col("lo") + (F.col("m.b") + 0.5) * F.col("step")).alias("window_start"))
    out = out.join(F.broadcast(denominators), keys).where("denominator > 0")
    return out.withColumns({"window_end": F.col("window_start") + window, "efficiency": F.col("numerator") / F.col("denominator")})


def resolution_by_hat(times: DataFrame, ids: tuple[int, int, int], bins: int = 160) -> dict:
    """Pair widths of three detectors, their variances, weights and the resolution of their combination."""
    wide = combine_trackers(times, ids, [0.0, 0.0, 0.0])
    pairs = {}
    for a, b in ((1, 2), (1, 3), (2, 3)):
        pairs[a, b] = fit_width(wide.withColumn("d", F.col(f"t{a}") - F.col(f"t{b}")), "d", bins)
    variances = three_corner_hat(*(pairs[k]["sigma"] for k in ((1, 2), (1, 3), (2, 3))))
    weights, resolution = inverse_variance(variances)
    return {"pairs": pairs, "variances": variances, "weights": weights, "resolution": resolution}
