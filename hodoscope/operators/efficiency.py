"""Binned efficiencies, their intervals, non-uniformity, projections, margin scans and residual summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hodoscope.config import EfficiencyConfig
from hodoscope.functions import numerics
from hodoscope.functions.columns import finite, group_quantile, group_quantiles

AXES = ("x", "y", "2d")


def flat_bin(c: EfficiencyConfig, x: Column | None = None, y: Column | None = None) -> Column:
    """(bx-1)*ny + by-1 of a point in the half-open grid, NULL outside it and in excluded columns and rows."""
    x, y = F.col("pred_x") if x is None else x, F.col("pred_y") if y is None else y
    bx = F.floor((x - c.x_min) / (c.x_max - c.x_min) * c.x_bins) + 1
    by = F.floor((y - c.y_min) / (c.y_max - c.y_min) * c.y_bins) + 1
    ok = finite(x) & finite(y) & (x >= c.x_min) & (x < c.x_max) & (y >= c.y_min) & (y < c.y_max) & (bx <= c.x_bins) & (by <= c.y_bins)
    if c.exclude_x:
        ok &= ~bx.isin(*c.exclude_x)
    if c.exclude_y:
        ok &= ~by.isin(*c.exclude_y)
    return F.when(ok, ((bx - 1) * c.y_bins + by - 1).cast("int"))


def in_region(c: EfficiencyConfig, closed: bool = True) -> Column:
    """Fiducial cut: closed for row output and alignment, half-open for bins."""
    x, y = F.col("pred_x"), F.col("pred_y")
    if closed:
        return x.between(c.x_min, c.x_max) & y.between(c.y_min, c.y_max)
    return (x >= c.x_min) & (x < c.x_max) & (y >= c.y_min) & (y < c.y_max)


def grid(samples: DataFrame, margin: float, keys: tuple[str, ...] = ("det",)) -> DataFrame:
    """Counts per flat bin: total and passed per axis. samples: need_x, need_y, need_2d and flat_bin."""
    aggs = [F.count("*").alias("total"), *[F.count_if(F.col(f"need_{a}") <= margin).alias(f"passed_{a}") for a in AXES]]
    return samples.where("flat_bin IS NOT NULL").groupBy(*keys, "flat_bin").agg(*aggs)


def with_intervals(df: DataFrame, passed: str, total: str, level: float = 0.683, name: str = "") -> DataFrame:
    """df with low/high of the binomial interval of passed / total; rows of summaries, so a small table."""
    schema = df.withColumns({f"low{name}": F.lit(0.0), f"high{name}": F.lit(0.0)}).schema
    for f in (schema[f"low{name}"], schema[f"high{name}"]):
        f.nullable = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [numerics.clopper_pearson(int(p), int(t), level) if t else (None, None) for p, t in zip(frame[passed], frame[total])]
            yield frame.assign(**{f"low{name}": [g[0] for g in got], f"high{name}": [g[1] for g in got]})

    return df.mapInPandas(run, schema)


def summary(cells: DataFrame, c: EfficiencyConfig, keys: tuple[str, ...] = ("det",), intervals: bool = True) -> DataFrame:
    """Event-weighted efficiency over bins with enough entries, its interval, and the non-uniformity of bins per axis."""
    good = cells.where(F.col("total") >= max(1, c.min_entries_per_bin))
    eff = lambda a: F.col(f"passed_{a}") / F.col("total")
    aggs = [F.sum("total").alias("total_events"), F.count("*").alias("valid_bins")]
    for a in AXES:
        mean = F.avg(eff(a))
        aggs += [F.sum(f"passed_{a}").alias(f"passed_{a}"), (F.sum(f"passed_{a}") / F.sum("total")).alias(f"efficiency_{a}"), F.when(mean > 0, F.stddev_pop(eff(a)) / mean).otherwise(0.0).alias(f"nonuniformity_{a}")]
    out = good.groupBy(*keys).agg(*aggs)
    if intervals:
        for a in AXES:
            out = with_intervals(out, f"passed_{a}", "total_events", name=f"_{a}")
    return out


def projections(cells: DataFrame, c: EfficiencyConfig, axis: str, keys: tuple[str, ...] = ("det",)) -> DataFrame:
    """Efficiency along the grid's columns ("x") or rows ("y"), from bins with enough entries."""
    at = F.floor(F.col("flat_bin") / c.y_bins) + 1 if axis == "x" else F.pmod("flat_bin", F.lit(c.y_bins)) + 1
    good = cells.where(F.col("total") >= max(1, c.min_entries_per_bin)).withColumn("slice", at.cast("int"))
    return good.groupBy(*keys, "slice").agg(F.sum("total").alias("total"), *[(F.sum(f"passed_{a}") / F.sum("total")).alias(f"efficiency_{a}") for a in AXES])


def margins(c: EfficiencyConfig) -> list[float]:
    """Margins of the scan, up to half a step beyond its end, by repeated addition."""
    out, m = [], c.scan_min
    while c.scan_step > 0 and m <= c.scan_max + 0.5 * c.scan_step:
        out.append(m)
        m += c.scan_step
    return out


def margin_scan(samples: DataFrame, c: EfficiencyConfig, keys: tuple[str, ...] = ("det",)) -> DataFrame:
    """Efficiency per margin in one pass: samples are counted once per bin and step at which they begin to match.

    Bins with too few entries are left out; the counts per step are then summed up along the margins.
    """
    steps = margins(c)
    levels = F.array(*[F.lit(m) for m in steps])
    first = lambda a: F.size(F.filter(levels, lambda m: m < F.col(f"need_{a}")))
    rows = samples.where("flat_bin IS NOT NULL")
    fine = rows.groupBy(*keys, "flat_bin", *[first(a).alias(f"s_{a}") for a in AXES]).agg(F.count("*").alias("n"))
    big = fine.groupBy(*keys, "flat_bin").agg(F.sum("n").alias("total")).where(F.col("total") >= max(1, c.min_entries_per_bin)).select(*keys, "flat_bin")
    fine = fine.join(big, [*keys, "flat_bin"], "left_semi").groupBy(*keys, *[f"s_{a}" for a in AXES]).agg(F.sum("n").alias("n"))
    spread = fine.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    out = spread.groupBy(*keys, "step").agg(F.sum("n").alias("total_events"), *[(F.sum(F.when(F.col(f"s_{a}") <= F.col("step"), F.col("n")).otherwise(0)) / F.sum("n")).alias(f"efficiency_{a}") for a in AXES])
    return out.withColumn("margin", F.get(levels, F.col("step"))).drop("step")


def residual_summary(rows: DataFrame, axis: str, cut: float = 5.0, keys: tuple[str, ...] = ("det",)) -> DataFrame:
    """Per detector: rows, used ones (|res| below the cut), mean, rms, sigma68 and fractions of all rows within 1 mm.

    Also median, q16, q84; sigma68 is half the distance of the 16 % and 84 % elements.
    """
    res = F.col(f"res_{axis}")
    ok = F.coalesce(finite(res) & (F.abs(res) < cut), F.lit(False))
    base = rows.withColumn("__r", F.when(ok, res))
    stats = base.groupBy(*keys).agg(F.count("*").alias("rows"), F.count("__r").alias("used"), F.avg("__r").alias("mean"), F.stddev_pop("__r").alias("rms"), (F.count_if(F.coalesce(F.abs("__r") < 1.0, F.lit(False))) / F.count("*")).alias("within_1mm"))
    order = group_quantiles(base, list(keys), "__r", {"q16": (0.16, "round_fn1"), "median": (0.5, "round_fn1"), "q84": (0.84, "round_fn1")})
    return stats.join(order, list(keys), "left").withColumn("sigma68", (F.col("q84") - F.col("q16")) / 2)


def residual_range(rows: DataFrame, axis: str, keys: tuple[str, ...] = ("det",)) -> DataFrame:
    """Half-width of a residual map: 1.2 times the 99 % element of |res|, within 1 and 100."""
    own = rows.withColumn("__a", F.abs(F.col(f"res_{axis}")))
    q = group_quantile(own, list(keys), "__a", 0.99, "floor_fn", "p99")
    return q.select(*keys, F.least(F.greatest(F.col("p99") * 1.2, F.lit(1.0)), F.lit(100.0)).alias("half_width"))


def residual_fractions(rows: DataFrame, widths: DataFrame, axis: str, keys: tuple[str, ...] = ("det",)) -> DataFrame:
    """Shares of all rows within 3 and 5 widths of the mean. widths: keys, mean, sigma; a row a detector."""
    res = F.col(f"res_{axis}")
    both = rows.join(F.broadcast(widths), list(keys))
    near = lambda k: F.count_if(F.coalesce(F.abs(res - F.col("mean")) < k * F.col("sigma"), F.lit(False))) / F.count("*")
    return both.groupBy(*keys).agg(near(3).alias("within_3sigma"), near(5).alias("within_5sigma"))


def double_gaussian_fit(counts: pd.DataFrame) -> dict[str, float]:
    """Core and tail of a residual histogram (columns centre, count): core width, effective sigma, tail fraction."""
    x, n = counts["centre"].to_numpy(float), counts["count"].to_numpy(float)
    one = numerics.counts_fit(n, x)
    if not one.ok:
        return {"mean": math.nan, "core_sigma": math.nan, "tail_sigma": math.nan, "effective_sigma": math.nan, "tail_fraction": math.nan}
    a, m, s = one.params
    use = n > 0
    fit = numerics.least_squares(numerics.double_gaussian, x[use], n[use], np.array([a * 0.8, m, s * 0.8, a * 0.2, s * 2.5]), np.sqrt(n[use]))
    p = fit.params if fit.ok else np.array([a, m, s, 0.0, s])
    core, tail = sorted([(abs(p[2]), p[0]), (abs(p[4]), p[3])])
    area = core[0] * core[1] + tail[0] * tail[1]
    share = tail[0] * tail[1] / area if area else 0.0
    return {"mean": float(p[1]), "core_sigma": core[0], "tail_sigma": tail[0], "effective_sigma": math.sqrt(max((1 - share) * core[0] ** 2 + share * tail[0] ** 2, 0.0)), "tail_fraction": share}


def efficiency_report(samples: DataFrame, margin: float) -> DataFrame:
    """Per detector: eligible and matched events, losses, efficiencies with binomial errors, and y given x and the reverse."""
    ok = {a: F.col(f"need_{a}") <= margin for a in AXES}
    n = F.count("*")
    aggs = [n.alias("eligible")]
    for a in AXES:
        p = F.count_if(ok[a]) / n
        aggs += [F.count_if(ok[a]).alias(f"matched_{a}"), (n - F.count_if(ok[a])).alias(f"lost_{a}"), p.alias(f"efficiency_{a}"), F.sqrt(p * (1 - p) / n).alias(f"error_{a}")]
    aggs += [(F.count_if(ok["x"] & ok["y"]) / F.nullif(F.count_if(ok["x"]), F.lit(0))).alias("y_given_x"), (F.count_if(ok["x"] & ok["y"]) / F.nullif(F.count_if(ok["y"]), F.lit(0))).alias("x_given_y")]
    return samples.groupBy("det").agg(*aggs)
