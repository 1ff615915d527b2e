"""Hit maps and hit properties: all histograms of a stage in one scan of its rows, one partial aggregate, one long table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hodoscope.functions.columns import finite, group_quantiles

#: (keys, hist, x_low, x_high, x_bins, y_low, y_high, y_bins, bin_x, bin_y, count); y columns are null for one axis.
HIST = ("hist", "x_low", "x_high", "x_bins", "y_low", "y_high", "y_bins", "bin_x", "bin_y")


@dataclass(frozen=True)
class Axis:
    """Values and equal bins of a histogram's axis; bin 0 lies below low, bin n + 1 at or above high."""

    value: Column
    low: Column
    high: Column
    bins: Column

    def bin(self) -> Column:
        at = F.floor((self.value - self.low) / (self.high - self.low) * self.bins) + 1
        return F.when(finite(self.value), F.when(self.value < self.low, 0).when(self.value >= self.high, self.bins + 1).otherwise(F.least(at, self.bins))).cast("int")


def axis(value: Column, low: Column | float, high: Column | float, bins: Column | int) -> Axis:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return Axis(value.cast("double"), as_column(low).cast("double"), as_column(high).cast("double"), (bins if isinstance(bins, Column) else F.lit(bins)).cast("int"))


def fill(rows: DataFrame, keys: list[str], hists: dict[str, tuple[Axis, ...]]) -> DataFrame:
    """All of hists (one or two axes) over rows, per value of keys: one inline of (histogram, bins) a row and one aggregate.

    A row without a finite value on an axis takes no part in that histogram.
    """
    none, whole = F.lit(None).cast("double"), F.lit(None).cast("int")

    def entry(name: str, axes: tuple[Axis, ...]) -> Column:
        x, y = axes[0], axes[1] if len(axes) > 1 else None
        parts = (F.lit(name), x.low, x.high, x.bins, y.low if y else none, y.high if y else none, y.bins if y else whole, x.bin(), y.bin() if y else whole)
        two = F.struct(*(p.alias(n) for p, n in zip(parts, HIST)))
        return F.when(x.bin().isNotNull() & (y.bin().isNotNull() if y else F.lit(True)), two)

    each = F.filter(F.array(*(entry(n, a) for n, a in hists.items())), lambda e: e.isNotNull())
    return rows.select(*keys, F.inline(each)).groupBy(*keys, *HIST).agg(F.count("*").alias("count"))


def map_ranges(dets: DataFrame, plane_dim: DataFrame) -> DataFrame:
    """(det, x_low, x_high, y_low, y_high) of a detector's hit map.

    Strips: from 0 to pitch times count of planes 0 and 1, or to 1 where there is no such plane; pads: half a pitch around the
    outer pads; others from 0 to 1.
    """
    size = lambda p: F.max(F.when(F.col("plane") == p, F.col("pitch") * F.col("n_strips")))
    strips = plane_dim.groupBy("det").agg(size(0).alias("x"), size(1).alias("y"))
    both = dets.select("det", "type", "pad_rows", "pad_columns", "pad_pitch_x", "pad_pitch_y").join(strips, "det", "left")
    pad, flat = F.col("type") == "planar_pad", F.col("type") == "planar"
    high = lambda n, count, pitch: F.when(pad, (F.col(count) - 0.5) * F.col(pitch)).when(flat, F.coalesce(F.col(n), F.lit(1.0))).otherwise(1.0)
    low = lambda pitch: F.when(pad, -0.5 * F.col(pitch)).otherwise(0.0)
    return both.select("det", low("pad_pitch_x").alias("x_low"), high("x", "pad_columns", "pad_pitch_x").alias("x_high"), low("pad_pitch_y").alias("y_low"), high("y", "pad_rows", "pad_pitch_y").alias("y_high"))


def hit_maps(hits: DataFrame, ranges: DataFrame, names: dict[str, tuple[str, str]], bins: int = 100) -> DataFrame:
    """Maps of hits (det and coordinates) over map_ranges: names gives each map's two coordinate columns."""
    span = ranges.select("det", *(F.col(c).alias(f"m_{c}") for c in ("x_low", "x_high", "y_low", "y_high")))  # a row a detector
    both = hits.join(span, "det")
    return fill(both, ["det"], {n: (axis(F.col(x), F.col("m_x_low"), F.col("m_x_high"), bins), axis(F.col(y), F.col("m_y_low"), F.col("m_y_high"), bins)) for n, (x, y) in names.items()})


def profiles(maps: DataFrame, side: str) -> DataFrame:
    """(det, hist, bin, count): maps summed onto one axis ("x" or "y"), bins outside the other axis' range left out."""
    other = "y" if side == "x" else "x"
    inside = F.col(f"bin_{other}").between(1, F.col(f"{other}_bins"))
    return maps.where(inside).groupBy("det", "hist", F.col(f"bin_{side}").alias("bin")).agg(F.sum("count").alias("count"))


def hit_properties(rows: DataFrame, keys: list[str], shared: list[str], values: dict[str, str], bins: int = 100, trim: bool = False) -> DataFrame:
    """Histograms per keys of the properties `values` (name: column), over ranges from the data that `shared` keys have in common.

    A range begins at 0 or below and has 5 % on top, and below 0 where it begins there; whole numbers named size_... have a
    bin each from 1 on. trim: between the 0.5 % and 99.5 % elements instead, pushed apart by 1 where they are equal.
    """
    if trim:
        long = rows.select(*shared, F.inline(F.array(*(F.struct(F.lit(n).alias("p"), F.col(c).cast("double").alias("v")) for n, c in values.items()))))
        ends = group_quantiles(long, [*shared, "p"], "v", {"low": (0.005, "floor_fn1"), "high": (0.995, "floor_fn1")})
        pick = lambda n, c: F.max(F.when(F.col("p") == n, F.col(c)))
        spans = ends.groupBy(*shared).agg(*(pick(n, c).alias(f"{c}_{n}") for n in values for c in ("low", "high")))
    else:
        only = lambda c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("double"))
        spans = rows.groupBy(*shared).agg(*(f(only(c)).alias(f"{s}_{n}") for n, c in values.items() for s, f in (("low", F.min), ("high", F.max))))
    hists = {}
    for n, c in values.items():
        low, high = F.col(f"low_{n}"), F.col(f"high_{n}")
        if n.startswith("size"):
            count = F.greatest(high, F.lit(1.0))
            hists[n] = (axis(F.col(c), 0.5, count + 0.5, count.cast("int")),)
            continue
        if trim:
            flat = ~(high > low)
            hists[n] = (axis(F.col(c), F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high), bins),)
            continue
        a, b = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
        pad = 0.05 * (b - a)
        flat = ~(b > a)
        hists[n] = (axis(F.col(c), F.when(flat, a - 0.5).when(a < 0, a - pad).otherwise(a), F.when(flat, b + 0.5).otherwise(b + pad), bins),)
    return fill(rows.join(F.broadcast(spans), shared), keys, hists)  # a row a part of the set-up; few keys would leave few tasks
