"""Quality tables: multiplicities, occupancies, peak samples, hit properties, cross-run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.functions.columns import bucket, finite
from hodoscope.operators.timing import robust_range


def channel_qa(hits: DataFrame) -> DataFrame:
    """hits with waveform_max and peak_sample (first largest)."""
    top = F.array_max("adc")
    return hits.withColumns({"waveform_max": top, "peak_sample": (F.array_position("adc", top) - 1).cast("int")})


def plane_qa(hits: DataFrame, samples: int = 30, adc_bins: int = 100, adc_max: float = 4096.0) -> DataFrame:
    """(det, plane, hist, bin, count): strip occupancy, maximum and peak-sample histograms in one long table."""
    own = channel_qa(hits)
    bins = F.array(
        F.struct(F.lit("occupancy").alias("hist"), F.col("id0").alias("bin")),
        F.struct(F.lit("maximum").alias("hist"), bucket(F.col("waveform_max").cast("double"), 0.0, adc_max, adc_bins).alias("bin")),
        F.struct(F.lit("peak_sample").alias("hist"), F.least(F.col("peak_sample"), F.lit(samples)).alias("bin")),
    )
    return own.select("det", "plane", F.inline(bins)).where("bin IS NOT NULL").groupBy("det", "plane", "hist", "bin").agg(F.count("*").alias("count"))


def multiplicity(hits: DataFrame, events: DataFrame) -> DataFrame:
    """(det, plane, hits, mean_multiplicity): hits per plane over all events, empty ones too."""
    n = events.select("entry").distinct().count()
    return hits.groupBy("det", "plane").agg(F.count("*").alias("hits")).withColumn("mean_multiplicity", F.col("hits") / F.lit(max(n, 1)))


def pad_mean_maximum(hits: DataFrame) -> DataFrame:
    """(det, id0, id1, mean_max, hits): mean waveform maximum per pad."""
    return channel_qa(hits.where("id1 >= 0")).groupBy("det", "id0", "id1").agg(F.avg("waveform_max").alias("mean_max"), F.count("*").alias("hits"))


def geometry_consistency(geometry: DataFrame) -> DataFrame:
    """(det, plane, n_chips, extents, ok): no plane mixes strips and pads, and a pad plane has a valid coordinate."""
    pad = F.col("id1").isNotNull() & (F.col("id1") >= 0)
    each = geometry.groupBy("det", "plane", "chip_id").agg(F.max(F.col("is_pad")).alias("is_pad"), F.min(F.when(pad, F.col("id0"))).alias("x0"), F.max(F.when(pad, F.col("id0"))).alias("x1"), F.min(F.when(pad, F.col("id1"))).alias("y0"), F.max(F.when(pad, F.col("id1"))).alias("y1"))
    out = each.groupBy("det", "plane").agg(F.count("*").alias("n_chips"), F.count_distinct("is_pad").alias("kinds"), F.max("is_pad").alias("is_pad"), F.min("x0").alias("id0_min"), F.max("x1").alias("id0_max"), F.min("y0").alias("id1_min"), F.max("y1").alias("id1_max"))
    return out.withColumn("ok", (F.col("kinds") == 1) & (~F.col("is_pad") | F.col("id0_max").isNotNull())).drop("kinds")


def hit_properties(members: DataFrame, value: str, keys: list[str], bins: int = 100, trim: bool = False) -> DataFrame:
    """Histogram of a property of selected hits over a range from the data: from 0 with 5 % on top, or the robust range."""
    if trim:
        span = robust_range(members, keys, value)
    else:
        span = members.where(finite(F.col(value))).groupBy(*keys).agg(F.least(F.min(value), F.lit(0.0)).alias("low"), (F.max(value) * 1.05).alias("high"))
        span = span.withColumn("high", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1))
    both = members.where(finite(F.col(value))).join(F.broadcast(span), keys)  # a row a detector
    b = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins) + 1, F.lit(bins + 1))
    return both.withColumn("bin", F.greatest(b, F.lit(0)).cast("int")).groupBy(*keys, "low", "high", "bin").agg(F.count("*").alias("count"))


def event_debug(hits: DataFrame, entry: int) -> DataFrame:
    """Largest sample per strip of one event."""
    return hits.where(F.col("entry") == entry).groupBy("det", "plane", "id0").agg(F.max(F.array_max("adc")).alias("maximum"))


def event_display(channel_hits: DataFrame, predictions: DataFrame, plane_dim: DataFrame, entry: int) -> DataFrame:
    """Channels of one event with amplitude, scaled time and the strip the track points to."""
    own = channel_hits.where(F.col("entry") == entry)
    p = predictions.where(F.col("entry") == entry).select("det", "pred_x", "pred_y")
    both = own.join(p, "det", "left").join(F.broadcast(plane_dim), ["det", "plane"], "left")
    u = F.col("pred_x") * F.cos(F.radians("angle_deg")) + F.col("pred_y") * F.sin(F.radians("angle_deg"))
    return both.select("entry", "det", "plane", "id0", "id1", "amp", ((F.col("time") - 81) * 0.021).alias("depth"), (u / F.col("pitch")).alias("predicted_strip"))


def run_summary(widths: DataFrame, efficiencies: DataFrame, fakes: DataFrame, voltages: DataFrame) -> DataFrame:
    """One row per run: core width, efficiency, accidental rate and voltage, by voltage then run; a run must have one summary row.

    The first detector below id 100 stands for a run.
    """
    first = efficiencies.where("det < 100").groupBy("run_id").agg(F.min("det").alias("det"))
    eff = efficiencies.join(first, ["run_id", "det"])
    one = eff.groupBy("run_id").agg(F.count("*").alias("n"), F.first("det").alias("det"), F.first("efficiency_2d").alias("efficiency_2d"))
    one = one.withColumn("efficiency_2d", F.when(F.col("n") == 1, F.col("efficiency_2d")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("not one summary row in run"), "run_id")).cast("double"))).drop("n")
    out = one.join(widths, ["run_id", "det"], "left").join(fakes.select("run_id", "det", F.col("efficiency_2d").alias("fake_2d")), ["run_id", "det"], "left")
    return out.join(F.broadcast(voltages), "run_id", "left").orderBy("voltage", "run_id")


def without_pads(cells: DataFrame, bad: DataFrame) -> DataFrame:
    """Cells less the masked (column, row) pads."""
    return cells.join(F.broadcast(bad.select("column", "row")), ["column", "row"], "left_anti")
