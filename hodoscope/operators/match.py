"""Clusters against predictions: nearest, envelope, soft and accidental matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hodoscope.functions.columns import finite

#: Events among which accidental partners are drawn.
RING = 4096


def strip_clusters(clusters: DataFrame, axes: DataFrame, plane_dim: DataFrame) -> DataFrame:
    """Clusters of the axis planes with `axis` ("x" or "y") and coordinates in mm: u of pos, centre of centroid."""
    axis = axes.select("det", F.explode(F.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array("plane_x", "plane_y"))).alias("axis", "plane"))
    dim = F.broadcast(axis.join(plane_dim, ["det", "plane"]).select("det", "plane", "axis", "pitch"))
    return clusters.join(dim, ["det", "plane"]).withColumns({"u": F.col("pos") * F.col("pitch"), "centre": F.col("centroid") * F.col("pitch")})


def nearest_clusters(pred: DataFrame, own: DataFrame) -> DataFrame:
    """pred (entry, det, pred_x, pred_y, ...) with the nearest cluster per axis, however far; the lowest cluster wins ties.

    Adds hit_x, res_x, cluster_x, the same of y, and hit_flag: 1 for x plus 2 for y. own: strip_clusters.
    """
    near = own.join(pred.select("entry", "det", "pred_x", "pred_y"), ["entry", "det"])
    res = F.col("u") - F.when(F.col("axis") == "x", F.col("pred_x")).otherwise(F.col("pred_y"))
    near = near.withColumn("res", res).where(finite(F.col("res")))
    best = near.groupBy("entry", "det", "axis").agg(F.min_by(F.struct("u", "res", "cluster_idx"), F.struct(F.abs("res"), "cluster_idx")).alias("b"))
    pick = lambda a: F.max(F.when(F.col("axis") == a, F.col("b")))
    wide = best.groupBy("entry", "det").agg(pick("x").alias("best_x"), pick("y").alias("best_y"))
    out = pred.join(wide, ["entry", "det"], "left")
    for a in "xy":
        out = out.withColumns({f"hit_{a}": F.col(f"best_{a}.u"), f"res_{a}": F.col(f"best_{a}.res"), f"cluster_{a}": F.col(f"best_{a}.cluster_idx")})
    flag = F.when(F.col("hit_x").isNotNull(), 1).otherwise(0) + F.when(F.col("hit_y").isNotNull(), 2).otherwise(0)
    return out.withColumn("hit_flag", flag).drop("best_x", "best_y")


def strip_envelopes(own: DataFrame) -> DataFrame:
    """(entry, det, axis, intervals): per event and axis the spans of its clusters' strips in mm."""
    lo, hi = F.array_min("members.id0") * F.col("pitch"), F.array_max("members.id0") * F.col("pitch")
    return own.groupBy("entry", "det", "axis").agg(F.sort_array(F.collect_list(F.struct(lo.alias("low"), hi.alias("high")))).alias("intervals"))


def required_extension(at: Column, intervals: Column) -> Column:
    """By how much intervals must grow for the nearest to hold a coordinate; infinite without intervals."""
    away = F.transform(intervals, lambda i: F.when(at < i["low"], i["low"] - at).when(at > i["high"], at - i["high"]).otherwise(0.0))
    return F.coalesce(F.array_min(away), F.lit(float("inf")))


def strip_samples(pred: DataFrame, envelopes: DataFrame) -> DataFrame:
    """One row per prediction with need_x, need_y, need_2d: the margins at which it counts as matched per axis and in both."""
    pick = lambda a: F.max(F.when(F.col("axis") == a, F.col("intervals")))
    wide = envelopes.groupBy("entry", "det").agg(pick("x").alias("ix"), pick("y").alias("iy"))
    out = pred.join(wide, ["entry", "det"], "left")
    out = out.withColumns({"need_x": required_extension(F.col("pred_x"), F.col("ix")), "need_y": required_extension(F.col("pred_y"), F.col("iy"))})
    return out.withColumn("need_2d", F.greatest("need_x", "need_y"))


def pad_envelopes(clusters: DataFrame, dets: DataFrame) -> DataFrame:
    """(entry, det, boxes): per cluster the union of its pads' rectangles, by half the pad size around each centre."""
    dim = F.broadcast(dets.where("type = 'planar_pad'").select("det", "pad_pitch_x", "pad_pitch_y", "pad_size_x", "pad_size_y"))
    both = clusters.join(dim, "det")
    side = lambda a, agg, i, s: agg(f"members.{i}") * F.col(f"pad_pitch_{a}") + s * F.col(f"pad_size_{a}") / 2
    box = F.struct("cluster_idx", "local_x", "local_y", side("x", F.array_min, "id0", -1).alias("x_low"), side("x", F.array_max, "id0", 1).alias("x_high"), side("y", F.array_min, "id1", -1).alias("y_low"), side("y", F.array_max, "id1", 1).alias("y_high"))
    return both.groupBy("entry", "det").agg(F.sort_array(F.collect_list(box)).alias("boxes"))


def _box_need(b: Column) -> tuple[Column, Column]:
    def away(at: Column, lo: Column, hi: Column) -> Column:
        return F.when(at < lo, lo - at).when(at > hi, at - hi).otherwise(0.0)

    return away(F.col("pred_x"), b["x_low"], b["x_high"]), away(F.col("pred_y"), b["y_low"], b["y_high"])


def pad_samples(pred: DataFrame, envelopes: DataFrame) -> DataFrame:
    """As strip_samples for pads; in two dimensions one and the same cluster must reach in both axes."""
    out = pred.join(envelopes, ["entry", "det"], "left")
    far = F.lit(float("inf"))
    need = {
        "need_x": F.array_min(F.transform("boxes", lambda b: _box_need(b)[0])),
        "need_y": F.array_min(F.transform("boxes", lambda b: _box_need(b)[1])),
        "need_2d": F.array_min(F.transform("boxes", lambda b: F.greatest(*_box_need(b)))),
    }
    return out.withColumns({k: F.coalesce(v, far) for k, v in need.items()})


def pad_nearest(samples: DataFrame, margin: float) -> DataFrame:
    """Of the clusters whose envelope, grown by the margin, holds the prediction, the nearest one; the lowest wins ties."""
    ok = F.filter("boxes", lambda b: F.greatest(*_box_need(b)) <= margin)
    dist = F.transform(ok, lambda b: F.struct(((b["local_x"] - F.col("pred_x")) ** 2 + (b["local_y"] - F.col("pred_y")) ** 2).alias("d"), b["cluster_idx"].alias("cluster_idx"), b["local_x"].alias("x"), b["local_y"].alias("y")))
    best = samples.withColumn("best", F.array_min(dist))
    out = best.withColumns({"cluster_idx": F.col("best.cluster_idx"), "hit_x": F.col("best.x"), "hit_y": F.col("best.y")})
    out = out.withColumns({"res_x": F.col("hit_x") - F.col("pred_x"), "res_y": F.col("hit_y") - F.col("pred_y")})
    return out.withColumn("hit_flag", F.when(F.col("cluster_idx").isNotNull(), 1).otherwise(0)).drop("best")


def soft_match(pred: DataFrame, own: DataFrame, sigma: float) -> DataFrame:
    """(entry, det, axis, residual, dominance): Gaussian-weighted mean residual over all clusters of an axis.

    Weights are taken relative to the best residual, so they stay finite while the geometry is far off.
    """
    near = own.join(pred.select("entry", "det", "pred_x", "pred_y"), ["entry", "det"])
    near = near.withColumn("res", F.col("centre") - F.when(F.col("axis") == "x", F.col("pred_x")).otherwise(F.col("pred_y"))).where(finite(F.col("res")))
    low = F.min(F.col("res") ** 2).over(Window.partitionBy("entry", "det", "axis"))
    near = near.withColumn("r0", low).withColumn("w", F.exp(-(F.col("res") ** 2 - F.col("r0")) / (2 * sigma * sigma)))
    return near.groupBy("entry", "det", "axis").agg((F.sum(F.col("w") * F.col("res")) / F.sum("w")).alias("residual"), (F.max("w") / F.sum("w")).alias("dominance"))


def residual_slope(matched: DataFrame, at: str, res: str, least: int = 100) -> DataFrame:
    """Slope of a residual against position per detector, where there are enough rows."""
    rows = matched.where(finite(F.col(at)) & finite(F.col(res)))
    return rows.groupBy("det").agg(F.regr_slope(res, at).alias("slope"), F.count("*").alias("n")).where(F.col("n") >= least)


#: Fixed numbers of the draw: a prime modulus and multipliers, so that any engine with 64-bit whole numbers draws the same.
PRIME, FIRST, SECOND, SEEDS, DETS = 2_147_483_647, 48_271, 16_807, 69_621, 7919


def mixed(number: Column, seed: int) -> Column:
    """A number below PRIME made of a whole number and a seed: u = number * FIRST + seed * SEEDS, then u * u * SECOND + 7 u + seed."""
    u = F.pmod(F.pmod(number, F.lit(PRIME)) * FIRST + seed * SEEDS, F.lit(PRIME))
    return F.pmod(F.pmod(u * u, F.lit(PRIME)) * SECOND + 7 * u + seed, F.lit(PRIME))


def fake_partners(events: DataFrame, seed: int, partners: int) -> DataFrame:
    """(det, entry, partner): for each strict event of a detector `partners` distinct random others.

    A seeded integer mix deals a detector's events to rings of about RING events and orders each ring; an event's partners stand
    at strides spread over its ring. Sorting stands for drawing, so the choice is reproducible, needs no all-pairs step, and
    no task holds more than a ring.
    """
    counts = events.groupBy("det").agg(F.ceil(F.count("*") / RING).alias("rings"))
    dealt = events.select("det", "entry").join(counts, "det").withColumn("ring", F.pmod(mixed(F.col("entry"), seed + 1), F.col("rings")))
    w = Window.partitionBy("det", "ring")
    ring = dealt.withColumns({"k": F.row_number().over(w.orderBy(mixed(F.col("entry"), seed), "entry")) - 1, "n": F.count("*").over(w)})
    steps = ring.where("n > 1").withColumn("j", F.explode(F.sequence(F.lit(1), F.least(F.lit(partners), F.col("n") - 1).cast("int"))))
    # strides spread over the ring; distinct for distinct j while j < n
    free = F.col("n") - 1
    spread = F.floor((F.col("j") - 1) * free / partners) + F.pmod(mixed(F.col("entry") + DETS * F.col("det"), seed + 2), F.greatest(F.floor(free / partners), F.lit(1)))
    stride = F.when(free <= partners, F.col("j")).otherwise(1 + F.pmod(spread, free))
    steps = steps.withColumn("to", F.pmod(F.col("k") + stride, F.col("n")))
    other = ring.select("det", "ring", F.col("k").cast("long").alias("to"), F.col("entry").alias("partner"))
    return steps.withColumn("to", F.col("to").cast("long")).join(other, ["det", "ring", "to"]).select("det", "entry", "partner")


def strip_fakes(samples: DataFrame, pairs: DataFrame, margin: float) -> DataFrame:
    """Accidental matches: a partner's prediction against the clusters that the event's own prediction leaves over.

    samples: strip_samples with flat_bin; rows come back with the partner's bin and need_x, need_y, need_2d.
    """
    left = lambda i, p: F.filter(i, lambda v: F.when(F.col(p) < v["low"], v["low"] - F.col(p)).when(F.col(p) > v["high"], F.col(p) - v["high"]).otherwise(0.0) > margin)
    source = samples.select("det", "entry", left("ix", "pred_x").alias("ix"), left("iy", "pred_y").alias("iy"))
    partner = samples.select("det", F.col("entry").alias("partner"), "pred_x", "pred_y", "flat_bin")
    both = pairs.join(source, ["det", "entry"]).join(partner, ["det", "partner"])
    both = both.withColumns({"need_x": required_extension(F.col("pred_x"), F.col("ix")), "need_y": required_extension(F.col("pred_y"), F.col("iy"))})
    return both.withColumn("need_2d", F.greatest("need_x", "need_y"))


def pad_fakes(samples: DataFrame, pairs: DataFrame, margin: float) -> DataFrame:
    """strip_fakes for pads: whole clusters that the event's own prediction matches are left out."""
    rest = F.filter("boxes", lambda b: F.greatest(*_box_need(b)) > margin)
    source = samples.select("det", "entry", rest.alias("boxes"))
    partner = samples.select("det", F.col("entry").alias("partner"), "pred_x", "pred_y", "flat_bin")
    both = pairs.join(source, ["det", "entry"]).join(partner, ["det", "partner"])
    far = F.lit(float("inf"))
    return both.withColumns({"need_x": F.coalesce(F.array_min(F.transform("boxes", lambda b: _box_need(b)[0])), far), "need_y": F.coalesce(F.array_min(F.transform("boxes", lambda b: _box_need(b)[1])), far), "need_2d": F.coalesce(F.array_min(F.transform("boxes", lambda b: F.greatest(*_box_need(b)))), far)})
