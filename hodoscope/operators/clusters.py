"""Hits to clusters to positions to local hits."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hodoscope.config import ClusterConfig, PositionConfig
from hodoscope.functions.columns import finite
from hodoscope.functions.geometry import to_global
from hodoscope.operators.grouped import component_labels, map_whole_groups

KEYS = ["entry", "det"]


def ordered_hits(hits: DataFrame) -> DataFrame:
    """hits with hit_idx, their place in an event's detector by plane, id1 and id0; raw_idx settles ties."""
    w = Window.partitionBy(*KEYS).orderBy("plane", "id1", "id0", "raw_idx")
    return hits.withColumn("hit_idx", F.row_number().over(w) - 1)


def strip_groups(hits: DataFrame, c: ClusterConfig) -> DataFrame:
    """Valid strip hits with `part`: hits of one part are one cluster.

    Without a time cut a part is a run of strips with gaps of at most max_gap: a window with a running count. With a time
    cut, links skip over hits of other times, so parts are connected components, found per event, detector and plane (a
    group is one event's readout of one plane).
    """
    valid = hits.where(F.col("is_valid") & (F.col("id1").isNull() | (F.col("id1") < 0)))
    if c.time_window_ns == float("inf"):
        w = Window.partitionBy(*KEYS, "plane").orderBy("id0", "raw_idx")
        gap = F.coalesce(F.col("id0") - F.lag("id0").over(w) > 1 + c.max_gap, F.lit(True))
        return valid.withColumn("__new", gap.cast("int")).withColumn("part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")
    schema = valid.withColumn("part", F.lit(0)).schema

    def link(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        ids, times = frame["id0"].to_numpy(), frame["time"].to_numpy(float)
        left, right = [], []
        for step in range(1, len(frame)):
            i = np.flatnonzero((group[step:] == group[:-step]) & (ids[step:] - ids[:-step] <= 1 + c.max_gap))
            if not len(i):
                break
            i = i[np.abs(times[i + step] - times[i]) <= c.time_window_ns]
            left.append(i)
            right.append(i + step)
        edges = [np.concatenate(e) if e else np.zeros(0, int) for e in (left, right)]
        return frame.assign(part=component_labels(len(frame), *edges).astype("int32"))

    return map_whole_groups(valid, [*KEYS, "plane"], link, schema, ["id0", "raw_idx"])


def pad_groups(hits: DataFrame, c: ClusterConfig) -> DataFrame:
    """Valid pad hits (id0 column, id1 row, both within the grid) with `part`: pads that touch, by 4 or 8 neighbours."""
    inside = hits.where(F.col("is_valid") & F.col("id0").between(0, F.col("pad_columns") - 1) & F.col("id1").between(0, F.col("pad_rows") - 1))
    schema = inside.withColumn("part", F.lit(0)).schema
    near = [(a, b) for a, b in ((1, 0), (0, 1), (1, 1), (-1, 1)) if c.connectivity == 8 or a == 0 or b == 0]

    def touch(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        # one number a pad: group, row and column; a step to a neighbour is a fixed difference
        pad = (group.astype(np.int64) << 40) | (frame["id1"].to_numpy(np.int64) << 20) | frame["id0"].to_numpy(np.int64)
        own, at = np.unique(pad, return_inverse=True)
        left, right = [], []
        for dx, dy in near:
            k = np.searchsorted(own, own + dx + (dy << 20))
            there = np.flatnonzero((k < len(own)) & (own[np.minimum(k, len(own) - 1)] == own + dx + (dy << 20)))
            left.append(there)
            right.append(k[there])
        return frame.assign(part=component_labels(len(own), np.concatenate(left), np.concatenate(right))[at].astype("int32"))

    return map_whole_groups(inside, [*KEYS, "plane"], touch, schema)


def _weight(c: PositionConfig) -> Column:
    v = F.col(c.weight_source)
    return v if c.weight_power == 1 else F.pow(F.greatest(v, F.lit(0.0)), F.lit(c.weight_power))


def build_clusters(groups: DataFrame, c: ClusterConfig, p: PositionConfig, pads: bool = False, plane_dim: DataFrame | None = None) -> DataFrame:
    """CLUSTERS plus `members` (hit_idx, raw_idx, id0, id1 in order): one row per part, of allowed size, numbered by first member.

    size counts distinct strips (pads: pads); range is their span (pads: the larger span). Position is the weighted mean of
    strip numbers, or the member in the middle where weights sum to nothing; drift-time methods replace it.
    """
    w = _weight(p)
    member = F.struct("hit_idx", "raw_idx", "id0", "id1", "amp", "charge", "time", "time_error")
    size = F.count_distinct(F.struct("id0", "id1")) if pads else F.count_distinct("id0")
    span = F.max("id0") - F.min("id0") + 1
    aggs = [
        size.cast("int").alias("size"),
        (F.greatest(span, F.max("id1") - F.min("id1") + 1) if pads else span).cast("int").alias("range"),
        F.sum("amp").alias("charge"),
        F.greatest(F.max("amp"), F.lit(0.0)).alias("max_amp"),
        F.min("time").alias("time"),
        F.sum(F.col("id0") * F.col("charge")).alias("__cs"), F.sum("charge").alias("__c"),
        ((F.max("id0") + F.min("id0")) / 2).alias("__mid"),
        F.sum(F.col("id0") * w).alias("__ws"), F.sum(w).alias("__w"),
        F.sort_array(F.collect_list(member)).alias("members"),
    ]
    if pads:
        pw = F.when(w > 0, w).otherwise(1.0)
        aggs += [(F.sum(pw * F.col("id0") * F.col("pad_pitch_x")) / F.sum(pw)).alias("local_x"), (F.sum(pw * F.col("id1") * F.col("pad_pitch_y")) / F.sum(pw)).alias("local_y")]
    out = groups.groupBy(*KEYS, "plane", "part").agg(*aggs).where(F.col("size").between(c.min_cluster_size, c.max_cluster_size))
    middle = F.get(F.col("members.id0"), F.floor(F.col("size") / 2).cast("int")).cast("double")
    out = out.withColumns({"centroid": F.when(F.col("__c") != 0, F.col("__cs") / F.col("__c")).otherwise(F.col("__mid")), "pos": F.when(F.col("__w") > 0, F.col("__ws") / F.col("__w")).otherwise(middle)})
    if not pads:
        out = out.withColumns({"local_x": F.lit(None).cast("double"), "local_y": F.lit(None).cast("double")})
    number = Window.partitionBy(*KEYS).orderBy(F.get("members.hit_idx", F.lit(0)))
    out = out.withColumn("cluster_idx", F.row_number().over(number) - 1)
    out = out.select(*KEYS, "plane", "cluster_idx", "size", "range", "charge", "max_amp", "time", "centroid", "pos", "local_x", "local_y", "members")
    return out


def drift_positions(clusters: DataFrame, t0: DataFrame, p: PositionConfig, plane_dim: DataFrame) -> DataFrame:
    """pos by drift times where the method asks for it and the event has a T0: clusters of planes other than 0 with 3 hits or more."""
    if p.method not in ("UTPC", "rawUTPC"):
        return clusters
    dim = F.broadcast(plane_dim.select("det", "plane", "pitch", "n_strips"))
    both = clusters.join(t0.select("entry", "t0"), "entry", "left").join(dim, ["det", "plane"], "left")
    iterated = p.method == "UTPC"

    # numbers of the clusters that need a line go to Python as plain arrays, all else stays in the JVM
    def run(at: pd.Series, plane: pd.Series, start: pd.Series, pitch: pd.Series, n: pd.Series, *members: pd.Series) -> pd.Series:
        pos = np.full(len(at), np.nan)
        for i in np.flatnonzero(members[0].notna().to_numpy()):
            hits = [dict(zip(MEMBER, v)) for v in zip(*(m.iloc[i] for m in members))]
            if iterated:
                pos[i] = drift_iterated(hits, float(at.iloc[i]), float(start.iloc[i]))
            else:
                pos[i] = drift_line(hits, plane.iloc[i], float(start.iloc[i]), p, float(pitch.iloc[i]) if pitch.iloc[i] > 0 else 0.4, int(n.iloc[i]) if n.iloc[i] > 0 else 1)
        return pd.Series(pos)

    lined = (F.col("plane") != 0) & (F.size("members") >= 3)
    timed = F.coalesce(finite(F.col("t0")), F.lit(False))
    total = lambda v: F.aggregate("members", F.lit(0.0), lambda acc, m: acc + v(m))
    charge = total(lambda m: m["charge"])
    centre = F.when(charge != 0, total(lambda m: m["id0"] * m["charge"]) / charge).otherwise(total(lambda m: m["id0"].cast("double")) / F.size("members"))
    field = lambda n: F.transform("members", lambda m: F.coalesce(m[n].cast("double"), F.lit(0.0 if n == "time_error" else float("nan"))))
    line = F.pandas_udf(run, "double")("pos", "plane", "t0", "pitch", "n_strips", *(F.when(timed & lined, field(n)) for n in MEMBER))
    pos = F.when(~timed, F.col("pos")).when(lined, line).otherwise(F.col("pos") if iterated else centre)
    return both.withColumn("pos", pos).select(*clusters.columns)


#: Fields of a cluster's members that the drift methods use.
MEMBER = ("id0", "time", "charge", "amp", "time_error")


def _line(x: np.ndarray, y: np.ndarray, var: np.ndarray) -> tuple[float, float] | None:
    """Slope and intercept of a weighted line, or None where it is not determined."""
    if not (np.isfinite(var).all() and (var > 0).all()):
        return None
    w = 1 / var
    mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
    sxx = (w * (x - mx) ** 2).sum()
    if not sxx > 0:
        return None
    k = (w * (x - mx) * (y - my)).sum() / sxx
    return (float(k), float(my - k * mx)) if np.isfinite(k) else None


def drift_line(hits: list[Any], plane: int, t0: float, p: PositionConfig, pitch: float, n_strips: int) -> float:
    """Strip position where the track crosses half the gas gap: a line through drift depths, tied to the charge centroid.

    Depth errors come from time errors (their upper median where one is missing). The centroid has an error along the
    strips only, which the slope turns into depth; the line is refitted until the slope settles.
    """
    rows = sorted(hits, key=lambda h: h["id0"])
    strip = np.array([h["id0"] for h in rows], float)
    charge = np.array([h["charge"] for h in rows], float)
    centre = float((strip * charge).sum() / charge.sum()) if charge.sum() else float(strip.mean())
    if plane == 0 or len(rows) < 3:
        return centre
    err = np.array([h["time_error"] if h["time_error"] is not None else np.nan for h in rows], float)
    good = np.sort(err[np.isfinite(err) & (err > 0)])
    err = np.where(np.isfinite(err) & (err > 0), err, good[len(good) // 2] if len(good) else 1.0)
    when = np.array([h["time"] for h in rows], float) - t0 + p.time_offset + p.strip_time_slope * (strip - 0.5 * (n_strips - 1))
    x, y, dy = strip * pitch, when * p.drift_velocity, err * p.drift_velocity
    fit = _line(x, y, dy**2)
    if fit is None or abs(fit[0]) < 1e-12:
        return centre
    x, y = np.append(x, centre * pitch), np.append(y, p.gas_gap / 2)
    dx, dy = np.append(np.zeros(len(rows)), p.charge_centroid_x_error), np.append(dy, 0.0)
    for _ in range(10):
        new = _line(x, y, dy**2 + (fit[0] * dx) ** 2)
        if new is None or abs(new[0]) < 1e-12:
            break
        settled = abs(new[0] - fit[0]) <= 1e-6 * max(1.0, abs(fit[0]))
        fit = new
        if settled:
            break
    return (p.gas_gap / 2 - fit[1]) / fit[0] / pitch


#: Fixed values of the iterated drift method: speed, gap and the two cubic time corrections (by distance and by time).
DRIFT_SPEED, DRIFT_GAP = 0.021, 5.0
DISTANCE_CUBIC = (-81.77373196181657, 9.060528533349935, -6.620452354084467, 21.23345582870448)
TIME_CUBIC = (131.16578571441693, -2.057779313411427, 0.01023940912182441, -0.00001630064845924149)


def drift_iterated(hits: list[Any], centre: float, t0: float) -> float:
    """Strip position by the iterated line: time corrections depend on the distance from the last position."""
    rows = sorted(hits, key=lambda h: h["id0"])
    strip, when, charge, amp = (np.array([h[k] for h in rows], float) for k in ("id0", "time", "charge", "amp"))
    amp_centre = float((strip * amp).sum() / amp.sum()) if amp.sum() else centre
    err = np.array([h["time_error"] or 0.0 for h in rows], float) * DRIFT_SPEED
    x = strip.copy()  # a strip next to another of about the same time stands for both; the left neighbour wins
    for i in range(len(rows)):
        for j in (i + 1, i - 1):
            if 0 <= j < len(rows) and strip[j] - strip[i] == j - i and abs(when[j] - when[i]) < 15 and charge[i] + charge[j]:
                x[i] = (strip[i] * charge[i] + strip[j] * charge[j]) / (charge[i] + charge[j])
    late = np.polyval(TIME_CUBIC[::-1], when)

    def crossing(at: float) -> float:
        depth = (when - t0 + np.polyval(DISTANCE_CUBIC[::-1], (x - at) * 0.4) + late) * DRIFT_SPEED
        use = (depth >= -0.4) & (depth <= DRIFT_GAP + 0.4)
        px, py = np.append(x[use], amp_centre), np.append(depth[use], DRIFT_GAP / 2)
        dx, dy = np.append(np.zeros(use.sum()), 0.26), np.append(err[use], 0.0)
        line = _line(px, py, np.ones(len(px)))
        for _ in range(10):
            if line is None:
                return at
            var = dy**2 + (line[0] * dx) ** 2
            new = _line(px, py, np.where(var > 0, var, 1.0))
            if new is None or abs(new[0] - line[0]) <= 1e-9 * max(1.0, abs(line[0])):
                break
            line = new
        return (DRIFT_GAP / 2 - line[1]) / line[0] if line and abs(line[0]) > 1e-12 else at

    pos, last, n = crossing(centre), -99.0, 1
    while abs(pos - last) > 0.01 and n < 5:
        last = pos
        pos = (crossing(pos) + pos * n) / (n + 1)
        n += 1
    return pos


def local_hits(clusters: DataFrame, dets: DataFrame, plane_dim: DataFrame) -> DataFrame:
    """LOCAL_HITS with global gx, gy, gz: pads as they are, one strip plane along its angle, two planes in every combination.

    The planes of a flat detector are the configured ones; more than two give no hits. Those of a cylinder are the ones met.
    Parallel planes give none.
    """
    kind = F.broadcast(dets.select("det", "type", "pad_plane"))
    dim = plane_dim.withColumn("n_planes", F.count("*").over(Window.partitionBy("det")))
    u = clusters.join(kind, "det").join(F.broadcast(dim), ["det", "plane"], "left").withColumn("u", F.col("pos") * F.col("pitch"))
    pads = u.where("type = 'planar_pad' AND plane = pad_plane AND local_x IS NOT NULL").select(*KEYS, F.col("local_x").alias("x"), F.col("local_y").alias("y"), F.array("cluster_idx").alias("cluster_indices"))
    strips = u.where("type <> 'planar_pad' AND pitch IS NOT NULL")
    met = Window.partitionBy(*KEYS)
    strips = strips.withColumn("planes", F.when(F.col("type") == "cylinder", F.size(F.collect_set("plane").over(met))).otherwise(F.col("n_planes")))
    phi = F.radians("angle_deg")
    round_ = F.col("type") == "cylinder"
    one = strips.where("planes = 1").select(*KEYS, F.when(round_, F.when(F.col("plane") == 0, F.col("u")).otherwise(0.0)).otherwise(F.col("u") * F.cos(phi)).alias("x"), F.when(round_, F.when(F.col("plane") == 1, F.col("u")).otherwise(0.0)).otherwise(F.col("u") * F.sin(phi)).alias("y"), F.array("cluster_idx").alias("cluster_indices"))
    two = strips.where("planes = 2").select(*KEYS, "type", "plane", "cluster_idx", "u", F.when(round_, F.when(F.col("plane") == 0, 1.0).otherwise(0.0)).otherwise(F.cos(phi)).alias("c"), F.when(round_, F.when(F.col("plane") == 0, 0.0).otherwise(1.0)).otherwise(F.sin(phi)).alias("s"))
    a, b = two.alias("a"), two.alias("b")
    pair = a.join(b, (F.col("a.entry") == F.col("b.entry")) & (F.col("a.det") == F.col("b.det")) & (F.col("a.plane") < F.col("b.plane")))
    area = F.col("a.c") * F.col("b.s") - F.col("a.s") * F.col("b.c")
    x = (F.col("a.u") * F.col("b.s") - F.col("a.s") * F.col("b.u")) / area
    y = (F.col("a.c") * F.col("b.u") - F.col("a.u") * F.col("b.c")) / area
    both = pair.where(F.abs(area) >= 1e-12).select(F.col("a.entry").alias("entry"), F.col("a.det").alias("det"), x.alias("x"), y.alias("y"), F.array("a.cluster_idx", "b.cluster_idx").alias("cluster_indices"))
    every = pads.unionByName(one).unionByName(both).withColumn("z", F.lit(0.0))
    number = Window.partitionBy(*KEYS).orderBy("cluster_indices")
    every = every.withColumn("hit_idx", F.row_number().over(number) - 1).join(F.broadcast(dets), "det")
    g = to_global(F.col("x"), F.col("y"), F.col("z"))
    return every.select(*KEYS, "hit_idx", "x", "y", "z", "cluster_indices", *[v.alias(f"g{n}") for n, v in zip("xyz", g)])


def member_hits(clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """(entry, det, cluster_idx, members' fields): the hits of chosen clusters (entry, det, cluster_idx)."""
    return clusters.join(chosen.select(*KEYS, "cluster_idx").distinct(), [*KEYS, "cluster_idx"]).select(*KEYS, "plane", "cluster_idx", F.inline("members"))


def neighbours(hits: DataFrame, target: int, low: int = 0, high: int = 512, missing: int = 2) -> DataFrame:
    """Strips of a plane around a target strip, outwards until `missing` strips in a row have no hit."""
    near = hits.where(F.col("id0").between(low, high - 1))
    side = F.when(F.col("id0") < target, -1).when(F.col("id0") > target, 1).otherwise(0)
    away = near.withColumns({"side": side, "away": F.abs(F.col("id0") - target)})
    w = Window.partitionBy(*KEYS, "plane", "side").orderBy("away", "raw_idx")
    step = F.col("away") - F.coalesce(F.lag("away").over(w), F.lit(0))
    cutoff = F.max((step > missing).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return away.withColumn("__cut", cutoff).where("__cut = 0").drop("__cut", "side", "away")


def reconstruct(hits: DataFrame, dets: DataFrame, plane_dim: DataFrame, c: ClusterConfig, p: PositionConfig, t0: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, local hits) of valid channel hits: the chain a detector's events go through; a stage without rows ends it."""
    own = ordered_hits(hits)
    pads = own.join(F.broadcast(dets.where("type = 'planar_pad'").select("det", "pad_rows", "pad_columns", "pad_pitch_x", "pad_pitch_y")), "det")
    strips = own.join(F.broadcast(dets.where("type <> 'planar_pad'").select("det")), "det", "left_semi")
    clusters = build_clusters(strip_groups(strips, c), c, p).unionByName(build_clusters(pad_groups(pads, c), c, p, pads=True))
    if t0 is not None:
        clusters = drift_positions(clusters, t0, p, plane_dim)
    return clusters, local_hits(clusters, dets, plane_dim)


def finite_time(hits: DataFrame) -> DataFrame:
    return hits.where(finite(F.col("time")))
