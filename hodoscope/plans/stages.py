"""The analyses: tracking, DUT efficiency (strips and pads), time resolution and scope, as lazily built tables.

A stage takes tables and settings and returns named tables; writing them is the caller's choice. Each is registered under the
name a configuration uses.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.config import AlignmentConfig, ClusterConfig, EfficiencyConfig, EventBuilderConfig, HitConfig, PadAlignmentConfig, PositionConfig, ScopeConfig, StripAlignmentConfig, TimingConfig, TrackConfig
from hodoscope.functions import geometry
from hodoscope.operators import align, clusters, efficiency, fits, hits, maps, match, scope, timing, tracks
from hodoscope.plans.registry import ALGORITHMS, ANALYSES, CONVERTERS
from hodoscope.sources import apv, bt, scope as scope_source, vmm

Tables = dict[str, DataFrame]


@ALGORITHMS.register("HitProcessor")
def hit_processor(raw: DataFrame, settings: HitConfig) -> DataFrame:
    return hits.channel_hits(raw, settings)


@ALGORITHMS.register("ClusterBuilder")
def cluster_builder(own: DataFrame, settings: ClusterConfig) -> DataFrame:
    return clusters.strip_groups(clusters.ordered_hits(own), settings)


@ALGORITHMS.register("ClusterReconstructor")
def cluster_reconstructor(groups: DataFrame, settings: tuple[ClusterConfig, PositionConfig]) -> DataFrame:
    return clusters.build_clusters(groups, *settings)


CONVERTERS.register("APV25SRS", "apv", "srs")(apv.convert)
CONVERTERS.register("BTAPVDat", "bt", "dat")(bt.convert)
CONVERTERS.register("VMM3a", "vmm")(lambda h, g, c=None: vmm.convert(h, g, c or EventBuilderConfig()))


def detector_chain(raw: DataFrame, dets: DataFrame, plane_dim: DataFrame, hit: HitConfig, cluster: ClusterConfig, position: PositionConfig, t0: DataFrame | None = None) -> Tables:
    """Raw hits to channel hits, clusters and local hits. Persist channel_hits when more than one of them is used."""
    channel = hits.channel_hits(raw, hit)
    own, local = clusters.reconstruct(channel, dets, plane_dim, cluster, position, t0)
    return {"channel_hits": channel, "clusters": own, "local_hits": local}


@ANALYSES.register("TrackAnalysis")
def track_analysis(local: DataFrame, own: DataFrame, dets: DataFrame, config: TrackConfig, raw_ids: DataFrame | None = None, alignment: AlignmentConfig | None = None, estimate_resolution: bool = True, plane_dim: DataFrame | None = None) -> dict[str, Any]:
    """Tracks, tracker validation rows and performance tables; alignment first if asked for, its corrections are returned.

    With plane_dim, also maps of the tracks' hits and, from clusters with members, properties of their clusters.

    The resolution may be estimated from leave-one-out residuals of events with one hit in each tracker.
    """
    spark = local.sparkSession
    ids = [r["det"] for r in dets.where("role = 'tracker'").orderBy("pz").select("det").collect()]
    if len(ids) < 3:
        raise ValueError("tracking needs three trackers")
    strict = tracks.strict_events(local, ids)
    single = local.join(strict, "entry", "left_semi")
    out: dict[str, Any] = {}
    if alignment:
        found = align.align_trackers(single, dets, alignment, (config.resolution_x, config.resolution_y))
        out["alignment"] = align.corrections_table(spark, found)
        dets = moved(dets, found)
        local, single = regloballed(local, dets), regloballed(single, dets)
        out["detectors"] = dets
    if estimate_resolution:
        r = tracks.pooled_resolution(tracks.leave_one_out(single.where(F.col("det").isin(*ids)), ["entry"])).first()
        if r["residuals"] and min(r["resolution_x"] or 0, r["resolution_y"] or 0) > 0:
            config = TrackConfig(**(config.__dict__ | {"resolution_x": r["resolution_x"], "resolution_y": r["resolution_y"]}))
    found = tracks.find_tracks(local, dets, config)
    if raw_ids is not None:
        found = found.join(raw_ids, "entry", "left")
    points = tracks.track_points(found, local)
    loo = tracks.leave_one_out(points, ["entry", "track_index"])
    members = clusters.member_hits(own, points.select("entry", "det", F.explode("cluster_indices").alias("cluster_idx"))) if "members" in own.columns else None
    if members is not None:
        found = found.join(tracks.track_t0(members), "entry", "left").withColumn("has_t0", F.coalesce("has_t0", F.lit(False)))
    if plane_dim is not None:
        out["hit_maps"] = maps.hit_maps(points, maps.map_ranges(dets, plane_dim), {"selected": ("x", "y")})
        out["hit_properties"] = _cluster_properties(own, points.select("entry", "det", F.explode("cluster_indices").alias("cluster_idx")))
    out |= {"tracks": found, "validation": loo, "performance": tracks.pooled_resolution(loo, ["det"]), "resolution": tracks.pooled_resolution(loo), "config": config}
    return out


def _cluster_properties(own: DataFrame, chosen: DataFrame, trim: bool = False) -> DataFrame:
    """Charge, size and largest amplitude of chosen clusters (entry, det, cluster_idx) per plane, over ranges a detector's planes share.

    Of clusters that lack some of these columns, the rest.
    """
    picked = own.join(chosen.distinct(), ["entry", "det", "cluster_idx"])
    values = {"cluster_charge": "charge", "size": "size", "adc": "max_amp"}
    return maps.hit_properties(picked, ["det", "plane"], ["det"], {n: c for n, c in values.items() if c in own.columns}, trim=trim)


def _residual_tables(rows: DataFrame, prefix: str = "") -> Tables:
    """Double-Gaussian fits with their shares, and histograms of mean +- 5 rms, of both axes' residuals."""
    out: Tables = {}
    for a in "xy":
        out[f"residual_fits_{a}"] = fits.fit_residuals(rows, ["det"], f"res_{a}")
        out[f"residual_histogram_{a}"] = fits.histograms(rows, ["det"], f"res_{a}", 100, 5.0)
    return out


def moved(dets: DataFrame, found: align.Alignment) -> DataFrame:
    """The detector table with corrections added and its rotation coefficients made anew."""
    rows = []
    for r in dets.collect():  # a configuration's detectors
        d = r.asDict()
        c = found.corrections.get(d["det"], (0.0,) * 6)
        for i, n in enumerate(("px", "py", "pz", "rx", "ry", "rz")):
            d[n] += c[i]
        for n, v in zip(("r00", "r01", "r02", "r10", "r11", "r12", "r20", "r21", "r22"), geometry.rotation(d["rx"], d["ry"], d["rz"])):
            d[n] = v
        rows.append(tuple(d[f] for f in dets.columns))
    return dets.sparkSession.createDataFrame(rows, dets.schema)


def regloballed(local: DataFrame, dets: DataFrame) -> DataFrame:
    """Local hits with global coordinates by the present geometry; local ones do not depend on it."""
    own = local.drop("gx", "gy", "gz").join(F.broadcast(dets.drop("name", "type", "role")), "det")
    g = geometry.to_global(F.col("x"), F.col("y"), F.col("z"))
    return own.select(*[c for c in local.columns if c not in ("gx", "gy", "gz")], *[v.alias(f"g{n}") for n, v in zip("xyz", g)])


def predictions(found: DataFrame, duts: DataFrame, max_events: int = -1) -> DataFrame:
    """(entry, det, pred_x, pred_y, kx..by) of single-track events on DUTs: all of them, or the first max_events by entry."""
    one = tracks.single_track_events(found)
    one = one.orderBy("entry").limit(max_events) if max_events > 0 else one
    return geometry.predict(one.select("entry", "track_index", "kx", "ky", "bx", "by"), duts).select("entry", "track_index", "det", "kx", "ky", "bx", "by", "pred_x", "pred_y")


@ANALYSES.register("DUTAnalysis")
def dut_analysis(found: DataFrame, own: DataFrame, dets: DataFrame, plane_dim: DataFrame, config: EfficiencyConfig, strict: DataFrame | None = None, alignment: StripAlignmentConfig | None = None, max_events: int = -1, local: DataFrame | None = None) -> Tables:
    """Strip DUTs: row table (nearest clusters), residuals, efficiency map, summary, projections, scan and accidental rates.

    With alignment settings each detector is aligned first, on the tracks and clusters of single-track events, and all that
    follows uses its moved geometry; the corrections are returned as tables.
    """
    axes = geometry.axis_planes(plane_dim)
    strips = match.strip_clusters(own, axes, plane_dim)
    duts = dets.where("role = 'dut' AND type <> 'planar_pad'")
    out: dict[str, Any] = {}
    if alignment:
        region = (alignment.x_min, alignment.x_max, alignment.y_min, alignment.y_max)
        for d in [r.asDict() for r in duts.where("type = 'planar'").collect()]:  # a configuration's detectors
            lines = predictions(found, duts.where(F.col("det") == d["det"]), max_events)
            got = align.align_strip_dut(lines, strips.where(F.col("det") == d["det"]), d, region=region)
            if math.isfinite(got.after):
                duts = moved(duts, got)
            out[f"alignment_{d['det']}"] = align.corrections_table(found.sparkSession, got)
        out["detectors"] = duts
    pred = predictions(found, duts, max_events)
    rows = match.nearest_clusters(pred.where(efficiency.in_region(config)), strips)
    samples = match.strip_samples(pred, match.strip_envelopes(strips)).withColumn("flat_bin", efficiency.flat_bin(config))
    out |= _efficiency_tables(samples, config)
    ranges = maps.map_ranges(duts, plane_dim)
    out["hit_maps"] = maps.hit_maps(rows, ranges, {"matched": ("hit_x", "hit_y"), "predicted": ("pred_x", "pred_y")})
    if local is not None:
        out["hit_maps"] = out["hit_maps"].unionByName(maps.hit_maps(local, ranges, {"reconstructed": ("x", "y")}))
    out["hit_profile_x"], out["hit_profile_y"] = maps.profiles(out["hit_maps"], "x"), maps.profiles(out["hit_maps"], "y")
    out["hit_properties"] = _cluster_properties(own, rows.select("entry", "det", F.explode(F.array("cluster_x", "cluster_y")).alias("cluster_idx")).where("cluster_idx IS NOT NULL"), trim=True)
    out |= _residual_tables(rows)
    out |= {"dut_rows": rows, "residuals_x": efficiency.residual_summary(rows, "x"), "residuals_y": efficiency.residual_summary(rows, "y"), "slope_x": match.residual_slope(rows, "pred_x", "res_x")}
    if config.fake_enabled and strict is not None:
        kept = samples.join(strict, "entry", "left_semi")
        fakes = match.strip_fakes(kept, match.fake_partners(kept.select("det", "entry"), config.fake_seed, config.fake_partners), config.margin)
        out |= {"fake_map": (cells := efficiency.grid(fakes, config.margin)), "fake_summary": efficiency.summary(cells, config)}
    return out


def _efficiency_tables(samples: DataFrame, config: EfficiencyConfig) -> Tables:
    cells = efficiency.grid(samples, config.margin)
    return {"samples": samples, "efficiency_map": cells, "efficiency_summary": efficiency.summary(cells, config), "projection_x": efficiency.projections(cells, config, "x"), "projection_y": efficiency.projections(cells, config, "y"), "margin_scan": efficiency.margin_scan(samples, config), "report": efficiency.efficiency_report(samples, config.margin)}


@ANALYSES.register("PadDUTAnalysis")
def pad_analysis(found: DataFrame, own: DataFrame, dets: DataFrame, config: EfficiencyConfig, strict: DataFrame | None = None, alignment: PadAlignmentConfig | None = None, plane_dim: DataFrame | None = None, max_events: int = -1) -> dict[str, Any]:
    """Pad DUTs: a row for every event (the first max_events by entry, if given), envelope matching for rows and efficiency alike; optional alignment first."""
    pads = dets.where("role = 'dut' AND type = 'planar_pad'")
    out: dict[str, Any] = {}
    if alignment:
        base = pads
        for d in [r.asDict() for r in pads.collect()]:

            def matched(shift: tuple[float, ...], d: dict = d) -> DataFrame:
                now = moved(base.where(F.col("det") == d["det"]), align.Alignment({d["det"]: shift}, 0, 0, 0, True))
                s = match.pad_samples(predictions(found, now, max_events), match.pad_envelopes(own, now))
                return match.pad_nearest(s, config.margin).where("hit_flag = 1").select("kx", "ky", "bx", "by", F.col("hit_x").alias("x"), F.col("hit_y").alias("y"))

            got = align.align_pad_dut(d, alignment, matched)
            pads = moved(pads, got)
            out[f"alignment_{d['det']}"] = align.corrections_table(found.sparkSession, got)
    samples = match.pad_samples(predictions(found, pads, max_events), match.pad_envelopes(own, pads)).withColumn("flat_bin", efficiency.flat_bin(config))
    out |= _efficiency_tables(samples, config)
    out["pad_rows"] = rows = match.pad_nearest(samples, config.margin)
    out |= _residual_tables(rows) | {f"residuals_{a}": efficiency.residual_summary(rows, a) for a in "xy"}
    if plane_dim is not None:
        out["hit_maps"] = maps.hit_maps(rows, maps.map_ranges(pads, plane_dim), {"matched": ("hit_x", "hit_y"), "predicted": ("pred_x", "pred_y")})
        out["hit_properties"] = _cluster_properties(own, rows.select("entry", "det", "cluster_idx").where("cluster_idx IS NOT NULL"))
    if config.fake_enabled and strict is not None:
        kept = samples.join(strict, "entry", "left_semi")
        fakes = match.pad_fakes(kept, match.fake_partners(kept.select("det", "entry"), config.fake_seed, config.fake_partners), config.margin)
        out |= {"fake_map": (cells := efficiency.grid(fakes, config.margin)), "fake_summary": efficiency.summary(cells, config)}
    return out


@ANALYSES.register("TimeResolution")
def time_resolution(strips: DataFrame, config: TimingConfig, tracks_: DataFrame | None = None, scope_events: DataFrame | None = None) -> dict[str, Any]:
    """Three trackers' resolutions and track times from strip timings (entry, track_index, det, plane, time, time_error, amp).

    With scope events, residuals to the external T0, the time-walk correction and its corrected times.
    """
    ids = config.tracker_ids
    if len(ids) != 3:
        raise ValueError("time resolution needs three tracker ids")
    keys = ["entry", "track_index", "det"]
    times = timing.cluster_times(strips, keys, config.time_method, config.amplitude_weight_power)
    hat = timing.resolution_by_hat(times, tuple(ids), config.histogram_bins)
    if not hat["resolution"] == hat["resolution"]:
        raise ValueError("the three widths give no positive variances")
    combined = timing.combine_trackers(times, tuple(ids), hat["weights"])
    out: dict[str, Any] = {"hat": hat, "times": times, "track_times": combined}
    if tracks_ is not None and scope_events is not None:
        known = timing.external_t0(tracks_, scope_events).select("entry", "track_index", "external_t0")
        calm = timing.veto(strips, keys, config.maximum_strip_amplitude)
        res = calm.join(known, ["entry", "track_index"]).withColumn("residual", F.col("time") - F.col("external_t0"))
        walk = timing.time_walk(res, "amp", "residual")
        out |= {"t0_residuals": res, "time_walk": walk}
        if walk:
            fixed = timing.corrected_times(calm, keys, walk, config.time_method, config.amplitude_weight_power)
            out["corrected_times"] = fixed.join(known, ["entry", "track_index"]).withColumn("residual", F.col("t") - F.col("external_t0"))
    return out


def refitted(raw: DataFrame, strips: DataFrame, settings: HitConfig) -> DataFrame:
    """strips (entry, det, raw_idx, ...) with time, time_error and amp of their raw hits by other waveform settings.

    Only the raw hits that strips name are worked on; strips whose hit is then not valid are left out.
    """
    names = ["entry", "det", "raw_idx"]
    again = hits.channel_hits(raw.join(strips.select(*names).distinct(), names, "left_semi"), settings).where("is_valid")
    keep = [c for c in strips.columns if c not in ("time", "time_error", "amp")]
    return strips.select(*keep).join(again.select(*names, "time", "time_error", "amp"), names)


def in_active_area(rows: DataFrame, dets: DataFrame, plane_dim: DataFrame) -> DataFrame:
    """rows (det, pred_x, pred_y, ...) with `inside`: whether the prediction lies on the detector's strips or pads."""
    along = F.struct("angle_deg", "pitch", "n_strips")
    strips = plane_dim.groupBy("det").agg(F.collect_list(along).alias("__planes"))  # a detector's planes
    dim = dets.select("det", "type", "pad_rows", "pad_columns", "pad_pitch_x", "pad_pitch_y").join(strips, "det", "left")
    both = rows.join(F.broadcast(dim), "det")  # a configuration's detectors
    on_strips = F.forall("__planes", lambda p: (F.col("pred_x") * F.cos(F.radians(p["angle_deg"])) + F.col("pred_y") * F.sin(F.radians(p["angle_deg"]))).between(-0.5 * p["pitch"], (p["n_strips"] - 0.5) * p["pitch"] - 1e-12))
    on_pads = F.expr("pred_x >= -0.5 * pad_pitch_x AND pred_x < (pad_columns - 0.5) * pad_pitch_x AND pred_y >= -0.5 * pad_pitch_y AND pred_y < (pad_rows - 0.5) * pad_pitch_y")
    return both.withColumn("inside", F.coalesce(F.when(F.col("type") == "planar_pad", on_pads).otherwise(on_strips), F.lit(False))).drop("type", "pad_rows", "pad_columns", "pad_pitch_x", "pad_pitch_y", "__planes")


def dut_timing(rows: DataFrame, members: DataFrame, references: DataFrame, config: TimingConfig, dets: DataFrame, plane_dim: DataFrame, raw: DataFrame | None = None) -> Tables:
    """DUT times against the track time of events with one timed track.

    rows: DUT rows (entry, det, pred_x, pred_y, hit_flag, cluster_x, cluster_y); members: strips of clusters; references:
    (entry, track_index, track_time). Returns the samples, tracks with their DUTs, the best timing window's efficiency for two
    denominators (tracks inside the active area, and those of them with a matched hit), and residuals over amplitude.
    """
    unique = timing.unique_references(references).select("entry", "track_index", "track_time")
    cases = in_active_area(rows, dets, plane_dim).join(unique.select("entry"), "entry", "left_semi")
    strips = timing.dut_strips(rows, unique, members)
    strips = refitted(raw, strips, config.waveform) if raw is not None else strips
    times = timing.cluster_times(strips, ["entry", "track_index", "track_time", "det"], config.time_method, config.amplitude_weight_power)
    samples = times.where("t IS NOT NULL").withColumn("residual", F.col("t") - F.col("track_time")).join(cases.select("entry", "det", "inside"), ["entry", "det"], "left")
    inside = samples.where("inside")
    counts = cases.where("inside").groupBy("det").agg(F.count("*").alias("tracks"), F.count_if(F.col("hit_flag") != 0).alias("matched"))
    windows = None
    for case in ("tracks", "matched"):
        one = timing.window_efficiency(inside, "residual", counts.select("det", F.col(case).alias("denominator")), config.window_ns, config.window_step_ns, ["det"]).withColumn("case", F.lit(case))
        windows = one if windows is None else windows.unionByName(one)
    late = strips.withColumn("residual", F.col("time") - F.col("track_time"))
    map_, profile = timing.amplitude_map(late, ["det"], "amp", "residual")
    return {"dut_times": samples, "track_duts": timing.track_with_dut(references, times), "window_efficiency": windows, "dut_amplitude_map": map_, "dut_amplitude_profile": profile}


@ANALYSES.register("OscilloscopeAnalysis")
def oscilloscope(spark, directory: str, config: ScopeConfig) -> dict[str, Any]:
    """Scope events with reference times, the fits behind them, and status counts."""
    measured = scope.measure(scope_source.read_segments(spark, directory, config.max_waveform_files), config)
    events, fits = scope.reference_times(scope.complete(measured), config.histogram_bins)
    return {"scope_events": events, "fits": fits, "status": scope.status_counts(measured)}


@ANALYSES.register("ExampleScript")
def example(own: DataFrame) -> Tables:
    """A template: counts per detector."""
    return {"counts": own.groupBy("det").agg(F.count("*").alias("rows"))}
