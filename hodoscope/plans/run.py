"""A run from its directory and id: configuration, conversion or reuse, then each enabled analysis with its tables written.

python -m hodoscope.plans.run BASE_DIR RUN_ID
"""

from __future__ import annotations

import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodoscope import config as cfg
from hodoscope.functions import geometry
from hodoscope.operators import clusters, events, hits, qa, tracks
from hodoscope.plans import stages
from hodoscope.plans.registry import ANALYSES, CONVERTERS
from hodoscope.schemas import schema
from hodoscope.session import session
from hodoscope.sources import apv, bt, canonical, results, vmm

#: What a converter returns: events, channels, and the version of their schema.
Converted = tuple[DataFrame, DataFrame, int]
#: Exit codes: usage, configuration, conversion, analysis.
USAGE, CONFIG, CONVERSION, ANALYSIS = 2, 3, 4, 5


def _apv(spark: SparkSession, base: str, run_id: str, conversion: dict[str, Any]) -> Converted:
    raw, geo = apv.discover(base, run_id)
    ped = f"{base}/raw/run{run_id}_pedestal"
    pedestals = spark.read.schema(schema("APV_PEDESTALS")).parquet(ped) if results.exists(spark, ped) else None
    return *apv.convert(apv.read_raw(spark, raw), apv.read_geometry(spark, geo), pedestals), 2


def _bt(spark: SparkSession, base: str, run_id: str, conversion: dict[str, Any]) -> Converted:
    found = bt.discover(base, run_id)
    samples = int(conversion.get("samples", 27))
    stats = bt.pedestal_stats(bt.read_blocks(spark, [found["pedestal"]], samples))
    return *bt.upgrade(*bt.convert(bt.read_blocks(spark, [found["data"]], samples), bt.read_map(spark, found["map"]), stats, bool(conversion.get("allowUnmapped", False)))), 2


def _vmm(spark: SparkSession, base: str, run_id: str, conversion: dict[str, Any]) -> tuple:
    raw, geo = vmm.discover(base, run_id)
    own, dim, c = vmm.read_hits(spark, raw), vmm.read_geometry(spark, geo), cfg.settings(cfg.EventBuilderConfig, conversion)
    return *vmm.convert(own, dim, c)[:2], 3, lambda n_events: vmm.conversion_report(*events.select_hits(own, dim, c), n_events)


#: How a run directory is read for the converters that come with the engine.
OWN_CONVERTERS = {"APV25SRS": _apv, "BTAPVDat": _bt, "VMM3a": _vmm}


def convert(spark: SparkSession, base: str, run_id: str, conversion: dict[str, Any], path: str) -> None:
    """Convert a run's raw files by the configured kind, the engine's or a registered one, and write the canonical tables.

    Beside them go the channels' quality tables and, where the converter makes one, its report.
    """
    kind = CONVERTERS.get(conversion["type"])
    read = next((f for n, f in OWN_CONVERTERS.items() if kind is CONVERTERS.get(n)), kind)
    made, channels, version, *report = read(spark, base, run_id, conversion)
    canonical.write_run(path, made, channels, {"schema_version": version, "source_format": conversion["type"]})
    rows = canonical.channel_rows(stored := spark.read.parquet(f"{path}/events"), version)
    out = {"qa": qa.plane_qa(rows), "qa_multiplicity": qa.multiplicity(rows, stored), "qa_pads": qa.pad_mean_maximum(rows)}
    if report:
        out["conversion_report"] = report[0](stored.count())
    for name, table in out.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def save(out: dict[str, Any], path: str, keep: tuple[str, ...] | None = None) -> None:
    """Write the named tables of a stage's result (all, if none are named) and its fits as one table of parameters."""
    names = out if keep is None else [n for n in out if n in keep or n.startswith("alignment_")]
    for name in names:
        if isinstance(out[name], DataFrame):
            results.write(out[name], f"{path}/{name}")
    fits = {n: v for n, v in out.items() if isinstance(v, dict)}
    spark = next((v.sparkSession for v in out.values() if isinstance(v, DataFrame)), None)
    if fits and spark:
        results.write(results.parameters(spark, fits), f"{path}/parameters")


def stored(table: DataFrame, path: str) -> DataFrame:
    """The table written and read again: a stage's result is a file, and later plans start from it."""
    results.write(table, path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


ALIASES = {"noiseThreshold": "threshold"}


def chain_settings(detectors: list[dict[str, Any]]) -> dict[tuple, list[int]]:
    """Detector ids by their (hit, cluster, position) settings; a detector without settings has the defaults."""
    out: dict[tuple, list[int]] = {}
    for d in detectors:
        own = d.get("Algorithms") or {}
        key = tuple(cfg.settings(c, own.get(n) or {}, ALIASES) for c, n in ((cfg.HitConfig, "HitProcessor"), (cfg.ClusterConfig, "ClusterBuilder"), (cfg.PositionConfig, "ClusterReconstructor")))
        out.setdefault(key, []).append(d["id"])
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Run:
    """What the analyses of one run share: its tables, brought up to date by those that change them."""

    def __init__(self, spark: SparkSession, config: dict[str, Any], run: canonical.CanonicalRun, path: str):
        self.spark, self.run, self.path = spark, run, path
        self.chains = chain_settings(config["detectors"])
        self.dets, self.planes = geometry.detectors(spark, config["detectors"]), geometry.planes(spark, config["detectors"])
        raw = run.hits(self.dets)
        self.channel = stored(_union([hits.channel_hits(raw.where(F.col("det").isin(ids)), h) for (h, _, _), ids in self.chains.items()]), f"{path}/channel_hits")
        self.reconstruct()
        self.trackers = [r["det"] for r in self.dets.where("role = 'tracker'").select("det").collect()]
        self.strict = stored(tracks.strict_events(self.local, self.trackers), f"{path}/strict_events")
        self.found: DataFrame | None = None

    def reconstruct(self, t0: DataFrame | None = None) -> None:
        """Clusters and local hits, each detector by its own settings; with track times, drift positions too."""
        made = []
        for (_, c, p), ids in self.chains.items():
            timed = t0 if p.method in ("UTPC", "rawUTPC") else None
            one = [t.where(F.col("det").isin(ids)) for t in (self.channel, self.dets, self.planes)]
            made.append(clusters.reconstruct(*one, c, p, timed))
        tail = "" if t0 is None else "_t0"
        self.own, self.local = (stored(_union([m[k] for m in made]), f"{self.path}/{n}{tail}") for k, n in enumerate(("clusters", "local_hits")))

    def tracks(self) -> DataFrame:
        """The tracks of this run's track analysis, or those written before."""
        if self.found is None:
            self.found = results.read_tracks(self.spark, f"{self.path}/tracks")
        return self.found

    def table(self, name: str) -> DataFrame | None:
        """A table written under the run's results, if it is there."""
        where = f"{self.path}/{name}"
        return self.spark.read.parquet(where) if results.exists(self.spark, where) else None


def _track_analysis(r: Run, script: dict[str, Any]) -> None:
    alignment = cfg.settings(cfg.AlignmentConfig, script) if script.get("runAlignment", script.get("performAlignment", False)) else None
    out = stages.track_analysis(r.local, r.own, r.dets, cfg.settings(cfg.TrackConfig, script, {"maxTracksPerEvent": "max_tracks"}), r.run.raw_ids, alignment, script.get("useEstimatedResolution", True), r.planes)
    save(out, r.path, ("tracks", "validation", "performance", "resolution", "alignment", "detectors", "hit_maps", "hit_properties"))
    r.found, r.dets = results.read_tracks(r.spark, f"{r.path}/tracks"), out.get("detectors", r.dets)
    if any(p.method in ("UTPC", "rawUTPC") for _, _, p in r.chains):
        r.reconstruct(r.found.select("entry", "t0"))


EFFICIENCY_TABLES = ("dut_rows", "pad_rows", "efficiency_map", "efficiency_summary", "projection_x", "projection_y", "margin_scan", "report", "fake_map", "fake_summary", "residuals_x", "residuals_y", "slope_x", "detectors", "hit_maps", "hit_profile_x", "hit_profile_y", "hit_properties", "residual_fits_x", "residual_fits_y", "residual_histogram_x", "residual_histogram_y")


def _dut_analysis(r: Run, script: dict[str, Any]) -> None:
    alignment = cfg.settings(cfg.StripAlignmentConfig, script.get("alignmentRegion") or {}) if script.get("runAlignment", True) else None
    out = stages.dut_analysis(r.tracks(), r.own, r.dets, r.planes, cfg.settings(cfg.EfficiencyConfig, script), r.strict, alignment, int(script.get("maxEvents", -1)), r.local)
    save(out, f"{r.path}/DUTAnalysis", EFFICIENCY_TABLES)


def _pad_analysis(r: Run, script: dict[str, Any]) -> None:
    alignment = cfg.settings(cfg.PadAlignmentConfig, script) if script.get("runAlignment", False) else None
    save(stages.pad_analysis(r.tracks(), r.own, r.dets, cfg.settings(cfg.EfficiencyConfig, script), r.strict, alignment, r.planes, int(script.get("maxEvents", -1))), f"{r.path}/PadDUTAnalysis", EFFICIENCY_TABLES)


def _time_resolution(r: Run, script: dict[str, Any]) -> None:
    c = cfg.settings(cfg.TimingConfig, script)
    c = c if c.tracker_ids else cfg.TimingConfig(**(c.__dict__ | {"tracker_ids": tuple(sorted(r.trackers)[:3])}))
    used = tracks.track_points(r.tracks(), r.local).select("entry", "track_index", "det", F.explode("cluster_indices").alias("cluster_idx"))
    members = r.own.select("entry", "det", "plane", "cluster_idx", F.inline("members"))
    where = f"{r.path}/OscilloscopeAnalysis/scope_events"
    scope = results.read_scope(r.spark, where) if results.exists(r.spark, where) else None
    out = stages.time_resolution(used.join(members, ["entry", "det", "cluster_idx"]), c, r.tracks() if scope is not None else None, scope)
    if c.analyze_dut_timing:
        rows = [results.read_dut_rows(r.spark, f"{r.path}/{n}") for n in ("DUTAnalysis/dut_rows", "PadDUTAnalysis/pad_rows") if results.exists(r.spark, f"{r.path}/{n}")]
        if not rows:
            raise ValueError("DUT timing needs the rows of a DUT analysis")
        own = _union([d.select("entry", "det", "pred_x", "pred_y", "hit_flag", "cluster_x", "cluster_y") for d in rows])
        out |= stages.dut_timing(own, members, out["track_times"], c, r.dets, r.planes, r.run.hits(r.dets))
    save(out, f"{r.path}/TimeResolution")


def _oscilloscope(r: Run, script: dict[str, Any]) -> None:
    save(stages.oscilloscope(r.spark, script["csvDirectory"], cfg.settings(cfg.ScopeConfig, script)), f"{r.path}/OscilloscopeAnalysis", ("scope_events", "status"))


def _example(r: Run, script: dict[str, Any]) -> None:
    save(stages.example(r.channel), f"{r.path}/ExampleScript")


#: The engine's own analyses by their names in a configuration; other names are looked up among the registered ones.
OWN_ANALYSES = {"TrackAnalysis": _track_analysis, "DUTAnalysis": _dut_analysis, "PadDUTAnalysis": _pad_analysis, "TimeResolution": _time_resolution, "OscilloscopeAnalysis": _oscilloscope, "ExampleScript": _example}


def analyse(spark: SparkSession, config: dict[str, Any], run: canonical.CanonicalRun, path: str) -> None:
    """Run the enabled analyses in order; later ones use the tracks of earlier ones, or those written before."""
    r = Run(spark, config, run, path)
    for script in config["scripts"]:
        if not script.get("enabled", True):
            continue
        name = script["name"]
        if name in OWN_ANALYSES:
            OWN_ANALYSES[name](r, script)
        else:
            tables = {"channel_hits": r.channel, "clusters": r.own, "local_hits": r.local, "detectors": r.dets, "planes": r.planes, "strict_events": r.strict}
            if (found := r.table("tracks")) is not None:
                tables["tracks"] = found
            save(ANALYSES.get(name)(tables, script), f"{path}/{name}")


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) != 2 or not args[1].isdigit():
        print(__doc__)
        return USAGE
    base, run_id = args
    try:
        config = cfg.load_config(base)
    except (OSError, ValueError) as e:
        print(e)
        return CONFIG
    if bad := cfg.validate(config, tuple(ANALYSES.names())):
        print("\n".join(bad))
        return CONFIG
    spark = spark or session()
    path, conversion = f"{base}/processed/run{run_id}", config.get("conversion") or {}
    try:
        if conversion.get("enabled", False):
            run = canonical.convert_or_reuse(spark, path, lambda p: convert(spark, base, run_id, conversion, p), conversion.get("overwrite", False))
        else:
            run = canonical.CanonicalRun(spark, path)
    except Exception as e:
        print(f"conversion: {e}")
        return CONVERSION
    try:
        analyse(spark, config, run, f"{base}/result/run{run_id}")
    except ValueError as e:
        print(f"analysis: {e}")
        return ANALYSIS
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
