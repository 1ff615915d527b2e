"""A whole run directory: conversion, reuse and analyses, and the exit codes."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hodoscope.plans import run
from hodoscope.plans.registry import ANALYSES, CONVERTERS
from hodoscope.schemas import schema
from hodoscope.sources import results


@pytest.fixture(autouse=True, scope="module")
def user_code():
    """An analysis and a converter of a user, as a plug-in registers them."""

    @ANALYSES.register("CountTracks")
    def count_tracks(tables, script):
        return {"per_event": tables["tracks"].groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") > script["least"])}

    @CONVERTERS.register("Nothing")
    def nothing(spark, base, run_id, conversion):
        one = spark.createDataFrame([(0, 5, 1.0, [1], [0], [3], [0], [0], [0], [None], [int(run_id)], [0], [1.0])], schema("EVENTS_V3")) if conversion.get("rows", True) else None
        return one, spark.createDataFrame([], schema("CHANNELS")), 3


@pytest.fixture
def base(spark, tmp_path):
    """Digitised hits of straight tracks through three trackers and a DUT."""
    rng = np.random.default_rng(1)
    os.makedirs(tmp_path / "raw")
    dets = [{"id": i, "type": "planar", "role": "tracker", "position": [0, 0, 100 * i], "rotation": [0, 0, 0]} for i in (1, 2, 3)]
    dets.append({"id": 10, "type": "planar", "role": "dut", "position": [0, 0, 250], "rotation": [0, 0, 0], "Algorithms": {"HitProcessor": {}, "ClusterBuilder": {"maxClusterSize": 4}}})
    chips = [{"detector": d, "plane": p, "fec": d, "vmm": 4 * p + c, "id0": list(range(64 * c, 64 * c + 64))} for d in (1, 2, 3, 10) for p in (0, 1) for c in range(4)]
    json.dump({"vmm_geometry": chips}, open(tmp_path / "vmm_geometry.json", "w"))
    rows = []
    for e in range(40):
        t, (bx, by), (kx, ky) = 10000.0 * e, rng.uniform(20, 80, 2), rng.uniform(-0.01, 0.01, 2)
        rows += [(0, 0, 0, 0, 3, 400, t), (0, 0, 0, 0, 7, 400, t + 10)]
        for d, z in ((1, 100), (2, 200), (3, 300), (10, 250)):
            for p, u in ((0, kx * z + bx), (1, ky * z + by)):
                s = int(round(u / 0.4 + rng.normal(0, 0.1)))
                rows.append((d, p, d, 4 * p + s // 64, s % 64, 300, t + 20 + float(rng.normal(0, 2))))
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, det int, plane int, fec int, vmm int, ch int, adc int, time double").write.parquet(str(tmp_path / "raw" / "run7_"))
    scripts = [{"name": "TrackAnalysis", "resolutionX": 0.3, "resolutionY": 0.3, "useEstimatedResolution": False}, {"name": "DUTAnalysis", "xBins": 2, "yBins": 2, "margin": 1.0, "fakePartners": 2}, {"name": "TimeResolution", "analyzeDUTTiming": True}, {"name": "ExampleScript"}, {"name": "CountTracks", "least": 0}, {"name": "PadDUTAnalysis", "enabled": False}]
    json.dump({"conversion": {"type": "VMM3a", "enabled": True}, "detectors": dets, "scripts": scripts}, open(tmp_path / "config.json", "w"))
    return str(tmp_path)


def test_run(spark, base):
    assert run.main([base, "7"], spark) == 0
    out = f"{base}/result/run7"
    assert spark.read.parquet(f"{out}/tracks").count() >= 36
    s = spark.read.parquet(f"{out}/DUTAnalysis/efficiency_summary").first()
    assert s["efficiency_2d"] > 0.9 and spark.read.parquet(f"{out}/TimeResolution/track_times").count() >= 36
    assert spark.read.parquet(f"{out}/ExampleScript/counts").agg(F.sum("rows")).first()[0] == 320
    assert spark.read.parquet(f"{out}/CountTracks/per_event").count() >= 36
    moved = spark.read.parquet(f"{out}/DUTAnalysis/alignment_10").first()
    assert abs(moved["dx"]) < 0.5 and abs(moved["dy"]) < 0.5
    duts = spark.read.parquet(f"{out}/TimeResolution/dut_times")
    assert duts.count() >= 30 and abs(duts.agg(F.avg("residual")).first()[0]) < 2
    windows = {r["case"]: r["efficiency"] for r in spark.read.parquet(f"{out}/TimeResolution/window_efficiency").collect()}
    assert 0.9 <= windows["tracks"] <= windows["matched"] <= 1
    stored = results.read_parameters(spark, f"{out}/TimeResolution/parameters")
    assert stored["hat.resolution"] > 0 and sum(stored[f"hat.weights.{k}"] for k in range(3)) == pytest.approx(1)
    made = spark.read.parquet(f"{out}/hit_maps").groupBy("det").agg(F.sum("count").alias("n")).collect()
    assert {r.det for r in made} == {1, 2, 3} and sum(r.n for r in made) == spark.read.parquet(f"{out}/tracks").select(F.explode("hits")).count()
    assert {r.hist for r in spark.read.parquet(f"{out}/hit_properties").select("hist").distinct().collect()} == {"cluster_charge", "size", "adc"}
    kinds = {r.hist: r.n for r in spark.read.parquet(f"{out}/DUTAnalysis/hit_maps").groupBy("hist").agg(F.sum("count").alias("n")).collect()}
    rows = spark.read.parquet(f"{out}/DUTAnalysis/dut_rows")
    assert kinds["matched"] == rows.where("hit_flag = 3").count() and kinds["predicted"] == rows.count() and kinds["reconstructed"] >= kinds["matched"]
    assert spark.read.parquet(f"{out}/DUTAnalysis/hit_profile_x").count() > 5 and spark.read.parquet(f"{out}/DUTAnalysis/hit_properties").where("hist = 'size'").count() > 0
    fit = spark.read.parquet(f"{out}/DUTAnalysis/residual_fits_x").first()
    assert fit["entries"] == rows.where("res_x IS NOT NULL").count() and fit["within_3sigma"] <= fit["within_5sigma"]
    report = {(r.det, r.plane): r.hits for r in spark.read.parquet(f"{base}/processed/run7/conversion_report").collect()}
    assert report[10, 0] == 40 and spark.read.parquet(f"{base}/processed/run7/qa").where("det = 10 AND plane = 0 AND hist = 'occupancy'").agg(F.sum("count")).first()[0] == 40
    before = os.path.getmtime(f"{base}/processed/run7/metadata/_SUCCESS")
    config = json.load(open(f"{base}/config.json"))
    config["scripts"] = [{"name": "ExampleScript"}]
    json.dump(config, open(f"{base}/config.json", "w"))
    assert run.main([base, "7"], spark) == 0 and os.path.getmtime(f"{base}/processed/run7/metadata/_SUCCESS") == before


def test_exit_codes(spark, base, tmp_path):
    assert run.main([base], spark) == run.USAGE and run.main([base, "x"], spark) == run.USAGE
    assert run.main([str(tmp_path / "none"), "1"], spark) == run.CONFIG
    assert run.main([base, "99"], spark) == run.CONVERSION


def test_each_detector_has_its_own_settings(spark, base):
    config = json.load(open(f"{base}/config.json"))
    config["detectors"][3]["Algorithms"] = {"HitProcessor": {"noiseThreshold": 500}}
    config["scripts"] = [{"name": "ExampleScript"}]
    json.dump(config, open(f"{base}/config.json", "w"))
    kinds = run.chain_settings(config["detectors"])
    assert sorted(map(sorted, kinds.values())) == [[1, 2, 3], [10]]
    assert {h.threshold for h, _, _ in kinds} == {100.0, 500.0}
    assert run.main([base, "7"], spark) == 0
    valid = {r["det"]: r["n"] for r in spark.read.parquet(f"{base}/result/run7/channel_hits").where("is_valid").groupBy("det").agg(F.count("*").alias("n")).collect()}
    assert valid[1] == 80


def test_registered_converter_runs(spark, base):
    config = json.load(open(f"{base}/config.json"))
    config["conversion"], config["scripts"] = {"type": "nothing", "enabled": True}, [{"name": "ExampleScript"}]
    json.dump(config, open(f"{base}/config.json", "w"))
    assert run.main([base, "12"], spark) == 0
    assert spark.read.parquet(f"{base}/processed/run12/events").first()["adc"] == [12]


def test_unknown_analysis_is_a_configuration_error(spark, base):
    config = json.load(open(f"{base}/config.json"))
    config["scripts"] = [{"name": "Unheard"}]
    json.dump(config, open(f"{base}/config.json", "w"))
    assert run.main([base, "7"], spark) == run.CONFIG
