"""Whole chains: a synthetic telescope, converters and files, streaming, properties."""

import math
import os
import random
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F, types as T

from hodoscope.config import AlignmentConfig, ClusterConfig, EfficiencyConfig, EventBuilderConfig, HitConfig, PadAlignmentConfig, PositionConfig, ScopeConfig, TimingConfig, TrackConfig
from hodoscope.functions import geometry, numerics
from hodoscope.operators import align, beam, clusters, efficiency, events, fits, grouped, hits, maps, match, scope, timing, tracks
from hodoscope.plans import adapters, catalog_tracks, registry, stages
from hodoscope.sources import apv, blocks, bt, canonical, results, scope as scope_source, vmm
from hodoscope.streaming import events as streaming
from tests import brute_tracks

SETUP = [
    *({"id": i, "type": "planar", "role": "tracker", "position": [0, 0, 100.0 * i], "rotation": [0, 0, 0]} for i in range(4)),
    {"id": 8, "type": "planar", "role": "dut", "position": [0, 0, 150.0], "rotation": [0, 0, 0]},
    {"id": 9, "type": "planar_pad", "role": "dut", "position": [0, 0, 250.0], "rotation": [0, 0, 0], "pads": {"rows": 20, "columns": 20, "pitchX": 5.0, "pitchY": 5.0, "planeType": 0}},
]
SIGMA, EFF = 0.1, 0.9


def telescope(spark, n=300, seed=1, shift=None):
    """(local hits, clusters of DUTs, detectors, planes): straight tracks with smeared hits and an inefficient DUT."""
    rng = np.random.default_rng(seed)
    dets, planes = geometry.detectors(spark, SETUP), geometry.planes(spark, SETUP)
    local, own = [], []
    for e in range(n):
        kx, ky, bx, by = rng.uniform(-0.01, 0.01, 2).tolist() + rng.uniform(20, 80, 2).tolist()
        for i in range(4):
            dx, dy = (shift or {}).get(i, (0, 0))
            x, y = kx * 100 * i + bx + rng.normal(0, SIGMA), ky * 100 * i + by + rng.normal(0, SIGMA)
            local.append((e, i, 0, float(x - dx), float(y - dy), 0.0))
        for axis, u in enumerate((kx * 150 + bx, ky * 150 + by)):
            if rng.random() < EFF:
                s = u / 0.4 + rng.normal(0, 0.1)
                own.append((e, 8, axis, axis, 1, float(s), float(s), None, None, [(axis, axis, round(s), -1, 1.0, 1.0, 5.0, 1.0)]))
        px, py = round((kx * 250 + bx) / 5), round((ky * 250 + by) / 5)
        if rng.random() < EFF:
            own.append((e, 9, 0, 0, 1, float(px), float(px), 5.0 * px, 5.0 * py, [(0, 0, px, py, 1.0, 1.0, 5.0, 1.0)]))
    lh = spark.createDataFrame(local, "entry long, det int, hit_idx int, x double, y double, z double").withColumns({"cluster_indices": F.array(F.lit(0)), "gx": F.lit(0.0), "gy": F.lit(0.0), "gz": F.lit(0.0)})
    cl = spark.createDataFrame(own, "entry long, det int, plane int, cluster_idx int, size int, pos double, centroid double, local_x double, local_y double, members array<struct<hit_idx:int,raw_idx:int,id0:int,id1:int,amp:double,charge:double,time:double,time_error:double>>")
    return stages.regloballed(lh, dets), cl, dets, planes


def test_tracks_and_efficiencies(spark):
    local, own, dets, planes = telescope(spark)
    out = stages.track_analysis(local, own, dets, TrackConfig())
    assert out["config"].resolution_x == pytest.approx(SIGMA, rel=0.2)
    found = out["tracks"].persist()
    assert 280 <= found.count() <= 300
    assert out["resolution"].first()["resolution_x"] == pytest.approx(SIGMA, rel=0.25)
    c = EfficiencyConfig(x_bins=2, y_bins=2, margin=0.8, fake_partners=5, scan_max=0.2)
    strict = tracks.strict_events(local, [0, 1, 2, 3])
    dut = stages.dut_analysis(found, own, dets, planes, c, strict)
    s = dut["efficiency_summary"].first()
    assert s["low_x"] - 0.06 < EFF < s["high_x"] + 0.06 and s["efficiency_2d"] <= min(s["efficiency_x"], s["efficiency_y"])
    assert dut["fake_summary"].first()["efficiency_2d"] < 0.02
    assert dut["residuals_x"].first()["sigma68"] < 0.3 and dut["margin_scan"].count() == 5
    pads = stages.pad_analysis(found, own, dets, c, strict)
    assert pads["efficiency_summary"].first()["efficiency_2d"] == pytest.approx(EFF, abs=0.06)
    assert pads["pad_rows"].count() == pads["samples"].count() and dut["projection_x"].count() == 2


def test_trackers_are_aligned(spark):
    local, own, dets, _ = telescope(spark, 200, 2, {1: (0.4, -0.3)})
    out = stages.track_analysis(local, own, dets, TrackConfig(), alignment=AlignmentConfig(max_iterations=6), estimate_resolution=False)
    a = {r["det"]: r for r in out["alignment"].collect()}
    # only what differs from a common shift and tilt of all planes can be seen: residuals come back to the resolution
    assert a[1]["loss_after"] < 0.5 * a[1]["loss_before"]
    assert out["resolution"].first()["resolution_x"] == pytest.approx(SIGMA, rel=0.3)


def test_pad_alignment_recovers_a_shift(spark):
    local, own, dets, _ = telescope(spark, 250, 3)
    found = stages.track_analysis(local, own, dets, TrackConfig())["tracks"].persist()
    own = own.withColumns({"local_x": F.col("local_x") - 0.8})
    out = stages.pad_analysis(found, own, dets, EfficiencyConfig(margin=2.0, x_bins=2, y_bins=2, fake_enabled=False), alignment=PadAlignmentConfig(parameters=("dx", "dy"), min_matches=50))
    assert out["alignment_9"].first()["dx"] == pytest.approx(0.8, abs=0.3)


def test_strip_alignment_recovers_a_shift(spark):
    local, own, dets, planes = telescope(spark, 200, 4)
    found = stages.track_analysis(local, own, dets, TrackConfig())["tracks"].persist()
    strips = match.strip_clusters(own.where("det = 8"), geometry.axis_planes(planes.where("det = 8")), planes).withColumn("centre", F.col("centre") - F.when(F.col("axis") == "x", 0.7).otherwise(0.0))
    g = dets.where("det = 8").first().asDict()
    got = align.align_strip_dut(found, strips, g, iterations=4, scan=1, scan_range=0.0, free=(0, 1))
    assert got.corrections[8][0] == pytest.approx(0.7, abs=0.15) and got.after < got.before


def test_search_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        scores = sorted((rng.uniform(200, 400) for _ in range(n)), reverse=True)
        picks = [tuple(rng.randint(-1, 2) for _ in range(3)) for _ in range(n)]
        free = lambda s: all(not any(a >= 0 and a == b for a, b in zip(picks[i], picks[j])) for i in s for j in s if i < j)
        best = max(sum(scores[i] for i in s) for k in range(1 << n) for s in [[i for i in range(n) if k >> i & 1]] if free(s) and len(s) <= 4)
        clash = np.array([[not free([i, j]) for j in range(n)] for i in range(n)]) if n > 1 else np.zeros((1, 1), bool)
        got = np.flatnonzero(beam.independent_sets(np.array([scores]), clash[None], np.array([n]), 4, 20000)[0]).tolist()
        assert got == brute_tracks.independent_set(scores, picks, 4, 20000)
        assert free(got) and sum(scores[i] for i in got) == pytest.approx(best)


def _block_file(rng, blocks, samples):
    raw = b"\x12\x34\xca\xca"
    event = 65300
    for _ in range(blocks):
        if rng.random() < 0.3:
            raw += b"\xca\xca\x00\x01"[: 2 * rng.randint(1, 2)]  # other words between blocks
        event = (event + rng.choice([1, 40, 150])) % 65536
        count = rng.randint(0, 5)
        raw += struct.pack(">10H", 0xEEEE, rng.randint(0, 15), rng.randint(0, 9), rng.randint(0, 65535), rng.randint(0, 65535), event, count, 1, 0xEEEE, 3)
        for _ in range(count):
            raw += struct.pack(f">{1 + samples}H", rng.randint(0, 300), *(rng.choice([0xEEEE, 0xCACA, rng.randint(0, 65535)]) for _ in range(samples)))
        raw += bytes([rng.choice([0xEE, 0, 0xCA])])
    return raw


def test_block_source_is_the_decoder_at_every_cut(spark, folder):
    """Files cut off at every byte, read in parts of a few blocks; counter turns and marks inside of samples."""
    rng = random.Random(9)
    schema = T._parse_datatype_string(bt.CHANNEL)
    raw = _block_file(rng, 14, 3)
    path = f"{folder}/cut.dat"
    for end in range(0, len(raw) + 1):
        with open(path, "wb") as f:
            f.write(raw[:end])
        reader = blocks.BlockReader(schema, {"samples": "3", "splitBytes": str(rng.choice([1, 60, 10**6])), "path": path})
        try:
            want = bt.decode(raw[:end], 3)
        except ValueError as e:
            with pytest.raises(ValueError, match=str(e)):
                reader.partitions()
            continue
        got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert [r[1:] for r in got] == want


def test_block_source_in_spark(spark, folder):
    rng = random.Random(1)
    for k in range(3):
        with open(f"{folder}/run{k}.dat", "wb") as f:
            f.write(_block_file(rng, 150, 5))
    paths = [f"{folder}/run{k}.dat" for k in range(3)]
    blocks.register(spark)
    df = spark.read.format("chip_blocks").option("samples", 5).option("splitBytes", 2000).load(paths)
    want = [tuple(r) for r in bt.read_blocks(spark, paths, 5).collect()]
    assert df.rdd.getNumPartitions() > 6
    key = lambda r: (r[0].split("/")[-1], *r[1:])
    assert sorted(key(tuple(r)) for r in df.collect()) == sorted(key(r) for r in want)
    slim = spark.read.format("chip_blocks").schema("ext_event long, pos int").option("samples", 5).load(paths[0])
    assert sorted(map(tuple, slim.collect())) == sorted((r[2], r[8]) for r in want if r[0].endswith("run0.dat"))


def test_counters_are_unwrapped_over_parts_and_blocks(spark):
    rng = random.Random(6)
    ids = sorted(rng.sample(range(-50, 4000), 900))  # gaps longer than a part and a block of 3
    c, rows, epoch, before = 64000, [], 0, None
    for i in ids:
        c = (c + rng.choice([10, 900, 3000])) % 65536
        epoch += 65536 * (before is not None and before > 0xF000 and c < 0x1000)
        rows.append((i, c, c + epoch))
        before = c
    df = spark.createDataFrame([(i, c, "kept") for i, c, _ in rows] + [(None, 3, "x"), (5, None, "x")], "i long, c long, other string").repartition(5)
    for span in (3, 20, 1000):
        assert sorted((r.i, r.c, r.extended) for r in bt.unwrap(df, "i", "c", span).collect()) == rows
    assert epoch > 65536


def _coincidences_one_by_one(rows, window, dead):
    out = []
    for run in {r[0] for r in rows}:
        a, b = (sorted((t, i) for r, side, t, i in rows if r == run and side == s) for s in (0, 1))
        i = j = n = 0
        last = -math.inf
        while i < len(a) and j < len(b):
            if abs(a[i][0] - b[j][0]) <= window:
                t = (a[i][0] + b[j][0]) / 2
                if t - last >= dead:
                    out.append((run, t, a[i][1], b[j][1], n))
                    last, n = t, n + 1
                i, j = i + 1, j + 1
            elif a[i][0] < b[j][0]:
                i += 1
            else:
                j += 1
    return sorted(out)


@pytest.mark.parametrize("window, dead, rate", [(2.0, 0.0, 1.0), (2.0, 3.5, 1.0), (0.1, 7.0, 3.0), (9.0, 1.0, 0.3), (3.0, 40.0, 0.05)])
def test_coincidences_over_slices_are_the_walk(spark, window, dead, rate):
    """Dense bursts without a gap, more candidates of one side, ties and quiet stretches, cut into many slices."""
    rng = random.Random(int(window * 10 + dead))
    rows, k = [], 0
    for run, n in ((1, 900), (2, 40), (7, 500)):
        t = 0.0
        for _ in range(n):
            t += rng.choice([0.0, 0.1, 0.3, 1.0, 0.5 + rng.random()]) / rate + (30 if rng.random() < 0.01 else 0)
            rows.append((run, int(rng.random() < (0.3 if t % 50 < 25 else 0.6)), round(t, 1), k))
            k += 1
    df = spark.createDataFrame([*rows, (1, 0, None, -1), (1, 1, float("nan"), -2), (None, 0, 1.0, -3)], "run long, side int, t double, id long").repartition(5)
    want = _coincidences_one_by_one(rows, window, dead)
    assert len(want) > 10
    for size in (25, 150, 10**6):
        got = events.coincidences(df, window, dead, slice_rows=size)
        assert sorted((r.run, r.t, r.id_a, r.id_b, r.trigger) for r in got.collect()) == want
    placed = events._slices(df.where("run = 1 AND t > 0"), window, 25)
    assert len(placed.starts[1]) > 5  # one run, many tasks


def test_left_range_join_keeps_each_row(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(1, 3, 5.0)] * 3 + [(1, i, rng.uniform(0, 90)) for i in range(40)], "run long, k int, t double")
    right = spark.createDataFrame([(1, i, rng.uniform(0, 60)) for i in range(30)], "run long, id int, s double")
    got = events.range_join(left, right, F.col("t") - 3, F.col("t") + 2, "s", 2.0, ["run"])
    want = [(l.k, l.t, r.id) for l in left.collect() for r in [x for x in right.collect() if l.t - 3 <= x.s < l.t + 2] or [right.select(F.lit(None).alias("id")).first()]]
    assert sorted(map(str, want)) == sorted(str((r.k, r.t, r.id)) for r in got.collect())


def test_windows_shuffle_no_pairs(spark):
    """In a dense run the pairs of triggers and hits are a multiple of both; only triggers and hits may be shuffled."""
    n = 3000
    hits = spark.range(n).select(F.lit(1).cast("long").alias("run"), "id", *(F.lit(0).alias(c) for c in ("det", "plane", "id0", "id1", "vmm", "ch", "adc")), F.pmod(F.col("id") * 7, F.lit(50)).cast("double").alias("time"))
    # one trigger is there twice, one has no hit
    triggers = spark.createDataFrame([(1, k, float(k % 40)) for k in range(100)] + [(1, 3, 3.0), (1, 500, 900.0)], "run long, trigger long, t double")
    c = EventBuilderConfig(window_offset_ns=0.0, before_ns=5.0, after_ns=5.0)
    flat = events.event_window(triggers, hits, c)
    nested = events.nested_events(triggers, hits, c)
    want = {}
    for t in triggers.collect():
        want.setdefault(t.trigger, []).extend((float(i * 7 % 50), i) for i in range(n) if t.t - 5 <= i * 7 % 50 < t.t + 5)
    got = {}
    for r in flat.collect():
        got.setdefault(r.trigger, []).extend([(r.hit_time, r.id)] if r.id is not None else [])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and want[500] == []
    rows = nested.collect()
    assert {r.evt: list(zip((r.time + x for x in r.hit_time_ns), r.rawhitid)) for r in rows} == {k: sorted(v) for k, v in want.items()}
    assert sorted(r.entry for r in rows) == list(range(101)) and all(len(r.adc) == len(r.waveform) == len(r.rawhitid) for r in rows)
    for own in (flat, nested):
        own.write.format("noop").mode("overwrite").save()
    for own in (flat, nested):
        plan = own._jdf.queryExecution().optimizedPlan().toString()
        # nothing is grouped, sorted or joined after hits have met their triggers
        assert plan.index("Join LeftOuter") < min([plan.index(w) for w in ("Aggregate", "Window", "Sort") if w in plan] or [len(plan)])


@pytest.mark.parametrize("together", [4096, 7])
def test_triggers_of_one_time_meet_their_hits_once(spark, monkeypatch, together):
    """All triggers of a time follow each other for each hit, in every task; none is lost, be it there twice, without id, run, time or hits."""
    monkeypatch.setattr(events, "TOGETHER", together)
    hits = spark.range(60).select(F.lit(1).cast("long").alias("run"), "id", (F.col("id") % 20).cast("double").alias("time"))
    rows = [(1, k, float(k % 4)) for k in range(80)] + [(1, 3, 3.0), (1, None, 2.0), (1, 900, None), (None, 901, 2.0), (1, 902, 500.0)]
    triggers = spark.createDataFrame(rows, "run long, trigger long, t double").repartition(6)
    got = events.event_window(triggers, hits, EventBuilderConfig(window_offset_ns=0.0, before_ns=2.0, after_ns=3.0))
    assert got.columns == ["run", "trigger", "t", "id", "hit_time", "hit_time_ns"]
    want = []
    for run, k, t in rows:
        near = [i for i in range(60) if run and t is not None and t - 2 <= i % 20 < t + 3]
        want += [(run, k, t, i, float(i % 20), i % 20 - t) for i in near] or [(run, k, t, None, None, None)]
    parts = got.rdd.glom().collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for p in parts for r in p)
    runs = sum(1 for p in parts for k, r in enumerate(p) if not k or (r.t, r.id) != (p[k - 1].t, p[k - 1].id))
    pairs = len({w[2:4] for w in want})
    assert runs <= pairs * (1 if together > 100 else 4) + 1 < len(want) / 2


def _searched_one_by_one(frame, geometry, c):
    """(event, hits by layer, line) of every track, event by event."""
    out = []
    for e, own in frame.groupby("event"):
        by = {k: h.assign(row=h.index).to_dict("records") for k, h in own.groupby("layer")}
        have = [k for k in range(len(geometry)) if k in by]
        for t in brute_tracks.search_event([(geometry[k], by[k]) for k in have], len(geometry), c):
            hit = [-1] * len(geometry)
            for k, i in zip(have, t["hits"]):
                hit[k] = by[k][i]["row"] if i >= 0 else -1
            out.append((e, hit, list(t["line"])))
    return out


@pytest.mark.parametrize("layers, limits", [(3, {}), (4, {}), (5, {"max_candidates": 40, "conflict_search_nodes": 300, "max_tracks": 4, "final_candidates": 20}), (4, {"max_candidates": 9, "conflict_search_nodes": 50, "max_branches_per_layer": 2})])
def test_columnar_search_is_the_search_event_by_event(layers, limits, monkeypatch):
    """A thousand events in all, at and below every limit, with ties, missing planes and planes at one z."""
    monkeypatch.setattr(beam, "CANDIDATES", 700)  # many parts of a batch
    monkeypatch.setattr(beam, "PAIRS", 900)
    rng = np.random.default_rng(layers)
    c = TrackConfig(resolution_x=0.5, resolution_y=0.5, **limits)
    turn = {"r00": 1.0, "r01": 0.0, "r02": 0.0, "r10": 0.0, "r11": 1.0, "r12": 0.0, "r20": 0.0, "r21": 0.0, "r22": 1.0}
    geometry = [{"det": k, "px": 0.0, "py": 0.0, "pz": 100.0 * k, **turn} for k in range(layers)]
    rows = []
    for e in range(260):
        for _ in range(rng.integers(1, 6)):
            bx, by, kx, ky = rng.integers(0, 12, 4)
            rows += [(e, k, bx + kx * k / 10 + rng.integers(-2, 3) / 10, by + ky * k / 10, 100.0 * k if rng.random() < 0.97 else 0.0) for k in range(layers) if rng.random() < 0.85]
    frame = pd.DataFrame(rows, columns=["event", "layer", "gx", "gy", "gz"])
    frame = frame.assign(event=frame["event"].rank(method="dense").astype(int) - 1, x=frame["gx"], y=frame["gy"]).sort_values(["event", "layer"], kind="stable").reset_index(drop=True)
    got = beam.search(frame["event"].to_numpy(), frame["layer"].to_numpy(), {k: frame[k].to_numpy() for k in ("x", "y", "gx", "gy", "gz")}, geometry, c)
    want = _searched_one_by_one(frame, geometry, c)
    assert [(e, h) for e, h, _ in want] == list(zip(got["event"].tolist(), got["hit"].T.tolist()))
    assert np.array_equal(np.array([w for _, _, w in want]).T, got["line"])


def test_conflict_search_ends_at_any_node_limit_as_one_by_one(monkeypatch):
    """Each limit gives what the search node by node gives there, in about half as many steps as nodes."""
    rng = np.random.default_rng(3)
    steps, rest = [], beam._rest
    monkeypatch.setattr(beam, "_rest", lambda words: steps.append(1) or rest(words))
    for n, hits, most in ((12, 4, 32), (40, 9, 3), (70, 12, 32), (130, 14, 32)):
        picks = rng.integers(0, hits, (9, n, 3))
        scores = -np.sort(-(300 - rng.integers(0, 12, (9, n)) / 4), 1)
        count = rng.integers(1, n + 1, 9)
        clash = (picks[:, :, None, :] == picks[:, None, :, :]).any(3) & ~np.eye(n, dtype=bool)
        for nodes in [*range(1, 40), 77, 400, 3000]:
            steps.clear()
            got = beam.independent_sets(np.where(np.arange(n) < count[:, None], scores, 0.0), clash, count, most, nodes)
            want = [brute_tracks.independent_set(scores[k, :c].tolist(), [tuple(p) for p in picks[k, :c].tolist()], most, nodes) for k, c in enumerate(count.tolist())]
            assert [np.flatnonzero(g).tolist() for g in got] == [sorted(w) for w in want]
            assert len(steps) <= nodes / 2 + n


@pytest.mark.parametrize("block, steps", [(7, 3), (16_384, 32)])
def test_conflict_search_with_hits_ends_at_any_node_limit_as_one_by_one(monkeypatch, block, steps):
    """Nodes below which nothing is better are counted apart, and the limit holds nevertheless; few nodes are left to be searched."""
    monkeypatch.setattr(beam, "BLOCK", block)
    monkeypatch.setattr(beam, "STEPS", steps)
    rng = np.random.default_rng(5)
    taken, rest = [], beam._rest
    monkeypatch.setattr(beam, "_rest", lambda words: taken.append(1) or rest(words))
    for n, hits, most, least in ((12, 4, 32, 0), (40, 9, 3, -1), (70, 12, 32, 0), (130, 14, 32, -1), (80, 12, 32, 0)):
        picks = rng.integers(least, hits, (9, n, 3))
        scores = -np.sort(-(300 - rng.integers(0, 12, (9, n)) / 4 if n != 80 else 300 - 3 * rng.random((9, n))), 1)
        count = rng.integers(max(1, n // 2), n + 1, 9)
        clash = ((picks[:, :, None, :] == picks[:, None, :, :]) & (picks[:, :, None, :] >= 0)).any(3) & ~np.eye(n, dtype=bool)
        for nodes in [*range(1, 20), 77, 400, 3000, 12_000]:
            taken.clear()
            got = beam.independent_sets(np.where(np.arange(n) < count[:, None], scores, 0.0), clash, count, most, nodes, picks)
            want = [brute_tracks.independent_set(scores[k, :c].tolist(), [tuple(p) for p in picks[k, :c].tolist()], most, nodes) for k, c in enumerate(count.tolist())]
            assert [np.flatnonzero(g).tolist() for g in got] == [sorted(w) for w in want]
        if steps > 3 and n == 80:
            assert len(taken) <= nodes / 5


@pytest.mark.parametrize("mode", ["Fit", "Mode1"])
def test_waveforms_of_one_partition_are_fitted_by_all_cores(spark, mode):
    wave = [0] * 8 + [20, 200, 420, 500, 430, 330, 240, 170, 120, 80, 50, 30] + [10] * 14
    rows = spark.range(40).coalesce(1).select(F.col("id").alias("entry"), *(F.lit(0).alias(n) for n in ("det", "plane", "id0", "raw_idx")), F.lit(-1).alias("id1"), F.array(*map(F.lit, wave)).cast("array<short>").alias("adc"), F.lit(None).cast("double").alias("adc_value"), F.lit(None).cast("double").alias("hit_time_ns"))
    own = hits.fitted_features(rows, HitConfig(mode=mode))
    used = own.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == min(40, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)) > 1
    assert own.count() == 40 and own.select("time").distinct().count() == 1


def test_a_step_of_the_fit_takes_one_call_for_its_jacobian():
    calls = []
    x = np.arange(20.0)
    fit = numerics.least_squares(lambda x, p: calls.append(1) or numerics.power_pulse(x, p), x, numerics.power_pulse(x, np.array([50.0, 2.5, 2.0, 4.0, 1.5])), np.array([40.0, 2.0, 2.5, 0.0, 1.2]))
    assert fit.ok and fit.params == pytest.approx([50.0, 2.5, 2.0, 4.0, 1.5], rel=1e-4)
    assert len(calls) < 50


def _met_by_key(df):
    """Whether the plan sorts or deals whole rows to meet them by key."""
    return any(w in df._jdf.queryExecution().executedPlan().toString() for w in ("SortMergeJoin", "ShuffledHashJoin"))


def test_property_ranges_are_sent_to_the_rows(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("det"), F.lit(0).alias("plane"), F.col("id").cast("double").alias("v"))
    own = maps.hit_properties(rows, ["det", "plane"], ["det"], {"v": "v"})
    assert not _met_by_key(own) and own.agg(F.sum("count")).first()[0] == 500


def test_residual_ranges_and_fits_are_sent_to_the_rows(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("det"), (F.col("id") % 31).cast("double").alias("v"))
    assert not _met_by_key(fits.histograms(rows, ["det"], "v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the one join left is of the fits with their shares, a row a key each
    try:
        plan = fits.fit_residuals(rows, ["det"], "v")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") >= 2 and plan.count("SortMergeJoin") <= 1


def test_groups_are_gathered_whole(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for least in (0, 1200):
            calls = grouped.map_whole_groups(df, ["k"], lambda f, g: pd.DataFrame({"rows": [len(f)], "groups": [g.max() + 1], "whole": [int((f.groupby("k").size() >= 7).all())]}), "rows long, groups long, whole long", least_rows=least).collect()
            assert sum(r.rows for r in calls) == 5000 and sum(r.groups for r in calls) == 700 and all(r.whole for r in calls)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


@hyp(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 20)), max_size=25), st.integers(0, 1))
def test_labels_are_components(pairs, _):
    n = 21
    edges = np.array([(a, b) for a, b in pairs], int).reshape(-1, 2)
    got = grouped.component_labels(n, edges[:, 0], edges[:, 1])
    want = list(range(n))
    for _ in range(n):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got.tolist() == want


def test_range_join_is_the_nested_loop(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(1, i, rng.uniform(0, 100)) for i in range(60)], "run long, k int, t double")
    right = spark.createDataFrame([(1, i, rng.uniform(0, 100)) for i in range(200)], "run long, id int, s double")
    got = events.range_join(left, right, F.col("t") - 3, F.col("t") + 2, "s", 5.0, ["run"], "inner")
    want = left.join(right, "run").where("s >= t - 3 AND s < t + 2")
    assert sorted(map(tuple, got.select("k", "id").collect())) == sorted(map(tuple, want.select("k", "id").collect()))


def test_fake_partners_are_distinct_others(spark):
    own = spark.range(500).select(F.lit(1).alias("det"), F.col("id").alias("entry"))
    got = match.fake_partners(own, 12345, 20).collect()
    by = {}
    for r in got:
        by.setdefault(r["entry"], []).append(r["partner"])
    assert len(by) == 500 and all(len(set(v)) == 20 and k not in v for k, v in by.items())
    assert sorted(map(tuple, got)) == sorted(map(tuple, match.fake_partners(own.repartition(7), 12345, 20).collect()))
    assert match.fake_partners(own.limit(1), 1, 5).count() == 0 and match.fake_partners(own.limit(3), 1, 5).count() == 6


# --- converters ----------------------------------------------------------------------------------------------------------


def stream(blocks, samples=2):
    raw = b"\x00\x01" + struct.pack(">H", bt.SYNC)
    for chip, event, chans in blocks:
        raw += struct.pack(">8H", bt.BLOCK, chip, 1, 2, 0x0300, event, len(chans), 0) + b"\0\0\0\0"
        for ch, wave in chans:
            raw += struct.pack(f">{1 + samples}H", ch, *[w & 0xFFFF for w in wave])
        raw += b"\0"
    return raw


def test_binary_run(spark, folder):
    raw = stream([(5, 65535, [(3, [1, -1]), (4, [0x7FF, 0x800])]), (5, 0, [(3, [5, 6])]), (1, 500, []), (1, 499, [(9, [1, 2])])]) + struct.pack(">2H", bt.BLOCK, 1)
    rows = bt.decode(raw, 2)
    assert [r[1:4] for r in rows] == [(65535, 65535, 16777731)] * 2 + [(65536, 0, 16777731), (65536 + 499, 499, 16777731)]
    assert rows[0][4:] == (1, 1, 3, 0, [1, -1]) and rows[1][-1] == [2047, -2048]
    with pytest.raises(ValueError):
        bt.decode(b"\0\0\0\0", 2)
    (p := f"{folder}/a.dat") and open(p, "wb").write(raw)
    blocks = bt.read_blocks(spark, bt.list_files([p], folder), 2)
    cmap = spark.createDataFrame(bt.parse_map("# map\nboard_id,Chip_ID,channel_id,detector_id,plane_type,strip_id,gain\n1,1,3,0,0,7,2.5 # x\n1,1,4,0,0,8\n0,1,9,1,1,9\n"), "board_id int, chip_id int, channel_id int, detector_id int, plane_type int, strip_id int, pedestal double, noise_sigma double, gain double, polarity int, status long")
    ev, ch = bt.convert(blocks, cmap, bt.pedestal_stats(blocks))
    assert [(r["entry"], r["event_id"], r["strip_id"]) for r in ev.orderBy("entry").collect()] == [(0, 65535, [7, 8]), (1, 0, [7]), (2, 499, [9])]
    canonical.write_run(f"{folder}/v1", ev, ch, {"schema_version": 1})
    with pytest.raises(ValueError, match="schema version"):
        canonical.CanonicalRun(spark, f"{folder}/v1")
    canonical.write_run(f"{folder}/v2", *bt.upgrade(ev, ch), {"schema_version": 2})
    run = canonical.CanonicalRun(spark, f"{folder}/v2")
    assert run.hits().count() == 0 and run.raw_ids.count() == 3  # nothing rises above its own pedestal
    assert canonical.convert_or_reuse(spark, f"{folder}/v2", None).version == 2
    with pytest.raises(ValueError, match="pedestal"):
        bt.convert(blocks, cmap, bt.pedestal_stats(blocks.where("channel_id = 3")))


@pytest.mark.parametrize("text", ["", "1,1,1,0,0,0\n1,1,1,0,0,1", "1,2,3"])
def test_bad_maps(text):
    with pytest.raises(ValueError):
        bt.parse_map(text)


def test_waveform_run(spark, folder):
    import json

    json.dump([{"detectorId": 2, "chipId": 7, "planeId": 1, "id0": list(range(128))}], open(f"{folder}/Geometry.json", "w"))
    geo = apv.read_geometry(spark, f"{folder}/Geometry.json")
    raw = spark.createDataFrame([(40, [7, 7], [0, 5], [[1, 9, 9], [4, 2, 0]], 1, 2), (30, [7], [1], [[0, 300, 0]], 1, 0)], "apv_evt long, apv_id array<int>, apv_ch array<int>, apv_q array<array<short>>, time_s long, time_us long")
    ped = spark.createDataFrame([([7, 7], [0, 9], [2.0, 3.0])], "apv_id array<int>, apv_ch array<int>, apv_pedstd array<double>")
    ev, ch = apv.convert(raw, geo, ped)
    a, b = ev.orderBy("entry").collect()
    assert (a["event_id"], a["timestamp"], a["peak_sample"]) == (30, 1000000, [1]) and (b["id0"], b["waveform_max"]) == ([0, 5], [9, 4])
    assert {(r["channel_id"], r["noise_sigma"]) for r in ch.collect()} == {(0, 2.0), (1, -1.0), (5, -1.0), (9, 3.0)}
    canonical.write_run(f"{folder}/run", ev, ch, {"schema_version": 2})
    own = canonical.CanonicalRun(spark, f"{folder}/run")
    assert [r["id0"] for r in own.hits().orderBy("id0").collect()] == [0, 1, 5] and own.event(0).count() == 1
    with pytest.raises(Exception, match="no geometry"):
        apv.convert(raw.withColumn("apv_id", F.transform("apv_id", lambda x: F.lit(9))), geo)[0].collect()


def test_digitised_run(spark, folder):
    import json

    json.dump({"vmm_geometry": [{"detector": 1, "plane": 0, "fec": 1, "vmm": 2, "id0": list(range(64))}]}, open(f"{folder}/vmm_geometry.json", "w"))
    geo = vmm.read_geometry(spark, vmm.discover(folder, "5")[1])
    rows = [(1, 1, 0, 0, 0, 0, 3, 400, 100.0), (1, 2, 0, 0, 0, 0, 7, 400, 110.0), (1, 3, 1, 1, 1, 2, 5, 50, 120.0), (1, 4, 1, 0, 1, 9, 5, 50, 121.0), (1, 5, 1, 0, 1, 2, 6, 60, 2000.0)]
    h = spark.createDataFrame(rows, "run long, id long, det int, plane int, fec int, vmm int, ch int, adc int, time double")
    ev, ch, lost = vmm.convert(h, geo, EventBuilderConfig())
    r = ev.first()
    assert ev.count() == 1 and (r["rawhitid"], r["id0"], r["plane"]) == ([3], [5], [0]) and r["hit_time_ns"][0] == pytest.approx(120 - (100 + 110 - 3.958) / 2)
    assert lost.first()["unmapped"] == 1 and ch.count() == 2
    canonical.write_run(f"{folder}/run", ev, ch, {"schema_version": 3})
    hit = canonical.CanonicalRun(spark, f"{folder}/run").hits().first()
    assert hit["adc_value"] == 50 and hit["id0"] == 5


def scope_files(folder, n=3, ids=(5, 1000, 65535)):
    rng = np.random.default_rng(1)
    t0, dt, size = -300e-9, 1e-9, 900
    t = t0 + dt * np.arange(size)
    waves = {c: [] for c in range(1, 5)}
    for i in range(n):
        bits = [1, *map(int, f"{ids[i % len(ids)]:016b}"), 0]
        w = np.full(size, 1.0)
        for k, b in enumerate(bits):
            w[(t >= -50e-9 + k * 25e-9) & (t < -50e-9 + (k + 1) * 25e-9)] = 0.0 if b else 1.0
        waves[4].append(w)
        at = -170e-9 + rng.uniform(-3e-9, 3e-9)
        for c, s in ((1, 0.3e-9), (2, 0.4e-9), (3, 0.5e-9)):
            x = (t - at - rng.normal(0, s)) / 4e-9
            waves[c].append(-np.where(x > 0, np.minimum(x, 1) * np.exp(-np.maximum(x - 1, 0)), 0) * 0.8)
    for c, segs in waves.items():
        lines = ["scope", f"Segments,{n},x,{size}", "info", "Time,Ampl"]
        lines += [f"{a:.4e},{v:.6f}" for w in segs for a, v in zip(t, w)]
        open(f"{folder}/C{c}--run--00001.csv", "w").write("\n".join(lines))
    open(f"{folder}/C1Trace00002.csv", "w").write("alone")


def test_scope_run(spark, folder):
    scope_files(folder, 60, tuple(range(7, 67)))
    out = stages.oscilloscope(spark, folder, ScopeConfig())
    rows = out["scope_events"].collect()
    assert len(rows) >= 55 and {r["event_id"] for r in rows} <= set(range(7, 67))
    assert all(-160 < r["c1_time"] < -80 for r in rows)
    assert {r["status"] for r in out["status"].collect()} >= {"valid", "distinct_ids"}
    assert scope.smooth(np.array([5.0, 1, 4, 2, 3]), 3).tolist() == [5, 4, 2, 3, 3] and scope.decode_id(np.arange(5.0), np.arange(5.0), ScopeConfig()) is None
    assert scope_source.is_trace("C2Trace9.csv") and not scope_source.is_trace("C5--a--1.csv")


def test_time_resolution(spark):
    rng = np.random.default_rng(2)
    sig = {0: 2.0, 1: 3.0, 2: 4.0}
    rows = []
    for e in range(1500):
        t = rng.uniform(0, 50)
        for d, s in sig.items():
            a = rng.uniform(50, 500)
            rows.append((e, 0, d, 0, float(t + rng.normal(0, s)), 1.0, float(a)))
    strips = spark.createDataFrame(rows, "entry long, track_index int, det int, plane int, time double, time_error double, amp double")
    tr = spark.range(1500).select(F.col("id").alias("entry"), F.lit(0).alias("track_index"), F.col("id").alias("raw_event_id"))
    truth = strips.groupBy("entry").agg(F.avg("time").alias("reference_time")).withColumnRenamed("entry", "event_id")
    out = stages.time_resolution(strips, TimingConfig(tracker_ids=(0, 1, 2)), tr, truth)
    assert [math.sqrt(v) for v in out["hat"]["variances"]] == pytest.approx([2, 3, 4], rel=0.15)
    assert out["time_walk"]["entries"] == 4500 and out["corrected_times"].count() == 4500
    with pytest.raises(ValueError):
        stages.time_resolution(strips, TimingConfig())


# --- results, registries, streaming --------------------------------------------------------------------------------------


def test_result_readers(spark, folder):
    spark.createDataFrame([(1, 0, 0.1, 0.1, 1.0, 1.0)], "entry long, track_index int, kx double, ky double, bx double, by double").write.parquet(f"{folder}/t")
    assert results.read_tracks(spark, f"{folder}/t").first()["has_t0"] is False
    spark.createDataFrame([(1, 9, 3, 1)], "entry long, det int, cluster_idx int, hit_flag int").write.parquet(f"{folder}/pads")
    r = results.read_dut_rows(spark, f"{folder}/pads").first()
    assert (r["cluster_x"], r["cluster_y"], r["hit_flag"]) == (3, 3, 3)
    v = "entry long, raw_event_id long, track_index int, det int, res_x double, res_y double, cluster_indices array<int>"
    spark.createDataFrame([(1, 5, 0, 0, 0.0, 0.0, [0]), (1, 6, 0, 1, 0.0, 0.0, [0])], v).write.parquet(f"{folder}/v")
    with pytest.raises(ValueError, match="several"):
        results.read_validation(spark, f"{folder}/v")
    old = "event_id long, " + ", ".join(f"c{k}_time double, c{k}_valid boolean, c{k}_resolution double" for k in (1, 2, 3))
    spark.createDataFrame([(7, 1.0, True, 1.0, 2.0, True, 1.0, 3.0, True, 1.0), (8, 1.0, False, 1.0, 2.0, True, 1.0, 3.0, True, 1.0)], old).write.parquet(f"{folder}/s")
    assert [(r["event_id"], r["reference_time"]) for r in results.read_scope(spark, f"{folder}/s").collect()] == [(7, 2.0)]
    results.write(spark.range(4).selectExpr("id", "id % 2 AS run_id"), f"{folder}/runs", ["run_id"])
    assert results.read_runs(spark, f"{folder}/runs", [1]).count() == 2
    with pytest.raises(ValueError, match="lacks"):
        results.read_tracks(spark, f"{folder}/pads")


def test_registries():
    assert {"TrackAnalysis", "DUTAnalysis", "PadDUTAnalysis", "TimeResolution", "OscilloscopeAnalysis", "ExampleScript"} <= set(registry.ANALYSES.names())
    assert registry.CONVERTERS.get("VMM") is registry.CONVERTERS.get("vmm3a") and registry.ALGORITHMS.names() == sorted(registry.DEFAULT_CHAIN)
    with pytest.raises(KeyError, match="known: .*TrackAnalysis"):
        registry.ANALYSES.get("nothing")
    with pytest.raises(ValueError):
        registry.ALGORITHMS.register("HitProcessor")(None)


def test_streams(spark, folder):
    spark.sql("SELECT id AS run, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS trigger_time FROM range(2)").write.parquet(f"{folder}/t")
    spark.sql("SELECT id % 2 AS run, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 0.5) AS hit_time, int(id) AS det, 1 AS adc FROM range(6)").write.parquet(f"{folder}/h")
    read = lambda n: spark.readStream.schema(spark.read.parquet(f"{folder}/{n}").schema).parquet(f"{folder}/{n}")

    def run(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    got = run(streaming.window_join(read("t"), read("h"), "0.4 seconds", "0.6 seconds"), "joined")
    assert sorted((r["run"], r["det"]) for r in got) == [(0, 0), (1, 3)]
    h = read("h").select("run", F.col("hit_time").alias("trigger_time"))
    assert len(run(streaming.dead_time(h, 1.5), "alive")) == 4
    assert sum(r["hits"] for r in run(streaming.rates(read("h")), "rates", "complete")) == 6


def test_clusters_do_not_depend_on_order(spark):
    rng = random.Random(5)
    rows = [(e, 0, p, rng.randint(0, 30), -1, k, float(rng.randint(1, 50)), 1.0, float(rng.randint(0, 20)), 1.0, True) for e in range(20) for p in (0, 1) for k in range(p * 10, p * 10 + rng.randint(0, 9))]
    schema = "entry long, det int, plane int, id0 int, id1 int, raw_idx int, amp double, charge double, time double, time_error double, is_valid boolean"
    c = ClusterConfig(max_gap=1, time_window_ns=6, max_cluster_size=99)

    def make(own):
        df = spark.createDataFrame(own, schema)
        out = clusters.build_clusters(clusters.strip_groups(clusters.ordered_hits(df), c), c, PositionConfig())
        return sorted((r["entry"], r["cluster_idx"], [m["raw_idx"] for m in r["members"]]) for r in out.collect())

    a = make(rows)
    rng.shuffle(rows)
    assert a == make(rows) and sum(len(m) for *_, m in a) == len(rows)


def test_unused_settings_are_harmless():
    assert efficiency.margins(EfficiencyConfig(scan_step=0)) == [] and HitConfig().mode == "Default" and timing.three_corner_hat(1, 1, 1) == (0.5, 0.5, 0.5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_search_sees_all_valid_tracker_hits(spark):
    sf = "/root/testdata/sf0.001"
    assert catalog_tracks._searchable(spark, sf).count() == adapters.hits(spark, sf).where("is_valid AND det < 3").count() > 0


def test_only_clusters_that_need_a_line_go_to_python(spark):
    """Members are handed over only of clusters of three hits or more off plane 0, in events with a T0; a table is dealt by its rows."""
    member = "array<struct<hit_idx:int,raw_idx:int,id0:int,id1:int,amp:double,charge:double,time:double,time_error:double>>"
    of = lambda n: [(k, k, 10 + k, -1, 5.0 + k, 50.0 + k, 100.0 + 20 * k, None) for k in range(n)]
    rows = [(e, 0, plane, n, 7.5, of(n)) for e in (1, 2) for plane in (0, 1) for n in (1, 2, 4)]
    own = spark.createDataFrame(rows, f"entry long, det int, plane int, size int, pos double, members {member}")
    t0 = spark.createDataFrame([(1, 90.0), (2, float("nan"))], "entry long, t0 double")
    dim = spark.createDataFrame([(0, 0, 0.4, 64), (0, 1, 0.4, 64)], "det int, plane int, pitch double, n_strips int")
    for method in ("rawUTPC", "UTPC"):
        p = PositionConfig(method=method)
        out = clusters.drift_positions(own, t0, p, dim)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
        for r in out.collect():
            hits = [m.asDict() for m in r.members]
            if r.entry == 2 or (method == "UTPC" and (r.plane == 0 or r.size < 3)):
                want = 7.5
            else:
                want = clusters.drift_iterated(hits, 7.5, 90.0) if method == "UTPC" else clusters.drift_line(hits, r.plane, 90.0, p, 0.4, 64)
            assert r.pos == pytest.approx(want, rel=1e-12)


def test_a_large_table_is_dealt_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 100)
    assert adapters.dealt(spark.range(2000), F.col("id")).rdd.getNumPartitions() == 20
    assert "Repartition" not in adapters.dealt(spark.range(300), F.col("id"))._jdf.queryExecution().logical().toString()
