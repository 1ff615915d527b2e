"""Hand-computed cases of single operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hodoscope.config import ClusterConfig, EfficiencyConfig, EventBuilderConfig, HitConfig, PositionConfig, ScopeConfig, TimingConfig, clean_bins, ordered_range, settings, validate
from hodoscope.functions import columns, geometry, numerics
from hodoscope.operators import clusters, efficiency, events, hits, match, timing, tracks
from hodoscope.sources import bt

W1 = [0, 50, 150, 300, 200, 50]
RAW = "entry long, det int, plane int, id0 int, id1 int, raw_idx int, adc array<short>, adc_value double, hit_time_ns double"
CH = "entry long, det int, plane int, id0 int, id1 int, raw_idx int, amp double, charge double, time double, time_error double, is_valid boolean"


def raw(spark, *waves):
    return spark.createDataFrame([(i, 0, 0, i, -1, 0, w, None, None) for i, w in enumerate(waves)], RAW)


def test_default_features(spark):
    a, b, c, d, e = hits.waveform_features(raw(spark, [0, 0, 150, 300, 200, 50], [0, 50, 99], [0, 2001, 0], [0, 2000, 0], []), HitConfig()).orderBy("entry").collect()
    assert (a["amp"], a["peak_time"], a["charge"], a["time"], a["width"], a["is_valid"]) == pytest.approx((300, 75, 350, 40, 75, True))
    assert a["rise_time"] == pytest.approx(40)
    assert not b["is_valid"] and (c["is_valid"], c["is_saturated"]) == (False, True) and not d["is_saturated"] and not e["is_valid"]


def test_fit_charge_keeps_the_threshold(spark):
    r = hits.channel_hits(raw(spark, [0, 0, 150, 300, 200, 50]), HitConfig(mode="Fit")).first()
    assert r["charge"] == 650


def test_fitted_edge_and_pulse_times():
    t = np.arange(30)
    wave = np.round(numerics.sigmoid_edge(t, np.array([800, 0, 9.0, 1.2]))) * (t < 25)
    got = hits.fit_edge(wave, HitConfig(mode="Fit", time_pitch=1.0))
    assert got["is_valid"] and got["time"] == pytest.approx(9 - 1.2 * math.log(1 / 0.3 - 1), abs=0.05)
    p = np.array([300, 4.0, 3.0, 0.0, 1.5])
    wave = np.round(numerics.power_pulse(t.astype(float), p))
    got = hits.fit_pulse(wave, HitConfig(mode="Mode1", time_pitch=1.0, saturation_level=5000))
    height = 300 * (1.5 * 3) ** 1.5 * math.exp(-1.5)
    assert got["is_valid"] and numerics.power_pulse(np.array([got["time"]]), p)[0] == pytest.approx(0.3 * height, rel=0.03)


def test_calibration_rounds_away_from_zero(spark):
    ch = spark.createDataFrame([(0, 0, 0, -1, 2.5, 10.0, 1.0, 1)], "det int, plane int, id0 int, id1 int, pedestal double, noise_sigma double, gain double, polarity int")
    assert hits.calibrate(hits.with_calibration(raw(spark, [0]), ch)).first()["adc"] == [-3]
    loud = spark.createDataFrame([(0, 0, 0, -1, 0.0, 10.0, 2.0, 1), (0, 0, 1, -1, 0.0, 10.0, 2.0, 1)], ch.schema)
    kept = hits.zero_suppress(hits.calibrate(hits.with_calibration(raw(spark, [30, 0], [31, 0], [1]), loud)))
    assert [r["id0"] for r in kept.orderBy("id0").collect()] == [1, 2]  # 60 is at the limit, 62 above; unknown sigma stays


def strip(spark, rows):
    return spark.createDataFrame([(0, 0, 0, i, -1, k, a, q, t, 1.0, True) for k, (i, t, a, q) in enumerate(rows)], CH)


def parts(spark, rows, c):
    own = clusters.strip_groups(clusters.ordered_hits(strip(spark, rows)), c).groupBy("part").agg(F.sort_array(F.collect_list("id0")).alias("m"))
    return sorted(r["m"] for r in own.collect())


def test_islands(spark):
    rows = [(i, 0.0, 1.0, 1.0) for i in (10, 11, 13, 20)]
    assert parts(spark, rows, ClusterConfig()) == [[10, 11], [13], [20]]
    assert parts(spark, rows, ClusterConfig(max_gap=1)) == [[10, 11, 13], [20]]
    timed = [(10, 0.0, 1.0, 1.0), (11, 100.0, 1.0, 1.0), (12, 2.0, 1.0, 1.0)]
    assert parts(spark, timed, ClusterConfig(max_gap=1, time_window_ns=5)) == [[10, 12], [11]]


def test_cluster_numbers(spark):
    c = ClusterConfig()
    r = clusters.build_clusters(clusters.strip_groups(clusters.ordered_hits(strip(spark, [(10, 1.0, 100.0, 100.0), (11, 2.0, 300.0, 100.0)])), c), c, PositionConfig()).first()
    assert (r["size"], r["range"], r["charge"], r["max_amp"], r["centroid"], r["pos"], r["time"]) == (2, 2, 400, 300, 10.5, 10.75, 1.0)


@pytest.mark.parametrize("connectivity,n", [(4, 2), (8, 1)])
def test_pads(spark, connectivity, n):
    rows = [(0, 0, 0, x, y, k, 1.0, 1.0, 0.0, 1.0, True, 8, 8) for k, (y, x) in enumerate([(0, 0), (1, 1), (2, 1)])]
    df = spark.createDataFrame(rows, CH + ", pad_rows int, pad_columns int")
    assert clusters.pad_groups(df, ClusterConfig(connectivity=connectivity)).select("part").distinct().count() == n


def test_geometry(spark):
    d = geometry.detectors(spark, [{"id": 1, "type": "planar", "position": [5, 6, 7], "rotation": [0, 0, math.pi / 2]}])
    g = d.select(*[c.alias(n) for c, n in zip(geometry.to_global(F.lit(1.0), F.lit(0.0), F.lit(0.0)), "xyz")]).first()
    assert tuple(g) == pytest.approx((5, 7, 7))
    t = spark.createDataFrame([(0.01, -0.02, 1.0, 2.0), (0.0, 0.0, 0.0, 0.0)], "kx double, ky double, bx double, by double")
    flat = geometry.detectors(spark, [{"id": 1, "type": "planar", "position": [0, 0, 100], "rotation": [0, 0, 0]}, {"id": 2, "type": "planar", "position": [0, 0, -5], "rotation": [0, 0, 0]}])
    got = geometry.predict(t, flat).orderBy("kx").collect()
    assert len(got) == 2 and (got[1]["pred_x"], got[1]["pred_y"]) == pytest.approx((2, 0))  # the plane behind the start gives none
    with pytest.raises(ValueError, match="twice"):
        geometry.detectors(spark, [{"id": 1, "type": "planar"}, {"id": 1, "type": "planar"}])


def test_two_plane_solution(spark):
    cl = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 0, 1, 1, math.sqrt(2))], "entry long, det int, plane int, cluster_idx int, pos double").withColumns({"local_x": F.lit(None).cast("double"), "local_y": F.lit(None).cast("double")})
    setup = [{"id": 0, "type": "planar", "readoutPlanes": {"0": {"angle": 0, "pitch": 1}, "1": {"angle": 45, "pitch": 1}}}]
    r = clusters.local_hits(cl, geometry.detectors(spark, setup), geometry.planes(spark, setup)).first()
    assert (r["x"], r["y"]) == pytest.approx((1, 1))


def test_line_fit_and_leave_one_out(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (0, 1.0, 0.0, 100.0), (0, 2.0, 0.0, 200.0)], "entry long, gx double, gy double, gz double")
    r = tracks.fit_tracks(pts, ["entry"]).first()
    assert (r["kx"], r["bx"], r["chi2"]) == pytest.approx((0.01, 0, 0))
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (0, 0.3, 0.0, 100.0), (0, 0.0, 0.0, 200.0)], pts.schema)
    r = tracks.leave_one_out(pts, ["entry"]).where("gz = 100").first()
    assert (r["res_x"], r["eq_x"]) == pytest.approx((0.3, 0.244949), abs=1e-6)


def test_variances():
    v = timing.three_corner_hat(5.0, math.sqrt(34), math.sqrt(41))
    assert v == pytest.approx((9, 16, 25))
    w, r = timing.inverse_variance(v)
    assert w == pytest.approx([0.520156, 0.292588, 0.187256], abs=1e-6) and r == pytest.approx(2.163655, abs=1e-6)
    assert math.isnan(timing.inverse_variance((1.0, -1.0, 2.0))[1])


def test_time_methods(spark):
    rows = [(0, 10.0, 1.0, 1.0, 0), (0, 20.0, 2.0, 3.0, 1)]
    df = spark.createDataFrame(rows, "k int, time double, time_error double, amp double, plane int")
    t = lambda m, d=df: timing.cluster_times(d, ["k"], m).first()["t"]
    assert (t("XYMean"), t("XYMin"), t("XYWeighted"), t("YMean"), t("XMin")) == pytest.approx((12, 10, 17.5, 20, 10))
    assert t("XYMean", df.withColumn("time_error", F.lit(0.0))) == 15
    assert t("XMean", df.where("plane = 1")) is None


@pytest.mark.parametrize("a,b,dead,want", [([0, 10, 100], [3, 60, 104], 0, [1.5, 102]), ([0, 10, 100], [3, 60, 104], 200, [1.5]), ([0, 4], [2, 3], 0, [1.0, 3.5])])
def test_coincidences(spark, a, b, dead, want):
    rows = [(1, 0, float(t), i) for i, t in enumerate(a)] + [(1, 1, float(t), 100 + i) for i, t in enumerate(b)]
    got = events.coincidences(spark.createDataFrame(rows, "run long, side int, t double, id long"), 5.0, float(dead))
    assert [r["t"] for r in got.orderBy("trigger").collect()] == want


def test_window_is_half_open(spark):
    c = EventBuilderConfig(before_ns=10, after_ns=10)
    trig = spark.createDataFrame([(1, 0, 100.0), (1, 1, 1000.0)], "run long, trigger int, t double")
    h = spark.createDataFrame([(1, i, t) for i, t in enumerate([89.99, 90.0, 109.99, 110.0])], "run long, id long, time double")
    got = events.event_window(trig, h, c)
    assert sorted(r["id"] for r in got.where("trigger = 0").collect()) == [1, 2]
    assert [r["id"] for r in got.where("trigger = 1").collect()] == [None]


def test_bins_and_envelopes(spark):
    c = EfficiencyConfig()
    pts = spark.createDataFrame([(0.0, 0.0), (99.9, 99.9), (100.0, 50.0)], "pred_x double, pred_y double")
    assert [r[0] for r in pts.select(efficiency.flat_bin(c)).collect()] == [0, 55, None]
    need = spark.createDataFrame([(3.5,), (3.3,), (3.4,), (6.0,), (9.0,)], "x double").select(match.required_extension(F.col("x"), F.array(F.struct(F.lit(4.0).alias("low"), F.lit(8.0).alias("high")))).alias("n"))
    assert [r["n"] <= 0.6 for r in need.collect()] == [True, False, False, True, False]


def test_nonuniformity(spark):
    cells = spark.createDataFrame([(0, 0, 10, 10, 10, 10), (0, 1, 10, 5, 5, 5)], "det int, flat_bin int, total long, passed_x long, passed_y long, passed_2d long")
    r = efficiency.summary(cells, EfficiencyConfig()).first()
    assert r["nonuniformity_x"] == pytest.approx(1 / 3) and r["efficiency_x"] == 0.75 and r["low_x"] < 0.75 < r["high_x"]


def test_quantile_rules(spark):
    a = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)])
    got = spark.range(1).select(*[columns.array_quantile(a, 0.5, r).alias(r) for r in ("floor_fn", "median", "floor_fn1", "round_fn1", "upper_median")]).first()
    assert tuple(got) == (3, 2.5, 2, 3, 3)
    df = spark.range(20001).select(F.lit(0).alias("k"), (F.col("id") * 7919 % 20001).cast("double").alias("v"))
    for rule, f, want in (("round_fn1", 0.16, 3200), ("floor_fn", 0.95, 19000), ("median", 0.5, 10000), ("floor_fn1", 0.995, 19900), ("upper_median", 0.5, 10000)):
        assert columns.group_quantile(df, ["k"], "v", f, rule).first()["q"] == want


def test_quantiles_by_narrowing(spark):
    """Groups far above the rows that are ranked: skewed, of few values, of one value, of huge range, small; null keys stay out."""
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(size=9000), "skew": np.exp(rng.normal(size=8000) * 9), "two": rng.choice([1.0, 2.0], 7000), "one": np.full(6000, 3.5), "ties": np.floor(rng.normal(size=9000) * 3), "range": rng.choice([-1e300, 0.0, 1e-300, 1e300], 5000) + rng.normal(size=5000), "small": rng.normal(size=30)}
    rows = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()] + [pd.DataFrame({"k": [None, "small", "small"], "v": [1.0, np.nan, np.inf]})])
    df = spark.createDataFrame(rows.sample(frac=1, random_state=1)).repartition(6)
    wanted = {"a": (0.05, "floor_fn"), "b": (0.995, "floor_fn1"), "c": (0.16, "round_fn1"), "d": (0.5, "upper_median"), "e": (0.5, "median"), "f": (1.0, "floor_fn")}
    at = {"floor_fn": lambda f, n: min(n - 1, math.floor(f * n)), "floor_fn1": lambda f, n: math.floor(f * (n - 1)), "round_fn1": lambda f, n: math.floor(f * (n - 1) + 0.5), "upper_median": lambda f, n: n // 2}
    for limit in (40, 1000):
        got = {r.k: r for r in columns.group_quantiles(df, ["k"], "v", wanted, ranked_rows=limit).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            v = np.sort(v)
            for name, (f, rule) in wanted.items():
                want = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if rule == "median" else v[at[rule](f, len(v))]
                assert got[k][name] == want, (limit, k, name)


def test_clopper_pearson():
    # for no successes the limits solve (1-p)^n = alpha/2 in closed form
    lo, hi = numerics.clopper_pearson(0, 10, 0.683)
    assert lo == 0 and (1 - hi) ** 10 == pytest.approx(0.1585)
    lo, hi = numerics.clopper_pearson(10, 10, 0.683)
    assert hi == 1 and lo**10 == pytest.approx(0.1585)
    lo, hi = numerics.clopper_pearson(3, 9, 0.9)
    tail = lambda p, k: sum(math.comb(9, i) * p**i * (1 - p) ** (9 - i) for i in k)
    assert tail(lo, range(3, 10)) == pytest.approx(0.05) and tail(hi, range(4)) == pytest.approx(0.05)


def test_gaussian_fits():
    rng = np.random.default_rng(1)
    v = rng.normal(3, 0.5, 20000)
    fit = numerics.histogram_fit(v, 100, 0, 6)
    assert fit.ok and fit.params[1] == pytest.approx(3, abs=0.02) and fit.params[2] == pytest.approx(0.5, abs=0.02)
    core = numerics.core_gaussian(np.concatenate([v, rng.uniform(-20, 20, 4000)]))
    assert core.ok and core.params[2] == pytest.approx(0.5, abs=0.03)
    import pandas as pd

    mix = np.concatenate([rng.normal(0, 0.1, 30000), rng.normal(0, 0.5, 6000)])
    n, e = np.histogram(mix, 200, (-2, 2))
    got = efficiency.double_gaussian_fit(pd.DataFrame({"centre": (e[1:] + e[:-1]) / 2, "count": n}))
    assert got["core_sigma"] == pytest.approx(0.1, abs=0.01) and got["tail_fraction"] == pytest.approx(1 / 6, abs=0.04)


def test_words():
    assert bt.signed12(np.array([0x7FF, 0x800, 0xFFF], ">u2")).tolist() == [2047, -2048, -1]


def test_config_problems_are_all_reported():
    assert validate({"detectors": [{"id": 1, "type": "planar"}], "scripts": [{"name": "TrackAnalysis"}]}) == []
    bad = validate({"mode": "x", "conversion": {"enabled": False}, "detectors": [{"id": 1, "type": "planar"}, {"id": 1, "type": "box", "position": [1]}], "scripts": [{"name": "No"}, {"name": "DUTAnalysis", "enabled": False}]})
    assert [b.split(":")[0] for b in bad] == ["mode", "conversion.type", "detectors[1].id", "detectors[1].type", "detectors[1].position", "scripts[0].name"]
    assert validate({"detectors": [{"id": 1, "type": "planar"}], "scripts": [{"name": "DUTAnalysis", "enabled": False}]}) == ["scripts: at least one must be enabled"]


def test_settings():
    assert settings(HitConfig, {"cfdFraction": 0.5, "noiseThreshold": 80, "unknown": 1}, {"noiseThreshold": "threshold"}) == HitConfig(cfd_fraction=0.5, threshold=80)
    assert ordered_range(5, 2) == (2, 5) and ordered_range(3, 3) == (3, 4) and clean_bins([3, 9, 1, 3], 4) == (1, 3)
    assert PositionConfig(method="What").method == "ChargeWeighted" and TimingConfig(time_method="xymin").time_method == "XYMin"
    for bad in (lambda: ClusterConfig(connectivity=6), lambda: PositionConfig(gas_gap=0), lambda: ScopeConfig(median_samples=4), lambda: TimingConfig(tracker_ids=(1, 1, 2)), lambda: EventBuilderConfig(trigger_channels=(3, 3))):
        with pytest.raises(ValueError):
            bad()
