"""Queries: calibration, waveform features, clusters and positions, geometry, quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.config import ClusterConfig, HitConfig, PositionConfig
from hodoscope.functions import columns, geometry
from hodoscope.operators import clusters, hits, maps, qa
from hodoscope.plans import adapters as ad
from hodoscope.plans.catalog import query


def r6(*names: str) -> list:
    """Columns rounded to six places, without a negative zero."""
    return [F.when(F.round(n, 6) == 0, 0.0).otherwise(F.round(n, 6)).alias(n) for n in names]


def s6(expr: str) -> str:
    """The same in SQL."""
    return f"(CASE WHEN round({expr}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expr}, 6) END)"


# --- calibration ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.HITS}, {ad.CHANNELS}
SELECT entry, raw_idx, {s6("(amp - coalesce(pedestal, 0)) * coalesce(gain, 1) * coalesce(polarity, 1)")} AS adc_value
FROM h LEFT JOIN c ON h.det = c.det AND h.plane = c.plane AND h.id0 = c.id0""")
def calibrate_scalar(spark, sf) -> DataFrame:
    own = ad.hits(spark, sf).select("entry", "det", "plane", "id0", "id1", "raw_idx", F.col("amp").alias("adc_value"), F.array().cast("array<short>").alias("adc"))
    return hits.calibrate(hits.with_calibration(own, ad.channels(spark, sf))).select("entry", "raw_idx", *r6("adc_value"))


WAVE_CAL = f"""WITH {ad.WAVES}, {ad.CHANNELS}, j AS (
  SELECT entry, coalesce(noise_sigma, -1) AS noise_sigma, coalesce(gain, 1) AS gain,
    list_transform(adc, lambda s: CAST(greatest(least(round((s - coalesce(pedestal, 0)) * coalesce(gain, 1) * coalesce(polarity, 1)), 32767), -32768) AS INTEGER)) AS adc
  FROM w LEFT JOIN c ON c.det = 0 AND c.plane = 0 AND w.id0 = c.id0)
SELECT entry, CAST(list_sum(adc) AS BIGINT) AS total, CAST(list_max(adc) AS SMALLINT) AS top, CAST(list_min(adc) AS SMALLINT) AS low FROM j"""


def _calibrated_waves(spark, sf) -> DataFrame:
    return hits.calibrate(hits.with_calibration(ad.waves(spark, sf), ad.channels(spark, sf)))


def _wave_sums(df: DataFrame) -> DataFrame:
    total = F.aggregate("adc", F.lit(0).cast("long"), lambda a, s: a + s)
    return df.select("entry", total.alias("total"), F.array_max("adc").alias("top"), F.array_min("adc").alias("low"))


@query(WAVE_CAL)
def calibrate_wave(spark, sf) -> DataFrame:
    return _wave_sums(_calibrated_waves(spark, sf))


@query(WAVE_CAL + " WHERE NOT (noise_sigma >= 0 AND list_max(adc) <= 60 * noise_sigma * abs(gain))")
def zero_suppress(spark, sf) -> DataFrame:
    return _wave_sums(hits.zero_suppress(_calibrated_waves(spark, sf), 60.0))


@query("""SELECT conv_id AS entry, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS raw_idx, turn, role FROM conversations
WHERE conv_id IS NOT NULL""")
def flatten_arrays(spark, sf) -> DataFrame:
    own = ad.table(spark, sf, "conversations").where("conv_id IS NOT NULL").groupBy(F.col("conv_id").alias("entry")).agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("h"))
    nested = own.select("entry", F.col("h.turn").alias("turns"), F.col("h.role").alias("roles"))
    return hits.flatten(nested, {"turn": "turns", "role": "roles"})


# --- features ------------------------------------------------------------------------------------------------------------

MODE = HitConfig(threshold=300, saturation_level=900, time_window_end=1200)


def _feature_sql(time: str) -> str:
    rise = lambda name, level: f"""(SELECT min(i) FROM unnest(range(2, p + 2)) u(i) WHERE wave[i - 1] < {level} AND wave[i] >= {level}) AS {name}"""
    at = lambda i, level: f"({i} - 2 + ({level} - wave[{i} - 1]) / CAST(wave[{i}] - wave[{i} - 1] AS DOUBLE))"
    return f"""WITH {ad.WAVES}, a AS (SELECT entry, adc AS wave, greatest(list_max(adc), 0) AS amp FROM w),
b AS (SELECT *, CASE WHEN amp > 0 THEN list_position(wave, amp) - 1 ELSE 0 END AS p FROM a),
k AS (SELECT *, {rise("i_thr", "300")}, {rise("i_cfd", "0.3::DOUBLE * amp")}, {rise("i10", "0.1::DOUBLE * amp")}, {rise("i90", "0.9::DOUBLE * amp")},
  (SELECT min(i) FROM unnest(range(p + 2, len(wave) + 1)) u(i) WHERE wave[i - 1] >= 300 AND wave[i] < 300) AS i_fall FROM b),
t AS (SELECT *, {at("i_thr", "300")} AS r_thr, {at("i_cfd", "0.3::DOUBLE * amp")} AS r_cfd, {at("i10", "0.1::DOUBLE * amp")} AS r10, {at("i90", "0.9::DOUBLE * amp")} AS r90,
  i_fall - 2 + (wave[i_fall - 1] - 300) / CAST(wave[i_fall - 1] - wave[i_fall] AS DOUBLE) AS f_thr FROM k)
SELECT entry, CAST(amp AS DOUBLE) AS amp, CAST(coalesce(list_sum(list_transform(list_filter(wave, lambda s: s > 300), lambda s: s - 300)), 0) AS DOUBLE) AS charge,
  CAST(p * 25 AS DOUBLE) AS peak_time, round({time} * 25, 6) AS time, round(CASE WHEN r90 >= r10 THEN (r90 - r10) * 25 END, 6) AS rise_time,
  round(CASE WHEN f_thr >= r_thr THEN (f_thr - r_thr) * 25 END, 6) AS width, amp > 900 AS is_saturated,
  amp >= 300 AND amp <= 900 AND coalesce({time} * 25 BETWEEN -50 AND 1200, false) AS is_valid FROM t"""


FEATURES = ["entry", "amp", "charge", "peak_time", "time", "rise_time", "width", "is_saturated", "is_valid"]


@query(_feature_sql("r_cfd"))
def wave_features_default(spark, sf) -> DataFrame:
    return hits.waveform_features(ad.waves(spark, sf), MODE).select(*[F.round(c, 6).alias(c) if c in ("time", "rise_time", "width") else c for c in FEATURES])


@query(_feature_sql("r_thr"))
def wave_features_fixed(spark, sf) -> DataFrame:
    mode = HitConfig(**(MODE.__dict__ | {"mode": "FixedThreshold"}))
    return hits.waveform_features(ad.waves(spark, sf), mode).select(*[F.round(c, 6).alias(c) if c in ("time", "rise_time", "width") else c for c in FEATURES])


@query(f"""WITH {ad.HITS} SELECT entry, raw_idx, amp, amp AS charge, time, amp >= 45 AS is_saturated, amp >= 10 AS is_valid FROM h""")
def direct_features(spark, sf) -> DataFrame:
    own = ad.hits(spark, sf).select("entry", "det", "plane", "id0", "id1", "raw_idx", F.col("amp").alias("adc_value"), F.col("time").alias("hit_time_ns"))
    return hits.direct_features(own, HitConfig(threshold=10, saturation_level=45)).select("entry", "raw_idx", "amp", "charge", "time", "is_saturated", "is_valid")


@query()
def wave_fit_edge(spark, sf) -> DataFrame:
    return hits.channel_hits(ad.waves(spark, sf), HitConfig(**(MODE.__dict__ | {"mode": "Fit"})))


@query()
def wave_fit_pulse(spark, sf) -> DataFrame:
    return hits.channel_hits(ad.waves(spark, sf), HitConfig(**(MODE.__dict__ | {"mode": "Mode1"})))


@query(f"""WITH {ad.WAVES}, x AS (SELECT entry, i - 1 AS i, adc[i] AS s FROM w, range(1, 27) r(i) WHERE len(adc) >= 26),
f AS (SELECT entry, k, sum(s * cos(2 * pi() * k * i / 26)) AS c, sum(s * sin(2 * pi() * k * i / 26)) AS d FROM x, range(14) q(k) GROUP BY entry, k)
SELECT 0 AS det, 0 AS plane, CAST(k AS INTEGER) AS frequency, round(avg((c * c + d * d) / 26), 5) AS power, count(*) AS waveforms FROM f GROUP BY k""")
def power_spectrum(spark, sf) -> DataFrame:
    """Mean spectra of the first 26 samples, as many as the analysis takes by rule."""
    own = hits.power_spectra(ad.waves(spark, sf))
    return own.select("det", "plane", "frequency", F.round("power", 5).alias("power"), "waveforms")


@query(f"""WITH {ad.WAVES}, x AS (SELECT entry, unnest(range(1, 65)) AS i, adc FROM w),
m AS (SELECT entry, i, list_sort(adc[greatest(i - 2, 1):least(i + 2, 64)]) AS n FROM x)
SELECT entry, CAST(sum(i * n[len(n) // 2 + 1]) AS BIGINT) AS checksum FROM m GROUP BY entry""")
def median_filter(spark, sf) -> DataFrame:
    own = ad.waves(spark, sf).select("entry", columns.median_filter(F.col("adc"), 5).alias("m"))
    return own.select("entry", F.aggregate(F.transform("m", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v).alias("checksum"))


@query(f"""WITH {ad.WAVES}, x AS (SELECT entry, adc, list_position(adc, list_max(adc)) AS p FROM w)
SELECT entry, CAST(list_max(adc) AS SMALLINT) AS waveform_max, CAST(p - 1 AS INTEGER) AS peak_sample FROM x""")
def channel_qa(spark, sf) -> DataFrame:
    return qa.channel_qa(ad.waves(spark, sf)).select("entry", "waveform_max", "peak_sample")


# --- clusters ------------------------------------------------------------------------------------------------------------

GAP = ClusterConfig(max_gap=1, max_cluster_size=6)
TIMED = ClusterConfig(max_gap=1, max_cluster_size=6, time_window_ns=3)
PLAIN, POWER = PositionConfig(), PositionConfig(weight_source="charge", weight_power=0.5)

ISLANDS = f"""{ad.HITS}, v AS (SELECT * FROM h WHERE is_valid),
l AS (SELECT *, CASE WHEN id0 - lag(id0) OVER z <= 2 THEN 0 ELSE 1 END AS first FROM v WINDOW z AS (PARTITION BY entry, det, plane ORDER BY id0, raw_idx)),
i AS (SELECT *, sum(first) OVER (PARTITION BY entry, det, plane ORDER BY id0, raw_idx ROWS UNBOUNDED PRECEDING) AS part FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY entry, det ORDER BY plane, id1, id0, raw_idx) - 1 AS hit_idx FROM
  (SELECT h.*, i.part FROM h LEFT JOIN i ON h.entry = i.entry AND h.raw_idx = i.raw_idx))"""
CLUSTER = """SELECT entry, det, plane, CAST(row_number() OVER (PARTITION BY entry, det ORDER BY first) - 1 AS INTEGER) AS cluster_idx, size, range, charge, max_amp, time, centroid, pos FROM (
  SELECT entry, det, plane, min(hit_idx) AS first, CAST(count(DISTINCT id0) AS INTEGER) AS size, CAST(max(id0) - min(id0) + 1 AS INTEGER) AS range, sum(amp) AS charge, max(amp) AS max_amp, min(time) AS time,
    round(sum(id0 * charge) / sum(charge), 6) AS centroid, round(sum(id0 * {w}) / sum({w}), 6) AS pos
  FROM o WHERE part IS NOT NULL GROUP BY entry, det, plane, part) WHERE size BETWEEN 1 AND 6"""
SHOW = ["entry", "det", "plane", "cluster_idx", "size", "range", "charge", "max_amp", "time"]


def _clusters(spark, sf, c: ClusterConfig = GAP, p: PositionConfig = PLAIN, bits: int = 4) -> DataFrame:
    return clusters.build_clusters(clusters.strip_groups(clusters.ordered_hits(ad.hits(spark, sf, bits)), c), c, p)


@query(f"WITH {ISLANDS} {CLUSTER.format(w='amp')}")
def strip_islands(spark, sf) -> DataFrame:
    return _clusters(spark, sf).select(*SHOW, *r6("centroid", "pos"))


@query(f"WITH {ISLANDS} {CLUSTER.format(w='sqrt(charge)')}")
def cluster_position_pow(spark, sf) -> DataFrame:
    return _clusters(spark, sf, p=POWER).select(*SHOW, *r6("centroid", "pos"))


LINKED = f"""WITH RECURSIVE {ad.HITS}, v AS (SELECT *, row_number() OVER (PARTITION BY entry, det ORDER BY plane, id1, id0, raw_idx) - 1 AS hit_idx FROM h),
e AS (SELECT a.entry, a.raw_idx AS a, b.raw_idx AS b FROM v a JOIN v b ON a.entry = b.entry AND a.det = b.det AND a.plane = b.plane AND a.raw_idx <> b.raw_idx
  AND a.is_valid AND b.is_valid AND abs(a.id0 - b.id0) <= 2 AND abs(a.time - b.time) <= 3),
r AS (SELECT entry, raw_idx, raw_idx AS reach FROM v WHERE is_valid UNION SELECT r.entry, r.raw_idx, e.b FROM r JOIN e ON e.entry = r.entry AND e.a = r.reach),
q AS (SELECT entry, raw_idx, min(reach) AS part FROM r GROUP BY entry, raw_idx), o AS (SELECT v.*, q.part FROM v LEFT JOIN q ON v.entry = q.entry AND v.raw_idx = q.raw_idx)
"""


@query(LINKED + CLUSTER.format(w="amp"))
def strip_islands_timewindow(spark, sf) -> DataFrame:
    return _clusters(spark, sf, TIMED).select(*SHOW, *r6("centroid", "pos"))


def _pad_clusters(spark, sf, connectivity: int = 4, bits: int = 4) -> DataFrame:
    c = ClusterConfig(max_cluster_size=64, connectivity=connectivity)
    dets = geometry.detectors(spark, ad.SETUP).select("det", "pad_rows", "pad_columns", "pad_pitch_x", "pad_pitch_y")
    own = clusters.ordered_hits(ad.pad_hits(spark, sf, bits)).join(F.broadcast(dets), "det")
    return clusters.build_clusters(clusters.pad_groups(own, c), c, PLAIN, pads=True)


def _pad_sql(near: str) -> str:
    return f"""WITH RECURSIVE {ad.PAD_HITS}, e AS (SELECT a.entry, a.raw_idx AS a, b.raw_idx AS b FROM p a JOIN p b ON a.entry = b.entry AND a.raw_idx <> b.raw_idx AND {near}),
r AS (SELECT entry, raw_idx, raw_idx AS reach FROM p UNION SELECT r.entry, r.raw_idx, e.b FROM r JOIN e ON e.entry = r.entry AND e.a = r.reach),
q AS (SELECT entry, raw_idx, min(reach) AS part FROM r GROUP BY entry, raw_idx)
SELECT p.entry, CAST(count(DISTINCT id0 * 8 + id1) AS INTEGER) AS size, CAST(greatest(max(id0) - min(id0), max(id1) - min(id1)) + 1 AS INTEGER) AS range, sum(amp) AS charge,
  round(sum(amp * id0 * 3) / sum(amp), 6) AS local_x, round(sum(amp * id1 * 3) / sum(amp), 6) AS local_y
FROM p JOIN q ON p.entry = q.entry AND p.raw_idx = q.raw_idx GROUP BY p.entry, part"""


@query(_pad_sql("abs(a.id0 - b.id0) + abs(a.id1 - b.id1) <= 1"))
def pad_components(spark, sf) -> DataFrame:
    return _pad_clusters(spark, sf).select("entry", "size", "range", "charge", *r6("local_x", "local_y"))


@query(_pad_sql("abs(a.id0 - b.id0) <= 1 AND abs(a.id1 - b.id1) <= 1"))
def pad_components_8(spark, sf) -> DataFrame:
    return _pad_clusters(spark, sf, 8).select("entry", "size", "range", "charge", *r6("local_x", "local_y"))


def _local(spark, sf) -> DataFrame:
    dets, planes = geometry.detectors(spark, ad.SETUP), geometry.planes(spark, ad.SETUP)
    return clusters.local_hits(_clusters(spark, sf), dets, planes)


CL = f"{ISLANDS}, cl AS ({CLUSTER.format(w='amp').replace('round(sum(id0 * amp) / sum(amp), 6)', 'sum(id0 * amp) / sum(amp)').replace('round(sum(id0 * charge) / sum(charge), 6)', 'sum(id0 * charge) / sum(charge)')})"
XY = f"""{CL}, xy AS (SELECT a.entry, a.det, a.cluster_idx AS ia, b.cluster_idx AS ib, a.pos * 0.4::DOUBLE AS ua, b.pos * 0.4::DOUBLE AS ub,
  CASE WHEN a.det = 3 THEN cos(radians(45)) ELSE cos(radians(90)) END AS cb, CASE WHEN a.det = 3 THEN sin(radians(45)) ELSE sin(radians(90)) END AS sb
  FROM cl a JOIN cl b ON a.entry = b.entry AND a.det = b.det AND a.plane = 0 AND b.plane = 1)"""


@query(f"""WITH {XY} SELECT entry, det, CAST(row_number() OVER (PARTITION BY entry, det ORDER BY ia, ib) - 1 AS INTEGER) AS hit_idx,
  {s6("ua")} AS x, {s6("(ub - ua * cb) / sb")} AS y FROM xy""")
def xy_combination(spark, sf) -> DataFrame:
    return _local(spark, sf).select("entry", "det", "hit_idx", *r6("x", "y"))


@query(f"""WITH {CL} SELECT entry, det, round(pos * 0.5::DOUBLE * cos(radians(30)), 6) AS x, round(pos * 0.5::DOUBLE * sin(radians(30)), 6) AS y FROM cl WHERE plane = 0""")
def single_plane_hits(spark, sf) -> DataFrame:
    setup = [d | {"readoutPlanes": {"0": {"angle": 30, "pitch": 0.5}}} for d in ad.SETUP[:4]]
    dets, planes = geometry.detectors(spark, setup), geometry.planes(spark, setup)
    return clusters.local_hits(_clusters(spark, sf), dets, planes).select("entry", "det", *r6("x", "y"))


@query(f"""WITH {CL}, n AS (SELECT entry, det, count(DISTINCT plane) AS n FROM cl GROUP BY entry, det)
SELECT a.entry, a.det, round(a.pos * 0.4::DOUBLE, 6) AS x, round(b.pos * 0.4::DOUBLE, 6) AS y FROM cl a JOIN cl b ON a.entry = b.entry AND a.det = b.det AND a.plane = 0 AND b.plane = 1
UNION ALL SELECT cl.entry, cl.det, round(CASE WHEN plane = 0 THEN pos * 0.4::DOUBLE ELSE 0 END, 6), round(CASE WHEN plane = 1 THEN pos * 0.4::DOUBLE ELSE 0 END, 6)
FROM cl JOIN n ON cl.entry = n.entry AND cl.det = n.det AND n.n = 1""")
def cylinder_hits(spark, sf) -> DataFrame:
    setup = [{"id": i, "type": "cylinder", "position": [0, 0, 0], "rotation": [0, 0, 0]} for i in range(4)]
    return clusters.local_hits(_clusters(spark, sf), geometry.detectors(spark, setup), geometry.planes(spark, setup)).select("entry", "det", *r6("x", "y"))


@query(f"""{_pad_sql("abs(a.id0 - b.id0) + abs(a.id1 - b.id1) <= 1").replace("SELECT p.entry, CAST(count", "SELECT entry, local_x AS x, local_y AS y, 150.0::DOUBLE AS gz FROM (SELECT p.entry, CAST(count")})""")
def pad_local_hits(spark, sf) -> DataFrame:
    own = clusters.local_hits(_pad_clusters(spark, sf), geometry.detectors(spark, ad.SETUP), geometry.planes(spark, ad.SETUP))
    return own.select("entry", *r6("x", "y"), "gz")


@query(f"""WITH {ISLANDS}, k AS ({CLUSTER.format(w="amp")})
SELECT o.entry, o.det, k.cluster_idx, CAST(o.hit_idx AS INTEGER) AS hit_idx, o.raw_idx FROM (SELECT *, min(hit_idx) OVER (PARTITION BY entry, det, plane, part) AS first, part FROM o WHERE part IS NOT NULL) o
JOIN (SELECT *, row_number() OVER (PARTITION BY entry, det ORDER BY cluster_idx) AS rn FROM k) k ON o.entry = k.entry AND o.det = k.det
JOIN (SELECT entry, det, first, row_number() OVER (PARTITION BY entry, det ORDER BY first) AS rn FROM (SELECT entry, det, min(hit_idx) AS first FROM o WHERE part IS NOT NULL GROUP BY entry, det, plane, part HAVING count(DISTINCT id0) BETWEEN 1 AND 6)) f
  ON f.entry = o.entry AND f.det = o.det AND f.first = o.first AND f.rn = k.rn WHERE k.max_amp > 45""")
def member_hits(spark, sf) -> DataFrame:
    own = _clusters(spark, sf)
    return clusters.member_hits(own, own.where("max_amp > 45")).select("entry", "det", "cluster_idx", "hit_idx", "raw_idx")


@query(f"""WITH {ad.HITS}, n AS (SELECT *, CASE WHEN id0 < 30 THEN -1 WHEN id0 > 30 THEN 1 ELSE 0 END AS side, abs(id0 - 30) AS away FROM h WHERE id0 BETWEEN 0 AND 63),
g AS (SELECT *, away - coalesce(lag(away) OVER (PARTITION BY entry, det, plane, side ORDER BY away, raw_idx), 0) AS step FROM n)
SELECT entry, raw_idx, id0 FROM (SELECT *, max(CASE WHEN step > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY entry, det, plane, side ORDER BY away, raw_idx ROWS UNBOUNDED PRECEDING) AS stop FROM g) WHERE stop = 0""")
def neighbour_strips(spark, sf) -> DataFrame:
    return clusters.neighbours(ad.hits(spark, sf), 30, 0, 64).select("entry", "raw_idx", "id0")


@query()
def drift_positions(spark, sf) -> DataFrame:
    own = _clusters(spark, sf)
    t0 = own.groupBy("entry").agg((F.min("time") - 1).alias("t0"))
    return clusters.drift_positions(own, t0, PositionConfig(method="rawUTPC"), geometry.planes(spark, ad.SETUP)).drop("members")


@query()
def drift_positions_iterated(spark, sf) -> DataFrame:
    own = _clusters(spark, sf)
    t0 = own.groupBy("entry").agg((F.min("time") - 1).alias("t0"))
    return clusters.drift_positions(own, t0, PositionConfig(method="UTPC"), geometry.planes(spark, ad.SETUP)).drop("members")


# --- geometry ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {XY} SELECT entry, det, round(ua, 9) + 100 AS x, round((ub - ua * cb) / sb, 9) + 100 AS y FROM xy""")
def local_global_roundtrip(spark, sf) -> DataFrame:
    own = _local(spark, sf).join(F.broadcast(geometry.detectors(spark, ad.SETUP)), "det")
    x, y, _ = geometry.to_local(F.col("gx"), F.col("gy"), F.col("gz"))
    return own.select("entry", "det", (F.round(x, 9) + 100).alias("x"), (F.round(y, 9) + 100).alias("y"))


def _matrix(r: list[float]) -> str:
    return ", ".join(f"{v!r}::DOUBLE AS r{i // 3}{i % 3}" for i, v in enumerate(r))


D3 = ad.SETUP[3]
PLANE3 = f"""{ad.LINES}, d AS (SELECT 0.5::DOUBLE AS px, 0.5::DOUBLE AS py, 150.0::DOUBLE AS pz, {_matrix(geometry.rotation(*D3["rotation"]))}),
z AS (SELECT t.*, d.*, ((px - bx) * r02 + (py - "by") * r12 + pz * r22) / (kx * r02 + ky * r12 + r22) AS z FROM t, d),
q AS (SELECT *, kx * z + bx - px AS dx, ky * z + "by" - py AS dy, z - pz AS dz FROM z WHERE z >= 0),
pred AS (SELECT *, r00 * dx + r10 * dy + r20 * dz AS pred_x, r01 * dx + r11 * dy + r21 * dz AS pred_y FROM q)"""


@query(f"WITH {PLANE3} SELECT entry, track_index, {s6("pred_x")} AS pred_x, {s6("pred_y")} AS pred_y FROM pred")
def plane_intersection(spark, sf) -> DataFrame:
    dets = geometry.detectors(spark, [D3])
    return geometry.predict(ad.lines(spark, sf), dets).select("entry", "track_index", *r6("pred_x", "pred_y"))


@query(f"""WITH {ad.LINES}, l AS (SELECT *, cos(0.4::DOUBLE) AS c, sin(0.4::DOUBLE) AS s FROM t),
m AS (SELECT *, c * (bx - 1) + s * ("by" - 2) AS qx, -s * (bx - 1) + c * ("by" - 2) AS qy, c * kx + s * ky AS sx, -s * kx + c * ky AS sy FROM l),
n AS (SELECT *, sx * sx + sy * sy AS a, 2 * (sx * qx + sy * qy) AS b, qx * qx + qy * qy - 65.0 * 65.0 AS k FROM m),
r AS (SELECT *, CASE WHEN abs(a) >= 1e-12 AND b * b - 4 * a * k >= 0 THEN (-b + sqrt(greatest(b * b - 4 * a * k, 0))) / (2 * a) END AS z1,
  CASE WHEN abs(a) >= 1e-12 AND b * b - 4 * a * k >= 0 THEN (-b - sqrt(greatest(b * b - 4 * a * k, 0))) / (2 * a) END AS z2 FROM n),
z AS (SELECT *, CASE WHEN abs(z2 - 120) < abs(z1 - 120) THEN z2 ELSE z1 END AS z FROM r)
SELECT entry, track_index, round(1 + sx * z + qx, 3) AS x, round(2 + sy * z + qy, 3) AS y, round(z, 3) AS z FROM z WHERE z IS NOT NULL""")
def cylinder_intersection(spark, sf) -> DataFrame:
    dets = geometry.detectors(spark, [ad.SETUP[5]])
    own = ad.lines(spark, sf).withColumn("det", F.lit(6)).join(F.broadcast(dets), "det")
    own = geometry.cylinder_crossing(own).where("gz IS NOT NULL")
    return own.select("entry", "track_index", F.round("gx", 3).alias("x"), F.round("gy", 3).alias("y"), F.round("gz", 3).alias("z"))


@query("SELECT * FROM (VALUES (0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 1), (6, 0, 1)) v(det, plane_x, plane_y)")
def axis_planes(spark, sf) -> DataFrame:
    return geometry.axis_planes(geometry.planes(spark, ad.SETUP))


@query(f"""WITH {PLANE3} SELECT entry, track_index, (pred_x >= -0.2 AND pred_x < 102.2 AND (pred_x + pred_y) * cos(radians(45)) >= -0.2 AND (pred_x + pred_y) * cos(radians(45)) < 102.2) AS active FROM pred""")
def active_area(spark, sf) -> DataFrame:
    planes = geometry.planes(spark, [D3]).groupBy("det").agg(F.collect_list(F.struct("angle_deg", "pitch", "n_strips")).alias("planes"))
    own = geometry.predict(ad.lines(spark, sf), geometry.detectors(spark, [D3]).join(planes, "det"))
    return own.select("entry", "track_index", geometry.active_area(F.col("pred_x"), F.col("pred_y"), F.col("planes")).alias("active"))


@query(f"""WITH {ad.LINES}, q AS (SELECT entry, track_index, kx * 150 + bx AS x, ky * 150 + "by" AS y FROM t)
SELECT entry, track_index, (x >= -1.5 AND x < 22.5 AND y >= -1.5 AND y < 22.5) AS active,
  (x + 1.5 >= 0 AND x + 1.5 < 24 AND abs((x + 1.5) - 3 * floor((x + 1.5) / 3) - 1.5) <= 1.4 AND y + 1.5 >= 0 AND y + 1.5 < 24 AND abs((y + 1.5) - 3 * floor((y + 1.5) / 3) - 1.5) <= 1.4) AS on_pad FROM q""")
def pad_containment(spark, sf) -> DataFrame:
    own = geometry.predict(ad.lines(spark, sf), geometry.detectors(spark, [ad.SETUP[4]]))
    x, y = F.col("pred_x"), F.col("pred_y")
    return own.select("entry", "track_index", geometry.active_area(x, y, None).alias("active"), geometry.in_pad(x, y).alias("on_pad"))


@query(f"WITH {ad.PAD_HITS} SELECT entry, raw_idx, id0 * 3.0::DOUBLE AS x, id1 * 3.0::DOUBLE AS y FROM p")
def pad_position(spark, sf) -> DataFrame:
    own = ad.pad_hits(spark, sf).where("is_valid").join(F.broadcast(geometry.detectors(spark, ad.SETUP)), "det")
    x, y = geometry.pad_position(F.col("id1"), F.col("id0"))
    return own.select("entry", "raw_idx", x.alias("x"), y.alias("y"))


# --- quality -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {ad.WAVES}, x AS (SELECT list_max(adc) AS m, list_position(adc, list_max(adc)) - 1 AS p, id0 FROM w)
SELECT hist, CAST(bin AS INTEGER) AS bin, count(*) AS count FROM (SELECT 'occupancy' AS hist, id0 AS bin FROM x
  UNION ALL SELECT 'maximum', CASE WHEN m < 0 THEN 0 WHEN m >= 4096 THEN 101 ELSE floor(m / 4096.0 * 100) + 1 END FROM x UNION ALL SELECT 'peak_sample', least(p, 30) FROM x) GROUP BY hist, bin""")
def plane_qa(spark, sf) -> DataFrame:
    return qa.plane_qa(ad.waves(spark, sf)).select("hist", "bin", "count")


@query(f"WITH {ad.HITS}, n AS (SELECT count(DISTINCT entry) AS n FROM h) SELECT det, plane, count(*) AS hits, round(count(*) / max(n.n), 6) AS mean_multiplicity FROM h, n GROUP BY det, plane")
def multiplicity(spark, sf) -> DataFrame:
    own = ad.hits(spark, sf)
    return qa.multiplicity(own, own).select("det", "plane", "hits", *r6("mean_multiplicity"))


@query(f"""WITH {ad.HITS}, s AS (SELECT det, least(min(amp), 0) AS low, max(amp) * 1.05::DOUBLE AS high FROM h GROUP BY det)
SELECT h.det, CAST(greatest(least(floor((amp - low) / (high - low) * 50) + 1, 51), 0) AS INTEGER) AS bin, count(*) AS count FROM h JOIN s ON h.det = s.det GROUP BY 1, 2""")
def hit_properties(spark, sf) -> DataFrame:
    return qa.hit_properties(ad.hits(spark, sf), "amp", ["det"], 50).select("det", "bin", "count")


def _bin_sql(v: str, low: str, high: str, n: str) -> str:
    return f"CAST(CASE WHEN {v} < {low} THEN 0 WHEN {v} >= {high} THEN {n} + 1 ELSE least(floor(({v} - {low}) / ({high} - {low}) * {n}) + 1, {n}) END AS INTEGER)"


@query(f"""WITH {ad.POINTS} SELECT det, {_bin_sql("gx", "0", "102.4::DOUBLE", "100")} AS bin_x, {_bin_sql("gy", "0", "20.0::DOUBLE", "100")} AS bin_y, count(*) AS count FROM g GROUP BY ALL""")
def track_hit_maps(spark, sf) -> DataFrame:
    """Hit maps of the trackers, over pitch times strips of their planes."""
    setup = [{"id": i, "type": "planar", "role": "tracker", "position": [0, 0, 100 * i], "rotation": [0, 0, 0], "readoutPlanes": {"0": {}, "1": {"num": 50}}} for i in range(3)]
    ranges = maps.map_ranges(geometry.detectors(spark, setup), geometry.planes(spark, setup))
    return maps.hit_maps(ad.points(spark, sf), ranges, {"selected": ("gx", "gy")}).select("det", "bin_x", "bin_y", "count")


PROPERTIES = {"cluster_charge": "charge", "size": "id0", "adc": "amp", "signed": "shifted"}
_SPAN = ", ".join(f"least(min({c}), 0)::DOUBLE AS a_{n}, greatest(max({c}), 0)::DOUBLE AS b_{n}" for n, c in PROPERTIES.items())


def _property_sql(n: str, c: str) -> str:
    low, high, bins = ("0.5::DOUBLE", f"(greatest(b_{n}, 1) + 0.5::DOUBLE)", f"CAST(greatest(b_{n}, 1) AS INTEGER)") if n == "size" else (f"CASE WHEN a_{n} < 0 THEN a_{n} - 0.05::DOUBLE * (b_{n} - a_{n}) ELSE a_{n} END", f"(b_{n} + 0.05::DOUBLE * (b_{n} - a_{n}))", "100")
    return f"SELECT det, plane, '{n}' AS hist, {_bin_sql(c, f'({low})', high, bins)} AS bin, count(*) AS count FROM x JOIN s USING (det) GROUP BY ALL"


@query(f"WITH {ad.HITS}, x AS (SELECT *, amp - 30 AS shifted FROM h), s AS (SELECT det, {_SPAN} FROM x GROUP BY det) " + " UNION ALL ".join(_property_sql(n, c) for n, c in PROPERTIES.items()))
def property_histograms(spark, sf) -> DataFrame:
    """Four properties per plane in one scan, over ranges that the planes of a detector share."""
    own = ad.hits(spark, sf).withColumn("shifted", F.col("amp") - 30)
    return maps.hit_properties(own, ["det", "plane"], ["det"], PROPERTIES).select("det", "plane", "hist", F.col("bin_x").alias("bin"), "count")


@query(f"WITH {ad.WAVES} SELECT id0, CAST(max(list_max(adc)) AS SMALLINT) AS maximum FROM w WHERE entry = 7 GROUP BY id0")
def event_debug(spark, sf) -> DataFrame:
    return qa.event_debug(ad.waves(spark, sf), 7).select("id0", "maximum")


@query(f"WITH {ad.HITS} SELECT det, plane, id0, amp, round((time - 81) * 0.021::DOUBLE, 6) AS depth, round(CASE WHEN plane = 0 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END / 0.4::DOUBLE, 6) AS predicted_strip FROM h WHERE entry = 5 AND det < 3")
def event_display(spark, sf) -> DataFrame:
    pred = spark.range(3).select(F.lit(5).cast("long").alias("entry"), F.col("id").cast("int").alias("det"), F.lit(2.0).alias("pred_x"), F.lit(3.0).alias("pred_y"))
    return qa.event_display(ad.hits(spark, sf).where("det < 3"), pred, geometry.planes(spark, ad.SETUP), 5).select("det", "plane", "id0", "amp", *r6("depth", "predicted_strip"))


@query("""WITH g AS (SELECT CAST(s_nationkey AS INTEGER) AS det, CAST(s_suppkey % 2 AS INTEGER) AS plane, s_suppkey AS chip_id, s_suppkey % 3 = 0 AS is_pad, s_suppkey % 128 AS id0, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 8 ELSE -1 END AS id1 FROM supplier)
SELECT det, plane, count(DISTINCT chip_id) AS n_chips, count(DISTINCT is_pad) = 1 AND (NOT bool_or(is_pad) OR max(CASE WHEN id1 >= 0 THEN id0 END) IS NOT NULL) AS ok FROM g GROUP BY det, plane""")
def geometry_consistency(spark, sf) -> DataFrame:
    s, k = ad.table(spark, sf, "supplier"), F.col("s_suppkey")
    g = s.select(F.col("s_nationkey").cast("int").alias("det"), (k % 2).cast("int").alias("plane"), k.alias("chip_id"), (k % 3 == 0).alias("is_pad"), (k % 128).alias("id0"), F.when(k % 3 == 0, k % 8).otherwise(-1).alias("id1"))
    return qa.geometry_consistency(g).select("det", "plane", "n_chips", "ok")


@query("""WITH n AS (SELECT n_nationkey AS run_id, n_regionkey AS voltage FROM nation), e AS (SELECT s_nationkey AS run_id, min(s_suppkey) AS det FROM supplier WHERE s_suppkey < 100 GROUP BY s_nationkey)
SELECT e.run_id, CAST(e.det AS BIGINT) AS det, (e.det % 7) / 7.0::DOUBLE AS efficiency_2d, (e.det % 5) / 100.0::DOUBLE AS fake_2d, n.voltage FROM e LEFT JOIN n ON n.run_id = e.run_id""")
def run_summary(spark, sf) -> DataFrame:
    s = ad.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("det"), ((F.col("s_suppkey") % 7) / 7).alias("efficiency_2d"), ((F.col("s_suppkey") % 5) / 100).alias("f"))
    v = ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("run_id"), F.col("n_regionkey").alias("voltage"))
    out = qa.run_summary(s.select("run_id", "det", F.lit(0.1).alias("core_sigma")), s.drop("f"), s.select("run_id", "det", F.col("f").alias("efficiency_2d")), v)
    return out.select("run_id", "det", "efficiency_2d", "fake_2d", "voltage")


@query(f"WITH {ad.PAD_HITS} SELECT id0 AS \"column\", id1 AS \"row\", count(*) AS total FROM p WHERE NOT (id0 = 3 AND id1 % 2 = 1) GROUP BY id0, id1")
def bad_pad_mask(spark, sf) -> DataFrame:
    own = ad.pad_hits(spark, sf).where("is_valid").groupBy(F.col("id0").alias("column"), F.col("id1").alias("row")).agg(F.count("*").alias("total"))
    bad = spark.range(4).select(F.lit(3).alias("column"), (F.col("id") * 2 + 1).cast("int").alias("row"))
    return qa.without_pads(own, bad)
