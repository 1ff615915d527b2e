"""Queries: track fits and searches, matching, efficiencies, residuals, timing, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.config import AlignmentConfig, EfficiencyConfig, TrackConfig
from hodoscope.functions import geometry
from hodoscope.operators import align, efficiency, fits, match, timing, tracks
from hodoscope.plans import adapters as ad
from hodoscope.plans.catalog import query
from hodoscope.plans.catalog_detector import CL, PLANE3, _clusters, _pad_clusters, _pad_sql, r6, s6

# --- tracks --------------------------------------------------------------------------------------------------------------

SUMS = "count(*)::DOUBLE AS n, sum(gz) AS z, sum(gz * gz) AS zz, sum(gx) AS x, sum(gy) AS y, sum(gx * gz) AS xz, sum(gy * gz) AS yz, sum(gx * gx) AS xx, sum(gy * gy) AS yy"


@query(f"""WITH {ad.POINTS}, s AS (SELECT entry, {SUMS} FROM g GROUP BY entry),
f AS (SELECT *, CASE WHEN abs(n * zz - z * z) > 1e-12 THEN (n * xz - z * x) / (n * zz - z * z) END AS kx, CASE WHEN abs(n * zz - z * z) > 1e-12 THEN (n * yz - z * y) / (n * zz - z * z) END AS ky FROM s)
SELECT entry, {s6("kx")} AS kx, {s6("(x - kx * z) / n")} AS bx, {s6("ky")} AS ky, {s6("(y - ky * z) / n")} AS "by", CAST(n AS INTEGER) AS hits,
  round((greatest(xx - kx * xz - (x - kx * z) / n * x, 0) + greatest(yy - ky * yz - (y - ky * z) / n * y, 0)) / (0.12::DOUBLE * 0.12::DOUBLE) / greatest(2 * n - 4, 1)) AS chi2 FROM f""")
def track_fit(spark, sf) -> DataFrame:
    return tracks.fit_tracks(ad.points(spark, sf), ["entry"]).select("entry", *r6("kx", "bx", "ky", "by"), "hits", F.round("chi2").alias("chi2"))


_PAIRS = f"""{ad.POINTS}, p AS (SELECT a.entry, a.det, a.raw_idx, a.gx, a.gy, a.gz, b.gx AS ox, b.gy AS oy, b.gz AS oz FROM g a JOIN g b ON a.entry = b.entry AND a.raw_idx <> b.raw_idx),
f AS (SELECT entry, raw_idx, any_value(det) AS det, any_value(gx) AS gx, any_value(gy) AS gy, any_value(gz) AS gz, count(*) AS n, avg(oz) AS mz, regr_slope(ox, oz) AS k, regr_intercept(ox, oz) AS b,
  regr_slope(oy, oz) AS ky, regr_intercept(oy, oz) AS byy, sum(oz * oz) - sum(oz) * sum(oz) / count(*) AS szz FROM p GROUP BY entry, raw_idx)"""


@query(f"WITH {_PAIRS} SELECT entry, raw_idx, CAST(n AS INTEGER) AS n_other, round(gx - (k * gz + b), 7) + 1000 AS res_x, round(gy - (ky * gz + byy), 7) + 1000 AS res_y FROM f WHERE n >= 2 AND szz > 1")
def track_leave_one_out(spark, sf) -> DataFrame:
    own = tracks.leave_one_out(ad.points(spark, sf), ["entry"]).where("n_other >= 2 AND res_x IS NOT NULL AND pointing < 1e6")
    return own.select("entry", "raw_idx", "n_other", *((F.round(f"res_{a}", 7) + 1000).alias(f"res_{a}") for a in "xy"))


@query(f"""WITH {_PAIRS} SELECT det, {", ".join(f"round(stddev_pop((g{a} - ({k} * gz + {b})) / sqrt(1 + 1 / n::DOUBLE + (gz - mz) * (gz - mz) / szz)), 4) AS resolution_{a}" for a, k, b in (("x", "k", "b"), ("y", "ky", "byy")))}, count(*) AS residuals FROM f WHERE n >= 2 AND szz > 1 GROUP BY det""")
def pooled_resolution(spark, sf) -> DataFrame:
    own = tracks.leave_one_out(ad.points(spark, sf), ["entry"]).where("n_other >= 2 AND pointing < 1e6")
    return tracks.pooled_resolution(own, ["det"]).select("det", *(F.round(f"resolution_{a}", 4).alias(f"resolution_{a}") for a in "xy"), "residuals")


@query("""WITH p AS (SELECT 3.0::DOUBLE AS n, 100.0::DOUBLE AS m, 20000.0::DOUBLE AS szz) SELECT z * 2.0::DOUBLE AS z, round(0.12 * sqrt(1 / n + (z * 2 - m) ^ 2 / szz), 6) AS pointing, round(0.12 / sqrt(szz), 6) AS angular FROM p, range(0, 301) r(z)""")
def pointing_curve(spark, sf) -> DataFrame:
    dets = geometry.detectors(spark, ad.SETUP).where("role = 'tracker'")
    return tracks.pointing_curve(dets, 0.12, 0.0, 600.0).select("z", *r6("pointing", "angular"))


@query(f"""WITH {ad.HITS}, d AS (SELECT entry, det, sum(amp * amp * time) / sum(amp * amp) AS t FROM h WHERE is_valid GROUP BY entry, det)
SELECT entry, {s6("avg(t)")} AS t0, true AS has_t0 FROM d GROUP BY entry""")
def track_t0(spark, sf) -> DataFrame:
    return tracks.track_t0(ad.hits(spark, sf).where("is_valid")).select("entry", *r6("t0"), "has_t0")


@query(f"WITH {ad.LINES} SELECT entry, track_index, raw_event_id FROM t WHERE chi2 < 4 AND entry IN (SELECT entry FROM t WHERE chi2 < 4 GROUP BY entry HAVING count(*) = 1)")
def single_track_events(spark, sf) -> DataFrame:
    return tracks.single_track_events(ad.lines(spark, sf).where("chi2 < 4")).select("entry", "track_index", "raw_event_id")


@query(f"""WITH {ad.HITS}, n AS (SELECT entry, det, count(*) AS n FROM h WHERE amp > 40 AND det < 3 GROUP BY entry, det) SELECT entry FROM n GROUP BY entry HAVING count(CASE WHEN n = 1 THEN 1 END) = 3 AND max(n) = 1""")
def strict_single_hit(spark, sf) -> DataFrame:
    return tracks.strict_events(ad.hits(spark, sf).where("amp > 40"), [0, 1, 2])


@query(f"""WITH {ad.HITS}, e AS (SELECT det, entry, bool_or(plane = 0) AS x, bool_or(plane = 1) AS y FROM h WHERE amp > 35 GROUP BY det, entry)
SELECT det, count(CASE WHEN x THEN 1 END) AS with_x, count(CASE WHEN y THEN 1 END) AS with_y, count(CASE WHEN x AND y THEN 1 END) AS with_both, (SELECT count(DISTINCT entry) FROM h) AS events FROM e GROUP BY det""")
def availability(spark, sf) -> DataFrame:
    own = ad.hits(spark, sf)
    return tracks.availability(own.where("amp > 35").withColumns({"has_x": F.col("plane") == 0, "has_y": F.col("plane") == 1}), own)


def _searchable(spark, sf, bits: int = 4) -> DataFrame:
    """Local hits for the search: all valid tracker hits, with coordinates of the plain three-plane set-up."""
    return ad.points(spark, sf, bits).withColumns({"x": F.col("gx"), "y": F.col("gy"), "hit_idx": F.col("raw_idx")})


def _trackers(spark) -> DataFrame:
    return geometry.detectors(spark, [{"id": i, "type": "planar", "role": "tracker", "position": [0, 0, 100 * i], "rotation": [0, 0, 0]} for i in range(3)])


@query()
def track_search(spark, sf) -> DataFrame:
    c = TrackConfig(resolution_x=2.0, resolution_y=2.0)
    found = tracks.find_tracks(_searchable(spark, sf), _trackers(spark), c)
    return found.withColumn("hits", F.to_json("hits"))


# every order its own event: so few hits that SQL can try all sets of tracks
SEEDS = f"""{ad.by_order(ad.POINTS)}, p AS (SELECT entry, det, raw_idx, gx + 0.01371319::DOUBLE * raw_idx AS gx, gy + 0.00711713::DOUBLE * raw_idx * raw_idx AS gy FROM g),
ab AS (SELECT a.entry, a.raw_idx AS a, b.raw_idx AS b, a.gx AS ax, a.gy AS ay, b.gx AS bx, b.gy AS byy FROM p a JOIN p b ON a.entry = b.entry AND a.det = 0 AND b.det = 2),
near AS (SELECT ab.*, m.raw_idx AS m, m.gx AS mx, m.gy AS my, ((m.gx - (ax + bx) / 2) / 2) ^ 2 + ((m.gy - (ay + byy) / 2) / 1.9::DOUBLE) ^ 2 AS d2 FROM ab JOIN p m ON m.entry = ab.entry AND m.det = 1),
mid AS (SELECT * FROM near WHERE d2 <= 9 QUALIFY row_number() OVER (PARTITION BY entry, a, b ORDER BY d2, m) <= 3),
fit AS (SELECT *, (bx - ax) / 200 AS kx, (byy - ay) / 200 AS ky, (ax + mx + bx) / 3 - (bx - ax) / 2 AS x0, (ay + my + byy) / 3 - (byy - ay) / 2 AS y0 FROM mid),
chi AS (SELECT *, (((ax - x0) ^ 2 + (mx - x0 - 100 * kx) ^ 2 + (bx - x0 - 200 * kx) ^ 2) / 4 + ((ay - y0) ^ 2 + (my - y0 - 100 * ky) ^ 2 + (byy - y0 - 200 * ky) ^ 2) / (1.9::DOUBLE * 1.9::DOUBLE)) / 2 AS chi2 FROM fit),
pool AS (SELECT *, 300 - chi2 AS score, row_number() OVER (PARTITION BY entry ORDER BY 300 - chi2 DESC, a, m, b) AS k FROM chi WHERE chi2 <= 10 QUALIFY k <= 80)"""
SETS = """sets AS (SELECT entry, k, score AS total, [k] AS ks, [a, m, b] AS used FROM pool
  UNION ALL SELECT s.entry, p.k, s.total + p.score, list_append(s.ks, p.k), list_concat(s.used, [p.a, p.m, p.b]) FROM sets s JOIN pool p ON p.entry = s.entry AND p.k > s.k AND NOT list_has_any(s.used, [p.a, p.m, p.b])),
top AS (SELECT entry, unnest(ks) AS k, generate_subscripts(ks, 1) - 1 AS track_index FROM (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY entry ORDER BY total DESC, ks) = 1))"""


@query(f"""WITH RECURSIVE {SEEDS}, {SETS}
SELECT entry, CAST(track_index AS INTEGER) AS track_index, {s6("kx")} AS kx, {s6("x0")} AS bx, {s6("ky")} AS ky, {s6("y0")} AS "by", {s6("chi2")} AS chi2, a AS hit_0, m AS hit_1, b AS hit_2 FROM pool JOIN top USING (entry, k)""")
def track_search_orders(spark, sf) -> DataFrame:
    """The search where each order is an event: the caps are not met there, so the result is the best of all sets of tracks.

    Hits are set off a little by their numbers, since on the plain grid two sets may be equally good.
    """
    off = {"x": F.col("gx") + 0.01371319 * F.col("raw_idx"), "y": F.col("gy") + 0.00711713 * F.col("raw_idx") * F.col("raw_idx")}
    own = _searchable(spark, sf, 0).withColumns({n: off[n[-1]] for n in ("gx", "gy", "x", "y")})
    found = tracks.find_tracks(own, _trackers(spark), TrackConfig(resolution_x=2.0, resolution_y=1.9))
    return found.select("entry", "track_index", *r6("kx", "bx", "ky", "by", "chi2"), *(F.col("hits")[k].alias(f"hit_{k}") for k in range(3)))


@query()
def tracker_alignment(spark, sf) -> DataFrame:
    """Each order is an event, so that many events have a single hit in each plane; all valid hits take part."""
    own = _searchable(spark, sf, 0)
    strict = tracks.strict_events(own, [0, 1, 2])
    found = align.align_trackers(own.join(strict, "entry", "left_semi"), _trackers(spark), AlignmentConfig(min_tracks=5), (5.0, 5.0))
    return align.corrections_table(spark, found)


# --- matching ------------------------------------------------------------------------------------------------------------

DUT = [ad.SETUP[3]]
CONFIG = EfficiencyConfig(x_bins=4, x_max=24.0, y_bins=3, y_max=21.0, exclude_x=(2,), min_entries_per_bin=5, margin=0.6, fake_partners=3)
PADS = EfficiencyConfig(x_bins=4, x_max=24.0, y_bins=3, y_max=21.0, min_entries_per_bin=5, margin=0.6)


def _pred(spark, sf) -> DataFrame:
    """Where the tracks of all orders meet the DUT; each order is an event here, so an event has one track."""
    return geometry.predict(ad.lines(spark, sf, 0), geometry.detectors(spark, DUT)).select("entry", "det", "pred_x", "pred_y")


def _strips(spark, sf) -> DataFrame:
    planes = geometry.planes(spark, DUT)
    # the detector is a key of every clustering step, so Spark drops the other detectors' hits before them
    own = _clusters(spark, sf, bits=0).where(F.col("det").isin(*(d["id"] for d in DUT)))
    return match.strip_clusters(own, geometry.axis_planes(planes), planes)


PRED = ad.by_order(PLANE3)
MATCH = f"""WITH {ad.by_order(CL)}, {PRED}, k AS (SELECT * FROM cl WHERE det = 3)"""


@query(f"""{MATCH}, j AS (SELECT p.entry, k.plane, k.cluster_idx, k.pos * 0.4::DOUBLE AS u, k.pos * 0.4::DOUBLE - CASE WHEN k.plane = 0 THEN pred_x ELSE pred_y END AS res FROM pred p JOIN k ON p.entry = k.entry),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY entry, plane ORDER BY abs(res), cluster_idx) = 1)
SELECT p.entry, {s6("x.u")} AS hit_x, {s6("x.res")} AS res_x, x.cluster_idx AS cluster_x, {s6("y.u")} AS hit_y, {s6("y.res")} AS res_y, y.cluster_idx AS cluster_y,
  CAST(CASE WHEN x.entry IS NULL THEN 0 ELSE 1 END + CASE WHEN y.entry IS NULL THEN 0 ELSE 2 END AS INTEGER) AS hit_flag
FROM pred p LEFT JOIN (SELECT * FROM b WHERE plane = 0) x ON x.entry = p.entry LEFT JOIN (SELECT * FROM b WHERE plane = 1) y ON y.entry = p.entry""")
def nearest_cluster(spark, sf) -> DataFrame:
    own = match.nearest_clusters(_pred(spark, sf), _strips(spark, sf))
    return own.select("entry", *r6("hit_x", "res_x"), "cluster_x", *r6("hit_y", "res_y"), "cluster_y", "hit_flag")


SPAN = f"""{ad.by_order(ad.HITS)}, v AS (SELECT * FROM h WHERE is_valid AND det = 3),
l AS (SELECT *, CASE WHEN id0 - lag(id0) OVER z <= 2 THEN 0 ELSE 1 END AS first FROM v WINDOW z AS (PARTITION BY entry, plane ORDER BY id0, raw_idx)),
i AS (SELECT *, sum(first) OVER (PARTITION BY entry, plane ORDER BY id0, raw_idx ROWS UNBOUNDED PRECEDING) AS part FROM l),
e AS (SELECT entry, plane, min(id0) * 0.4::DOUBLE AS low, max(id0) * 0.4::DOUBLE AS high FROM i GROUP BY entry, plane, part HAVING count(DISTINCT id0) <= 6)"""
NEED = f"""WITH {SPAN}, {PRED}, w AS (SELECT p.entry, p.pred_x, p.pred_y, e.plane, min(CASE WHEN q0 < low THEN low - q0 WHEN q0 > high THEN q0 - high ELSE 0 END) AS need
  FROM (SELECT *, unnest([0, 1]) AS plane, unnest([pred_x, pred_y]) AS q0 FROM pred) p LEFT JOIN e ON e.entry = p.entry AND e.plane = p.plane GROUP BY ALL),
s AS (SELECT p.entry, p.pred_x, p.pred_y, coalesce(max(CASE WHEN w.plane = 0 THEN need END), 'inf'::DOUBLE) AS need_x, coalesce(max(CASE WHEN w.plane = 1 THEN need END), 'inf'::DOUBLE) AS need_y
  FROM pred p LEFT JOIN w ON w.entry = p.entry GROUP BY p.entry, p.pred_x, p.pred_y),
f AS (SELECT *, greatest(need_x, need_y) AS need_2d, CASE WHEN pred_x >= 0 AND pred_x < 24 AND pred_y >= 0 AND pred_y < 21 AND floor(pred_x / 24 * 4) + 1 <> 2
  THEN CAST(floor(pred_x / 24 * 4) * 3 + floor(pred_y / 21 * 3) AS INTEGER) END AS flat_bin FROM s)"""


def _samples(spark, sf) -> DataFrame:
    return match.strip_samples(_pred(spark, sf), match.strip_envelopes(_strips(spark, sf))).withColumn("flat_bin", efficiency.flat_bin(CONFIG))


@query(NEED + " SELECT entry, coalesce(flat_bin, -1) AS flat_bin, need_x <= 0.61 AS matched_x, need_y <= 0.61 AS matched_y, need_2d <= 0.61 AS matched_2d FROM f")
def envelope_match(spark, sf) -> DataFrame:
    return _samples(spark, sf).select("entry", F.coalesce("flat_bin", F.lit(-1)).alias("flat_bin"), *[(F.col(f"need_{a}") <= 0.61).alias(f"matched_{a}") for a in efficiency.AXES])


GRID = NEED + ", g AS (SELECT flat_bin, count(*) AS total, count(CASE WHEN need_x <= 0.61 THEN 1 END) AS passed_x, count(CASE WHEN need_y <= 0.61 THEN 1 END) AS passed_y, count(CASE WHEN need_2d <= 0.61 THEN 1 END) AS passed_2d FROM f WHERE flat_bin IS NOT NULL GROUP BY flat_bin)"


@query(GRID + " SELECT * FROM g")
def efficiency_map(spark, sf) -> DataFrame:
    return efficiency.grid(_samples(spark, sf), 0.61).drop("det")


@query(GRID + """ SELECT CAST(sum(total) AS BIGINT) AS total_events, count(*) AS valid_bins, round(sum(passed_x) / sum(total), 6) AS efficiency_x, round(sum(passed_2d) / sum(total), 6) AS efficiency_2d,
  round(stddev_pop(passed_x / total) / avg(passed_x / total), 6) AS nonuniformity_x FROM g WHERE total >= 5""")
def efficiency_weighted(spark, sf) -> DataFrame:
    own = efficiency.summary(efficiency.grid(_samples(spark, sf), 0.61), CONFIG, intervals=False)
    return own.select("total_events", "valid_bins", *r6("efficiency_x", "efficiency_2d", "nonuniformity_x"))


_TAIL = "list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))))"
_LIMITS = ", ".join(f"round(CASE WHEN p{a} = {0 if side == 'low' else 'total_events'} THEN {0 if side == 'low' else 1} ELSE (SELECT lo FROM limits WHERE a = '{a}' AND side = '{side}' AND step = 55) END, 6) AS {side}_{a}" for a in efficiency.AXES for side in ("low", "high"))


# limits by bisection of the binomial distribution's upper tail: of k for the low one, of k + 1 for the high one
@query(GRID.replace("WITH ", "WITH RECURSIVE ", 1) + f""", whole AS (SELECT CAST(sum(total) AS BIGINT) AS total_events, count(*) AS valid_bins, {", ".join(f"CAST(sum(passed_{a}) AS BIGINT) AS p{a}, CASE WHEN sum(passed_{a}) > 0 THEN round(stddev_pop(passed_{a} / total) / avg(passed_{a} / total), 6) ELSE 0 END AS nonuniformity_{a}" for a in efficiency.AXES)} FROM g WHERE total >= 5),
limits AS (SELECT a, side, CASE WHEN side = 'low' THEN p ELSE p + 1 END AS k, total_events AS n, CASE WHEN side = 'low' THEN (1 - 0.683::DOUBLE) / 2 ELSE 1 - (1 - 0.683::DOUBLE) / 2 END AS target, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step
    FROM (SELECT total_events, unnest(['x', 'y', '2d']) AS a, unnest([px, py, p2d]) AS p FROM whole), (SELECT unnest(['low', 'high']) AS side)
  UNION ALL SELECT a, side, k, n, target, CASE WHEN coalesce({_TAIL}, 0) < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN coalesce({_TAIL}, 0) < target THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM limits WHERE step < 55)
SELECT 3 AS det, total_events, valid_bins, {", ".join(f"p{a} AS passed_{a}, round(p{a} / total_events, 6) AS efficiency_{a}, nonuniformity_{a}" for a in efficiency.AXES)}, {_LIMITS} FROM whole""")
def clopper_pearson(spark, sf) -> DataFrame:
    own = efficiency.summary(efficiency.grid(_samples(spark, sf), 0.61), CONFIG)
    return own.select("det", "total_events", "valid_bins", *[f"passed_{a}" for a in efficiency.AXES], *r6(*[f"{n}_{a}" for a in efficiency.AXES for n in ("efficiency", "nonuniformity", "low", "high")]))


@query(GRID + " SELECT CAST(flat_bin // 3 + 1 AS INTEGER) AS slice, CAST(sum(total) AS BIGINT) AS total, round(sum(passed_x) / sum(total), 6) AS efficiency_x, round(sum(passed_2d) / sum(total), 6) AS efficiency_2d FROM g WHERE total >= 5 GROUP BY 1")
def efficiency_projection(spark, sf) -> DataFrame:
    return efficiency.projections(efficiency.grid(_samples(spark, sf), 0.61), CONFIG, "x").select("slice", "total", *r6("efficiency_x", "efficiency_2d"))


SCAN = EfficiencyConfig(**(CONFIG.__dict__ | {"scan_min": 0.013, "scan_max": 3.0, "scan_step": 0.1}))


@query(GRID + f""", big AS (SELECT flat_bin FROM g WHERE total >= 5), m AS (SELECT unnest([{', '.join(f"{m!r}::DOUBLE" for m in efficiency.margins(SCAN))}]) AS margin)
SELECT round(margin, 6) AS margin, count(*) AS total_events, round(count(CASE WHEN need_x <= margin THEN 1 END) / count(*), 6) AS efficiency_x, round(count(CASE WHEN need_2d <= margin THEN 1 END) / count(*), 6) AS efficiency_2d
FROM f JOIN big USING (flat_bin), m GROUP BY margin""")
def margin_scan(spark, sf) -> DataFrame:
    return efficiency.margin_scan(_samples(spark, sf), SCAN).select(*r6("margin"), "total_events", *r6("efficiency_x", "efficiency_2d"))


_PER_AXIS = ", ".join(f"count(CASE WHEN need_{a} <= 0.61 THEN 1 END) AS matched_{a}, count(CASE WHEN need_{a} > 0.61 THEN 1 END) AS lost_{a}" for a in efficiency.AXES)
_SHARES = ", ".join(f"matched_{a}, lost_{a}, round(matched_{a} / eligible, 6) AS efficiency_{a}, round(sqrt(matched_{a} / eligible * (1 - matched_{a} / eligible) / eligible), 6) AS error_{a}" for a in efficiency.AXES)


@query(NEED + f""", c AS (SELECT count(*) AS eligible, {_PER_AXIS}, count(CASE WHEN need_x <= 0.61 AND need_y <= 0.61 THEN 1 END) AS b FROM f)
SELECT 3 AS det, eligible, {_SHARES}, round(b / nullif(matched_x, 0), 6) AS y_given_x, round(b / nullif(matched_y, 0), 6) AS x_given_y FROM c""")
def efficiency_report(spark, sf) -> DataFrame:
    own = efficiency.efficiency_report(_samples(spark, sf), 0.61)
    return own.select("det", "eligible", *(f"{n}_{a}" for a in efficiency.AXES for n in ("matched", "lost")), *r6(*(f"{n}_{a}" for a in efficiency.AXES for n in ("efficiency", "error")), "y_given_x", "x_given_y"))


def _mixed_sql(number: str, seed: int) -> str:
    u = f"((({number}) % {match.PRIME} * {match.FIRST} + {seed * match.SEEDS}) % {match.PRIME})"
    return f"(({u} * {u} % {match.PRIME} * {match.SECOND} + 7 * {u} + {seed}) % {match.PRIME})"


_OFF = "CASE WHEN {q} < low THEN low - {q} WHEN {q} > high THEN {q} - high ELSE 0 END"


@query(NEED + f""", fe AS (SELECT entry, {_mixed_sql("entry", CONFIG.fake_seed + 1)} % (SELECT CAST(ceil(count(*) / {match.RING}) AS BIGINT) FROM f) AS ring, {_mixed_sql("entry", CONFIG.fake_seed)} AS h FROM f),
fr AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY h, entry) - 1 AS k, count(*) OVER (PARTITION BY ring) AS n FROM fe),
fj AS (SELECT *, unnest(range(1, least({CONFIG.fake_partners}, n - 1) + 1)) AS j FROM fr WHERE n > 1),
ft AS (SELECT *, CASE WHEN n - 1 <= {CONFIG.fake_partners} THEN j ELSE 1 + ((j - 1) * (n - 1) // {CONFIG.fake_partners} + {_mixed_sql(f"entry + {match.DETS} * 3", CONFIG.fake_seed + 2)} % greatest((n - 1) // {CONFIG.fake_partners}, 1)) % (n - 1) END AS stride FROM fj),
fp AS (SELECT a.entry, b.entry AS partner FROM ft a JOIN fr b ON a.ring = b.ring AND b.k = (a.k + a.stride) % a.n),
rest AS (SELECT e.* FROM e JOIN f USING (entry) WHERE {_OFF.format(q="(CASE WHEN plane = 0 THEN pred_x ELSE pred_y END)")} > {CONFIG.margin}),
fn AS (SELECT fp.entry, partner, flat_bin, min(CASE WHEN plane = 0 THEN {_OFF.format(q="pred_x")} END) AS nx, min(CASE WHEN plane = 1 THEN {_OFF.format(q="pred_y")} END) AS ny FROM fp JOIN f ON f.entry = partner LEFT JOIN rest ON rest.entry = fp.entry GROUP BY fp.entry, partner, flat_bin)
SELECT 3 AS det, flat_bin, count(*) AS total, count(CASE WHEN nx <= {CONFIG.margin} THEN 1 END) AS passed_x, count(CASE WHEN ny <= {CONFIG.margin} THEN 1 END) AS passed_y, count(CASE WHEN nx <= {CONFIG.margin} AND ny <= {CONFIG.margin} THEN 1 END) AS passed_2d FROM fn WHERE flat_bin IS NOT NULL GROUP BY flat_bin""")
def fake_efficiency(spark, sf) -> DataFrame:
    own = _samples(spark, sf)
    pairs = match.fake_partners(own.select("det", "entry"), CONFIG.fake_seed, CONFIG.fake_partners)
    return efficiency.grid(match.strip_fakes(own, pairs, CONFIG.margin), CONFIG.margin)


PADMATCH = ad.by_order(_pad_sql("abs(a.id0 - b.id0) + abs(a.id1 - b.id1) <= 1"))
BOX = PADMATCH.replace("SELECT p.entry, CAST(count", f", x AS (SELECT entry, local_x, local_y, x0 * 3 - 1.4::DOUBLE AS xl, x1 * 3 + 1.4::DOUBLE AS xh, y0 * 3 - 1.4::DOUBLE AS yl, y1 * 3 + 1.4::DOUBLE AS yh FROM (SELECT p.entry, min(id0) AS x0, max(id0) AS x1, min(id1) AS y0, max(id1) AS y1, CAST(count").replace("round(sum(amp * id0 * 3) / sum(amp), 6)", "sum(amp * id0 * 3) / sum(amp)").replace("round(sum(amp * id1 * 3) / sum(amp), 6)", "sum(amp * id1 * 3) / sum(amp)") + f""")), {ad.by_order(ad.LINES)},
q AS (SELECT entry, kx * 150 + bx AS px, ky * 150 + "by" AS py FROM t),
j AS (SELECT q.entry, px, py, local_x, local_y, CASE WHEN px < xl THEN xl - px WHEN px > xh THEN px - xh ELSE 0 END AS nx, CASE WHEN py < yl THEN yl - py WHEN py > yh THEN py - yh ELSE 0 END AS ny FROM q JOIN x ON x.entry = q.entry)"""


def _pad_samples(spark, sf) -> DataFrame:
    dets = geometry.detectors(spark, [ad.SETUP[4]])
    pred = geometry.predict(ad.lines(spark, sf, 0), dets).select("entry", "det", "pred_x", "pred_y")
    return match.pad_samples(pred, match.pad_envelopes(_pad_clusters(spark, sf, bits=0), dets)).withColumn("flat_bin", efficiency.flat_bin(PADS))


@query(BOX.replace(", q AS (SELECT entry, raw_idx", ", q0 AS (SELECT entry, raw_idx").replace("\nq AS (SELECT entry, raw_idx", "\nq0 AS (SELECT entry, raw_idx").replace("FROM p JOIN q ON p.entry = q.entry AND p.raw_idx = q.raw_idx", "FROM p JOIN q0 ON p.entry = q0.entry AND p.raw_idx = q0.raw_idx").replace("\n, x AS", ", x AS") + """
SELECT entry, min(greatest(nx, ny)) <= 0.61 AS matched, min(nx) <= 0.61 AS matched_x, round(min(CASE WHEN greatest(nx, ny) <= 0.61 THEN sqrt((local_x - px) ^ 2 + (local_y - py) ^ 2) END), 6) AS distance FROM j GROUP BY entry""")
def pad_envelope_match(spark, sf) -> DataFrame:
    own = match.pad_nearest(_pad_samples(spark, sf), 0.61).where("boxes IS NOT NULL")
    return own.select("entry", (F.col("need_2d") <= 0.61).alias("matched"), (F.col("need_x") <= 0.61).alias("matched_x"), F.round(F.sqrt(F.col("res_x") ** 2 + F.col("res_y") ** 2), 6).alias("distance"))


@query(f"""{MATCH}, j AS (SELECT p.entry, k.plane, k.centroid * 0.4::DOUBLE - CASE WHEN k.plane = 0 THEN pred_x ELSE pred_y END AS res FROM pred p JOIN k ON p.entry = k.entry),
w AS (SELECT *, exp((min(res * res) OVER (PARTITION BY entry, plane) - res * res) / (2 * 2.0 * 2.0)) AS w FROM j)
SELECT entry, CASE WHEN plane = 0 THEN 'x' ELSE 'y' END AS axis, {s6("sum(w * res) / sum(w)")} AS residual, {s6("max(w) / sum(w)")} AS dominance FROM w GROUP BY entry, plane""")
def soft_match(spark, sf) -> DataFrame:
    return match.soft_match(_pred(spark, sf), _strips(spark, sf), 2.0).select("entry", "axis", *r6("residual", "dominance"))


@query("""WITH r AS (SELECT CAST(l_suppkey % 4 AS INTEGER) AS det, l_quantity - 25 AS res, l_partkey % 64 AS w FROM lineitem)
SELECT det, round(regr_slope(res, w), 6) AS slope, count(*) AS n FROM r GROUP BY det HAVING count(*) >= 100""")
def residual_slope(spark, sf) -> DataFrame:
    li = ad.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("det"), (F.col("l_quantity") - 25).alias("res_x"), (F.col("l_partkey") % 64).alias("at"))
    return match.residual_slope(li, "at", "res_x").select("det", *r6("slope"), "n")


@query("""WITH r AS (SELECT CAST(l_suppkey % 4 AS INTEGER) AS det, (l_quantity - 25) / 4 AS res FROM lineitem), u AS (SELECT *, row_number() OVER (PARTITION BY det ORDER BY res) - 1 AS k, count(*) OVER (PARTITION BY det) AS n FROM r WHERE abs(res) < 5),
q AS (SELECT det, max(CASE WHEN k = CAST(round(0.16::DOUBLE * (n - 1)) AS BIGINT) THEN res END) AS lo, max(CASE WHEN k = CAST(round(0.84::DOUBLE * (n - 1)) AS BIGINT) THEN res END) AS hi, max(CASE WHEN k = CAST(round(0.5::DOUBLE * (n - 1)) AS BIGINT) THEN res END) AS mid, count(*) AS used, avg(res) AS mean, stddev_pop(res) AS rms FROM u GROUP BY det)
SELECT q.det, count(*) AS rows, any_value(used) AS used, round(any_value(mean), 6) AS mean, round(any_value(rms), 6) AS rms, round(count(CASE WHEN abs(res) < 1 THEN 1 END) / count(*), 6) AS within_1mm, any_value((hi - lo) / 2) AS sigma68, any_value(lo) AS q16, any_value(mid) AS median, any_value(hi) AS q84 FROM q JOIN r ON r.det = q.det GROUP BY q.det""")
def residual_summary(spark, sf) -> DataFrame:
    li = ad.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("det"), ((F.col("l_quantity") - 25) / 4).alias("res_x"))
    return efficiency.residual_summary(li, "x").select("det", "rows", "used", *r6("mean", "rms", "within_1mm"), "sigma68", "q16", "median", "q84")


def _blur(spark, sf) -> DataFrame:
    """Residuals of about normal form per detector: sums of independent columns, three times as wide on one line in seven."""
    li = ad.table(spark, sf, "lineitem")
    core = (F.col("l_quantity") - 25.5) / 14 + (F.round(F.col("l_discount") * 100) - 5) / 3 + (F.round(F.col("l_tax") * 100) - 4) / 2.5 + (F.col("l_partkey") % 64 - 31.5) / 18
    return li.select((F.col("l_suppkey") % 4).cast("int").alias("det"), (core * F.when(F.col("l_linenumber") == 7, 3.0).otherwise(1.0)).alias("res_x"))


BLUR = """r AS (SELECT CAST(l_suppkey % 4 AS INTEGER) AS det, ((l_quantity - 25.5::DOUBLE) / 14 + (round(l_discount * 100) - 5) / 3 + (round(l_tax * 100) - 4) / 2.5::DOUBLE + (l_partkey % 64 - 31.5::DOUBLE) / 18)
  * CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 END AS res FROM lineitem)"""
HISTOGRAM = """m AS (SELECT det, count(*) AS entries, avg(res) AS mean, stddev_pop(res) AS rms, avg(res) - 6 * stddev_pop(res) AS low, 12 * stddev_pop(res) / 160 AS width FROM r GROUP BY det),
h AS MATERIALIZED (SELECT det, bin, count(*)::DOUBLE AS n, any_value(low) + (bin + 0.5::DOUBLE) * any_value(width) AS x FROM (SELECT r.det, CAST(floor((res - low) / width) AS INTEGER) AS bin, low, width FROM r JOIN m ON r.det = m.det) WHERE bin BETWEEN 0 AND 159 GROUP BY det, bin)"""


def _newton(rounds: int = 25) -> str:
    """CTEs of Gauss-Newton steps of a Gaussian's least squares over h, by Cramer's rule: the last is p<rounds>(det, a, c, s)."""
    out = ["p0 AS (SELECT m.det, (SELECT max(n) FROM h WHERE h.det = m.det) AS a, mean AS c, rms AS s FROM m)"]
    for k in range(rounds):
        out.append(f"""j{k} AS (SELECT h.det, a, c, s, n, exp(-0.5::DOUBLE * ((x - c) / s) ^ 2) AS g, a * exp(-0.5::DOUBLE * ((x - c) / s) ^ 2) * (x - c) / (s * s) AS u, a * exp(-0.5::DOUBLE * ((x - c) / s) ^ 2) * (x - c) * (x - c) / (s * s * s) AS v FROM h JOIN p{k} USING (det)),
n{k} AS MATERIALIZED (SELECT det, a, c, s, sum(g * g / n) AS gg, sum(g * u / n) AS gu, sum(g * v / n) AS gv, sum(u * u / n) AS uu, sum(u * v / n) AS uv, sum(v * v / n) AS vv,
  sum(g * (n - a * g) / n) AS rg, sum(u * (n - a * g) / n) AS ru, sum(v * (n - a * g) / n) AS rv FROM j{k} GROUP BY det, a, c, s),
d{k} AS (SELECT *, gg * (uu * vv - uv * uv) - gu * (gu * vv - uv * gv) + gv * (gu * uv - uu * gv) AS det3 FROM n{k}),
p{k + 1} AS MATERIALIZED (SELECT det, a + (rg * (uu * vv - uv * uv) - gu * (ru * vv - uv * rv) + gv * (ru * uv - uu * rv)) / det3 AS a,
  c + (gg * (ru * vv - uv * rv) - rg * (gu * vv - uv * gv) + gv * (gu * rv - ru * gv)) / det3 AS c,
  s + (gg * (uu * rv - ru * uv) - gu * (gu * rv - ru * gv) + rg * (gu * uv - uu * gv)) / det3 AS s FROM d{k})""")
    return ",\n".join(out)


@query(f"""WITH {BLUR}, {HISTOGRAM}, {_newton()}
SELECT det, m.entries, CAST((SELECT count(*) FROM h WHERE h.det = m.det) AS INTEGER) AS used, true AS fitted, round(c, 4) + 1 AS centre, round(abs(s), 4) AS sigma FROM p25 JOIN m USING (det)""")
def gaussian_fits(spark, sf) -> DataFrame:
    """A Gaussian per detector; the SQL solves the same least squares by its own Gauss-Newton steps."""
    own = fits.fit_histograms(fits.histograms(_blur(spark, sf), ["det"], "res_x"), ["det"])
    return own.select("det", "entries", "used", "fitted", (F.round("centre", 4) + 1).alias("centre"), F.round("sigma", 4).alias("sigma"))


@query(f"""WITH {BLUR}, {HISTOGRAM} SELECT det, any_value(m.entries) AS entries, CAST(count(*) AS INTEGER) AS used, true AS stationary, true AS ordered FROM h JOIN m USING (det) GROUP BY det""")
def double_gaussian_fits(spark, sf) -> DataFrame:
    """Core and tail per detector. stationary: the normal equations hold at the fit; ordered: its widths and shares are in order."""
    own = fits.fit_residuals(_blur(spark, sf), ["det"], "res_x")
    ordered = (F.col("core_sigma") <= F.col("effective_sigma")) & (F.col("effective_sigma") <= F.col("tail_sigma")) & F.col("tail_fraction").between(0, 1) & (F.col("within_3sigma") <= F.col("within_5sigma"))
    return own.select("det", "entries", "used", (F.col("fitted") & (F.col("gradient") < 1e-3)).alias("stationary"), ordered.alias("ordered"))


@query(f"""WITH {BLUR}, {HISTOGRAM}, n AS (SELECT det, mean - 5 * rms AS low, 10 * rms / 100 AS width FROM m)
SELECT r.det, CAST(floor((res - n.low) / n.width) AS INTEGER) AS bin, count(*) AS count FROM r JOIN n ON r.det = n.det WHERE res >= n.low AND floor((res - n.low) / n.width) < 100 GROUP BY ALL""")
def residual_histogram(spark, sf) -> DataFrame:
    """Residuals of mean +- 5 rms in 100 bins, ranges per detector from the data."""
    return fits.histograms(_blur(spark, sf), ["det"], "res_x", 100, 5.0).select("det", "bin", "count")


# --- timing --------------------------------------------------------------------------------------------------------------

METHODS = {"XMean": "0", "YMean": "1", "XYMean": "0, 1", "XMin": "0", "YMin": "1", "XYMin": "0, 1", "XYWeighted": "0, 1"}


def _time_sql(m: str, planes: str) -> str:
    t = "min(time)" if m.endswith("Min") else "sum(amp * time) / sum(amp)" if m == "XYWeighted" else "sum(time / (time_error * time_error)) / sum(1 / (time_error * time_error))"
    return f"SELECT '{m}' AS method, entry, det, {s6(t)} AS t FROM h WHERE plane IN ({planes}) GROUP BY entry, det"


@query(f"WITH {ad.HITS} " + " UNION ALL ".join(_time_sql(m, p) for m, p in METHODS.items()))
def time_methods(spark, sf) -> DataFrame:
    # one scan and one shuffle for all methods
    wide = ad.hits(spark, sf).groupBy("entry", "det").agg(*[timing.combined_time(m).alias(m) for m in METHODS])
    return wide.unpivot(["entry", "det"], list(METHODS), "method", "t").where("t IS NOT NULL").select("method", "entry", "det", *r6("t"))


@query(f"WITH {ad.HITS} SELECT entry, det, raw_idx FROM h ANTI JOIN (SELECT DISTINCT entry, det FROM h WHERE amp > 45) v USING (entry, det)")
def amplitude_veto(spark, sf) -> DataFrame:
    return timing.veto(ad.hits(spark, sf), ["entry", "det"], 45).select("entry", "det", "raw_idx")


@query(f"""WITH {ad.HITS}, t AS (SELECT entry, det, min(time) AS t FROM h GROUP BY entry, det), w AS (SELECT entry, max(CASE WHEN det = 0 THEN t END) AS a, max(CASE WHEN det = 1 THEN t END) AS b, max(CASE WHEN det = 2 THEN t END) AS c FROM t GROUP BY entry),
s AS (SELECT stddev_pop(a - b) AS s12, stddev_pop(a - c) AS s13, stddev_pop(b - c) AS s23 FROM w),
v AS (SELECT (s12 ^ 2 + s13 ^ 2 - s23 ^ 2) / 2 AS v1, (s12 ^ 2 + s23 ^ 2 - s13 ^ 2) / 2 AS v2, (s13 ^ 2 + s23 ^ 2 - s12 ^ 2) / 2 AS v3 FROM s)
SELECT round(v1, 6) AS v1, round(v2, 6) AS v2, round(v3, 6) AS v3, round(1 / v1 / (1 / v1 + 1 / v2 + 1 / v3), 6) AS w1, round(1 / v2 / (1 / v1 + 1 / v2 + 1 / v3), 6) AS w2, round(1 / v3 / (1 / v1 + 1 / v2 + 1 / v3), 6) AS w3, round(1 / sqrt(1 / v1 + 1 / v2 + 1 / v3), 6) AS resolution FROM v""")
def three_corner_hat(spark, sf) -> DataFrame:
    t = ad.hits(spark, sf).groupBy("entry", "det").agg(F.min("time").alias("t"))
    pick = lambda d: F.max(F.when(F.col("det") == d, F.col("t")))
    w = t.groupBy("entry").agg(pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("c"))
    s = w.agg(F.stddev_pop(F.col("a") - F.col("b")).alias("s12"), F.stddev_pop(F.col("a") - F.col("c")).alias("s13"), F.stddev_pop(F.col("b") - F.col("c")).alias("s23"))
    return s.withColumns(timing.hat_columns(F.col("s12"), F.col("s13"), F.col("s23"))).select(*r6("v1", "v2", "v3", "w1", "w2", "w3", "resolution"))


@query("SELECT c_nationkey AS nation, round(CASE WHEN var_pop(c_acctbal) - avg(c_custkey) >= 0 THEN sqrt(var_pop(c_acctbal) - avg(c_custkey)) END, 4) AS intrinsic FROM customer GROUP BY c_nationkey")
def reference_subtraction(spark, sf) -> DataFrame:
    own = ad.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.stddev_pop("c_acctbal").alias("s"), F.avg("c_custkey").alias("v"))
    return own.select("nation", F.round(timing.subtract_reference(F.col("s"), F.col("v")), 4).alias("intrinsic"))


@query(f"""WITH {ad.LINES}, x AS (SELECT * REPLACE (raw_event_id // 3 AS raw_event_id) FROM t), own AS (SELECT raw_event_id FROM x GROUP BY 1 HAVING count(DISTINCT entry) = 1),
r AS (SELECT user_id * 10 + event_id % 10 AS id, any_value(value) AS v FROM events GROUP BY 1 HAVING count(*) = 1)
SELECT x.entry, x.track_index, r.v AS external_t0, r.v IS NOT NULL AS has_external_t0 FROM x LEFT JOIN r ON r.id = x.raw_event_id AND x.raw_event_id IN (SELECT raw_event_id FROM own)""")
def external_t0(spark, sf) -> DataFrame:
    own = ad.lines(spark, sf).withColumn("raw_event_id", F.floor(F.col("raw_event_id") / 3))
    ref = ad.table(spark, sf, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("event_id"), F.col("value").alias("reference_time"))
    return timing.external_t0(own, ref).select("entry", "track_index", "external_t0", "has_external_t0")


@query(f"""WITH {ad.LINES}, d AS (SELECT DISTINCT l_orderkey >> 1 AS entry, CAST(l_orderkey % 2 AS INTEGER) AS track_index, CAST(l_suppkey % 4 AS INTEGER) AS dut_id FROM lineitem WHERE l_suppkey % 4 = 3 AND l_quantity > 40)
SELECT t.entry, t.track_index, coalesce(d.dut_id, -1) AS dut_id, CASE WHEN d.dut_id IS NOT NULL THEN 3.5::DOUBLE - chi2 END AS dut_minus_track FROM t LEFT JOIN d ON d.entry = t.entry AND d.track_index = t.track_index WHERE d.dut_id IS NOT NULL OR chi2 > 5""")
def track_with_dut(spark, sf) -> DataFrame:
    k = F.col("l_orderkey")
    duts = ad.table(spark, sf, "lineitem").where("l_suppkey % 4 = 3 AND l_quantity > 40").select(F.shiftright(k, 1).alias("entry"), (k % 2).cast("int").alias("track_index"), F.lit(3).alias("det"), F.lit(3.5).alias("t")).distinct()
    own = timing.track_with_dut(ad.lines(spark, sf).withColumn("track_time", F.col("chi2")), duts)
    return own.where("dut_id IS NOT NULL OR chi2 > 5").select("entry", "track_index", F.coalesce("dut_id", F.lit(-1)).alias("dut_id"), "dut_minus_track")


@query(f"""WITH {ad.HITS}, t AS (SELECT entry, plane AS track_index, det, min(time) AS t FROM h WHERE det < 3 AND amp > 30 GROUP BY ALL), w AS (SELECT entry, track_index FROM t GROUP BY ALL HAVING count(*) = 3)
SELECT entry, track_index FROM w WHERE entry IN (SELECT entry FROM w GROUP BY entry HAVING count(*) = 1)""")
def unique_references(spark, sf) -> DataFrame:
    t = ad.hits(spark, sf).where("det < 3 AND amp > 30").groupBy("entry", F.col("plane").alias("track_index"), "det").agg(F.min("time").alias("t"))
    return timing.unique_references(timing.combine_trackers(t, (0, 1, 2), [0.2, 0.3, 0.5])).select("entry", "track_index")


@query(f"""WITH {ad.HITS}, w AS (SELECT entry, CAST(entry % 5 AS INTEGER) AS flag FROM h GROUP BY entry)
SELECT DISTINCT h.entry, h.raw_idx FROM h JOIN w ON w.entry = h.entry WHERE h.det = 3 AND ((w.flag & 1 <> 0 AND h.plane = 0) OR (w.flag & 2 <> 0 AND h.plane = 1)) AND h.entry % 3 = 0""")
def dut_strips(spark, sf) -> DataFrame:
    own = ad.hits(spark, sf)
    rows = own.select("entry").distinct().select("entry", F.lit(3).alias("det"), (F.col("entry") % 5).cast("int").alias("hit_flag"), F.lit(0).alias("cluster_x"), F.lit(1).alias("cluster_y"))
    refs = own.where("entry % 3 = 0").select("entry").distinct()
    members = own.withColumn("cluster_idx", F.col("plane"))
    return timing.dut_strips(rows, refs, members).select("entry", "raw_idx")


@query("""WITH r AS (SELECT l_returnflag AS k, l_partkey % 997 + l_quantity / 100 AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey % 997 + l_quantity / 100) - 1 AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
s AS (SELECT k, max(CASE WHEN rn = CAST(floor(0.005::DOUBLE * (n - 1)) AS BIGINT) THEN v END) - 25 AS lo, max(CASE WHEN rn = CAST(floor(0.995::DOUBLE * (n - 1)) AS BIGINT) THEN v END) AS hi, any_value(n) AS n FROM r GROUP BY k),
b AS (SELECT *, greatest(1, least(20000, CAST(ceil((hi - lo) / 5.3) AS INTEGER))) AS bins FROM s), w AS (SELECT k, n, lo + (unnest(range(0, bins)) + 0.5) * ((hi - lo) / bins) AS start FROM b),
c AS (SELECT w.k, w.start, any_value(w.n) AS n, count(*) AS c FROM w JOIN r ON r.k = w.k AND r.v >= w.start AND r.v <= w.start + 25 GROUP BY w.k, w.start)
SELECT k, c AS numerator, round(start, 6) AS window_start, round(c / n, 6) AS efficiency FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, start) = 1""")
def window_efficiency(spark, sf) -> DataFrame:
    own = ad.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_partkey") % 997 + F.col("l_quantity") / 100).alias("v"))
    out = timing.window_efficiency(own, "v", own.groupBy("k").agg(F.count("*").alias("denominator")), 25.0, 5.3, ["k"])
    return out.select("k", "numerator", *r6("window_start", "efficiency"))


@query()
def time_walk(spark, sf) -> DataFrame:
    own = ad.hits(spark, sf).withColumn("res", F.col("time") - F.col("amp") * 0.05)
    w = timing.time_walk(own, "amp", "res")
    rows = [("lineitem", 0, w["entries"], w["low"], w["high"], w["parameter"])] if w else []
    return spark.createDataFrame(rows, "source string, det int, entries long, amp_low double, amp_high double, parameter array<double>")


@query(f"""WITH {ad.HITS}, x AS (SELECT entry, det, time - (1 + greatest(least(amp, 40), 10) * (0.5 + greatest(least(amp, 40), 10) * (0.01 + greatest(least(amp, 40), 10) * 0.001))) AS t FROM h WHERE plane = 0)
SELECT entry, det, {s6("min(t)")} AS t FROM x GROUP BY entry, det""")
def corrected_times(spark, sf) -> DataFrame:
    walk = {"low": 10.0, "high": 40.0, "parameter": [1.0, 0.5, 0.01, 0.001]}
    return timing.corrected_times(ad.hits(spark, sf), ["entry", "det"], walk, "XMin").where("t IS NOT NULL").select("entry", "det", *r6("t"))


@query(f"""WITH {ad.HITS}, o AS (SELECT entry, det, avg(time) AS t FROM h WHERE det < 3 GROUP BY entry, det),
w AS (SELECT entry, max(CASE WHEN det = 0 THEN t END) AS a, max(CASE WHEN det = 1 THEN t END) AS b, max(CASE WHEN det = 2 THEN t END) AS c FROM o GROUP BY entry HAVING count(*) = 3),
r AS (SELECT 12 AS det, a - b AS res FROM w UNION ALL SELECT 13, a - c FROM w UNION ALL SELECT 23, b - c FROM w),
{HISTOGRAM.replace("h AS MATERIALIZED", "hg AS MATERIALIZED")}, {_newton().replace("FROM h ", "FROM hg ").replace("h.det", "hg.det")},
s AS (SELECT max(CASE WHEN det = 12 THEN s END) ^ 2 AS a, max(CASE WHEN det = 13 THEN s END) ^ 2 AS b, max(CASE WHEN det = 23 THEN s END) ^ 2 AS c FROM p25)
SELECT round(1 / sqrt(2 / (a + b - c) + 2 / (a + c - b) + 2 / (b + c - a)), 3) AS resolution, round((a + b - c) / 2, 3) AS v1, round((a + c - b) / 2, 3) AS v2, round((b + c - a) / 2, 3) AS v3 FROM s""")
def resolution_fit(spark, sf) -> DataFrame:
    """Three detectors' variances from fitted widths of their differences; the SQL solves the fits' least squares by itself."""
    t = ad.hits(spark, sf).where("det < 3").groupBy("entry", "det").agg(F.avg("time").alias("t")).withColumn("track_index", F.lit(0))
    h = timing.resolution_by_hat(t, (0, 1, 2))
    return spark.createDataFrame([tuple(round(float(v), 3) for v in (h["resolution"], *h["variances"]))], "resolution double, v1 double, v2 double, v3 double")


@query("""WITH r AS (SELECT l_returnflag AS k, l_quantity AS a, l_partkey % 101 AS r FROM lineitem), x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a) - 1 AS ra, row_number() OVER (PARTITION BY k ORDER BY r) - 1 AS rr, count(*) OVER (PARTITION BY k) AS n FROM r),
s AS (SELECT k, max(CASE WHEN ra = CAST(floor(0.005::DOUBLE * (n - 1)) AS BIGINT) THEN a END) AS a0, max(CASE WHEN ra = CAST(floor(0.995::DOUBLE * (n - 1)) AS BIGINT) THEN a END) AS a1,
  max(CASE WHEN rr = CAST(floor(0.005::DOUBLE * (n - 1)) AS BIGINT) THEN r END) AS r0, max(CASE WHEN rr = CAST(floor(0.995::DOUBLE * (n - 1)) AS BIGINT) THEN r END) AS r1 FROM x GROUP BY k)
SELECT r.k, CAST(least(floor((a - a0) / (a1 - a0) * 20) + 1, 20) AS INTEGER) AS bin_x, count(*) AS count, round(avg(r), 6) AS mean FROM r JOIN s ON r.k = s.k WHERE a BETWEEN a0 AND a1 AND r BETWEEN r0 AND r1 GROUP BY 1, 2""")
def time_amplitude_map(spark, sf) -> DataFrame:
    own = ad.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("a"), (F.col("l_partkey") % 101).cast("double").alias("r"))
    return timing.amplitude_map(own, ["k"], "a", "r")[1].select("k", "bin_x", "count", *r6("mean"))


@query("""WITH r AS (SELECT CAST(l_suppkey % 4 AS INTEGER) AS det, abs(l_quantity - 25) AS a FROM lineitem), x AS (SELECT *, row_number() OVER (PARTITION BY det ORDER BY a) - 1 AS k, count(*) OVER (PARTITION BY det) AS n FROM r)
SELECT det, round(least(greatest(max(CASE WHEN k = least(n - 1, CAST(floor(0.99::DOUBLE * n) AS BIGINT)) THEN a END) * 1.2::DOUBLE, 1), 100), 6) AS half_width FROM x GROUP BY det""")
def residual_range(spark, sf) -> DataFrame:
    li = ad.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("det"), (F.col("l_quantity") - 25).alias("res_x"))
    return efficiency.residual_range(li, "x").select("det", *r6("half_width"))
