"""Queries: event building, channel maps and counters over the event stream; histograms and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.config import EventBuilderConfig
from hodoscope.functions import columns
from hodoscope.operators import events as ev, timing
from hodoscope.plans import adapters as ad
from hodoscope.plans.catalog import query
from hodoscope.plans.catalog_detector import r6, s6
from hodoscope.sources import bt, canonical

C = EventBuilderConfig(trigger_detector=1, trigger_channels=(1, 5), time_offsets_ns=(0.0, -2.0), trigger_threshold=5, coincidence_window_ns=3600.0, dead_time_ns=7200.0, window_offset_ns=10.0, before_ns=600.0, after_ns=300.0, hit_threshold=3, detectors=(0, 2, 3))


def _geometry(spark) -> DataFrame:
    k = F.col("id")
    return spark.range(0, 64 * 15).select((k % 4).cast("int").alias("det"), (k % 2).cast("int").alias("plane"), (k % 3).cast("int").alias("fec"), (k % 5).cast("int").alias("vmm"), (k % 64).cast("int").alias("ch"), (k % 100 - 3).cast("int").alias("id0"), F.lit(-1).alias("id1")).dropDuplicates(["det", "fec", "vmm", "ch"])


GEOMETRY = """geo AS (SELECT CAST(k % 4 AS INTEGER) AS det, CAST(k % 2 AS INTEGER) AS plane, CAST(k % 3 AS INTEGER) AS fec, CAST(k % 5 AS INTEGER) AS vmm, CAST(k % 64 AS INTEGER) AS ch, CAST(k % 100 - 3 AS INTEGER) AS id0 FROM range(0, 960) r(k))"""


def _candidates(spark, sf) -> DataFrame:
    return ev.trigger_candidates(ad.stream(spark, sf), C)


@query(f"""WITH {ad.STREAM} SELECT run, CASE WHEN ch = 1 THEN 0 ELSE 1 END AS side, time + CASE WHEN ch = 1 THEN 0 ELSE -2 END AS t, id FROM s WHERE det = 1 AND adc > 5 AND ch IN (1, 5)""")
def trigger_candidates(spark, sf) -> DataFrame:
    return _candidates(spark, sf)


WALK = """c AS (SELECT run, CASE WHEN ch = 1 THEN 0 ELSE 1 END AS side, time + CASE WHEN ch = 1 THEN 0 ELSE -2 END AS t, id FROM s WHERE det = 1 AND adc > 5 AND ch IN (1, 5)),
o AS (SELECT *, row_number() OVER (PARTITION BY run, side ORDER BY t, id) AS k FROM c),
w AS (SELECT DISTINCT run, 1::BIGINT AS i, 1::BIGINT AS j, '-inf'::DOUBLE AS last, NULL::DOUBLE AS t, NULL::BIGINT AS id_a, NULL::BIGINT AS id_b FROM c
  UNION ALL
  SELECT w.run, w.i + CASE WHEN abs(a.t - b.t) <= 3600 OR a.t < b.t THEN 1 ELSE 0 END, w.j + CASE WHEN abs(a.t - b.t) <= 3600 OR a.t >= b.t THEN 1 ELSE 0 END,
    CASE WHEN abs(a.t - b.t) <= 3600 AND (a.t + b.t) / 2 - w.last >= 7200 THEN (a.t + b.t) / 2 ELSE w.last END,
    CASE WHEN abs(a.t - b.t) <= 3600 AND (a.t + b.t) / 2 - w.last >= 7200 THEN (a.t + b.t) / 2 END, a.id, b.id
  FROM w JOIN o a ON a.run = w.run AND a.side = 0 AND a.k = w.i JOIN o b ON b.run = w.run AND b.side = 1 AND b.k = w.j)"""


@query(f"WITH RECURSIVE {ad.STREAM}, {WALK} SELECT run, t, id_a, id_b, CAST(row_number() OVER (PARTITION BY run ORDER BY t) - 1 AS INTEGER) AS trigger FROM w WHERE t IS NOT NULL")
def trigger_coincidence(spark, sf) -> DataFrame:
    return ev.coincidences(_candidates(spark, sf), C.coincidence_window_ns, C.dead_time_ns)


@query(f"""WITH {ad.STREAM}, {GEOMETRY} SELECT s.run, s.id, s.det, geo.plane, geo.plane <> s.plane AS relabelled, geo.id0 FROM s JOIN geo ON s.det = geo.det AND s.fec = geo.fec AND s.vmm = geo.vmm AND s.ch = geo.ch
WHERE s.det IN (0, 2, 3) AND s.adc >= 3 AND s.ch < 64 AND geo.id0 >= 0""")
def hit_selection(spark, sf) -> DataFrame:
    return ev.select_hits(ad.stream(spark, sf), _geometry(spark), C)[0].select("run", "id", "det", "plane", "relabelled", "id0")


@query(f"""WITH {ad.STREAM}, {GEOMETRY} SELECT s.run, s.det, count(*) AS unmapped FROM s LEFT JOIN geo ON s.det = geo.det AND s.fec = geo.fec AND s.vmm = geo.vmm AND s.ch = geo.ch
WHERE s.det IN (0, 2, 3) AND s.adc >= 3 AND s.ch < 64 AND (geo.det IS NULL OR geo.id0 < 0) GROUP BY s.run, s.det""")
def unmapped_hits(spark, sf) -> DataFrame:
    return ev.select_hits(ad.stream(spark, sf), _geometry(spark), C)[1]


@query(f"""WITH {ad.STREAM}, {GEOMETRY} SELECT DISTINCT s.det, geo.plane, geo.id0, s.fec AS board_id, s.vmm AS chip_id, s.ch AS channel_id FROM s JOIN geo ON s.det = geo.det AND s.fec = geo.fec AND s.vmm = geo.vmm AND s.ch = geo.ch
WHERE s.det IN (0, 2, 3) AND s.adc >= 3 AND s.ch < 64 AND geo.id0 >= 0""")
def observed_channels(spark, sf) -> DataFrame:
    return ev.observed_channels(ev.select_hits(ad.stream(spark, sf), _geometry(spark), C)[0]).select("det", "plane", "id0", "board_id", "chip_id", "channel_id")


@query(f"""WITH {ad.STREAM}, t AS (SELECT run, id AS trigger, time AS t FROM s WHERE det = 1 AND adc > 20)
SELECT t.run, t.trigger, coalesce(h.id, -1) AS id, h.time - t.t AS hit_time_ns FROM t LEFT JOIN (SELECT * FROM s WHERE det <> 1) h ON h.run = t.run AND h.time >= t.t + 10 - 600 AND h.time < t.t + 10 + 300""")
def event_window_hits(spark, sf) -> DataFrame:
    s = ad.stream(spark, sf)
    triggers = s.where("det = 1 AND adc > 20").select("run", F.col("id").alias("trigger"), F.col("time").alias("t"))
    return ev.event_window(triggers, s.where("det <> 1"), C).select("run", "trigger", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), "hit_time_ns")


@query(f"""WITH {ad.STREAM}, t AS (SELECT run, id AS trigger, time AS t FROM s WHERE det = 1 AND adc > 20),
w AS (SELECT t.run, t.trigger, h.id FROM t LEFT JOIN (SELECT * FROM s WHERE det <> 1) h ON h.run = t.run AND h.time >= t.t + 10 - 600 AND h.time < t.t + 10 + 300)
SELECT CAST(row_number() OVER (PARTITION BY run ORDER BY trigger) - 1 AS BIGINT) AS entry, trigger AS evt, count(id) AS hits, coalesce(sum(id), 0)::BIGINT AS ids FROM w GROUP BY run, trigger""")
def nested_events(spark, sf) -> DataFrame:
    s = ad.stream(spark, sf)
    triggers = s.where("det = 1 AND adc > 20").select("run", F.col("id").alias("trigger"), F.col("time").alias("t"))
    rest = s.where("det <> 1").withColumns({"id0": F.col("ch"), "id1": F.lit(-1)})
    own = ev.nested_events(triggers, rest, C)
    return own.select("entry", "evt", F.size("rawhitid").cast("long").alias("hits"), F.aggregate("rawhitid", F.lit(0).cast("long"), lambda a, v: a + v).alias("ids"))


@query("""SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS entry, event_id AS raw_event_id FROM events""")
def entry_numbers(spark, sf) -> DataFrame:
    own = ad.table(spark, sf, "events").select(F.col("event_id").alias("raw_event_id"), "ts")
    return canonical.with_entry(own, ["ts", "raw_event_id"]).select("entry", "raw_event_id")


COUNTER = "event_id * 7919 % 65536"


@query(f"""WITH e AS (SELECT event_id, CAST({COUNTER} AS BIGINT) AS c FROM events), w AS (SELECT *, lag(c) OVER (ORDER BY event_id) AS before FROM e)
SELECT event_id, CAST(c + 65536 * sum(CASE WHEN before > 61440 AND c < 4096 THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS extended FROM w""")
def counter_unwrap(spark, sf) -> DataFrame:
    e = ad.table(spark, sf, "events").select("event_id", F.expr(COUNTER).cast("long").alias("c"))
    return bt.unwrap(e, "event_id", "c").select("event_id", "extended")


def _blocks(spark, sf) -> DataFrame:
    e, k = ad.table(spark, sf, "embeddings"), F.col("vec_id")
    return e.select(F.lit("f").alias("path"), k.alias("block"), F.floor(k / 4).alias("ext_event"), F.floor(k / 4).alias("event_id"), k.alias("timestamp"), (k % 2).cast("int").alias("board_id"), (F.floor(k / 2) % 4).cast("int").alias("chip_id"), (k % 11).cast("int").alias("channel_id"), F.lit(0).alias("pos"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("short")).alias("waveform"))


def _map(spark) -> DataFrame:
    k = F.col("id")
    return spark.range(60).select((k % 2).cast("int").alias("board_id"), (F.floor(k / 2) % 4).cast("int").alias("chip_id"), (k % 11).cast("int").alias("channel_id"), (k % 4).cast("int").alias("detector_id"), (k % 2).cast("int").alias("plane_type"), k.cast("int").alias("strip_id"), F.lit(0.0).alias("pedestal"), F.lit(-1.0).alias("noise_sigma"), F.lit(1.0).alias("gain"), F.lit(1).alias("polarity"), F.lit(0).cast("long").alias("status"))


BLOCKS = """b AS (SELECT vec_id AS block, CAST(vec_id % 2 AS INTEGER) AS board_id, CAST((vec_id // 2) % 4 AS INTEGER) AS chip_id, CAST(vec_id % 11 AS INTEGER) AS channel_id,
  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS INTEGER)) AS waveform FROM embeddings),
m AS (SELECT CAST(k % 2 AS INTEGER) AS board_id, CAST((k // 2) % 4 AS INTEGER) AS chip_id, CAST(k % 11 AS INTEGER) AS channel_id, CAST(k % 4 AS INTEGER) AS detector_id, CAST(k AS INTEGER) AS strip_id FROM range(60) r(k))"""


@query(f"""WITH {BLOCKS} SELECT block, coalesce(detector_id, -1) AS detector_id, coalesce(strip_id, -1) AS strip_id, CASE WHEN strip_id IS NULL THEN 2147483648 ELSE 0 END AS channel_flags
FROM b LEFT JOIN m ON b.board_id = m.board_id AND b.chip_id = m.chip_id AND b.channel_id = m.channel_id""")
def channel_map_join(spark, sf) -> DataFrame:
    return bt.map_channels(_blocks(spark, sf), _map(spark)).select("block", "detector_id", "strip_id", "channel_flags")


@query(f"""WITH {BLOCKS}, x AS (SELECT board_id, chip_id, channel_id, unnest(waveform) AS s FROM b)
SELECT board_id, chip_id, channel_id, {s6("avg(s)")} AS pedestal, round(coalesce(stddev_samp(s), 0), 6) AS noise_sigma, count(*) AS samples FROM x GROUP BY board_id, chip_id, channel_id""")
def pedestal_stats(spark, sf) -> DataFrame:
    return bt.pedestal_stats(_blocks(spark, sf)).select("board_id", "chip_id", "channel_id", *r6("pedestal", "noise_sigma"), "samples")


@query(f"""WITH {BLOCKS}, x AS (SELECT board_id, chip_id, channel_id FROM b GROUP BY ALL HAVING sum(len(waveform)) >= 400)
SELECT m.strip_id FROM m ANTI JOIN x ON m.board_id = x.board_id AND m.chip_id = x.chip_id AND m.channel_id = x.channel_id""")
def missing_pedestals(spark, sf) -> DataFrame:
    return bt.without_pedestal(_map(spark), bt.pedestal_stats(_blocks(spark, sf)), 400).select("strip_id")


@query(f"""WITH {BLOCKS} SELECT b.board_id, b.chip_id, b.channel_id, count(*) AS count FROM b ANTI JOIN m ON b.board_id = m.board_id AND b.chip_id = m.chip_id AND b.channel_id = m.channel_id GROUP BY ALL""")
def unmapped_addresses(spark, sf) -> DataFrame:
    return bt.unmapped(bt.map_channels(_blocks(spark, sf), _map(spark)))


# --- order statistics and histograms -------------------------------------------------------------------------------------


def _q(rule: str, f: float) -> str:
    at = {"floor_fn": f"least(n - 1, CAST(floor({f}::DOUBLE * n) AS BIGINT))", "floor_fn1": f"CAST(floor({f}::DOUBLE * (n - 1)) AS BIGINT)", "round_fn1": f"CAST(round({f}::DOUBLE * (n - 1)) AS BIGINT)", "upper_median": "n // 2"}[rule]
    return f"SELECT '{rule}' AS rule, l_returnflag, l_quantity * 100000 + l_partkey AS q FROM (SELECT *, {at} AS k FROM r) WHERE rn = k"


@query(f"""WITH r AS (SELECT l_returnflag, l_quantity, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity * 100000 + l_partkey) - 1 AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
{_q("floor_fn", 0.05)} UNION ALL {_q("floor_fn1", 0.995)} UNION ALL {_q("round_fn1", 0.16)} UNION ALL {_q("upper_median", 0.5)}
UNION ALL SELECT 'median', l_returnflag, median(l_quantity * 100000 + l_partkey) FROM lineitem GROUP BY l_returnflag""")
def quantile_rules(spark, sf) -> DataFrame:
    li = ad.table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") * 100000 + F.col("l_partkey")).alias("v"))
    rules = {"floor_fn": 0.05, "floor_fn1": 0.995, "round_fn1": 0.16, "upper_median": 0.5, "median": 0.5}
    wide = columns.group_quantiles(li, ["l_returnflag"], "v", {rule: (f, rule) for rule, f in rules.items()})
    return wide.unpivot(["l_returnflag"], list(rules), "rule", "q")


@query("""SELECT l_returnflag, CAST(CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity >= 45 THEN 21 ELSE floor((l_quantity - 5) / 40.0::DOUBLE * 20) + 1 END AS INTEGER) AS bin, count(*) AS count FROM lineitem GROUP BY ALL""")
def histogram_1d(spark, sf) -> DataFrame:
    return columns.histogram(ad.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", 5, 45, 20)


H2 = """SELECT CAST(CASE WHEN l_quantity >= 50 THEN 11 ELSE floor(l_quantity / 50.0::DOUBLE * 10) + 1 END AS INTEGER) AS bin_x,
  CAST(CASE WHEN l_discount >= 0.1 THEN 6 ELSE floor(l_discount / 0.1::DOUBLE * 5) + 1 END AS INTEGER) AS bin_y, count(*) AS count FROM lineitem GROUP BY ALL"""


@query(H2)
def histogram_2d(spark, sf) -> DataFrame:
    return columns.histogram2d(ad.table(spark, sf, "lineitem"), [], "l_quantity", "l_discount", (0, 50, 10), (0, 0.1, 5))


@query(f"WITH h AS ({H2}) SELECT bin_y, CAST(sum(count) AS BIGINT) AS count FROM h GROUP BY bin_y")
def histogram_projection(spark, sf) -> DataFrame:
    return columns.projection(histogram_2d(spark, sf), [], "bin_y")


@query(f"""WITH b AS (SELECT CAST(floor(l_quantity / 50.0::DOUBLE * 10) + 1 AS INTEGER) AS bin, l_tax * 100 AS y FROM lineitem WHERE l_quantity < 50)
SELECT bin, count(*) AS count, {s6("avg(y)")} AS mean, round(stddev_pop(y) / sqrt(count(*)), 6) AS error FROM b WHERE y BETWEEN 1 AND 7 GROUP BY bin""")
def profile(spark, sf) -> DataFrame:
    li = ad.table(spark, sf, "lineitem").withColumn("y", F.col("l_tax") * 100)
    return columns.profile(li, [], "l_quantity", "y", (0, 50, 10), (1, 7)).select("bin", "count", *r6("mean", "error"))


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(CASE WHEN rn = CAST(floor(0.005::DOUBLE * (n - 1)) AS BIGINT) THEN v END) AS low, max(CASE WHEN rn = CAST(floor(0.995::DOUBLE * (n - 1)) AS BIGINT) THEN v END) AS high FROM r GROUP BY l_returnflag""")
def robust_range(spark, sf) -> DataFrame:
    return timing.robust_range(ad.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("SELECT l_returnflag, round(sum(CASE WHEN abs(l_quantity - 25) <= 10 THEN (l_quantity - 25) ^ 2 / 2 ELSE 10 * (abs(l_quantity - 25) - 5) END), 3) AS loss FROM lineitem GROUP BY l_returnflag")
def huber_loss(spark, sf) -> DataFrame:
    return ad.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(columns.huber(F.col("l_quantity") - 25, 10)), 3).alias("loss"))


@query("SELECT 0 AS side, count(*) AS hits, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS minute FROM events GROUP BY ALL")
def minute_rates(spark, sf) -> DataFrame:
    e = ad.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("hits")).select(F.lit(0).alias("side"), "hits", F.floor(F.unix_micros("w.start") / 60_000_000).alias("minute"))
