"""Driver tables seen as detector tables: each a DataFrame and the SQL of the same rows. Whole numbers first, so both agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows that one task sorts and groups; a table of more than so many a shuffle partition is dealt to more partitions.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, key: Column) -> DataFrame:
    """rows by key in as many partitions as keep a task's rows at about TASK_ROWS, however large the table; small tables as they are."""
    parts = -(-rows.count() // TASK_ROWS)  # of a Parquet table from its footers
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def hits(spark: SparkSession, sf: str, bits: int = 4) -> DataFrame:
    """lineitem as channel hits: 2**bits orders an event, 4 detectors (3 is the DUT) of 2 planes with 64 strips."""
    li = dealt(table(spark, sf, "lineitem"), F.shiftright("l_orderkey", bits))
    w = Window.partitionBy(F.shiftright("l_orderkey", bits)).orderBy("l_orderkey", *ROW.split(", "))
    return li.select(
        F.shiftright("l_orderkey", bits).alias("entry"), (F.col("l_suppkey") % 4).cast("int").alias("det"), (F.col("l_linenumber") % 2).cast("int").alias("plane"),
        (F.col("l_partkey") % 64).cast("int").alias("id0"), F.lit(-1).alias("id1"), (F.row_number().over(w) - 1).cast("int").alias("raw_idx"),
        F.col("l_quantity").alias("amp"), F.round(F.col("l_extendedprice")).alias("charge"), F.round(F.col("l_discount") * 100).alias("time"), (F.round(F.col("l_tax") * 100) + 1).alias("time_error"),
        F.lit(False).alias("is_saturated"), (F.col("l_quantity") >= 5).alias("is_valid"),
    )


HITS = f"""h AS (SELECT l_orderkey >> 4 AS entry, CAST(l_suppkey % 4 AS INTEGER) AS det, CAST(l_linenumber % 2 AS INTEGER) AS plane,
  CAST(l_partkey % 64 AS INTEGER) AS id0, CAST(-1 AS INTEGER) AS id1,
  CAST(row_number() OVER (PARTITION BY l_orderkey >> 4 ORDER BY l_orderkey, {ROW}) - 1 AS INTEGER) AS raw_idx,
  l_quantity AS amp, round(l_extendedprice) AS charge, round(l_discount * 100) AS time, round(l_tax * 100) + 1 AS time_error,
  l_quantity >= 5 AS is_valid FROM lineitem)"""


def by_order(sql: str) -> str:
    """The same SQL where each order is an event, of hits and of tracks."""
    return sql.replace("l_orderkey >> 4", "l_orderkey").replace("o_orderkey >> 1", "o_orderkey").replace("CAST(o_orderkey % 2 AS INTEGER)", "CAST(0 AS INTEGER)")


def pad_hits(spark: SparkSession, sf: str, bits: int = 4) -> DataFrame:
    """lineitem as pad hits: columns and rows of an 8 x 8 grid."""
    own = hits(spark, sf, bits)
    return own.select("entry", F.lit(5).alias("det"), F.lit(0).alias("plane"), (F.col("id0") % 8).alias("id0"), F.floor(F.col("id0") / 8).cast("int").alias("id1"), "raw_idx", "amp", "charge", "time", "time_error", "is_saturated", (F.col("amp") >= 40).alias("is_valid"))


PAD_HITS = HITS + """, p AS (SELECT entry, id0 % 8 AS id0, CAST(id0 // 8 AS INTEGER) AS id1, raw_idx, amp, charge, time FROM h WHERE amp >= 40)"""


def channels(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration per strip of 4 x 2 x 64, from supplier numbers; half the channels have none."""
    s = table(spark, sf, "supplier").where("s_suppkey <= 512 AND s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"))
    return s.select((F.col("k") % 4).cast("int").alias("det"), (F.floor(F.col("k") / 4) % 2).cast("int").alias("plane"), (F.floor(F.col("k") / 8) % 64).cast("int").alias("id0"), F.lit(-1).alias("id1"), (F.col("k") % 5).cast("double").alias("pedestal"), (F.col("k") % 7 + 1).cast("double").alias("noise_sigma"), (1 + (F.col("k") % 3) / 4).cast("double").alias("gain"), F.when(F.col("k") % 4 == 0, -1).otherwise(1).alias("polarity"))


CHANNELS = """c AS (SELECT CAST(s_suppkey % 4 AS INTEGER) AS det, CAST((s_suppkey // 4) % 2 AS INTEGER) AS plane, CAST((s_suppkey // 8) % 64 AS INTEGER) AS id0,
  CAST(s_suppkey % 5 AS DOUBLE) AS pedestal, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS noise_sigma, 1 + (s_suppkey % 3) / 4.0::DOUBLE AS gain,
  CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE 1 END AS polarity FROM supplier WHERE s_suppkey <= 512 AND s_suppkey % 2 = 0)"""


def waves(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as waveforms of 64 samples."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("entry"), F.lit(0).alias("det"), F.lit(0).alias("plane"), (F.col("vec_id") % 64).cast("int").alias("id0"), F.lit(-1).alias("id1"), F.lit(0).alias("raw_idx"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 2000).cast("short")).alias("adc"), F.lit(None).cast("double").alias("adc_value"), F.lit(None).cast("double").alias("hit_time_ns"))


WAVES = """w AS (SELECT vec_id AS entry, CAST(vec_id % 64 AS INTEGER) AS id0,
  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 2000) AS INTEGER)) AS adc FROM embeddings)"""


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """events as time-ordered hits in seconds: channel by user, one run a day."""
    e = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select((us / 86_400_000_000).cast("long").alias("run"), F.col("event_id").alias("id"), (F.col("user_id") % 4).cast("int").alias("det"), (F.col("user_id") % 2).cast("int").alias("plane"), (F.col("user_id") % 3).cast("int").alias("fec"), (F.col("user_id") % 5).cast("int").alias("vmm"), (F.col("user_id") % 70).cast("int").alias("ch"), F.floor("value").cast("int").alias("adc"), F.floor(us / 1_000_000).cast("double").alias("time"))


STREAM = """s AS (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS run, event_id AS id, CAST(user_id % 4 AS INTEGER) AS det, CAST(user_id % 2 AS INTEGER) AS plane,
  CAST(user_id % 3 AS INTEGER) AS fec, CAST(user_id % 5 AS INTEGER) AS vmm, CAST(user_id % 70 AS INTEGER) AS ch, CAST(floor(value) AS INTEGER) AS adc,
  CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS time FROM events)"""

#: The set-up: three trackers, a strip DUT, a pad DUT and a cylinder.
SETUP = [
    {"id": 0, "type": "planar", "role": "tracker", "position": [0, 0, 0], "rotation": [0, 0, 0]},
    {"id": 1, "type": "planar", "role": "tracker", "position": [1, -2, 100], "rotation": [0, 0, 0.1]},
    {"id": 2, "type": "planar", "role": "tracker", "position": [-1, 1, 200], "rotation": [0.05, -0.02, 0.2]},
    {"id": 3, "type": "planar", "role": "dut", "position": [0.5, 0.5, 150], "rotation": [0.1, 0.05, 0.3], "readoutPlanes": {"0": {"angle": 0}, "1": {"angle": 45}}},
    {"id": 5, "type": "planar_pad", "role": "dut", "position": [0, 0, 150], "rotation": [0, 0, 0], "pads": {"rows": 8, "columns": 8, "pitchX": 3.0, "pitchY": 3.0, "sizeX": 2.8, "sizeY": 2.8, "planeType": 0}},
    {"id": 6, "type": "cylinder", "role": "ignored", "position": [1, 2, 120], "rotation": [0, 0, 0.4], "radius": 65.0, "readoutPlanes": {"0": {}, "1": {}}},
]


def points(spark: SparkSession, sf: str, bits: int = 4) -> DataFrame:
    """Global points of three planes: hits of detectors 0..2, z = 100 det, x and y from strip and charge."""
    own = hits(spark, sf, bits).where("det < 3 AND is_valid")
    return own.select("entry", "det", "raw_idx", (F.col("id0") * 0.4).alias("gx"), (F.pmod("charge", F.lit(97)) * 0.4).alias("gy"), (F.col("det") * 100.0).alias("gz"))


POINTS = HITS + """, g AS (SELECT entry, det, raw_idx, id0 * 0.4::DOUBLE AS gx, CAST(CAST(charge AS BIGINT) % 97 AS DOUBLE) * 0.4::DOUBLE AS gy, det * 100.0::DOUBLE AS gz FROM h WHERE det < 3 AND is_valid)"""


def lines(spark: SparkSession, sf: str, bits: int = 1) -> DataFrame:
    """orders as tracks: slopes and intercepts from keys; one track an order, events of 2**bits orders."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.shiftright(k, bits).alias("entry"), (k % 2**bits).cast("int").alias("track_index"), k.alias("raw_event_id"), ((k % 21 - 10) / 1000).alias("kx"), ((k % 17 - 8) / 1000).alias("ky"), (k % 50 / 2).cast("double").alias("bx"), (k % 46 / 2).cast("double").alias("by"), (k % 9).cast("double").alias("chi2"))


LINES = """t AS (SELECT o_orderkey >> 1 AS entry, CAST(o_orderkey % 2 AS INTEGER) AS track_index, o_orderkey AS raw_event_id, (o_orderkey % 21 - 10) / 1000.0::DOUBLE AS kx,
  (o_orderkey % 17 - 8) / 1000.0::DOUBLE AS ky, o_orderkey % 50 / 2.0::DOUBLE AS bx, o_orderkey % 46 / 2.0::DOUBLE AS "by", CAST(o_orderkey % 9 AS DOUBLE) AS chi2 FROM orders)"""
