"""Waveform readout by (chip, channel) addresses: raw rows, geometry and pedestals to canonical version 2.

Source files must have been brought to Parquet with the schemas APV_RAW and APV_PEDESTALS; the geometry is JSON.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodoscope.schemas import schema
from hodoscope.sources.canonical import field, with_entry

CHANNELS_PER_CHIP = 128


def discover(base: str, run_id: str) -> tuple[str, str]:
    """(raw table, geometry file) of a run."""
    return f"{base}/raw/run{run_id}", f"{base}/Geometry.json"


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """(chip_id, ch, det, plane, id0, id1, is_pad) from a JSON array of chips with 128 ids each; id1 marks pad chips.

    A repeated chip and an empty file are errors.
    """
    shape = "detectorId int, chipId int, planeId int, id0 array<int>, id1 array<int>"
    chips = spark.read.schema(shape).option("multiLine", True).json(path)
    bad = chips.agg(F.count("*").alias("n"), F.count_distinct("chipId").alias("d"), F.count_if(F.coalesce(F.size("id0"), F.lit(0)) != CHANNELS_PER_CHIP).alias("short")).first()
    if not bad["n"]:
        raise ValueError(f"{path}: no chips")
    if bad["d"] != bad["n"]:
        raise ValueError(f"{path}: a chip appears twice")
    if bad["short"]:
        raise ValueError(f"{path}: chips need {CHANNELS_PER_CHIP} ids")
    return explode_geometry(chips.select(F.col("chipId").alias("chip_id"), F.col("detectorId").alias("det"), F.col("planeId").alias("plane"), "id0", "id1"), ["chip_id", "det", "plane"])


def explode_geometry(chips: DataFrame, keys: list[str]) -> DataFrame:
    """A row per channel of each chip, its position being the channel; strips have id1 -1."""
    other = F.coalesce("id1", F.transform("id0", lambda x: F.lit(-1)))
    each = chips.withColumns({"is_pad": F.col("id1").isNotNull(), "id1": other}).select(*keys, "is_pad", F.posexplode(F.arrays_zip("id0", "id1")).alias("ch", "c"))
    return each.select(*keys, "ch", F.col("c.id0").alias("id0"), F.col("c.id1").alias("id1"), "is_pad")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema("APV_RAW")).parquet(path)


def convert(raw: DataFrame, geometry: DataFrame, pedestals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, channels) of version 2: one row in, one row out, in event order.

    A chip without geometry is an error, as are unequal arrays. Channels are those observed or in the pedestal table; the
    pedestal spread becomes their noise, -1 where there is none.
    """
    same = (F.size("apv_id") == F.size("apv_ch")) & (F.size("apv_id") == F.size("apv_q"))
    safe = raw.withColumn("apv_id", F.when(same, F.col("apv_id")).otherwise(F.raise_error(F.lit("unequal arrays in a raw row"))))
    safe = with_entry(safe, ["apv_evt"])
    hit = F.posexplode(F.arrays_zip(F.col("apv_id").alias("chip_id"), F.col("apv_ch").alias("ch"), F.col("apv_q").alias("waveform")))
    each = safe.select("entry", hit.alias("pos", "h")).select("entry", "pos", "h.chip_id", "h.ch", "h.waveform")
    both = each.join(F.broadcast(geometry), ["chip_id", "ch"], "left")
    checked = F.when(F.col("det").isNotNull(), F.col("det")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no geometry for chip"), F.col("chip_id"))))
    top = F.array_max("waveform")
    both = both.withColumns({"det": checked, "waveform_max": top, "peak_sample": (F.array_position("waveform", top) - 1).cast("int")})
    names = {"detector_id": "det", "plane_type": "plane", "id0": "id0", "id1": "id1", "chip_id": "chip_id", "channel_id": "ch", "waveform": "waveform", "waveform_max": "waveform_max", "peak_sample": "peak_sample"}
    own = both.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("pos", *dict.fromkeys(names.values())))).alias("h"))
    stamp = F.col("time_s") * 1_000_000 + F.col("time_us")
    head = safe.select("entry", F.col("apv_evt").alias("event_id"), F.coalesce(stamp, F.lit(0)).alias("timestamp"))
    arrays = [F.coalesce(F.transform("h", field(c)), F.array()).alias(n) for n, c in names.items()]
    events = head.join(own, "entry", "left").select("entry", "event_id", "timestamp", *arrays, F.transform(F.coalesce("h", F.array()), lambda x: F.lit(0)).alias("board_id"), F.transform(F.coalesce("h", F.array()), lambda x: F.lit(0).cast("long")).alias("channel_flags"))
    observed = both.select("chip_id", "ch", "det", "plane", "id0", "id1").distinct()
    return events, pedestal_channels(observed, geometry, pedestals)


def pedestal_channels(observed: DataFrame, geometry: DataFrame, pedestals: DataFrame | None) -> DataFrame:
    """Observed channels full-outer joined with the first row of the pedestal table."""
    known = observed
    noise = None
    if pedestals is not None:
        first = pedestals.limit(1).select(F.explode(F.arrays_zip("apv_id", "apv_ch", "apv_pedstd")).alias("p"))
        noise = first.select(F.col("p.apv_id").alias("chip_id"), F.col("p.apv_ch").alias("ch"), F.col("p.apv_pedstd").alias("noise_sigma"))
        known = observed.unionByName(noise.join(F.broadcast(geometry), ["chip_id", "ch"]).select(*observed.columns)).distinct()
        known = known.join(F.broadcast(noise), ["chip_id", "ch"], "left")
    else:
        known = known.withColumn("noise_sigma", F.lit(-1.0))
    return known.select(F.lit(0).alias("board_id"), "chip_id", F.col("ch").alias("channel_id"), "det", "plane", "id0", "id1", F.lit(0.0).alias("pedestal"), F.coalesce("noise_sigma", F.lit(-1.0)).alias("noise_sigma"), F.lit(1.0).alias("gain"), F.lit(1).alias("polarity"), F.lit(0).cast("long").alias("status"))


def discovered(base: str, run_id: str) -> bool:
    return all(Path(p).exists() for p in discover(base, run_id))
