"""The canonical tables: events, channels, metadata; version dispatch, calibration, and the reader's hit chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hodoscope.operators.hits import read_hits
from hodoscope.schemas import schema

#: Array columns of each readable version, by hit-level name.
VERSIONS = {
    2: {"det": "detector_id", "plane": "plane_type", "id0": "id0", "id1": "id1", "chip": "chip_id", "channel": "channel_id", "adc": "waveform"},
    3: {"det": "det", "plane": "plane", "id0": "id0", "id1": "id1", "chip": "chip", "channel": "channel", "adc_value": "adc", "hit_time_ns": "hit_time_ns"},
}


class CanonicalRun:
    """A converted run: its tables, with the schema version checked on opening."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.schema(schema("METADATA")).parquet(f"{path}/metadata").select("schema_version").distinct().collect()
        if len(meta) != 1 or meta[0][0] not in VERSIONS:
            raise ValueError(f"{path}: schema version must be one of {sorted(VERSIONS)}, found {[m[0] for m in meta]}")
        self.version = meta[0][0]
        self.events = spark.read.parquet(f"{path}/events")
        missing = {"entry", *VERSIONS[self.version].values()} - set(self.events.columns)
        if missing:
            raise ValueError(f"{path}: events lack {', '.join(sorted(missing))}")
        self.channels = calibration(spark.read.parquet(f"{path}/channels"))

    @property
    def raw_ids(self) -> DataFrame:
        """(entry, raw_event_id): an event is its row number; the stored id is another thing."""
        return self.events.select("entry", F.col("event_id" if self.version == 2 else "evt").alias("raw_event_id"))

    def hits(self, detectors: DataFrame | None = None) -> DataFrame:
        """Calibrated hits of all events; waveform versions are zero-suppressed."""
        return read_hits(self.events, self.channels, VERSIONS[self.version], detectors, waveforms=self.version == 2)

    def event(self, entry: int, detectors: DataFrame | None = None) -> DataFrame:
        """One event's hits; the filter reaches the scan."""
        rows = self.events.where(F.col("entry") == entry)
        return read_hits(rows, self.channels, VERSIONS[self.version], detectors, waveforms=self.version == 2)

    def sigma(self, keys: DataFrame) -> DataFrame:
        """keys (det, plane, id0, id1) with their noise, -1 where it is unknown."""
        known = self.channels.select("det", "plane", "id0", "id1", F.col("noise_sigma").alias("sigma"))
        return keys.join(F.broadcast(known), ["det", "plane", "id0", "id1"], "left").withColumn("sigma", F.coalesce("sigma", F.lit(-1.0)))


def calibration(channels: DataFrame) -> DataFrame:
    """One row per channel: the last of duplicates, optional columns defaulted, noise only where it is not negative."""
    rename = {"detector_id": "det", "plane_type": "plane"}
    own = channels.withColumnsRenamed({k: v for k, v in rename.items() if k in channels.columns})
    for name, value in (("pedestal", 0.0), ("noise_sigma", -1.0), ("gain", 1.0), ("polarity", 1), ("id1", -1), ("row", 0)):
        if name not in own.columns:
            own = own.withColumn(name, F.lit(value))
    fields = F.struct("pedestal", "noise_sigma", "gain", "polarity")
    last = own.groupBy("det", "plane", "id0", "id1").agg(F.max_by(fields, "row").alias("f"), F.max_by("noise_sigma", F.when(F.col("noise_sigma") >= 0, F.col("row"))).alias("s"))
    return last.select("det", "plane", "id0", "id1", F.coalesce("f.pedestal", F.lit(0.0)).alias("pedestal"), F.when(F.col("s") >= 0, F.col("s")).otherwise(-1.0).alias("noise_sigma"), F.coalesce("f.gain", F.lit(1.0)).alias("gain"), F.coalesce("f.polarity", F.lit(1)).alias("polarity"))


def channel_rows(events: DataFrame, version: int) -> DataFrame:
    """(entry, det, plane, id0, id1, adc): every channel of every event as read out; a scalar reading is a wave of one sample."""
    names = ("detector_id", "plane_type", "id0", "id1", "waveform") if version == 2 else ("det", "plane", "id0", "id1", "adc")
    flat = events.select("entry", F.inline(F.arrays_zip(*names)))
    wave = F.col("waveform") if version == 2 else F.array(F.col("adc"))
    return flat.select("entry", F.col(names[0]).alias("det"), F.col(names[1]).alias("plane"), "id0", "id1", wave.alias("adc"))


def field(name: str):
    """x -> x[name], for transform(); a default argument there would be taken for the position."""
    return lambda x: x[name]


def with_entry(events: DataFrame, order: list[str]) -> DataFrame:
    """events with entry, their row number in `order`.

    Numbers come from a range sort and per-partition counts, so no task holds all rows.
    """
    parts = events.sort(*order).withColumn("__p", F.spark_partition_id()).persist()
    sizes = [(r["__p"], r["n"]) for r in parts.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect()]  # a row a partition
    start, at = [], 0
    for p, n in sizes:
        start.append((p, at))
        at += n
    base = F.create_map(*[F.lit(v) for pair in start for v in pair]) if start else F.create_map(F.lit(0), F.lit(0))
    w = Window.partitionBy("__p").orderBy(*order)
    return parts.withColumn("entry", (F.row_number().over(w) - 1 + F.element_at(base, F.col("__p"))).cast("long")).drop("__p")


def write_run(path: str, events: DataFrame, channels: DataFrame, metadata: dict, overwrite: bool = True) -> None:
    """The three canonical tables, each in its folder."""
    spark = events.sparkSession
    mode = "overwrite" if overwrite else "error"
    events.write.mode(mode).parquet(f"{path}/events")
    channels.write.mode(mode).parquet(f"{path}/channels")
    row = [(metadata["schema_version"], metadata.get("source_format"), metadata.get("converter_version"), metadata.get("geometry_source"))]
    spark.createDataFrame(row, schema("METADATA")).write.mode(mode).parquet(f"{path}/metadata")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a converted run is there: its metadata table, which is written last."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def convert_or_reuse(spark: SparkSession, path: str, convert, overwrite: bool = False) -> CanonicalRun:
    """The run at path; converted first if it is not there or is to be overwritten."""
    if overwrite or not exists(spark, path):
        convert(path)
    return CanonicalRun(spark, path)
