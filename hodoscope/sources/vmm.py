"""Digitised hits with times, built into triggered events: canonical version 3."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hodoscope.config import EventBuilderConfig
from hodoscope.operators import events as ev
from hodoscope.sources.apv import explode_geometry

CHANNELS_PER_CHIP = 64


def discover(base: str, run_id: str, pattern: str = "run{run_id}_", geometry: str = "vmm_geometry.json") -> tuple[str, str]:
    """(hit table, geometry file); the geometry may also lie in the raw folder."""
    found = Path(base, geometry)
    return f"{base}/raw/{pattern.replace('{run_id}', run_id)}", str(found if found.exists() else Path(base, "raw", geometry))


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """(det, plane, fec, vmm, ch, id0, id1, is_pad); (detector, fec, vmm) must be unique and ids complete."""
    entry = "struct<detector:int,plane:int,fec:int,vmm:int,id0:array<int>,id1:array<int>>"
    chips = spark.read.schema(f"vmm_geometry array<{entry}>").option("multiLine", True).json(path).select(F.inline("vmm_geometry")).withColumnRenamed("detector", "det")
    n = chips.agg(F.count("*").alias("n"), F.count_distinct("det", "fec", "vmm").alias("d"), F.count_if(F.coalesce(F.size("id0"), F.lit(0)) != CHANNELS_PER_CHIP).alias("short")).first()
    if not n["n"] or n["n"] != n["d"] or n["short"]:
        raise ValueError(f"{path}: needs unique (detector, fec, vmm) with {CHANNELS_PER_CHIP} ids each")
    return explode_geometry(chips, ["det", "plane", "fec", "vmm"])


def read_hits(spark: SparkSession, path: str, time: str = "time", run: int = 0) -> DataFrame:
    """Hits of a run with only the columns used; the time column may have another name."""
    return spark.read.parquet(path).select(F.lit(run).cast("long").alias("run"), "id", "det", "plane", "fec", "vmm", "ch", "adc", F.col(time).alias("time"))


def convert(hits: DataFrame, geometry: DataFrame, c: EventBuilderConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, channels, unmapped counts): coincidence triggers, their windows, and the channels met."""
    triggers = ev.coincidences(ev.trigger_candidates(hits, c), c.coincidence_window_ns, c.dead_time_ns)
    mapped, lost = ev.select_hits(hits, geometry, c)
    return ev.nested_events(triggers, mapped, c), ev.observed_channels(mapped), lost


def conversion_report(mapped: DataFrame, lost: DataFrame, n_events: int) -> DataFrame:
    """(det, plane, hits, relabelled, mean_multiplicity), and unmapped hits per detector with a null plane."""
    own = mapped.groupBy("det", "plane").agg(F.count("*").alias("hits"), F.count_if("relabelled").alias("relabelled"))
    own = own.withColumns({"mean_multiplicity": F.col("hits") / max(n_events, 1), "unmapped": F.lit(None).cast("long")})
    return own.unionByName(lost.select("det", F.lit(None).cast("int").alias("plane"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("relabelled"), F.lit(0.0).alias("mean_multiplicity"), "unmapped"))
