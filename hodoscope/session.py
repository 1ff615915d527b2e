"""Session settings the engine is written for; callers may bring their own session instead."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Times are plain numbers (ns or s); only the adapters of driver tables look at timestamps, in UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; spark_driver_memory="8g" stands for spark.driver.memory."""
    builder = SparkSession.builder.appName("hodoscope")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
