"""Structured Streaming forms of event building: range windows by watermarked joins, dead time as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_join(triggers: DataFrame, hits: DataFrame, before: str, after: str, late: str = "10 seconds") -> DataFrame:
    """Hits of [t - before, t + after) around each trigger of the same run; both streams carry event times (trigger_time, hit_time).

    The watermarks bound what the join must remember.
    """
    t = triggers.withWatermark("trigger_time", late)
    h = hits.withWatermark("hit_time", late).withColumnRenamed("run", "hit_run")
    near = (F.col("run") == F.col("hit_run")) & (F.col("hit_time") >= F.col("trigger_time") - F.expr(f"INTERVAL {before}")) & (F.col("hit_time") < F.col("trigger_time") + F.expr(f"INTERVAL {after}"))
    return t.join(h, near).drop("hit_run")


def dead_time(triggers: DataFrame, seconds: float, late: str = "10 seconds") -> DataFrame:
    """Triggers (run, trigger_time) at least `seconds` after the last accepted one of their run, across batches."""
    schema = triggers.select("run", "trigger_time").schema

    def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("trigger_time")
        kept = []
        for t in rows["trigger_time"]:
            now = t.value
            if last is None or now - last >= seconds * 1e9:
                kept.append(t)
                last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"run": [key[0]] * len(kept), "trigger_time": kept})

    own = triggers.select("run", "trigger_time").withWatermark("trigger_time", late)
    return own.groupBy("run").applyInPandasWithState(accept, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def rates(hits: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Hits per detector in tumbling windows."""
    return hits.withWatermark("hit_time", late).groupBy(F.window("hit_time", width), "det").agg(F.count("*").alias("hits"), F.avg("adc").alias("mean_adc"))
