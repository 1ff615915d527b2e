"""Oscilloscope CSV files: four channels per file index, each split into segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"C([1-4])(?:--.*--(\d+)|Trace(\d+))\.csv$"
SEGMENTS = "file_index int, channel int, segment int, t0 double, dt double, wave array<double>"


def parse(text: str) -> list[tuple[int, float, float, list[float]]]:
    """(segment, first time, sample distance, amplitudes): line 2 gives the counts, data follow a line that starts with Time,Ampl.

    Times after the second sample follow from the first two. Lines that do not parse are skipped; too few are an error.
    """
    lines = text.splitlines()
    head = lines[1].split(",") if len(lines) > 1 else []
    if len(head) < 4 or head[0].strip() != "Segments":
        raise ValueError("the second line must give the segments")
    count, size = int(head[1]), int(head[3])
    start = next((i for i, line in enumerate(lines) if line.startswith("Time,Ampl")), None)
    if start is None:
        raise ValueError("no data header")
    rows: list[tuple[float, float]] = []
    for line in lines[start + 1 :]:
        parts = line.split(",")
        try:
            rows.append((float(parts[0]), float(parts[1])))
        except (ValueError, IndexError):
            continue
    if len(rows) < count * size:
        raise ValueError(f"{len(rows)} samples where {count} x {size} are stated")
    out = []
    for s in range(count):
        own = rows[s * size : (s + 1) * size]
        step = own[1][0] - own[0][0] if size > 1 else 0.0
        out.append((s, own[0][0], step, [a for _, a in own]))
    return out


def read_segments(spark: SparkSession, directory: str, most_files: int = -1) -> DataFrame:
    """(file_index, segment, t0, dt, c1..c4) of indices that have all four channels, the lowest `most_files` of them if positive.

    A file is parsed whole, as its counts stand at its top; files are read in parallel.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "C*.csv").option("recursiveFileLookup", True).load(directory)
    index = F.coalesce(F.nullif(F.regexp_extract("path", NAME, 2), F.lit("")), F.regexp_extract("path", NAME, 3))
    named = files.where(F.col("path").rlike(NAME)).withColumns({"channel": F.regexp_extract("path", NAME, 1).cast("int"), "file_index": index.cast("int")})
    whole = named.groupBy("file_index").agg(F.count_distinct("channel").alias("n")).where("n = 4").select("file_index")
    if most_files > 0:
        whole = whole.orderBy("file_index").limit(most_files)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, c, raw in zip(frame["file_index"], frame["channel"], frame["content"]):
                yield pd.DataFrame([(i, c, *row) for row in parse(bytes(raw).decode("utf-8", "replace"))], columns=["file_index", "channel", "segment", "t0", "dt", "wave"])

    each = named.join(whole, "file_index", "left_semi").select("file_index", "channel", "content").mapInPandas(run, SEGMENTS)
    wave = lambda c: F.max_by("wave", F.when(F.col("channel") == c, 1)).alias(f"c{c}")
    wide = each.groupBy("file_index", "segment").agg(F.count_distinct("channel").alias("n"), F.min_by("t0", "channel").alias("t0"), F.min_by("dt", "channel").alias("dt"), *[wave(c) for c in (1, 2, 3, 4)])
    return wide.where("n = 4").drop("n")  # segments that all four channels have


def is_trace(name: str) -> bool:
    return re.search(NAME, name) is not None
