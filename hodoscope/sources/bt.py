"""Binary block stream of waveform chips: decoder, channel-map CSV and conversion to canonical version 1.

Version 1 has strip_id instead of id0 and id1 and is refused by the reader; upgrade() makes version 2 of it.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hodoscope.sources.canonical import field, with_entry

#: Fixed values of the stream: big-endian 16-bit words, marks, and the flag of a channel without a map entry.
SYNC, BLOCK, UNMAPPED = 0xCACA, 0xEEEE, 0x80000000
CHANNEL = "path string, block int, ext_event long, event_id long, timestamp long, board_id int, chip_id int, channel_id int, pos int, waveform array<short>"


def signed12(words: np.ndarray) -> np.ndarray:
    """The low 12 bits as a two's complement number."""
    low = (words & 0x0FFF).astype(np.int16)
    return np.where(low >= 2048, low - 4096, low).astype(np.int16)


def decode(raw: bytes, samples: int) -> list[tuple]:
    """(block, extended event, event id, timestamp, board, chip, channel, position, waveform) of every complete block.

    Reading starts after the first sync word. A block is: mark, chip, three time words, event, channel count, three spare
    words, then per channel an id word and the samples; one byte follows a block. A block cut off at the end is dropped.
    The 16-bit event counter goes on by 65536 only where it falls from its top sixteenth to its bottom sixteenth.
    """
    at = 0
    while at + 2 <= len(raw) and int.from_bytes(raw[at : at + 2], "big") != SYNC:
        at += 2
    if at + 2 > len(raw):
        raise ValueError("no sync word")
    at += 2
    out: list[tuple] = []
    epoch, before, block = 0, None, 0
    while at + 2 <= len(raw):
        word = int.from_bytes(raw[at : at + 2], "big")
        at += 2
        if word != BLOCK:
            continue
        head = np.frombuffer(raw[at : at + 18], ">u2") if at + 18 <= len(raw) else None
        if head is None:
            break
        chip, high, low, tail, event, count = (int(v) for v in head[:6])
        size = 2 * count * (1 + samples)
        body = raw[at + 18 : at + 18 + size]
        if len(body) < size:
            break
        if before is not None and before > 0xF000 and event < 0x1000:
            epoch += 65536
        before = event
        words = np.frombuffer(body, ">u2").reshape(count, 1 + samples)
        waves = signed12(words[:, 1:])
        stamp = (high << 24) | (low << 8) | (tail >> 8 & 0xFF)
        real = chip & 0xFF
        for k in range(count):
            out.append((block, epoch + event, event, stamp, real // 4, real % 4, int(words[k, 0]) & 0xFF, k, waves[k].tolist()))
        block += 1
        at += 18 + size + 1
    if not block:
        raise ValueError("no complete block")
    return out


def discover(base: str, run_id: str) -> dict[str, str]:
    """Data, pedestal and channel-map files of a run; all three must be there."""
    found = {"data": f"{base}/raw/run{run_id}.dat", "pedestal": f"{base}/raw/run{run_id}_pedestal.dat", "map": f"{base}/maps/channel_map.csv"}
    missing = [p for p in found.values() if not Path(p).exists()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return found


def list_files(files: list[str] | None = None, directory: str | None = None) -> list[str]:
    """The .dat files of a list and a directory, sorted, each once."""
    own = [*(files or []), *([str(p) for p in Path(directory).iterdir()] if directory else [])]
    return sorted({p for p in own if p.endswith(".dat")})


def read_blocks(spark: SparkSession, paths: list[str], samples: int) -> DataFrame:
    """CHANNEL rows of binary files. A stream can't be split: a block's place follows from those before it; files run in parallel."""
    names = [f.strip().split()[0] for f in CHANNEL.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                rows = decode(bytes(raw), samples)
                for k in range(0, len(rows), 4096):
                    yield pd.DataFrame([(path, *r) for r in rows[k : k + 4096]], columns=names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, CHANNEL)


def unwrap(rows: DataFrame, order: str, counter: str, span: int = 1000) -> DataFrame:
    """rows with `extended`: the 16-bit counter plus 65536 for each time it has begun anew, along the whole numbers of order.

    A wrap is a fall from the counter's top sixteenth to its bottom sixteenth between neighbours. Neighbours are found within
    parts of `span` numbers, a part's first row looking at the end of the last part before it that has rows; counts of wraps
    are then carried over parts, within blocks of `span` parts, and over blocks: one row a part and a block at each level.
    Rows of a null order or counter take no part.
    """
    own = rows.where(F.col(order).isNotNull() & F.col(counter).isNotNull()).withColumn("__part", F.floor(F.col(order) / span))
    last = own.groupBy("__part").agg(F.max_by(counter, order).alias("__end")).withColumn("__block", F.floor(F.col("__part") / span))
    blocks = last.groupBy("__block").agg(F.max_by("__end", "__part").alias("__block_end"))
    w = Window.orderBy("__block")  # a row a block of span * span numbers
    blocks = blocks.withColumn("__before_block", F.lag("__block_end").over(w)).drop("__block_end")
    ends = last.join(blocks, "__block").withColumn("__end_before", F.coalesce(F.lag("__end").over(Window.partitionBy("__block").orderBy("__part")), F.col("__before_block")))
    w = Window.partitionBy("__part").orderBy(order)
    marked = own.join(ends.select("__part", "__end_before"), "__part").withColumn("__prev", F.coalesce(F.lag(counter).over(w), F.col("__end_before")))
    marked = marked.withColumn("__wrap", F.coalesce((F.col("__prev") > 0xF000) & (F.col(counter) < 0x1000), F.lit(False)).cast("int"))
    sums = marked.groupBy("__part").agg(F.sum("__wrap").alias("__n")).withColumn("__block", F.floor(F.col("__part") / span))
    upper = sums.groupBy("__block").agg(F.sum("__n").alias("__n_block"))
    upper = upper.withColumn("__base_block", F.coalesce(F.sum("__n_block").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("__n").over(Window.partitionBy("__block").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.join(upper.select("__block", "__base_block"), "__block").select("__part", (F.col("__base_block") + inner).alias("__base"))
    turns = F.col("__base") + F.sum("__wrap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.join(base, "__part").withColumn("extended", (F.col(counter) + 65536 * turns).cast("long")).select(*rows.columns, "extended")


MAP_COLUMNS = ["board_id", "chip_id", "channel_id", "detector_id", "plane_type", "strip_id", "pedestal", "noise_sigma", "gain", "polarity", "status"]
MAP_DEFAULTS = {"pedestal": 0.0, "noise_sigma": -1.0, "gain": 1.0, "polarity": 1, "status": 0}


def parse_map(text: str) -> list[tuple]:
    """Rows of a channel map: # comments and blank lines are skipped, a header may name columns in any case, else 6 to 11 stand in order.

    A repeated address and an empty map are errors.
    """
    names, rows, seen = MAP_COLUMNS, [], set()
    for fields in csv.reader(io.StringIO(text)):
        own = [f.strip() for f in fields]
        if own:
            own[-1] = own[-1].split("#")[0].strip()
        if not any(own) or own[0].startswith("#"):
            continue
        if not own[0].lstrip("+-").isdigit():
            names = [f.lower() for f in own]
            missing = [n for n in MAP_COLUMNS[:6] if n not in names]
            if missing:
                raise ValueError(f"channel map lacks {', '.join(missing)}")
            continue
        if not 6 <= len(own) <= 11:
            raise ValueError(f"channel map row of {len(own)} fields")
        row = MAP_DEFAULTS | {n: v for n, v in zip(names, own) if v != ""}
        key = tuple(int(row[n]) for n in MAP_COLUMNS[:3])
        if key in seen:
            raise ValueError(f"channel map has address {key} twice")
        seen.add(key)
        rows.append((*key, *(int(row[n]) for n in MAP_COLUMNS[3:6]), *(float(row[n]) for n in MAP_COLUMNS[6:9]), int(row["polarity"]), int(row["status"])))
    if not rows:
        raise ValueError("channel map is empty")
    return rows


def read_map(spark: SparkSession, path: str) -> DataFrame:
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    return spark.createDataFrame(parse_map(text), "board_id int, chip_id int, channel_id int, detector_id int, plane_type int, strip_id int, pedestal double, noise_sigma double, gain double, polarity int, status long")


def map_channels(blocks: DataFrame, channel_map: DataFrame) -> DataFrame:
    """blocks with detector, plane, strip (-1 without a map entry) and flags."""
    own = blocks.join(F.broadcast(channel_map.select("board_id", "chip_id", "channel_id", "detector_id", "plane_type", "strip_id", "status")), ["board_id", "chip_id", "channel_id"], "left")
    return own.withColumns({"channel_flags": F.coalesce("status", F.lit(UNMAPPED)), **{n: F.coalesce(n, F.lit(-1)) for n in ("detector_id", "plane_type", "strip_id")}}).drop("status")


def unmapped(mapped: DataFrame) -> DataFrame:
    """(board, chip, channel, count) of readouts without a map entry; a conversion fails if there are any and they aren't allowed."""
    return mapped.where(F.col("channel_flags") == UNMAPPED).groupBy("board_id", "chip_id", "channel_id").agg(F.count("*").alias("count"))


def pedestal_stats(blocks: DataFrame) -> DataFrame:
    """(board, chip, channel, pedestal, noise_sigma, samples): mean and sample spread of all samples, 0 for a single one."""
    each = blocks.select("board_id", "chip_id", "channel_id", F.explode("waveform").alias("s"))
    return each.groupBy("board_id", "chip_id", "channel_id").agg(F.avg("s").alias("pedestal"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("noise_sigma"), F.count("*").alias("samples"))


def without_pedestal(channel_map: DataFrame, stats: DataFrame, least: int = 2) -> DataFrame:
    """Mapped channels that have too few pedestal samples; a conversion fails if there are any."""
    return channel_map.join(stats.where(F.col("samples") >= least), ["board_id", "chip_id", "channel_id"], "left_anti")


def convert(blocks: DataFrame, channel_map: DataFrame, stats: DataFrame, allow_unmapped: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, channels) of version 1: the blocks of one extended event number of a file are one event."""
    if without_pedestal(channel_map, stats).limit(1).count():
        raise ValueError("mapped channels without a pedestal")
    mapped = map_channels(blocks, channel_map)
    if not allow_unmapped and unmapped(mapped).limit(1).count():
        raise ValueError("readouts of channels that the map lacks")
    fields = ["detector_id", "plane_type", "strip_id", "board_id", "chip_id", "channel_id", "waveform", "channel_flags"]
    own = mapped.groupBy("path", "ext_event").agg(F.min_by("event_id", "block").alias("event_id"), F.min_by("timestamp", "block").alias("timestamp"), F.sort_array(F.collect_list(F.struct("block", "pos", *fields))).alias("h"))
    events = with_entry(own, ["path", "ext_event"]).select("entry", "event_id", "timestamp", *[F.transform("h", field(n)).alias(n) for n in fields])
    channels = channel_map.drop("pedestal", "noise_sigma").join(stats.drop("samples"), ["board_id", "chip_id", "channel_id"])
    return events, channels


def upgrade(events: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Version 2 of version-1 tables: strips become id0 and have no id1."""
    top = F.transform("waveform", lambda w: F.array_max(w))
    peak = F.transform("waveform", lambda w: (F.array_position(w, F.array_max(w)) - 1).cast("int"))
    ev = events.withColumns({"id0": F.col("strip_id"), "id1": F.transform("strip_id", lambda s: F.lit(-1)), "waveform_max": top, "peak_sample": peak}).drop("strip_id")
    ch = channels.withColumns({"id0": F.col("strip_id"), "id1": F.lit(-1), "det": F.col("detector_id"), "plane": F.col("plane_type")}).drop("strip_id", "detector_id", "plane_type")
    return ev, ch
