"""The binary block stream as a Spark data source: one file is read by many tasks, and only what the schema asks for is decoded.

    register(spark)
    spark.read.format("chip_blocks").option("samples", 27).load("run1.dat")

A block's place follows from the one before it, and so do its number and the turns of its event counter. Planning therefore
walks the block headers (twenty bytes a block, none of the samples) and hands each task the place, block number and counter
at which its part begins. With a schema that leaves out the waveform, tasks skip the samples as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hodoscope.sources.bt import BLOCK, CHANNEL, SYNC, signed12

HEAD, MARK = 18, 2
SPLIT_BYTES = 64 << 20
#: Bytes looked through at once for the next mark, and rows handed out at once.
LOOK, OUT_ROWS = 1 << 16, 8192


@dataclass
class Block:
    """A complete block: where its header begins, its fields, and where reading goes on after it."""

    at: int
    chip: int
    stamp: int
    event: int
    count: int
    end: int


class Stream:
    """Random access to the blocks of one file."""

    def __init__(self, path: str, samples: int):
        self.samples = samples
        kind, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = kind.open_input_file(own)
        self.size = self.file.size()

    def __enter__(self) -> Stream:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at)

    def find(self, word: int, at: int) -> int:
        """Place of the first such word at or a whole number of words after `at`; -1 if there is none."""
        while at + 2 <= self.size:
            words = np.frombuffer((raw := self.read(at, LOOK))[: len(raw) // 2 * 2], ">u2")
            hit = np.flatnonzero(words == word)
            if len(hit):
                return at + 2 * int(hit[0])
            at += 2 * len(words)
        return -1

    def next(self, at: int) -> Block | None:
        """The first block at or after `at`, or None where none is complete."""
        mark = self.find(BLOCK, at)
        head = self.read(mark + MARK, HEAD) if mark >= 0 else b""
        if len(head) < HEAD:
            return None
        chip, high, low, tail, event, count = (int(v) for v in np.frombuffer(head, ">u2")[:6])
        end = mark + MARK + HEAD + 2 * count * (1 + self.samples)
        if end > self.size:
            return None
        return Block(mark + MARK, chip & 0xFF, (high << 24) | (low << 8) | (tail >> 8 & 0xFF), event, count, end + 1)


class Part(InputPartition):
    def __init__(self, path: str, at: int, blocks: int, number: int, epoch: int, before: int):
        self.path, self.at, self.blocks, self.number, self.epoch, self.before = path, at, blocks, number, epoch, before


def turned(before: int, event: int) -> bool:
    """Whether the 16-bit counter began anew: from its top sixteenth to its bottom sixteenth."""
    return before > 0xF000 and event < 0x1000


def plan(path: str, samples: int, split_bytes: int) -> list[Part]:
    """Parts of about split_bytes of one file, each with what its blocks need to know of those before it."""
    with Stream(path, samples) as s:
        start = s.find(SYNC, 0)
        if start < 0:
            raise ValueError(f"no sync word in {path}")
        parts: list[Part] = []
        at, number, epoch, before = start + 2, 0, 0, -1
        while block := s.next(at):
            if not parts or block.at - parts[-1].at >= split_bytes:
                parts.append(Part(path, block.at - MARK, 0, number, epoch, before))
            parts[-1].blocks += 1
            epoch += 65536 * turned(before, block.event)
            at, number, before = block.end, number + 1, block.event
        if not parts:
            raise ValueError(f"no complete block in {path}")
        return parts


class BlockReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.samples = int(options["samples"])
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]]

    def partitions(self) -> Sequence[InputPartition]:
        return [p for path in self.paths for p in plan(path, self.samples, self.split_bytes)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        whole = "waveform" in arrow.names
        held: list[dict] = []
        rows = 0
        with Stream(part.path, self.samples) as s:
            at, epoch, before = part.at, part.epoch, part.before
            for k in range(part.blocks):
                b = s.next(at)
                epoch += 65536 * turned(before, b.event)
                held.append(self._columns(s, b, part.path, part.number + k, epoch, whole))
                at, before, rows = b.end, b.event, rows + b.count
                if rows >= OUT_ROWS:
                    yield self._batch(held, arrow)
                    held, rows = [], 0
        yield self._batch(held, arrow)

    def _columns(self, s: Stream, b: Block, path: str, number: int, epoch: int, whole: bool) -> dict:
        wide = 1 + self.samples
        out = {"path": path, "block": number, "ext_event": epoch + b.event, "event_id": b.event, "timestamp": b.stamp, "board_id": b.chip // 4, "chip_id": b.chip % 4}
        if whole or "channel_id" in self.schema.names:
            words = np.frombuffer(s.read(b.at + HEAD, 2 * b.count * wide), ">u2").reshape(b.count, wide)
            out |= {"channel_id": (words[:, 0] & 0xFF).astype(np.int32), "waveform": signed12(words[:, 1:]) if whole else None}
        return out | {"pos": np.arange(b.count, dtype=np.int32), "rows": b.count}

    def _batch(self, held: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
        n = np.array([h["rows"] for h in held], np.int64)
        cols = []
        for f in arrow:
            if f.name == "waveform":
                flat = np.concatenate([h["waveform"].reshape(-1) for h in held]) if held else np.zeros(0, np.int16)
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(n.sum() + 1) * self.samples, pa.int32()), pa.array(flat, pa.int16())))
            elif f.name in ("channel_id", "pos"):
                cols.append(pa.array(np.concatenate([h[f.name] for h in held]) if held else [], f.type))
            else:
                each = np.repeat(np.arange(len(held)), n)
                cols.append(pa.array([h[f.name] for h in held], f.type).take(pa.array(each)))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)


class BlockDataSource(DataSource):
    """Options: samples (words after a channel's id), splitBytes. A given schema names the columns to be decoded."""

    @classmethod
    def name(cls) -> str:
        return "chip_blocks"

    def schema(self) -> str:
        return CHANNEL

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockDataSource)
