"""What the operators of this subpackage share: shared-folder writes, Arrow mapping, streamed groups, components."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handed to a text function at once; keeps a worker's memory near the size of a few hundred texts.
SLICE_ROWS = 256
BATCH_ROWS = 1000
WHITESPACE = "\x20\x09-\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset and all run in one process, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = cache().get("own_dir")
        if not found:
            found = cache()["own_dir"] = "file://" + tempfile.mkdtemp(prefix="hodoscope-")
    return found.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there and survives lost executors."""
    return cut_anew(df, what, None)[0]


def cut_anew(df: DataFrame, what: str, old: str | None) -> tuple[DataFrame, str]:
    """(df written and read again, its path); the table at `old`, from which df was made, is deleted then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hodoscope-{uuid.uuid4().hex}-{what}"
    df.write.parquet(path)
    _drop_at_exit(spark, path)
    if old:
        _delete(spark, old)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    paths = cache().setdefault("paths", [])
    if not paths:
        atexit.register(_drop_all)
    paths.append((spark, path))


def _drop_all() -> None:
    for spark, path in cache().get("paths", []):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit; the shared folder is then cleared by its owner
            return


#: A table of at most this many rows of a few numbers each is sent to all executors; a larger one is joined by a shuffle.
SEND_ROWS = 1_000_000


def send(df: DataFrame, rows: int) -> DataFrame:
    """df marked for a broadcast where its counted rows allow it."""
    return F.broadcast(df) if rows <= SEND_ROWS else df


def cache() -> dict:
    """A per-process dictionary; functions that travel by value do not carry module state."""
    return sys.modules.setdefault("_hodoscope_cache", types.ModuleType("_hodoscope_cache")).__dict__


def once(key: object, make: Callable[[], object]) -> object:
    """make() once per process, as long as no other key is asked for: a worker holds one operator's model at a time.

    Workers are used again from stage to stage; what an earlier one has built would stay for as long as they live.
    """
    own = cache()
    if own.get("once key") != key:
        own["once"] = own["once key"] = None
        own["once"] = make()
        own["once key"] = key
    return own["once"]


def give_back() -> None:
    """Return what is free, but still held by the allocators, to the system: an idle worker counts with all it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to trim
        return


def bound_batches(df: DataFrame) -> DataFrame:
    """df, its session set to send Python at most BATCH_ROWS rows at once: whole texts are long, and a batch is held several times."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow with bounded batches, by workers that give back at the end of a partition what they took for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return bound_batches(df).mapInArrow(run, schema)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, rows: int = SLICE_ROWS) -> DataFrame:
    """fn on slices of at most `rows` rows of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return map_batches(df, run, schema)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str | T.StructType, rows: int = SLICE_ROWS) -> DataFrame:
    """Apply fn to slices of df as columns of Python values; fn returns columns of schema, any number of rows."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        out = fn({n: c.to_pylist() for n, c in zip(piece.schema.names, piece.columns)})
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return map_slices(df, run, kind, rows)


def filter_texts(df: DataFrame, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of df, with all their columns, whose text keep wants."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return piece.filter(pa.array(keep(piece.column(piece.schema.get_field_index("text")).to_pylist()), pa.bool_()))

    return map_slices(df, run, df.schema)


def map_tables(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], pa.RecordBatch | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """fn(key, table) for each group of integer keys, streamed from sorted partitions; groups must be of bounded size."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ks = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys], 1)
            cuts = [0, *(np.flatnonzero((ks[1:] != ks[:-1]).any(1)) + 1).tolist(), len(ks)]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(ks[a].tolist())
                if key != now:
                    if held:
                        yield now, pa.Table.from_batches(held)
                    now, held = key, []
                held.append(batch.slice(a, b - a))
        if held:
            yield now, pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in groups(batches):
            out = fn(key, table)
            if out is not None and out.num_rows:
                yield out

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])), run, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, dict[str, list]], Iterable[tuple]], schema: str, order: list[str] | None = None, out_rows: int = 2000) -> DataFrame:
    """fn(key, columns) -> rows for each group of keys, streamed from sorted partitions.

    Groups must be of bounded size; many small groups cost no more than their rows.
    """
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    names = df.columns

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
        held: dict[str, list] = {n: [] for n in names}
        now = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                cols = {n: c.to_pylist() for n, c in zip(piece.schema.names, piece.columns)}
                ks = list(zip(*(cols[k] for k in keys)))
                start = 0
                while start < len(ks):
                    if ks[start] != now:
                        if now is not None:
                            yield now, held
                        now, held = ks[start], {n: [] for n in names}
                    end = start + 1
                    while end < len(ks) and ks[end] == now:
                        end += 1
                    for n in names:
                        held[n].extend(cols[n][start:end])
                    start = end
        if now is not None:
            yield now, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, cols in groups(batches):
            out.extend(fn(key, cols))
            if len(out) >= out_rows:
                yield pack(out)
                out = []
        yield pack(out)

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])), run, kind)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges(a, b): one row (id, root) per node, root the smallest id reachable.

    Alternates large-star and small-star steps (each a grouped minimum and a join), so a hub is never gathered in a task;
    every round is written to the shared folder. No nodes other than those of edges appear. Rounds grow with the logarithm
    of the longest chain; more than max_rounds, which 2**40 links in a row would take, is an error.
    """
    both = edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    now, mark = cut(both, "cc"), None
    for _ in range(max_rounds):
        # large star: each node's larger neighbours move to the smallest node of its neighbourhood
        flip = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = flip.groupBy("u").agg(F.min("v").alias("m0")).select(F.col("u").alias("k"), F.least("u", "m0").alias("m"))
        large = flip.join(low, flip["u"] == low["k"]).where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: each node and its smaller neighbours move to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k")
        small = large.join(low, large["v"] == low["k"])
        new = small.select(F.col("m").alias("u"), "v").union(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        now = cut(new, "cc")
        mark, before = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first(), mark
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("id"), "root").union(now.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())


def word_ids(text: str | None) -> list[str]:
    """Words of the shingle contract: A-Z lower-cased, runs of anything but space and \\t..\\r."""
    if not text:
        return []
    return lower_ascii(text).split() if text.isascii() and not _ODD.intersection(text) else _WORD.findall(lower_ascii(text))


_ODD = frozenset("\x1c\x1d\x1e\x1f")
_WORD = re.compile(f"[^{WHITESPACE}]+")


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
