"""Vector codes by product quantisation, the codebooks fitted by Yinyang Lloyd.

Each part position's codebook entries are put into groups. A vector carries, for each part, its entry, an upper bound of the
distance to it and one lower bound per group of the distance to the group's other entries. When entries move, the bounds move
by the entries' drifts; only groups whose lower bound no longer lies above the upper bound are scanned, and a part all of
whose groups pass is not looked at. Bounds are widened by more than the rounding of their arithmetic, and a group whose bound
is equal is scanned, so a skipped entry is truly farther; what is scanned is compared in integers, ties to the lower index.

The state travels with its vector from round to round as rows of a written table; codebooks are the only shared data, a
round's sums are the only ones that are gathered, and both are bounded by the codebooks' size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.llm.common import cut, cut_anew, map_batches, send
from hodoscope.llm.topk import usable

PARTS, ENTRIES, ROUNDS, GROUPS = 4, 256, 4, 16
SCALE = 1024
#: Components are held in 32 bits: after scaling they end at these bounds (absolute values of 2 million in an embedding).
LARGEST = 2**31 - 1
#: Up to this size of a component squared distances are whole numbers below 2**53, in which float arithmetic is exact.
EXACT = 2**20
SLACK = 1e-9
CHUNK = 4096


def grouping(book: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """The group of each codebook entry: a few Lloyd rounds over the entries, seeded by entries at even places."""
    k = len(book)
    groups = max(1, min(groups, k))
    points = book.astype(np.float64)
    centres = points[np.linspace(0, k - 1, groups).astype(int)]
    own = np.zeros(k, np.int64)
    for _ in range(rounds):
        own = ((points[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (own == g).any():
                centres[g] = points[own == g].mean(0)
    return own


@dataclass
class Book:
    """One part position's codebook with its groups, and how far each entry has moved since the last assignment."""

    entries: np.ndarray  # (k, d) int64
    group: np.ndarray  # (k,)
    drift: np.ndarray  # (k,) float64, rounded up

    def members(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.group == g) for g in range(int(self.group.max()) + 1)]

    def moved(self, entries: np.ndarray) -> Book:
        step = np.sqrt(((entries.astype(np.float64) - self.entries.astype(np.float64)) ** 2).sum(1))
        return Book(entries, self.group, step * (1 + SLACK))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances as exact integers (objects where they may pass 2**53)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and x.shape[1] <= 1024:
        a, b = x.astype(np.float64), c.astype(np.float64)
        # each term is a whole number below 2**53
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if x.shape[1] else np.zeros((len(x), len(c)), object)


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


def assign(x: np.ndarray, book: Book, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of each row of x, upper bounds, lower bounds per group, distances computed); without bounds, all is computed.

    upper and lower hold for the entries before they moved by book.drift.
    """
    members = book.members()
    n, groups = len(x), len(members)
    if own is None:
        d2 = distances(x, book.entries)
        own = d2.argmin(1).astype(np.int64)  # the first of equal ones
        low = np.empty((n, groups))
        rows = np.arange(n)
        best = _root(d2[rows, own])
        rest = d2.astype(np.float64)
        rest[rows, own] = np.inf
        for g, m in enumerate(members):
            low[:, g] = np.sqrt(rest[:, m].min(1)) * (1 - SLACK) if len(m) else np.inf
        return own, best * (1 + SLACK), low, d2.size
    own, done = own.copy(), 0
    upper = upper * (1 + SLACK) + book.drift[own]
    shift = np.array([book.drift[m].max(initial=0) for m in members])
    low = lower * (1 - SLACK) - shift[None]
    look = np.flatnonzero(low.min(1) <= upper)
    if not len(look):
        return own, upper, low, done
    exact = _own_distances(x[look], book.entries[own[look]])
    upper[look] = _root(exact) * (1 + SLACK)
    done += len(look)
    best, first, second = exact.copy(), own[look].copy(), np.full(len(look), np.inf)
    failed = low[look] <= upper[look][:, None]
    for g, m in enumerate(members):
        at = np.flatnonzero(failed[:, g])
        if not len(at) or not len(m):
            continue
        d2 = distances(x[look[at]], book.entries[m])
        done += d2.size
        mine = m[d2.argmin(1)]
        least = d2[np.arange(len(at)), d2.argmin(1)]
        wins = (least < best[at]) | ((least == best[at]) & (mine < first[at]))
        best[at[wins]], first[at[wins]] = least[wins], mine[wins]
        bound = np.full((len(at), len(m) + 1), np.inf)
        bound[:, :-1] = d2
        bound[:, :-1][m[None, :] == own[look[at]][:, None]] = np.inf  # the old entry comes in below, where another one wins
        bound.partition(1, axis=1)
        low[look[at], g] = np.sqrt(bound[:, 0]) * (1 - SLACK)
        second[at[wins]] = bound[wins, 1]
    changed = np.flatnonzero(first != own[look])
    if len(changed):
        rows = look[changed]
        # the new entry leaves the bound of its group, and the old one is now one of its group's others
        low[rows, book.group[first[changed]]] = np.sqrt(second[changed]) * (1 - SLACK)
        old = book.group[own[rows]]
        low[rows, old] = np.minimum(low[rows, old], _root(exact[changed]) * (1 - SLACK))
        own[rows] = first[changed]
        upper[rows] = _root(best[changed]) * (1 + SLACK)
    return own, upper, low, done


def _own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        return ((x - c) ** 2).sum(1)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(1)


STATE = "vec_id long, label int, v binary, own binary, upper binary, lower binary"
_STATE = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), *((n, pa.binary()) for n in ("v", "own", "upper", "lower"))])


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    out = np.frombuffer(b"".join(column.to_pylist()), kind)
    return out.reshape(len(column), width)


def _binary(table: np.ndarray) -> pa.Array:
    table = np.ascontiguousarray(table)
    step, n = table.dtype.itemsize * table.shape[1], len(table)
    offsets = pa.py_buffer(np.arange(0, (n + 1) * step, step or 1, np.int32)[: n + 1] if step else np.zeros(n + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(table.tobytes())])


@dataclass
class Shape:
    """How a state row's bytes are to be read: component type, padded dimensions, parts, groups of each part."""

    kind: str
    dims: int
    parts: int
    groups: list[int]

    @property
    def width(self) -> int:
        return self.dims // self.parts


def _whole(table: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(table * SCALE), -LARGEST, LARGEST)


def _vectors(df: DataFrame, id_col: str, vec: str, label: str, dims: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                v = b.column(2)
                size = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                table = np.zeros((b.num_rows, dims), np.float64)
                table[np.arange(dims) < size[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
                none = pa.array([None] * b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(_whole(table).astype(kind)), none, none, none], schema=_STATE)

    return map_batches(df.select(F.col(id_col).cast("long"), F.col(label).cast("int"), F.col(vec).cast("array<double>")), run, STATE)


def _assigned(state: DataFrame, books: list[Book], shape: Shape) -> DataFrame:
    """state after one assignment of all parts to the entries of books."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                v = _matrix(b.column("v"), shape.kind, shape.dims).astype(np.int64)
                fresh = b.column("own").null_count > 0
                if not fresh:
                    own0 = _matrix(b.column("own"), np.int16, shape.parts).astype(np.int64)
                    up0 = _matrix(b.column("upper"), np.float64, shape.parts)
                    low0 = _matrix(b.column("lower"), np.float32, sum(shape.groups)).astype(np.float64)
                owns, ups, lows, edge = [], [], [], 0
                for p, book in enumerate(books):
                    x = v[:, p * shape.width : (p + 1) * shape.width]
                    g = shape.groups[p]
                    o, u, w, _ = assign(x, book, None, None, None) if fresh else assign(x, book, own0[:, p], up0[:, p], low0[:, edge : edge + g])
                    edge += g
                    owns.append(o)
                    ups.append(u)
                    lows.append(w)
                low = np.concatenate(lows, 1)
                short = low.astype(np.float32)
                short = np.where(short.astype(np.float64) > low, np.nextafter(short, np.float32(-np.inf)), short)  # rounded down
                cols = [b.column("vec_id"), b.column("label"), b.column("v"), _binary(np.stack(owns, 1).astype(np.int16)), _binary(np.stack(ups, 1)), _binary(short)]
                yield pa.RecordBatch.from_arrays(cols, schema=_STATE)

    return map_batches(state, run, STATE)


def _sums(state: DataFrame, shape: Shape, entries: int) -> list[tuple[int, int, list[int]]]:
    """(part * entries + entry, count, sums of its parts): summed within a partition first, at most parts * entries rows in all."""
    arrow = pa.schema([("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(shape.parts * entries, np.int64)
        s = np.zeros((shape.parts * entries, shape.width), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), shape.kind, shape.dims).astype(np.int64)
            own = _matrix(batch.column("own"), np.int16, shape.parts).astype(np.int64)
            for p in range(shape.parts):
                at = own[:, p] + p * entries
                order = np.argsort(at, kind="stable")
                used, start = np.unique(at[order], return_index=True)
                if len(used):
                    s[used] += np.add.reduceat(v[order, p * shape.width : (p + 1) * shape.width], start, axis=0)
                    n[used] += np.diff(np.append(start, len(at)))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))], schema=arrow)

    part = map_batches(state.select("v", "own"), run, "entry int, n long, s array<long>")
    # decimals, since sums over all rows may pass 2**63
    total = part.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i].cast("decimal(20,0)")) for i in range(shape.width))).alias("s"))
    return [(r.entry, r.n, [int(x) for x in r.s]) for r in total.collect()]


def compress(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> tuple[DataFrame, list[np.ndarray]]:
    """(one row per usable vector: vec_id, label, codes array<int>, error decimal; the final codebooks).

    Vectors that are null or hold null or non-finite components are left out. Components are floor(1024 * x), at most 2**31 - 1
    in size. Vectors shorter than the longest, or than the next multiple of `parts`, are filled up with zeros. The codebooks
    start as the parts of the rows with the smallest ids (null last), ties by vector; with fewer rows than entries, all rows
    are entries. Rows of one id each have their own row. An empty table gives no rows and empty codebooks. Extra columns are
    not read.
    """
    kept = usable(df, vec).select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    top = kept.agg(F.max(F.size("vec")).alias("size"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("top")).first()
    dims = -(-max(top["size"] or 0, 1) // parts) * parts
    kind = "int16" if (top["top"] or 0) * SCALE < 2**15 - 2 else "int32"
    state = _vectors(kept, "vec_id", "vec", "label", dims, kind)
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), F.col("vec").cast("array<double>")).limit(entries)
    first = [r.v for r in seeds.select(F.col("vec").cast("array<double>").alias("v")).collect()]
    table = np.zeros((len(first), dims))
    for row, v in zip(table, first):
        row[: len(v)] = v
    table = _whole(table).astype(np.int64)
    width = dims // parts
    books = []
    for p in range(parts):
        e = np.ascontiguousarray(table[:, p * width : (p + 1) * width])
        books.append(Book(e, grouping(e, groups) if len(e) else np.zeros(0, np.int64), np.zeros(len(e))))
    none = df.sparkSession.createDataFrame([], "vec_id long, label int, codes array<int>, error decimal(38,0)")
    if not first:
        return none, [b.entries for b in books]
    shape = Shape(kind, dims, parts, [len(b.members()) for b in books])
    path = None
    for _ in range(rounds):
        state, path = cut_anew(_assigned(state, books, shape), "codes", path)
        new = [b.entries.copy() for b in books]
        for key, n, s in _sums(state, shape, len(first)):
            new[key // len(first)][key % len(first)] = [x // n for x in s]
        books = [b.moved(e) for b, e in zip(books, new)]
    return _coded(_assigned(state, books, shape), books, shape), [b.entries for b in books]


def _coded(state: DataFrame, books: list[Book], shape: Shape) -> DataFrame:
    arrow = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("codes", pa.list_(pa.int32())), ("error", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for b in batches:
            v = _matrix(b.column("v"), shape.kind, shape.dims).astype(np.int64)
            own = _matrix(b.column("own"), np.int16, shape.parts).astype(np.int64)
            error = sum(_own_distances(v[:, p * shape.width : (p + 1) * shape.width], book.entries[own[:, p]]).astype(object) for p, book in enumerate(books))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(own.tolist(), pa.list_(pa.int32())), pa.array([Decimal(int(e)) for e in error], pa.decimal128(38, 0))], schema=arrow)

    return map_batches(state.select("vec_id", "label", "v", "own"), run, "vec_id long, label int, codes array<int>, error decimal(38,0)")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors of embeddings. Errors past 2**63 - 1, which only components of millions have, end there."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = cut(coded, "coded")
    whole = lambda c: F.least(c, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(whole(F.sum("error")).alias("label_error")), "label_errors")
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))).alias("code")
    return coded.join(send(sums, sums.count()), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code, whole(F.col("error")).alias("error"), "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    out = [
        f"""v0 AS (
  SELECT vec_id, label, embedding, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
size AS (SELECT CAST(ceil(max(len(q)) / {PARTS}) AS BIGINT) AS w FROM v0),
v AS MATERIALIZED (SELECT vec_id, label, list_resize(q, {PARTS} * w, 0) AS q, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM v0, size),
x AS MATERIALIZED (SELECT r, p, list_slice(q, p * w + 1, (p + 1) * w) AS q FROM v, size, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, q AS c FROM x WHERE r <= {ENTRIES})"""
    ]
    for i in range(ROUNDS + 1):
        d2 = "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT"
        out.append(f"a{i} AS MATERIALIZED (SELECT r, p, q, min(struct_pack(d := {d2}, e := e)) AS m FROM x JOIN b{i} USING (p) GROUP BY r, p, q)")
        if i < ROUNDS:
            out.append(f"s{i} AS (SELECT p, m.e AS e, unnest(q) AS s, generate_subscripts(q, 1) AS i FROM a{i})")
            out.append(f"u{i} AS (SELECT p, e, i, CAST(floor(sum(s)::DOUBLE / count(*)) AS BIGINT) AS c FROM s{i} GROUP BY p, e, i)")
            out.append(f"n{i} AS (SELECT p, e, list(c ORDER BY i) AS c FROM u{i} GROUP BY p, e)")
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} USING (p, e))")
    return (
        "WITH "
        + ",\n".join(out)
        + f""",
k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
f AS (SELECT r, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN v USING (r), k"""
    )


ORACLE = _oracle()
