"""Near-duplicate documents: an LSH forest over MinHash signatures, links confirmed on full shingle sets.

Documents of one shingle set are one class, and only classes go on. Each of TREES trees sorts the classes by its own order
of the signature's values (classes alone with their first LEAST_DEPTH values are left out: they have no neighbour there). A
class's candidates are its neighbours of longest common prefix in that order: those of at least LEAST_DEPTH values in common
among the WINDOW classes on either side. So the depth adapts to the region: all of a region of up to WINDOW classes meet at
LEAST_DEPTH, and the fuller a region is, the longer the prefix that neighbours within the window share. Ranks in the order
are global, so a window passes over the borders of partitions, and a task holds two windows however full a region is.

Candidates whose signatures agree enough to be linked form groups (by a few spanning edges a window), and links are confirmed
on the full sets:
  - a group of up to CHUNK classes in one task, each pair;
  - a larger one in chunks of CHUNK, each with the group's hubs (classes that agree with most others), which the copies of
    one text meet in. The classes that its main component does not reach then meet the whole group, in blocks of bounded size;
    in a group of more than MAX_BLOCKS blocks they meet their neighbours in each tree's order instead. So no class is copied
    more than MAX_BLOCKS times, or twice a tree, however large its group is.
Components of the confirmed links are exact for all candidates; a pair at the threshold in regions of up to WINDOW classes is
missed as a candidate with a probability of 3e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.llm.common import components, cut, map_groups, map_slices, map_tables, send, word_ids

#: Values of a signature; a tree's order starts at its own four of them and goes on through DEPTH.
VALUES, TREES, LEAST_DEPTH, DEPTH = 128, 32, 3, 16
SHINGLE = 5
#: Links need NUMER * union <= DENOM * intersection; pairs that agree in less than LEAST_AGREE of the signature are not
#: confirmed (at the threshold that happens to one pair in ten million).
NUMER, DENOM = 75, 100
LEAST_AGREE = 0.55
#: Neighbours on either side; classes of a group compared in one task; hubs of a larger group.
WINDOW, CHUNK, HUBS = 256, 64, 4
#: Classes and shingles of a block, and the blocks of a group beyond which neighbours meet first.
BLOCK, BLOCK_SHINGLES, MAX_BLOCKS = 256, 500_000, 64
_SEED = np.random.default_rng(20240607)
_MUL = _SEED.integers(1, 1 << 63, VALUES, np.uint64) | np.uint64(1)
_ADD = _SEED.integers(0, 1 << 63, VALUES, np.uint64)
KEY = ["s1", "s2", "n_shingles"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; the whole sequence is one if it has fewer words than a shingle."""
    import xxhash

    own = word_ids(text)
    if not own:
        return np.zeros(0, np.uint64)
    known: dict[str, int] = {}
    digest = xxhash.xxh64_intdigest
    h = np.array([known[w] if w in known else known.setdefault(w, digest(w)) for w in own], np.uint64)
    n = len(h)
    k = min(SHINGLE, n)
    out = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j])
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of a shingle set, as 32-bit numbers."""
    out = np.empty(VALUES, np.uint32)
    for at in range(0, VALUES, 32):
        low = np.full(32, np.iinfo(np.uint64).max, np.uint64)
        for part in range(0, len(own), 4096):
            h = own[part : part + 4096, None] * _MUL[at : at + 32] + _ADD[at : at + 32]
            np.minimum(low, h.min(0), out=low)
        out[at : at + 32] = low >> np.uint64(32)
    return out


def _key(own: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, signed; with its size they name its class."""
    if not len(own):
        return 0, 0
    both = np.array([_mix(own).sum(), np.bitwise_xor.reduce(_mix(own + np.uint64(77)))], np.uint64)
    return tuple(both.view(np.int64).tolist())


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, n_shingles, sig, agree): set hashes and size; signature as big-endian bytes, and a byte of each value."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        sigs = [signature(s) if len(s) else None for s in sets]
        keys = [_key(s) for s in sets]
        raw = [None if g is None else g.astype(">u4").tobytes() for g in sigs]
        low = [None if g is None else (g & 0xFF).astype(np.uint8).tobytes() for g in sigs]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array(raw, pa.binary()), pa.array(low, pa.binary())],
            ["doc_id", *KEY, "sig", "agree"],
        )

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, s1 long, s2 long, n_shingles long, sig binary, agree binary")


class Groups:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _bytes(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def forest(reps: DataFrame) -> DataFrame:
    """(tree, rank, order, id, agree): classes with a neighbour, ranked over all partitions by tree and signature order."""
    heads = F.expr(f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(sig, 16 * t + 1, {4 * LEAST_DEPTH})))")
    trees = reps.select("id", *KEY, F.posexplode(heads).alias("tree", "head"))
    shared = trees.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    met = trees.join(shared, "head", "left_semi").select("id", *KEY, "tree")
    order = F.expr(f"substring(concat(sig, sig), 16 * tree + 1, {4 * DEPTH})")
    rows = met.join(reps, ["id", *KEY]).select("tree", order.alias("order"), "id", "agree")
    by = ["tree", "order", "id"]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_ = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("part"), place.alias("place")), "forest")
    counts = sorted_.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    before = [0, *np.cumsum([r["n"] for r in counts]).tolist()]
    starts = reps.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(counts, before)], "part int, before long")
    return sorted_.join(F.broadcast(starts), "part").select("tree", (F.col("before") + F.col("place")).alias("rank"), "order", "id", "agree")


def _cells(ranked: DataFrame, window: int) -> DataFrame:
    """Rows in cells of four windows each; the last window of a cell is in the next one too, as its earlier neighbours."""
    rank, size = F.col("rank"), 4 * window
    own = F.floor(rank / size)
    return ranked.withColumn("cell", F.explode(F.when(rank % size >= size - window, F.array(own, own + 1)).otherwise(F.array(own))))


def _candidates(cell: int, table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a cell (the later one its own) that are neighbours in a tree and whose signatures agree, and how much."""
    rank, tree = table["rank"].to_numpy(), table["tree"].to_numpy()
    head = _bytes(table["order"].to_pylist())[:, : 4 * LEAST_DEPTH]
    agree = _bytes(table["agree"].to_pylist())
    new = (tree[1:] != tree[:-1]) | (head[1:] != head[:-1]).any(1)
    run = np.concatenate([[0], np.cumsum(new)])
    mine = rank // (4 * window) == cell
    longest = int(np.bincount(run).max())
    found = []
    for d in range(1, longest):
        at = np.flatnonzero((run[d:] == run[:-d]) & mine[d:] & (rank[d:] - rank[:-d] <= window))
        same = (agree[at + d] == agree[at]).sum(1)
        good = same >= LEAST_AGREE * VALUES
        found.append((at[good] + d, at[good], same[good]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def candidate_edges(ranked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, n): for each window a few edges that join its candidates (a < b), and how many each class agrees with (a = b)."""

    def meet(key: tuple, table: pa.Table) -> pa.RecordBatch | None:
        i, j, same = _candidates(key[0], table, window)
        if not len(i):
            return None
        ids = table["id"].to_numpy()
        groups, edges = Groups(len(ids)), set()
        left = len(np.unique(np.concatenate([i, j]))) - 1  # more edges join nothing new
        order = np.argsort(-same, kind="stable")
        for x, y in zip(i[order].tolist(), j[order].tolist()):
            if groups.join(x, y):
                edges.add((min(ids[x], ids[y]), max(ids[x], ids[y])))
                left -= 1
                if not left:
                    break
        close = same >= NUMER / DENOM * VALUES
        met = np.bincount(np.concatenate([i[close], j[close]]), minlength=len(ids))
        at = np.flatnonzero(met)
        own = sorted(e for e in edges if e[0] != e[1])
        a, b = ([e[k] for e in own] + ids[at].tolist() for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(own) + met[at].tolist(), pa.int64())], ["a", "b", "n"])

    return map_tables(_cells(ranked, window), ["cell"], meet, "a long, b long, n long", ["rank"]).groupBy("a", "b").agg(F.sum("n").alias("n"))


def joining(ids: list[int], sets: list[np.ndarray], now: list[int], tried: list[int]) -> list[tuple[int, int]]:
    """Links that join the components `now` as far as links between the tried rows and all rows do (all, if all are tried)."""
    groups, seen, out = Groups(len(ids)), {}, []
    for i, c in enumerate(now):
        groups.join(seen.setdefault(c, i), i)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    vocab, word = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(vocab), np.int32)
    for i in tried:
        own = word[start[i] : start[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[word], start)  # shingles that each row shares with row i
        mark[own] = 0
        for j in np.flatnonzero(DENOM * both >= NUMER * (size[i] + size - both)).tolist():
            if groups.join(i, j) and ids[i] != ids[j]:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _apart(full: DataFrame, now: DataFrame, block: int) -> DataFrame:
    """Classes of the large groups of several components: (id, root, size, shingles, now, nx, ny, stray).

    full: the classes of large groups (id, root, size, shingles); now: their components (id, now). stray: outside the group's
    main component; nx, ny: how many blocks the group and its strays make.
    """
    each = full.join(now, "id").withColumn("n", F.length("shingles") / 8)
    parts = each.groupBy("root", "now").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    main = parts.groupBy("root").agg(F.max_by("now", F.struct("rows", -F.col("now"))).alias("main"), F.max("rows").alias("most"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum(F.lit(1)).alias("parts"))
    count = lambda rows, n: F.greatest(F.lit(1), F.ceil(rows / block), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    main = main.where("parts > 1").select("root", "main", count(F.col("rows"), F.col("n")).alias("nx"), count(F.col("rows") - F.col("most"), F.col("n") * (1 - F.col("most") / F.col("rows"))).alias("ny"))
    return each.join(main, "root").withColumn("stray", F.col("now") != F.col("main"))


def _columns(bx: str, by: str) -> list:
    return [F.col("root").cast("long").alias("root"), F.col(bx).cast("long").alias("bx"), F.col(by).cast("long").alias("by"), "id", "now", "stray", "shingles"]


def _blocks(each: DataFrame) -> DataFrame:
    """Rows (root, bx, by, id, now, stray, shingles): blocks in which each stray class meets each class of its group."""
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    across = each.withColumns({"bx": dealt("nx", 0), "by": F.explode(F.sequence(F.lit(0), F.col("ny") - 1)), "stray": F.lit(False)})
    down = each.where("stray").withColumns({"by": dealt("ny", 1), "bx": F.explode(F.sequence(F.lit(0), F.col("nx") - 1))})
    return across.select(_columns("bx", "by")).union(down.select(_columns("bx", "by")))


def _neighbours(each: DataFrame, ranked: DataFrame, window: int) -> DataFrame:
    """The same of cells of each tree's order, in which stray classes meet their neighbours."""
    own = _cells(ranked.select("id", "rank").join(each, "id"), window)
    return own.withColumns({"root": F.lit(-1), "by": F.lit(0)}).select(_columns("cell", "by"))


def links(docs: DataFrame, reps: DataFrame, window: int = WINDOW, chunk: int = CHUNK, block: int = BLOCK, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(a, b): confirmed links between classes, enough of them to connect each component."""
    ranked = forest(reps)
    edges = cut(candidate_edges(ranked, window), "edges")
    groups = cut(components(edges.select("a", "b").where("a <> b")), "groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    member = cut(groups.join(sizes, "root"), "members")
    degree = edges.where("a = b").select(F.col("a").alias("id"), F.col("n").alias("met"))
    large = member.where(F.col("size") > chunk)
    hubs = large.join(degree, "id").groupBy("root", F.pmod(F.xxhash64("id"), F.lit(HUBS)).alias("k")).agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("id"))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingle_set(t) for t in batch.column(3).to_pylist()]
        keys = [_key(s) for s in own]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["id", "root", "size", *KEY, "shingles"])

    text = docs.select("doc_id", "text").join(send(member, member.count()), F.col("doc_id") == F.col("id")).select("id", "root", "size", "text")
    full = map_slices(text, sets, "id long, root long, size long, s1 long, s2 long, n_shingles long, shingles binary", 64)
    # a document of several texts is a member with those of them that are classes of its own
    full = cut(full.join(reps.select("id", *KEY), ["id", *KEY], "left_semi").dropDuplicates(["id", *KEY]).drop(*KEY), "sets")
    many = F.ceil(F.col("size") / chunk).cast("int")
    small = full.where(F.col("size") <= chunk).withColumn("chunk", F.lit(0))
    parts = full.where(F.col("size") > chunk).withColumn("chunk", F.pmod(F.xxhash64("id"), many).cast("int"))
    hub = full.join(hubs.select("id"), "id").withColumn("chunk", F.explode(F.sequence(F.lit(0), many - 1))).select(*parts.columns)
    chunks = small.unionByName(parts).unionByName(hub).select("root", "chunk", "id", "shingles")

    def each_pair(key: tuple, cols: dict[str, list]) -> list[tuple]:
        every = list(range(len(cols["id"])))
        return joining(cols["id"], [np.frombuffer(s, np.uint64) for s in cols["shingles"]], cols["id"], every)

    first = cut(map_groups(chunks, ["root", "chunk"], each_pair, "a long, b long").distinct(), "links")
    if not large.limit(1).count():
        return first

    def strays(key: tuple, cols: dict[str, list]) -> list[tuple]:
        tried = [i for i, s in enumerate(cols["stray"]) if s]
        return joining(cols["id"], [np.frombuffer(s, np.uint64) for s in cols["shingles"]], cols["now"], tried) if tried else []

    def apart(found: DataFrame, name: str) -> DataFrame:
        joined = components(found).withColumnRenamed("root", "now")
        now = cut(large.select("id").join(joined, "id", "left").select("id", F.coalesce("now", "id").alias("now")), f"now{name}")
        return cut(_apart(full.where(F.col("size") > chunk), now, block), f"apart{name}")

    each = apart(first, "")
    many = each.where(F.col("nx") > max_blocks)
    if many.limit(1).count():
        near = map_groups(_neighbours(many, ranked, window), ["root", "bx", "by"], strays, "a long, b long")
        first = cut(first.union(near).distinct(), "nearer")
        each = apart(first, "2")
    return first.union(map_groups(_blocks(each), ["root", "bx", "by"], strays, "a long, b long"))


def near_duplicates(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, block: int = BLOCK, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A null or empty text has no shingles and is linked with nothing. Rows of null doc_id stand alone (their component is
    null and they are kept). Rows of one doc_id are one document: each has the size of its own text's set, and all of them
    the one component that any of their texts links to; kept is the same for all. Extra columns are ignored.
    """
    sig = cut(_signatures(docs), "signatures")
    some = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = cut(some.groupBy(*KEY).agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("agree").alias("agree")), "classes")
    named = reps.select(*KEY, "id")
    # a document of several texts joins their classes
    several = some.groupBy("doc_id").agg(*[(F.min(k) < F.max(k)).alias(k) for k in KEY]).where("s1 OR s2 OR n_shingles").select("doc_id")
    texts = some.join(several, "doc_id", "left_semi").select("doc_id", *KEY).join(named, KEY).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    root = components(links(docs, reps, window, chunk, block, max_blocks).union(texts))
    classes = named.join(root, "id", "left").select(*KEY, F.coalesce("root", "id").alias("root"))
    out = sig.select("doc_id", *KEY).join(classes, KEY, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def neardup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest doc_id, null ids last.

    Of rows repeated with one doc_id (or none) and one text, one stays.
    """
    # a null id gets one of the text's, above all others in use
    own = docs.withColumn("__own", F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))).withColumn("__hash", F.xxhash64("text"))
    again = cut(own.groupBy("__own", "__hash").agg(F.count("*").alias("n")).where("n > 1").select("__own", "__hash"), "again")
    n = again.count()
    if n:
        repeated = own.join(send(again, n), ["__own", "__hash"], "left_semi").dropDuplicates(["doc_id", "text"])
        own = cut(own.join(send(again, n), ["__own", "__hash"], "left_anti").unionByName(repeated), "once")
    gone = near_duplicates(own.select(F.col("__own").alias("doc_id"), "text")).where("NOT kept").select(F.col("doc_id").alias("__own")).distinct()
    return own.join(gone, "__own", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, f.b FROM r JOIN f ON f.a = r.reach)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.reach) AS component_id, r.doc_id = min(r.reach) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
