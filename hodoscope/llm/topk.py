"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Each dimension is a term. A block of candidate vectors is held as postings (per dimension the rows with a weight other than
zero and those weights); each query scatters weight * posting into one dense score array per block, a partition selection
keeps its k best of the block, and the blocks' lists are merged. Queries and candidates meet in a grid of blocks: no side is
broadcast or collected, and a cell's memory is bounded by the two block sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hodoscope.llm.common import cut, map_tables


def usable(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is there, without null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vec).isNotNull() & ~bad)


def quantised(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, row, v): each component x as floor(scale * x), x as double; row numbers the rows, also those of one id."""
    v = F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    # the written table fixes the numbers
    return cut(usable(df, vec).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v")), "vectors")


def _table(v: pa.ChunkedArray) -> np.ndarray:
    """Vectors as the rows of a table; where they differ in length, what is missing weighs nothing."""
    v = v.combine_chunks()
    size = v.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(v), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = v.flatten().to_numpy()
    return out


def _postings(table: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Postings of a block by dimension: rows with a weight other than zero, and those weights."""
    out: list[tuple[np.ndarray | slice, np.ndarray]] = []
    for d in range(table.shape[1]):
        at = np.flatnonzero(table[:, d])
        full = len(at) == len(table)
        out.append((slice(None) if full else at, np.ascontiguousarray(table[:, d] if full else table[at, d])))
    return out


def scan_block(query_rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, cands: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each query (place in the block, places of its k best candidates, their scores); ties to the smaller id, then row.

    ids: of the candidates, a null one as the largest number. A query's own row is left out.
    """
    order = np.lexsort((rows, ids))
    rows, postings = rows[order], _postings(cands[order])
    mine, best, scores = [], [], []
    for i, (own, q) in enumerate(zip(query_rows.tolist(), queries)):
        score = np.zeros(len(rows), np.int64)
        for (at, weights), w in zip(postings, q.tolist()):
            if w:
                score[at] += w * weights
        left = np.flatnonzero(rows != own)
        if len(left) > k:
            have = score[left]
            left = left[have >= np.partition(have, len(have) - k)[len(have) - k]]
        left = left[np.argsort(-score[left], kind="stable")][:k]  # places are in the order of ties
        mine.append(np.full(len(left), i))
        best.append(order[left])
        scores.append(score[left])
    return mine, best, scores


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = 2048, cand_block: int = 16384) -> DataFrame:
    """For each row (id, row, v) of queries the k candidates with the largest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties to the smaller vec_id (null last), then row. The candidate of the
    query's own row is left out; other rows of its id take part, and each query row of one id has its own list. An empty
    vector scores 0 with all. With fewer candidates, all are returned; empty tables give no rows. Extra columns are ignored.
    """
    queries, candidates = queries.where("id IS NOT NULL").select("id", "row", "v"), candidates.select("id", "row", "v")
    nq = max(1, -(-queries.count() // query_block))
    nc = max(1, -(-candidates.count() // cand_block))
    # row blocks by hash: about the stated sizes, and the same at each recomputation
    q = queries.select("id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"), F.lit(True).alias("is_query"))
    c = candidates.select("id", "row", "v", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.pmod(F.xxhash64("row"), F.lit(nc)).cast("int").alias("cb"), F.lit(False).alias("is_query"))
    last = np.iinfo(np.int64).max

    def cell(key: tuple, table: pa.Table) -> pa.RecordBatch | None:
        mine, rest = table.filter(table["is_query"]), table.filter(pa.compute.invert(table["is_query"]))
        if not len(mine) or not len(rest):
            return None
        ids = rest["id"].combine_chunks()
        found = scan_block(mine["row"].to_numpy(), _table(mine["v"]), ids.fill_null(last).to_numpy(), rest["row"].to_numpy(), _table(rest["v"]), k)
        own, best, score = (np.concatenate(x) for x in found)
        own, best = pa.array(own), pa.array(best)
        cols = [mine["id"].combine_chunks().take(own), mine["row"].combine_chunks().take(own), ids.take(best), rest["row"].combine_chunks().take(best), pa.array(score)]
        return pa.RecordBatch.from_arrays(cols, ["query_id", "query_row", "vec_id", "row", "score"])

    part = map_tables(q.unionByName(c), ["qb", "cb"], cell, "query_id long, query_row long, vec_id long, row long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Queries: rows of embeddings whose vec_id is divisible by 100; candidates: all rows."""
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v.where("id % 100 = 0"), v, 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, a.r AS own, b.vec_id, b.r,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
