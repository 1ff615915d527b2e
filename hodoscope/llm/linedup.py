"""Line dedup by deletion neighbourhoods: lines within one edit of an earlier line go, and the earliest stays.

Two lines are within one edit if and only if they share a deletion variant: the same string after deleting one character at
the same place (a substitution), or one line after a deletion and the other as it is (an insertion). Variants are emitted as
hashed keys, equal keys are joined, and each find is verified on the texts.

Emitting every variant of every line would multiply the corpus by its line length, so the place of the edit is narrowed
first, without loss: whichever part of a line the edit lies in, all the rest is equal. Lines that share no such rest with
another line (first with halves cut out, then with sixteenths) have no partner, and the others emit the deletions of that
sixteenth only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hodoscope.llm.common import bound_batches, cut, map_slices, send

#: Lines shorter than this are compared for equality only: by default none, a line of one character is an edit from any other.
LEAST_CHARS = 1
FINE = 16
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NO_ID = -(1 << 63)
ID = ["id0", "rid", "line_no"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any substring of many lines at once."""

    def __init__(self, lines: list[str]):
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.size = np.array([len(s) for s in lines], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) if len(lines) else np.zeros(0, np.int64)
        value = mix((code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.sums, self.back = [], []
        for b in BASE:
            inverse = np.uint64(pow(int(b), -1, 1 << 64))
            power = np.full(len(code) + 1, b, np.uint64)
            power[0] = 1
            self.back.append(np.full(len(code) + 1, inverse, np.uint64))
            self.back[-1][0] = 1
            np.multiply.accumulate(self.back[-1], out=self.back[-1])
            np.multiply.accumulate(power, out=power)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:-1], dtype=np.uint64)]))

    def of(self, a: np.ndarray, b: np.ndarray, k: int = 0) -> np.ndarray:
        """Hashes of the characters a..b-1 (places in the joined text), the same wherever they stand."""
        return (self.sums[k][b] - self.sums[k][a]) * self.back[k][a]

    def rest(self, line: np.ndarray, n: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
        """Keys of lines without part `part` of `parts`, for partners of which the shorter has n characters."""
        lo, hi = part * n // parts, (part + 1) * n // parts
        a = self.start[line]
        end = a + self.size[line]
        key = mix(self.of(a, a + lo) + np.uint64(1)) + mix(self.of(end - (n - hi), end) ^ np.uint64(0x5851F42D4C957F2D))
        return mix(key + (n * parts + part).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def without(self, line: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of lines without their character at `at`."""
        a = self.start[line]
        x = a + at
        tail = (self.sums[k][a + self.size[line]] - self.sums[k][x + 1]) * self.back[k][a] * self.back[k][1]
        return self.of(a, x, k) + tail


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def split_lines(text: str | None) -> list[str]:
    """A text's lines without spaces, tabs and returns at their ends; blank lines are '' and never compared."""
    return [s.strip(" \t\r") for s in text.split("\n")] if text else []


def _occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """Every line that is not blank: id0, rid, line_no, its hashes h1, h2 and its keys without a half."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rids, texts = (c.to_pylist() for c in batch.columns)
        lines, own, number = [], [], []
        for i, t in enumerate(texts):
            for k, s in enumerate(split_lines(t)):
                if s:
                    lines.append(s)
                    own.append(i)
                    number.append(k)
        r, own = Rolling(lines), np.array(own, np.int64)
        every = np.arange(len(lines))
        end = r.start + r.size
        keys = np.stack([r.rest(every, np.maximum(0, r.size - d), np.full(len(lines), j), 2) for d in (0, 1) for j in (0, 1)], 1) if lines else np.zeros((0, 4), np.uint64)
        valid = np.stack([r.size >= least_chars] * 2 + [r.size > least_chars] * 2, 1)
        offsets = np.concatenate([[0], np.cumsum(valid.sum(1))]).astype(np.int32)
        nested = pa.ListArray.from_arrays(offsets, _signed(np.ascontiguousarray(keys[valid])))
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[own]), pa.array(np.array(rids, np.int64)[own]), pa.array(np.array(number, np.int32)), _signed(r.of(r.start, end)), _signed(r.of(r.start, end, 1)), nested], ["id0", "rid", "line_no", "h1", "h2", "keys"])

    src = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id0"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    return map_slices(src, run, "id0 long, rid long, line_no int, h1 long, h2 long, keys array<long>", 512)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs with more than one line."""
    again = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return rows.join(again, key, "left_semi")


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """id0, rid, line_no of the first occurrences of lines that lie within one edit of an earlier line."""
    half = _shared(firsts.select(*ID, F.posexplode("keys").alias("part", "key")), "key")
    # part 0, 1: the halves for n = the line's length; 2, 3: for one less
    suspects = cut(half.groupBy(*ID).agg(F.sort_array(F.collect_set("part")).alias("parts")), "suspects")
    by_row = suspects.groupBy("id0", "rid").agg(F.collect_list(F.struct("line_no", "parts")).alias("wanted"))
    src = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id0"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    found = src.join(send(by_row, suspects.count()), ["id0", "rid"]).select("id0", "rid", "wanted", "text")

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The wanted lines of each text, which is split once."""
        out: list[tuple] = []
        for id0, rid, wanted, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = split_lines(text)
            out.extend((id0, rid, w["line_no"], w["parts"], own[w["line_no"]]) for w in wanted)
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*ID, "parts", "line"])

    picked = map_slices(found, pick, "id0 long, rid long, line_no int, parts array<int>, line string", 64)
    lines = cut(picked.dropDuplicates(ID), "lines")

    def fine(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = {n: c for n, c in zip(batch.schema.names, batch.columns)}
        r = Rolling(cols["line"].to_pylist())
        pick = [(i, p // 2, p % 2) for i, ps in enumerate(cols["parts"].to_pylist()) for p in ps]
        own, less, halves = (np.repeat(np.array([p[k] for p in pick], np.int64), FINE // 2) for k in range(3))
        part = halves * (FINE // 2) + np.tile(np.arange(FINE // 2), len(pick))
        key = r.rest(own, r.size[own] - less, part, FINE)
        return pa.RecordBatch.from_arrays([cols[n].take(pa.array(own)) for n in ID] + [_signed(key), pa.array(less.astype(np.int32)), pa.array(part.astype(np.int32))], [*ID, "key", "less", "part"])

    places = _shared(map_slices(lines.select(*ID, "parts", "line"), fine, "id0 long, rid long, line_no int, key long, less int, part int", 512), "key")
    places = places.groupBy(*ID).agg(F.collect_set(F.struct("less", "part")).alias("places"))

    def variants(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = {n: c for n, c in zip(batch.schema.names, batch.columns)}
        r = Rolling(cols["line"].to_pylist())
        own, at, kind = [], [], []  # kind 0: the line itself; 1: a deletion met at the same place; 2: a deletion met by a whole line
        for i, ps in enumerate(cols["places"].to_pylist()):
            size = int(r.size[i])
            if any(p["less"] == 0 for p in ps):
                own.append([i]), at.append([-1]), kind.append([0])
            for k in (0, 1):
                n = size - k
                mine = sorted({x for p in ps if p["less"] == k for x in range(p["part"] * n // FINE, (p["part"] + 1) * n // FINE + k)})
                own.append([i] * len(mine)), at.append(mine), kind.append([1 + k] * len(mine))
        own, at, kind = (np.array([v for x in y for v in x], np.int64) for y in (own, at, kind))
        whole = kind == 0
        a, x = r.start[own], np.maximum(at, 0)
        out = [np.where(whole, r.of(a, a + r.size[own], k), r.without(own, x, k)) for k in (0, 1)]
        place = np.where(kind == 1, at, -1)  # a substitution joins variants of one place only
        return pa.RecordBatch.from_arrays([cols[n].take(pa.array(own)) for n in ID] + [_signed(out[0]), _signed(out[1]), pa.array(place), pa.array(kind.astype(np.int32))], [*ID, "v1", "v2", "place", "kind"])

    emitted = map_slices(lines.select(*ID, "line").join(places, ID), variants, "id0 long, rid long, line_no int, v1 long, v2 long, place long, kind int", 128)
    emitted = cut(emitted, "variants")
    # a group's size is bounded by the alphabet and the line: its members differ in one character
    me = F.struct(*ID)
    low = emitted.groupBy("v1", "v2", "place").agg(F.min(F.when(F.col("kind") == 0, me)).alias("whole"), F.min(F.when(F.col("kind") > 0, me)).alias("other"), F.count("*").alias("n")).where("n > 1")
    met = emitted.join(low, ["v1", "v2", "place"])
    witness = F.when(F.col("kind") == 2, F.col("whole")).otherwise(F.col("other"))
    met = met.select(*ID, witness.alias("w")).where(F.col("w").isNotNull() & (F.col("w") < F.struct(*ID))).groupBy(*ID).agg(F.min("w").alias("w"))
    left = met.join(lines.select(*ID, "line"), ID)
    other = lines.select(F.struct(*ID).alias("w"), F.col("line").alias("before"))
    return left.join(other, "w").where(F.levenshtein("line", "before", 1).between(0, 1)).select(*ID)


def kept_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id0, rid, kept, near): for each document row the numbers of the lines that stay, and of those within an edit of an earlier one."""
    firsts = _occurrences(docs, least_chars).groupBy("h1", "h2").agg(F.min(F.struct(*ID)).alias("o"), F.any_value("keys").alias("keys"))
    firsts = cut(firsts.select("o.id0", "o.rid", "o.line_no", "keys"), "firsts")
    near = near_lines(docs, firsts).withColumn("near", F.lit(True))
    marked = firsts.select(*ID).join(near, ID, "left")
    flag = F.coalesce("near", F.lit(False))
    return marked.groupBy("id0", "rid").agg(F.sort_array(F.collect_list(F.when(~flag, F.col("line_no")))).alias("kept"), F.sort_array(F.collect_list(F.when(flag, F.col("line_no")))).alias("near"))


@F.pandas_udf(T.StringType())
def _staying(text: pd.Series, kept: pd.Series) -> pd.Series:
    """The texts' blank lines and those of the given numbers."""

    def one(t: str | None, numbers: np.ndarray | None) -> str | None:
        if t is None:
            return None
        stay = set() if numbers is None else set(numbers.tolist())
        return "\n".join(s for k, s in enumerate(t.split("\n")) if k in stay or not s.strip(" \t\r"))

    return pd.Series([one(t, k) for t, k in zip(text, kept)], dtype=object)


def _reduced(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with text reduced, and __n_lines, __n_kept, __n_near."""
    kept = kept_lines(docs, least_chars)
    side = docs.withColumns({"__id0": F.coalesce("doc_id", F.lit(NO_ID)), "__rid": F.xxhash64("doc_id", "text")})
    k = kept.select(F.col("id0").alias("__id0"), F.col("rid").alias("__rid"), F.col("kept").alias("__kept"), F.col("near").alias("__near"))
    both = bound_batches(side.join(k, ["__id0", "__rid"], "left"))
    none = F.array().cast("array<int>")
    out = both.withColumns({"__n_lines": n_lines(), "__n_kept": F.size(F.coalesce("__kept", none)), "__n_near": F.size(F.coalesce("__near", none)), "text": _staying("text", "__kept")})
    return out.drop("__id0", "__rid", "__kept", "__near")


def n_lines() -> Column:
    """A text's lines without blank ones."""
    lines = F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(" \t\r")) != "")
    return F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with text reduced to its lines that stay, and n_lines, n_kept, n_near (lines without blank ones).

    A line equal to an earlier one, or within one edit of an earlier one (both of least_chars characters or more), goes;
    'earlier' is by doc_id (null first), then text hash, then place. Blank lines stay. Null and empty texts are as they were;
    repeated rows keep the same lines; columns other than doc_id and text pass through, but for the three that are added.
    """
    out = _reduced(docs, least_chars)
    return out.withColumns({n: F.col(f"__{n}") for n in ("n_lines", "n_kept", "n_near")}).drop("__n_lines", "__n_kept", "__n_near")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For every document: its lines, those that stay, and those dropped as near or equal to an earlier line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id0"), F.xxhash64("doc_id", "text").alias("rid"), n_lines().alias("n_lines"))
    none = F.array().cast("array<int>")
    out = own.join(kept_lines(docs), ["id0", "rid"], "left").select("doc_id", "n_lines", F.coalesce("kept", none).alias("kept_lines"), F.coalesce("near", none).alias("near_lines"))
    return out.select("doc_id", "n_lines", F.size("kept_lines").alias("n_kept"), F.size("near_lines").alias("n_near"), F.array_join(F.col("kept_lines").cast("array<string>"), ",").alias("kept_lines"))


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with repeated lines removed and n_chars set to the new length; a document whose every line went is gone too."""
    out = _reduced(docs).where("__n_kept > 0 OR __n_lines = 0")
    changed = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(changed).select(*docs.columns)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, line_no - 1 AS line_no, trim(line, ' ' || chr(9) || chr(13)) AS s FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
f AS (SELECT *, length(s) AS n FROM l QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, line_no) = 1),
k AS (SELECT *, m // 2 AS h FROM (SELECT *, unnest([n, n - 1]) AS m FROM f) WHERE m >= 1),
c AS (
  SELECT a.doc_id AS da, a.line_no AS la, a.s AS a, a.n AS na, b.doc_id, b.line_no, b.s AS b, b.n AS nb FROM k a JOIN k b ON a.m = b.m AND left(a.s, a.h) = left(b.s, b.h)
  UNION SELECT a.doc_id, a.line_no, a.s, a.n, b.doc_id, b.line_no, b.s, b.n FROM k a JOIN k b ON a.m = b.m AND right(a.s, a.m - a.h) = right(b.s, b.m - b.h)),
near AS (
  SELECT DISTINCT doc_id, line_no FROM c WHERE (da, la) < (doc_id, line_no) AND abs(na - nb) <= 1
    AND len(list_filter(range(0, least(na, nb) + 1), lambda i: left(a, i) = left(b, i)
      AND substr(a, i + CASE WHEN na >= nb THEN 2 ELSE 1 END) = substr(b, i + CASE WHEN nb >= na THEN 2 ELSE 1 END))) > 0),
m AS (SELECT f.doc_id, f.line_no, near.doc_id IS NOT NULL AS near FROM f LEFT JOIN near ON f.doc_id = near.doc_id AND f.line_no = near.line_no),
g AS (SELECT doc_id, count(CASE WHEN NOT near THEN 1 END) AS n_kept, count(CASE WHEN near THEN 1 END) AS n_near,
  coalesce(string_agg(CASE WHEN NOT near THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no), '') AS kept_lines FROM m GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(t.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_kept, 0) AS INTEGER) AS n_kept, CAST(coalesce(n_near, 0) AS INTEGER) AS n_near, coalesce(kept_lines, '') AS kept_lines
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""
