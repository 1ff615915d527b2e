"""The Merkle manifest against a plain recursive build, with odd rows, several levels of digits and long shared source names."""

import hashlib
import random
import zlib

import pyspark.sql.functions as F
import pytest

from hodoscope.llm import merkle


def H(s):
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hs):
    """(top, per leaf the list of (left, right))."""
    paths = [[] for _ in hs]
    member = [[i] for i in range(len(hs))]
    while len(hs) > 1:
        up, mem = [], []
        for a in range(0, len(hs), 16):
            run = hs[a : a + 16]
            for k, m in enumerate(member[a : a + 16]):
                for i in m:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H("".join(run)))
            mem.append([i for m in member[a : a + 16] for i in m])
        hs, member = up, mem
    return hs[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    built = {}
    for g, rs in groups.items():
        rs = sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[g] = (rs, *tree([leaf(r) for r in rs]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, above = tree([built[g][1] for g in names])
    out = []
    for g, up in zip(names, above):
        rs, sub, paths = built[g]
        for r, path in zip(rs, paths):
            path = path + up
            fold = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                fold = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                fold = H(a + fold + b)
            out.append((r[0], leaf(r), sub, root, H("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(map(str, out))


@pytest.mark.parametrize("bucket_rows", [3, 16384])
def test_manifest_equals_plain_trees(spark, folder, monkeypatch, bucket_rows):
    rng = random.Random(5)
    rows = [(i * rng.choice([1, 1, 7, 2**40]) - 20, "hot" if i % 3 else f"s{i % 40}", rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Some Text É", "", None, "no capitals", "X" * 3000])) for i in range(420)]
    rows += [(None, "hot", None, 1, "A"), (None, "hot", None, 1, "A"), (None, None, None, None, None), (2**63 - 1, "hot", None, None, "Z"), (-(2**63), "hot", None, None, "Z"), (5, None, None, None, "Q"), (7, "", "", 0, "")]
    rows += [(9, "hot", "en", 1, "same Row")] * 30  # more repeats than a bucket holds
    rows += [(i, f"https://a-long-shared-prefix.example/of/sources/{'x' * (i % 4)}\x00{i % 9}", "en", 2, "Text") for i in range(36)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit("clash"), "rank": F.lit(7), "g": F.lit("x"), "path": F.lit(1)}).repartition(5).write.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], bucket_rows))
    got = merkle.op12_merkle_manifest(spark, folder).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_trees_of_edge_sizes(spark, folder, n):
    rows = [(i, "one", "en", i, f"Text {i}") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{folder}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, folder)
    assert sorted(str(tuple(r)[:7]) for r in got.collect()) == (brute(rows) if n else [])


def test_ranks_follow_unsigned_and_null_order(spark):
    ids = [None, -5, 0, 3, 2**62, -(2**62)] * 2
    df = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], "id long, row long")
    parts = [F.col("id").isNotNull().cast("long"), merkle._unsigned(F.coalesce("id", F.lit(0))), F.col("row")]
    got = merkle.radix_rank(df.withColumn("g", F.lit(None).cast("string")), "g", parts, [F.asc_nulls_first("id"), F.col("row")], 1)
    want = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
    assert [r.row for r in got.orderBy("rank").collect()] == want
    assert [r.rank for r in got.orderBy("rank").collect()] == list(range(len(ids)))
