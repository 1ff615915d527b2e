"""Vector codes against a plain Lloyd in whole numbers; Yinyang's bounds leave out work and never a result."""

import hashlib
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from hodoscope.llm import veccodes as V


def plain(rows, entries=256, rounds=4, parts=4):
    """rows: (vec_id, vector of floats, label), already usable, in any order."""
    dims = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    ints = [[min(max(int(np.floor(float(x) * 1024)), -V.LARGEST), V.LARGEST) for x in v] + [0] * (dims - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    w = dims // parts
    cut = lambda q, p: q[p * w : (p + 1) * w]
    books = [[cut(ints[i], p) for i in order[:entries]] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assigned():
        return [[min(range(len(books[p])), key=lambda e: (d(cut(q, p), books[p][e]), e)) for p in range(parts)] for q in ints]

    for _ in range(rounds):
        own = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(q, p) for q, o in zip(ints, own) if o[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    own = assigned()
    error = [sum(d(cut(q, p), books[p][o[p]]) for p in range(parts)) for q, o in zip(ints, own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = {}
    for (_, _, lab), e in zip(rows, error):
        by[lab] = by.get(lab, 0) + e
    top = 2**63 - 1
    return sorted(str((i, "".join(f"{x:02x}" for x in o), min(e, top), min(by[lab], top), sha)) for (i, _, lab), o, e in zip(rows, own, error))


def table(spark, folder, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit("clash"), "own": F.lit(1), "codes": F.lit(2)})
    df.repartition(3).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")


def got(spark, folder):
    return sorted(str(tuple(r)) for r in V.op11_vector_codes(spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_equals_plain_lloyd_on_odd_rows(spark, folder):
    rng = random.Random(3)
    grid = [-1.5, -0.25, 0.0, 0.0009765625, 0.5, 1.0]  # many ties
    rows = [(i, [float(np.float32(rng.choice(grid))) for _ in range(10)], rng.choice([1, 2, None])) for i in range(330)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[3][1], 2), (-4, [1.0], 1), (-5, [], None)]  # repeated, null and short ones
    bad = [(900, None, 1), (-901, [None, 1.0], 1), (-902, [float("nan")] * 10, 1), (-903, [float("inf")] * 10, 1)]
    table(spark, folder, rows + bad)
    assert got(spark, folder) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(3, [1.0, 2.0], 5)], [(i, [1e6 * i, -3e38, 2.0], None) for i in range(5)]])
def test_few_and_huge_vectors(spark, folder, rows):
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    table(spark, folder, rows)
    assert got(spark, folder) == (plain(rows) if rows else [])


def test_bounds_leave_out_work_and_nothing_else():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (40, 8))
    x = centres[rng.integers(0, 40, 6000)] + rng.integers(-40, 40, (6000, 8))
    book = V.Book(x[:64].copy(), V.grouping(x[:64], 8), np.zeros(64))
    own = up = low = None
    done = []
    for _ in range(6):
        own, up, low, n = V.assign(x, book, own, up, low)
        done.append(n)
        d2 = V.distances(x, book.entries)
        assert (own == d2.argmin(1)).all()
        d = np.sqrt(d2.astype(float))
        assert (up >= d[np.arange(len(x)), own]).all()
        for g, m in enumerate(book.members()):
            other = np.where(m[None] == own[:, None], np.inf, d[:, m])
            assert (low[:, g] <= other.min(1)).all()
        new = book.entries.copy()
        for e in np.unique(own):
            new[e] = x[own == e].sum(0) // (own == e).sum()
        book = book.moved(new)
    assert done[0] == x.shape[0] * 64 and sum(done[1:]) < 0.5 * 5 * done[0], done
