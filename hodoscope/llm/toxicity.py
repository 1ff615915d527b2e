"""Toxicity by a classifier chain: categories are predicted one after another by linear models over lexical features.

Model k sees the features of a text and the probabilities of categories 0..k-1. In training those probabilities are
out-of-fold: each row's come from models fitted without its fold, so later models learn how far earlier ones can be trusted.
Only the fit uses a bounded sample (TRAIN_ROWS labelled rows in a fixed hash order, of at most TRAIN_CHARS characters each);
every text of the table is scored whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.llm.common import cut, filter_texts, give_back, map_rows, once

#: Labelled rows and their largest length that the fit may use.
TRAIN_ROWS, TRAIN_CHARS = 12_000, 60_000
#: Features kept by the fit, and the fewest training rows a feature must occur in.
FEATURES, LEAST_ROWS = 4096, 6
#: Hash space in which candidate features are counted.
SPACE = 1 << 22
FOLDS = 5
#: A text whose probability reaches this is toxic.
THRESHOLD = 0.35
WORD = re.compile(r"[^\W\d_]+")
#: Categories in chain order, each a condition on the label columns.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_junk": "toxic = 1 AND quality = 0"}


def stems(word: str) -> list[str]:
    """A word and its beginnings: insults are inflected and compounded."""
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6, 7, 8) if len(word) > n)]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed feature numbers of a text."""
    words = set(WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((zlib.crc32(s.encode()) % SPACE for w in words for s in stems(w)), np.int64))


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, width: int, l2: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights of an L2-regularised logistic regression (features, dense columns, bias) by gradient descent with
    moments, whose step is even for rare and frequent features."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, d = len(rows), dense.shape[1]
    theta = np.zeros(width + d + 1)
    if not y.any():  # a category without examples is never predicted
        theta[-1] = -20.0
        return theta
    momentum, seen = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps):
        z = np.bincount(own, theta[:width][at], n) + dense @ theta[width : width + d] + theta[-1]
        err = sigmoid(z) - y
        grad = np.concatenate([np.bincount(at, err[own], width), dense.T @ err, [err.sum()]])
        grad[:width] += l2 * theta[:width]
        momentum = 0.9 * momentum + 0.1 * grad
        seen = 0.99 * seen + 0.01 * grad**2
        theta -= 0.3 * (1 - t / steps) * (momentum / (1 - 0.9**t)) / (np.sqrt(seen / (1 - 0.99**t)) + 1e-8)
    return theta


def predict_linear(theta: np.ndarray, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    width = len(theta) - dense.shape[1] - 1
    z = np.array([theta[:width][r].sum() for r in rows]) + dense @ theta[width:-1] + theta[-1]
    return sigmoid(z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    return np.clip(np.log(np.maximum(p, 1e-9) / np.maximum(1 - p, 1e-9)), -6, 6)


class Chain:
    """A fitted chain; kept: hashed feature numbers in order, weights: one vector a category."""

    def __init__(self, names: list[str], kept: np.ndarray, weights: list[np.ndarray]):
        self.names, self.kept, self.weights = names, kept, weights

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        member = once(("chain words", self.kept.tobytes()), dict)
        if len(member) > 60_000:
            member.clear()
        where = {int(h): i for i, h in enumerate(self.kept)}
        out = []
        for t in texts:
            got: set[int] = set()
            for w in set(WORD.findall(t.lower())) if t else ():
                hit = member.get(w)
                if hit is None:
                    hit = member[w] = tuple(i for s in stems(w) if (i := where.get(zlib.crc32(s.encode()) % SPACE)) is not None)
                if hit:
                    got.update(hit)
            out.append(np.fromiter(sorted(got), np.int64, len(got)))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a column for each category in chain order."""
        rows, p = self.rows(texts), np.zeros((len(texts), 0))
        for theta in self.weights:
            p = np.column_stack([p, predict_linear(theta, rows, logit(p))])
        return p


def select(hashed: list[np.ndarray], labels: np.ndarray, keep: int, least_rows: int) -> np.ndarray:
    """Hashed features by the largest G statistic (log-likelihood ratio) against any category."""
    found, n = np.unique(np.concatenate(hashed) if hashed else np.zeros(0, np.int64), return_counts=True)
    found, n = found[n >= least_rows], n[n >= least_rows].astype(float)
    best, total = np.zeros(len(found)), float(len(hashed))
    for y in labels.T:
        pos = float(y.sum())
        if not 0 < pos < total:
            continue
        at = np.concatenate([h for h, v in zip(hashed, y) if v])
        at, c = np.unique(at[np.isin(at, found)], return_counts=True)
        hit = np.zeros(len(found))
        hit[np.searchsorted(found, at)] = c
        g = np.zeros(len(found))
        for o, e in ((hit, n * pos / total), (n - hit, n * (total - pos) / total), (pos - hit, (total - n) * pos / total), (total - pos - n + hit, (total - n) * (total - pos) / total)):
            g += np.where(o > 0, 2 * o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0)
        best = np.maximum(best, g)
    order = np.lexsort((found, -best))[:keep]
    return np.sort(found[order[best[order] > 10.8]])  # beyond chance at 0.001


def fit_chain(hashed: list[np.ndarray], labels: np.ndarray, names: list[str], keep: int = FEATURES, least_rows: int = LEAST_ROWS, folds: int = FOLDS) -> Chain:
    """labels: a column of 0/1 for each category. A category without an example, or any without rows, is never predicted."""
    kept = select(hashed, labels, keep, least_rows)
    rows = [np.searchsorted(kept, h[np.isin(h, kept)]) for h in hashed]
    fold = np.arange(len(rows)) % folds
    earlier, weights = np.zeros((len(rows), 0)), []
    for y in labels.T:
        weights.append(fit_linear(rows, logit(earlier), y, len(kept)))
        out = np.zeros(len(rows))
        for f in range(folds):
            test = np.flatnonzero(fold == f)
            train = np.flatnonzero(fold != f)
            if len(test) and len(train):
                theta = fit_linear([rows[i] for i in train], logit(earlier[train]), y[train], len(kept))
                out[test] = predict_linear(theta, [rows[i] for i in test], logit(earlier[test]))
        earlier = np.column_stack([earlier, out])
    return Chain(names, kept, weights)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, rows: int = TRAIN_ROWS) -> Chain:
    """Fit on a bounded sample of labelled rows, drawn in a fixed hash order; rows with a null label or text are not drawn."""
    cats = categories or CATEGORIES
    flags = [F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"c{i}") for i, c in enumerate(cats.values())]
    order = [F.xxhash64(F.lit("toxicity"), "doc_id"), F.col("doc_id")]
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", *flags).groupBy("doc_id").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(cats))]).orderBy(*order).limit(rows)
    own = docs.where(F.length("text").between(1, TRAIN_CHARS)).select("doc_id", "text")
    got = own.join(F.broadcast(chosen), "doc_id")  # at most `rows` short rows

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "y": cols["y"], "h": [features(t).astype("<i4").tobytes() for t in cols["text"]]}

    packed = map_rows(got.select("doc_id", "text", F.array(*[f"c{i}" for i in range(len(cats))]).alias("y")), run, "doc_id long, y array<int>, h binary")
    # of rows repeated with one doc_id, one: `rows` bounds what reaches the driver
    packed = cut(packed.groupBy("doc_id").agg(F.min(F.struct("h", "y")).alias("r")).select("doc_id", "r.y", "r.h"), "labelled")
    # two passes over the sample: the driver keeps counts, and then only features that the fit could keep
    counts = np.zeros(SPACE, np.int32)
    for r in packed.select("h").toLocalIterator():
        counts[np.frombuffer(r["h"], "<i4")] += 1
    drawn = []
    for r in packed.toLocalIterator():
        h = np.frombuffer(r["h"], "<i4")
        drawn.append((r["doc_id"], tuple(r["y"]), h[counts[h] >= LEAST_ROWS].tobytes()))
    drawn.sort()
    hashed = [np.frombuffer(h, "<i4") for _, _, h in drawn]
    y = np.array([v for _, v, _ in drawn], float).reshape(len(drawn), len(cats))
    chain = fit_chain(hashed, y, list(cats))
    del counts, drawn, hashed, y
    give_back()  # the sample stays with the driver otherwise, for as long as it lives
    return chain


def score(docs: DataFrame, chain: Chain, decide: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """docs' doc_id with p_<category> of each category and the decision; a null or empty text is never toxic.

    Repeated rows are scored each; extra columns are ignored; an empty table gives no rows.
    """
    names = chain.names

    def run(cols: dict[str, list]) -> dict[str, list]:
        p = chain.scores(cols["text"])
        p[[not t for t in cols["text"]]] = 0
        out = {f"p_{n}": p[:, i].tolist() for i, n in enumerate(names)}
        return {"doc_id": cols["doc_id"], **out, "toxic": (p[:, names.index(decide)] >= threshold).tolist()}

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, " + "".join(f"p_{n} double, " for n in names) + "toxic boolean")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its category probabilities and whether it is toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, with their columns as they were."""
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def keep(texts: list[str | None]) -> list[bool]:
        p = chain.scores(texts)[:, chain.names.index("toxic")]
        return [not t or v < THRESHOLD for t, v in zip(texts, p.tolist())]

    return filter_texts(docs, keep)
