"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams with marked ends (so its affixes too) and itself as a lexicon entry, hashed;
transitions between the languages of neighbouring words are learned. Forward-backward gives each word a distribution over
languages, also where a text switches; a text's language is the one with the largest expected share of its words.
Training texts are spliced from segments of labelled documents, so that switches occur and their cost can be learned.
Only the fit uses a bounded sample (at most TRAIN_ROWS rows a language, each of at most TRAIN_CHARS characters).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hodoscope.llm.common import map_rows, once

TRAIN_ROWS, TRAIN_CHARS = 800, 20_000
SPACE = 1 << 17
GRAMS = (1, 2, 3, 4)
#: Words of a training sequence, and of a segment that inference treats side by side with others.
SPLICE, SEGMENT = 48, 32
MEMO_WORDS = 500_000
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of word characters but decimals and _, if they hold a letter (a superscript or a fraction is none)."""
    if not text:
        return []
    own = WORD.findall(text.lower())
    return own if text.isascii() else [w for w in own if w.isalpha() or any(map(str.isalpha, w))]


def word_features(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, place of each word's first one): n-grams of ^word$ and the word as a whole."""
    marked = [f"\x02{w}\x03" for w in own]
    size = np.array([len(w) for w in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(own)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the word's end
    key, at = np.zeros(len(code), np.uint64), []
    ids = []
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros_like(code)
        shifted[: len(code) - n + 1] = code[n - 1 :]
        key = (key ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        if n in GRAMS:
            good = left >= n
            ids.append(key[good])
            at.append(word[good])
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    value = code * (np.arange(len(code)).astype(np.uint64) - start[word].astype(np.uint64) + np.uint64(3)) * np.uint64(0xC2B2AE3D27D4EB4F)
    value ^= value >> np.uint64(31)
    ids.append(np.add.reduceat(value * np.uint64(0xD6E8FEB86659FD93), start) if len(own) else np.zeros(0, np.uint64))
    at.append(np.arange(len(own)))
    at, ids = np.concatenate(at), np.concatenate(ids)
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at, minlength=len(own))
    return ((ids[order] >> np.uint64(20)) % np.uint64(SPACE)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)


class Tagger:
    """A fitted field: weights (SPACE x languages), transitions (languages x languages)."""

    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def emissions(self, own: list[str]) -> np.ndarray:
        ids, start = word_features(own)
        if not own:
            return np.zeros((0, len(self.names)), np.float32)
        return np.add.reduceat(self.weights[ids], start, 0)

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """For each text the mean over its words of their distribution over languages; zeros for a text without words."""
        return self.read(texts)[0]

    def read(self, texts: list[list[str]]) -> tuple[np.ndarray, list[list[tuple[str, int, int]]]]:
        """The texts' shares, and their runs of words of one language: (language, first word, word after the last)."""
        if not self.names:
            return np.zeros((len(texts), 0)), [[] for _ in texts]
        memo = once(("langid memo", id(self.weights)), dict)
        if memo.get("of") is not self.weights or len(memo["rows"]) > MEMO_WORDS:
            memo.clear()
            memo |= {"of": self.weights, "rows": {}, "table": np.zeros((0, len(self.names)), np.float32)}
        rows = memo["rows"]
        new = list(set().union(*map(set, texts)).difference(rows)) if texts else []
        if new:
            memo["table"] = np.concatenate([memo["table"], self.emissions(new)])
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
        get = rows.__getitem__
        flat = np.fromiter((i for t in texts for i in map(get, t)), np.int64, sum(map(len, texts)))
        size = np.array([len(t) for t in texts], np.int64)
        marginals = posteriors(memo["table"][flat], size, self.moves)
        out = np.zeros((len(texts), len(self.names)))
        np.add.at(out, np.repeat(np.arange(len(texts)), size), marginals)
        label, own = marginals.argmax(1), np.repeat(np.arange(len(texts)), size)
        runs: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if len(label):
            at = np.concatenate([[0], np.flatnonzero((label[1:] != label[:-1]) | (own[1:] != own[:-1])) + 1, [len(label)]])
            first = np.cumsum(size) - size
            for a, b, i, k in zip(at.tolist(), at[1:].tolist(), own[at[:-1]].tolist(), label[at[:-1]].tolist()):
                runs[i].append((self.names[k], a - int(first[i]), b - int(first[i])))
        return out / np.maximum(1, size)[:, None], runs


def posteriors(scores: np.ndarray, size: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Word marginals by forward-backward, exact over each whole text (texts of `size` words one after another in scores).

    Texts are cut into segments that are worked on side by side: first each segment's transfer matrix, then the messages
    into each segment along its text, then the recursions within the segments.
    """
    k = moves.shape[0]
    if not len(scores):
        return np.zeros((0, k))
    move = np.exp(moves - moves.max())
    segs = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), segs)
    number = np.arange(len(text)) - np.repeat(np.cumsum(segs) - segs, segs)
    start = (np.cumsum(size) - size)[text] + number * SEGMENT
    length = np.minimum(SEGMENT, size[text] - number * SEGMENT)
    at = start[:, None] + np.arange(SEGMENT)
    there = np.arange(SEGMENT) < length[:, None]
    e = np.ones((len(text), SEGMENT, k))
    own = scores[at[there]].astype(float)
    e[there] = np.exp(own - own.max(1, keepdims=True))
    first = number == 0
    transfer = np.where(first[:, None, None], np.eye(k), move) * e[:, 0, None, :]
    for t in range(1, SEGMENT):
        on = np.flatnonzero(there[:, t])
        if not len(on):
            break
        step = (transfer[on] @ move) * e[on, t, None, :]
        transfer[on] = step / step.max((1, 2), keepdims=True)
    into, out = np.ones((len(text), k)), np.ones((len(text), k))
    place = np.cumsum(segs) - segs
    for j in range(1, int(segs.max())):
        on = place[segs > j] + j
        v = np.einsum("ni,nij->nj", into[on - 1], transfer[on - 1])
        into[on] = v / v.sum(1, keepdims=True)
    for j in range(1, int(segs.max())):
        on = (place + segs - 1)[segs > j] - j
        v = np.einsum("nij,nj->ni", transfer[on + 1], out[on + 1])
        out[on] = v / v.sum(1, keepdims=True)
    ahead = np.empty_like(e)
    v = np.where(first[:, None], into, into @ move) * e[:, 0]
    ahead[:, 0] = v / v.sum(1, keepdims=True)
    for t in range(1, SEGMENT):
        v = np.where(there[:, t, None], (ahead[:, t - 1] @ move) * e[:, t], ahead[:, t - 1])
        ahead[:, t] = v / v.sum(1, keepdims=True)
    back = out.copy()
    for t in range(SEGMENT - 1, -1, -1):
        v = ahead[:, t] * back
        ahead[:, t] = v / v.sum(1, keepdims=True)
        v = np.where(there[:, t, None], (e[:, t] * back) @ move.T, back)
        back = v / v.sum(1, keepdims=True)
    return ahead[there]


def splice(texts: list[np.ndarray], labels: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n sequences of SPLICE words (numbers) and their labels, put together from segments of random texts."""
    ids, tags = np.zeros((n, SPLICE), np.int64), np.zeros((n, SPLICE), np.int64)
    for s in range(n):
        at = 0
        while at < SPLICE:
            i = int(rng.integers(len(texts)))
            take = min(SPLICE - at, int(rng.integers(4, SPLICE)), len(texts[i]))
            a = int(rng.integers(len(texts[i]) - take + 1))
            ids[s, at : at + take], tags[s, at : at + take] = texts[i][a : a + take], labels[i]
            at += take
    return ids, tags


def fit(texts: list[list[str]], langs: list[str], steps: int = 120, batch: int = 192, rate: float = 0.08) -> Tagger:
    """Maximum likelihood by stochastic gradient with moments; the gradient comes from forward-backward."""
    names = sorted(set(langs))
    k, rng = len(names), np.random.default_rng(11)
    vocab = sorted(set().union(*map(set, texts))) if texts else []
    number = {w: i for i, w in enumerate(vocab)}
    ids, start = word_features(vocab)
    end = np.append(start[1:], len(ids))
    used, local = np.unique(ids, return_inverse=True)
    weights, moves = np.zeros((len(used), k)), np.zeros((k, k))
    seen_w, seen_m = np.zeros_like(weights), np.zeros_like(moves)
    rows = [np.array([number[w] for w in t]) for t in texts]
    labels = np.array([names.index(s) for s in langs])
    for step in range(steps if k > 1 else 0):
        seq, tags = splice(rows, labels, batch, rng)
        flat = seq.ravel()
        size = end[flat] - start[flat]
        at = local[np.repeat(start[flat] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        scores = np.add.reduceat(weights[at], np.cumsum(size) - size, 0)
        post = posteriors(scores, np.full(batch, SPLICE), moves)
        grad = post.copy()
        grad[np.arange(len(flat)), tags.ravel()] -= 1
        each = np.repeat(grad, size, 0)
        gw = np.stack([np.bincount(at, each[:, c], len(used)) for c in range(k)], 1) + 1e-3 * weights
        # expected less observed moves: pair marginals from the two words' scores and the messages around them
        gm = _move_gradient(scores.reshape(batch, SPLICE, k), tags, moves)
        pace = rate * min(1.0, 3 * (1 - step / steps))
        for grad_, seen, value in ((gw, seen_w, weights), (gm, seen_m, moves)):
            seen += grad_**2
            value -= pace * grad_ / np.sqrt(seen + 1e-6)
    full = np.zeros((SPACE, k), np.float32)
    full[used] = weights
    return Tagger(names, full, moves)


def _move_gradient(scores: np.ndarray, tags: np.ndarray, moves: np.ndarray) -> np.ndarray:
    n, t, k = scores.shape
    move, e = np.exp(moves - moves.max()), np.exp(scores - scores.max(2, keepdims=True))
    ahead, back = np.empty_like(e), np.empty_like(e)
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for j in range(1, t):
        v = (ahead[:, j - 1] @ move) * e[:, j]
        ahead[:, j] = v / v.sum(1, keepdims=True)
    back[:, -1] = 1
    for j in range(t - 2, -1, -1):
        v = (e[:, j + 1] * back[:, j + 1]) @ move.T
        back[:, j] = v / v.sum(1, keepdims=True)
    pair = ahead[:, :-1, :, None] * move * (e[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    got = np.zeros((k, k))
    np.add.at(got, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    return pair.sum((0, 1)) - got


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out (and not learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Tagger:
    """Fit on at most `rows` documents a language, drawn by a hash of doc_id among those that are not held out.

    Three quarters of `rows` are drawn on average; what exceeds `rows` by chance is left out by doc_id. Of rows
    that share language and doc_id only the least text is drawn.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.length("text").between(1, TRAIN_CHARS))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 0.75 * rows / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    one = usable.where(draw).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # repeated rows of an id count once
    drawn = sorted((r["lang"], r["doc_id"], r["text"]) for r in one.toLocalIterator())
    texts, langs, n = [], [], {}
    for lang, _, text in drawn:
        own = words(text)
        n[lang] = n.get(lang, 0) + bool(own)
        if own and n[lang] <= rows:
            texts.append(own)
            langs.append(lang)
    return fit(texts, langs)


def identify(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, held_out, lang_pred, score, runs for every row of docs; only the text is read for a prediction.

    A null text or one without a letter is `und` with score 0 and without runs. runs: language:first:end of neighbouring
    words of one language (numbers of the text's words, the end exclusive), comma-joined; more than one where the text
    switches. Repeated rows are each predicted; extra columns are ignored.
    """
    # SPACE x languages weights, as plain arrays: executors need not know the class to load them
    shared = docs.sparkSession.sparkContext.broadcast((tagger.names, tagger.weights, tagger.moves))

    def run(cols: dict[str, list]) -> dict[str, list]:
        own = [words(t) for t in cols["text"]]
        t = Tagger(*shared.value)
        share, runs = t.read(own)
        known = [bool(w) and bool(t.names) for w in own]
        best = share.argmax(1) if t.names else [0] * len(own)
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": [t.names[b] if k else "und" for b, k in zip(best, known)], "score": [min(1.0, float(share[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))], "runs": [",".join(f"{n}:{a}:{e}" for n, a, e in r) for r in runs]}

    return map_rows(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, runs string")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
