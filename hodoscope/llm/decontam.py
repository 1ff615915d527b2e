"""Benchmark decontamination: a BM25 index of test items, queried by every training passage with block-max WAND.

The items are indexed (never the corpus). Impacts are divided by the score an item gives itself, so one threshold holds for
all items. A bound from each item's rarest terms first rules out windows that cannot reach the threshold, without loss; the
rest are searched by block-max WAND, which retrieves all items at or above it. What is retrieved counts only if both the
question and the answer of the item overlap with the passage.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.llm.common import cut, map_batches, map_rows

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of its question's and answer's word runs.
SCORE, OVERLAP = 0.5, 0.5
#: Words of a passage; passages start every half of it.
WINDOW = 128
BLOCK = 64
#: Characters of items in one index; more items are dealt to as many further indexes (shards) as that takes.
INDEX_CHARS = 8_000_000
#: Characters of texts that a task holds to search them in one shard after the other, where there are several.
HELD_CHARS = 64_000_000
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last sentence is its answer, what stands before its question; one sentence is split at two thirds."""
    parts = [w for w in map(words, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    one = parts[0] if parts else []
    at = -(-2 * len(one) // 3)
    return one[:at], one[at:]


def runs(own: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(own))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()


def overlap(own: list[str], passage: list[str]) -> float:
    """Share of own's word runs of three (or of all its words, if fewer) that the passage has; 1 if there are none."""
    want, n = runs(own), min(3, len(own))
    return len({r for i in range(len(passage) - n + 1) if (r := tuple(passage[i : i + n])) in want}) / len(want) if want else 1.0


class Index:
    """Postings by term: items in order with normalised impacts, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_len: float):
        self.ids = [i for i, _ in items]
        self.texts = [question_answer(t) for _, t in items]
        postings: dict[str, list[tuple[int, float]]] = {}
        essential: dict[str, list[tuple[int, float]]] = {}
        self.floor = np.zeros(len(items))
        for k, (_, text) in enumerate(items):
            own = words(text)
            tf: dict[str, int] = {}
            for w in own:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(own) / max(mean_len, 1e-9))
            raw = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            total = sum(raw.values())
            share = min(1.0, WINDOW / 2 / max(1, len(own)))  # a longer item can only be there in part
            impact = {w: v / total / share for w, v in raw.items()}
            left = sum(impact.values())
            for w, v in sorted(impact.items(), key=lambda x: (-x[1], x[0])):
                postings.setdefault(w, []).append((k, v))
                if left > SCORE / 2:  # the rest of the terms give half the threshold at most
                    essential.setdefault(w, []).append((k, v))
                    left -= v
            self.floor[k] = SCORE - left - 1e-9
        self.postings = {w: ([k for k, _ in p], [v for _, v in p]) for w, p in postings.items()}
        self.blocks = {w: [max(v[at : at + BLOCK]) for at in range(0, len(v), BLOCK)] for w, (_, v) in self.postings.items()}
        self.most = {w: max(b) for w, b in self.blocks.items()}
        self.term = {w: i for i, w in enumerate(sorted(essential))}
        flat = [essential[w] for w in self.term]
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in flat])]).astype(np.int64)
        self.item = np.array([k for p in flat for k, _ in p], np.int64)
        self.impact = np.array([v for p in flat for _, v in p])

    @classmethod
    def of(cls, fields: dict) -> Index:
        """The index that has these fields."""
        own = cls.__new__(cls)
        own.__dict__.update(fields)
        return own

    def search(self, terms: set[str], least: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= least, by block-max WAND over the distinct terms of a passage."""
        cursors = [[self.postings[t][0], self.postings[t][1], self.blocks[t], self.most[t], 0] for t in sorted(terms) if t in self.postings]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[4]])
            bound, pivot = 0.0, None
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= least - 1e-9:
                    pivot = i
                    break
            if pivot is None:
                break
            doc = cursors[pivot][0][cursors[pivot][4]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][4]] == doc:
                pivot += 1
            ahead = cursors[: pivot + 1]
            for c in ahead:  # shallow move: only to the block that could hold doc
                while (c[4] // BLOCK + 1) * BLOCK < len(c[0]) and c[0][(c[4] // BLOCK + 1) * BLOCK - 1] < doc:
                    c[4] = (c[4] // BLOCK + 1) * BLOCK
            if sum(c[2][c[4] // BLOCK] for c in ahead) < least - 1e-9:
                # no item up to the nearest block border can reach the threshold
                border = min(c[0][min(len(c[0]), (c[4] // BLOCK + 1) * BLOCK) - 1] for c in ahead) + 1
                if pivot + 1 < len(cursors):
                    border = min(border, cursors[pivot + 1][0][cursors[pivot + 1][4]])
                target = max(border, doc + 1)
            else:
                score = 0.0
                for c in ahead:
                    while c[4] < len(c[0]) and c[0][c[4]] < doc:
                        c[4] += 1
                    if c[4] < len(c[0]) and c[0][c[4]] == doc:
                        score += c[1][c[4]]
                if score >= least:
                    out.append((doc, score))
                target = doc + 1
            for c in ahead:
                while c[4] < len(c[0]) and c[0][c[4]] < target:
                    c[4] += 1
            cursors = [c for c in cursors if c[4] < len(c[0])]
        return out

    def windows(self, texts: list[list[str]]) -> dict[tuple[int, int], None]:
        """(text, window) pairs that can hold an item at the threshold, by the bound from essential terms."""
        get, half = self.term.get, WINDOW // 2
        doc, pos, term = [], [], []
        for d, own in enumerate(texts):
            hit = [(p, i) for p, w in enumerate(own) if (i := get(w)) is not None]
            doc.extend([d] * len(hit))
            pos.extend([p for p, _ in hit])
            term.extend([i for _, i in hit])
        if not doc:
            return {}
        doc, pos, term = (np.array(x, np.int64) for x in (doc, pos, term))
        base = np.concatenate([[0], np.cumsum([len(t) // half + 2 for t in texts])])
        first = base[doc] + pos // half  # each word lies in two windows: this one and the one before
        n_terms = len(self.term)
        key = np.unique(np.concatenate([first + 1, first]) * n_terms + np.concatenate([term, term]))
        win, term = key // n_terms, key % n_terms
        size = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pair, back = np.unique(np.repeat(win, size) * len(self.ids) + self.item[at], return_inverse=True)
        gained = np.bincount(back, self.impact[at])
        good = np.unique(pair[gained >= self.floor[pair % len(self.ids)]] // len(self.ids))
        d = np.searchsorted(base, good, "right") - 1
        return {(int(a), int(b)): None for a, b in zip(d, good - base[d])}

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap): the best verified passage of each pair."""
        tokens, hits, best, half = [words(t) for t in texts], {}, {}, WINDOW // 2
        for d, w in self.windows(tokens):
            own = tokens[d][max(0, (w - 1) * half) : (w + 1) * half]  # window w starts half a window before its number
            for k, score in self.search(set(own), SCORE):
                hits.setdefault((d, k), []).append((score, w))
        for (d, k), own in hits.items():
            q, a = self.texts[k]
            more = max(half, len(q) + len(a))  # a copy of the item that meets a window ends within the item's length of it
            seen: dict[tuple[int, int], tuple[float, float]] = {}

            def near(low: int, high: int) -> tuple[float, float]:
                span = max(0, low), min(len(tokens[d]), high)
                if span not in seen:
                    part = tokens[d][span[0] : span[1]]
                    seen[span] = overlap(q, part), overlap(a, part)
                return seen[span]

            if len(own) > 1 and more > half and min(near(0, len(tokens[d]))) < OVERLAP:
                continue  # no span overlaps more than the whole text
            for score, w in sorted(own, reverse=True):
                if (d, k) in best and score < best[d, k][0]:
                    break
                found = (score, *near((w - 1) * half - more, (w + 1) * half + more))
                if min(found[1:]) >= OVERLAP:
                    best[d, k] = max(found, best.get((d, k), found))
        return [(*key, *v) for key, v in sorted(best.items())]


def indexes(items: DataFrame, index_chars: int = INDEX_CHARS) -> Iterator[Index]:
    """Indexes of all items (item_id, text), one after the other, each over about index_chars characters; statistics are those
    of all items.

    Items of null id or without words are left out; each different text of a repeated id is indexed, as an item of that id.
    """
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()

    def split(cols: dict[str, list]) -> dict[str, list]:
        own = [words(t) for t in cols["text"]]
        keep = [i for i, w in enumerate(own) if w]
        return {"item_id": [cols["item_id"][i] for i in keep], "text": [cols["text"][i] for i in keep], "terms": [sorted(set(own[i])) for i in keep], "size": [len(own[i]) for i in keep]}

    parsed = cut(map_rows(items, split, "item_id long, text string, terms array<string>, size long"), "items")
    n, mean, chars = parsed.agg(F.count("*"), F.avg("size"), F.sum(F.length("text"))).first()
    shards = max(1, -(-(chars or 0) // index_chars))
    df = parsed.select("item_id", F.explode("terms").alias("term"))
    counts = df.groupBy("term").agg(F.count("*").alias("df"))
    if shards > 1:
        counts = cut(counts, "df")
    for s in range(shards):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s
        own = sorted((r["item_id"], r["text"]) for r in parsed.where(mine).select("item_id", "text").collect())
        known = {r["term"]: r["df"] for r in counts.join(df.where(mine).select("term").distinct(), "term").collect()}
        if own:
            yield Index(own, known, n, mean)


def sent(docs: DataFrame, items: DataFrame, index_chars: int) -> list[Broadcast]:
    """The shards as broadcast files; the driver's process builds and holds one of them at a time.

    They are plain lists and arrays: executors need not know the class to load them.
    """
    return [docs.sparkSession.sparkContext.broadcast(vars(index)) for index in indexes(items, index_chars)]


def search_all(batches: Iterator[pa.RecordBatch], shards: list[Broadcast], held_chars: int = HELD_CHARS) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Slices of the batches, each with its (row, item id, score, question overlap, answer overlap) from every shard.

    One scan of the texts serves all shards. Of several, a task loads one at a time, for all of the texts it holds.
    """

    def flush(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[dict[tuple, tuple]] = [{} for _ in held]
        for shard in shards:
            index = Index.of(shard.value)
            for out, piece in zip(found, held):
                texts = piece.column(piece.schema.get_field_index("text")).to_pylist()
                for row, k, *rest in index.matches(texts):  # of several texts of an item, the best
                    out[row, index.ids[k]] = max(tuple(rest), out.get((row, index.ids[k]), tuple(rest)))
            if len(shards) > 1:
                del index
                shard.__dict__.pop("_value", None)  # it is read from its file again for the next texts
        yield from zip(held, ([(*key, *v) for key, v in out.items()] for out in found))

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            held.append(batch.slice(at, 256))
            size += held[-1].nbytes
            if len(shards) == 1 or size >= held_chars:
                yield from flush(held)
                held, size = [], 0
    yield from flush(held)


def contaminated(docs: DataFrame, items: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every leaked item in every document.

    Null and empty texts hold none; repeated rows give repeated pairs; extra columns are ignored; without documents or items
    there are no rows. score is the share of the item's own BM25 score.
    """
    shards = sent(docs, items, index_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for piece, found in search_all(batches, shards):
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(cols[0])), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no item, with their columns as they were."""
    shards = sent(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), INDEX_CHARS)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found in search_all(batches, shards):
            bad = {f[0] for f in found}
            yield piece.filter(pa.array([i not in bad for i in range(piece.num_rows)], pa.bool_()))

    return map_batches(docs, keep, docs.schema)
