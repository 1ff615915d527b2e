"""Best-fit packing by a grouping genetic algorithm: islands of bins, crossover of well-filled bins, elite migration.

Documents are tokenised once; pieces of exactly the capacity are sequences of their own. The other pieces, whatever their
number, are dealt by hash to blocks of bounded size. Each block is evolved on several islands, which start from random
groupings; crossover injects the fullest bins of one parent into the other, drops the bins that hold duplicates, and
best-fits the displaced pieces. Between epochs the best solution of each island migrates to the next one. An island stops at
the lower bound (all pieces' length by the capacity), which no packing can beat. Bins that stay below a fill threshold are
opened again and their pieces dealt to fewer blocks, so what is left over from all blocks meets in the end in one.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.llm.common import cut, map_groups, map_rows, once

CAPACITY = 2048
#: Characters for which the tokenizer's normal form is str.lower() and its classes are those of WORDS below.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-įĲ-ňŊ-ž]*")
#: The tokenizer's split over such characters, after lower-casing.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\\sa-zß-öø-ž0-9]+")
#: Distinct words whose ids a worker remembers, about 100 MB; beyond them it starts anew.
MEMO_WORDS = 500_000


class Memo(dict):
    """Numbers of words; a word not met before gets the next one and is noted in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Token ids of texts; those of a word are remembered, as they depend on nothing else, in one flat table."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.memo = Memo()
        self.start, self.size, self.n_words = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0
        self.flat, self.n_flat = np.zeros(1 << 14, np.uint32), 0

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self) -> None:
        """Encode the new words as one text; a word ends at the one token of it that carries the vocabulary's word end."""
        new = self.memo.new
        ids = self.encoded([" ".join(new)])[0]
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            each = self.encoded(new)
            ids, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
        starts = np.concatenate([[0], ends[:-1]])
        while self.n_words + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        own = slice(self.n_words, self.n_words + len(new))
        self.start[own], self.size[own] = starts + self.n_flat, ends - starts
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.n_words, self.n_flat = own.stop, self.n_flat + len(ids)
        self.memo.new = []

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for a null or empty one."""
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        words = [WORDS.findall(t.lower()) if t and "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        n = [len(w) if w else 0 for w in words]
        number = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(w for w in words if w)), np.int64, sum(n))
        if self.memo.new:
            self.learn()
        size = self.size[number]
        last = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat(self.start[number] - last + size, size) + np.arange(last[-1] if len(last) else 0)]
        bounds = np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(n)])].tolist()
        none = np.zeros(0, np.uint32)
        return [ids[a:b] if w is not None else self.encoded([t])[0] if t else none for w, t, a, b in zip(words, texts, bounds, bounds[1:])]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and a separator, cut at capacity.

    A null or empty text is the separator alone. ids: little-endian unsigned 32-bit.
    """
    where = tokenizer or default_tokenizer()
    end = np.array([separator], np.uint32)

    def run(cols: dict[str, list]) -> dict[str, list]:
        enc = once(f"encoder {where}", lambda: Encoder(where))
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))}
        for doc, ids in zip(cols["doc_id"], enc.many(cols["text"])):
            raw = np.concatenate([ids, end]).astype("<u4").tobytes()
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                for n, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                    out[n].append(v)
        return out

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Bins:
    """A packing: bins as lists of item numbers with their free room; best fit through a sorted list of rooms."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def best_fit(self, items: list[int]) -> None:
        """Place items, longest first, each into the fullest bin that has room."""
        order = sorted((r, b) for b, r in enumerate(self.room))
        for i in sorted(items, key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[i]
            k = bisect.bisect_left(order, (size, -1))
            if k < len(order):
                _, b = order.pop(k)
                self.bins[b].append(i)
                self.room[b] -= size
            else:
                b = len(self.bins)
                self.bins.append([i])
                self.room.append(self.capacity - size)
            bisect.insort(order, (self.room[b], b))

    def keep(self, chosen: list[int]) -> None:
        self.bins, self.room = [self.bins[b] for b in chosen], [self.room[b] for b in chosen]

    def copy(self) -> Bins:
        new = Bins(self.sizes, self.capacity)
        new.bins, new.room = [list(b) for b in self.bins], list(self.room)
        return new

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the mean square fill (uneven fills leave room that can be used)."""
        return -len(self.bins), sum((1 - r / self.capacity) ** 2 for r in self.room) / max(1, len(self.bins))


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """b with a's fullest bins injected; b's bins that hold any injected item, or have more room than all injected ones, are
    opened, and the items so displaced are best-fitted."""
    best = sorted(range(len(a.bins)), key=lambda k: (a.room[k], k))
    take = best[: max(1, int(len(best) * rng.uniform(0.1, 0.7)))]
    most = a.room[take[-1]]
    injected = {i for k in take for i in a.bins[k]}
    child = Bins(a.sizes, a.capacity)
    displaced: list[int] = []
    for items, room in zip(b.bins, b.room):
        if room <= most and injected.isdisjoint(items):
            child.bins.append(list(items))
            child.room.append(room)
        else:
            displaced.extend(i for i in items if i not in injected)
    for k in take:
        child.bins.append(list(a.bins[k]))
        child.room.append(a.room[k])
    child.best_fit(displaced)
    return child


def mutate(a: Bins, rng: random.Random) -> Bins:
    """Open the emptiest bins and a few others, and best-fit their items again."""
    child = a.copy()
    order = sorted(range(len(child.bins)), key=lambda k: (-child.room[k], k))
    open_ = set(order[: max(1, len(order) // 20)]) | set(rng.sample(range(len(order)), min(len(order), 3)))
    loose = [i for k in open_ for i in child.bins[k]]
    child.keep([k for k in range(len(child.bins)) if k not in open_])
    child.best_fit(loose)
    return child


class Evolution:
    """The search of one island, and what it did: crossovers made, and those whose child became the best solution."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes, capacity, random.Random(seed)
        self.least = -(-sum(sizes) // capacity)
        self.crossovers = self.gains = 0

    def bins(self, given: list[list[int]]) -> Bins:
        one = Bins(self.sizes, self.capacity)
        one.bins, one.room = [list(b) for b in given], [self.capacity - sum(self.sizes[i] for i in b) for b in given]
        return one

    def random_grouping(self) -> Bins:
        """Items in a random order, each into the fullest of a few random bins with room, or a new one."""
        one, order, open_ = Bins(self.sizes, self.capacity), list(range(len(self.sizes))), []
        self.rng.shuffle(order)
        for i in order:
            size, best = self.sizes[i], -1
            for b in open_:
                if one.room[b] >= size and (best < 0 or one.room[b] < one.room[best]):
                    best = b
            if best < 0:
                best = len(one.bins)
                one.bins.append([])
                one.room.append(self.capacity)
                open_.append(best)
                if len(open_) > 8:
                    open_.pop(self.rng.randrange(8))
            one.bins[best].append(i)
            one.room[best] -= size
        return one

    def run(self, given: list[list[list[int]]], population: int, generations: int) -> Bins:
        """The best packing found; given: bins that came with the island or by migration."""
        pool = [self.bins(b) for b in given]
        pool += [self.random_grouping() for _ in range(population - len(pool))]
        pool.sort(key=Bins.fitness, reverse=True)
        for _ in range(generations):
            if len(pool[0].bins) <= self.least:
                break
            a, b = self.rng.sample(pool, 2) if len(pool) > 1 else (pool[0], pool[0])
            best = pool[0].fitness()
            pool += [crossover(a, b, self.rng), mutate(pool[0], self.rng)]
            self.crossovers += 1
            pool = sorted(pool, key=Bins.fitness, reverse=True)[:population]
            self.gains += pool[0].fitness() > best
        return pool[0]


def _solution(cols: dict[str, list]) -> tuple[list[int], list[int], list[list[list[int]]]]:
    """A group's items in a fixed order, their sizes, and the packing of each source island."""
    size = dict(zip(cols["uid"], cols["size"]))
    keys = sorted(size)
    at = {k: i for i, k in enumerate(keys)}
    packed: dict[int, dict[int, list[int]]] = {}
    for src, b, k in zip(cols["src"], cols["bin"], cols["uid"]):
        if src >= 0:
            packed.setdefault(src, {}).setdefault(b, []).append(at[k])
    return keys, [size[k] for k in keys], [[bins[b] for b in sorted(bins)] for _, bins in sorted(packed.items())]


def _islands(items: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> DataFrame:
    """(uid, size, block, bin, offset, fill): the best solution of each block after all epochs."""
    state = "uid long, size int, block long, island int, bin int"
    now = items.withColumn("src", F.lit(-1)).withColumn("bin", F.lit(-1)).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))

    for epoch in range(epochs):

        def step(key: tuple, cols: dict[str, list], epoch: int = epoch) -> list[tuple]:
            keys, sizes, given = _solution(cols)
            best = Evolution(sizes, capacity, hash((seed, epoch, *key)) & 0x7FFFFFFF).run(given, population, generations)
            return [(keys[i], sizes[i], *key, b) for b, own in enumerate(best.bins) for i in own]

        now = map_groups(now, ["block", "island"], step, state).withColumn("src", F.col("island"))
        if epoch + 1 < epochs:  # each island's best stays and also goes to the next island of the ring
            ring = F.when(F.col("src") == (F.col("src") + 1) % islands, F.array("src")).otherwise(F.array("src", (F.col("src") + 1) % islands))
            now = now.withColumn("island", F.explode(ring))

    def choose(key: tuple, cols: dict[str, list]) -> list[tuple]:
        keys, sizes, given = _solution(cols)
        here = Evolution(sizes, capacity, 0)
        best = max(map(here.bins, given), key=Bins.fitness)
        out = []
        for b, (own, room) in enumerate(zip(best.bins, best.room)):
            offset = 0
            for i in own:
                out.append((keys[i], sizes[i], *key, b, offset, capacity - room))
                offset += sizes[i]
        return out

    return map_groups(now, ["block"], choose, "uid long, size int, block long, bin int, offset long, fill long")


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = 4096, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 20, good_fill: float = 0.99, max_rounds: int = 8) -> DataFrame:
    """items with sequence_id and offset added; their column length lies in 1..capacity.

    Repeated rows are packed each; an empty table gives an empty result. sequence_id holds round, block and bin in its bits.
    """
    # a row's number is fixed by the written table; no window over a key that many rows may share
    items = cut(items.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == capacity
    placed = items.where(full).select("uid", (F.lit(1 << 62) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, before = items.where(~full).select("uid", F.col("length").cast("int").alias("size")), None
    for round_ in range(max_rounds):
        n = rest.count()
        if not n:
            break
        blocks = -(-n // block_items)
        last = blocks == 1 or round_ == max_rounds - 1 or (before is not None and n > 0.9 * before)
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(blocks)))
        solved = cut(_islands(dealt, capacity, islands, epochs, population, generations, round_), f"packed{round_}")
        done = solved if last else solved.where(F.col("fill") >= good_fill * capacity)
        placed = placed.union(done.select("uid", (F.lit(round_ << 58) + F.shiftleft(F.col("block"), 20) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        rest, before = solved.where(F.col("fill") < good_fill * capacity).select("uid", "size"), n
    return items.join(placed, "uid").drop("uid")


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document.

    A null or empty text is one piece, the separator alone; rows of null doc_id and repeated rows are packed like others;
    a text longer than a sequence is cut into full pieces and a last one; extra columns are ignored.
    """
    out = pack(pieces(docs.select("doc_id", "text"), tokenizer))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_bestfit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the packed pieces of what the stages before kept."""
    return pack_documents(docs)
