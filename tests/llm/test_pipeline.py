"""The corpus pipeline on a small folder against its stages done one by one without Spark."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from hodoscope.llm import common, decontam, linedup, neardup, packing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder, n):
    rng = random.Random(21)
    words = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, say(rng.randint(20, 50)) + ". " + say(6)) for i in range(12)]
    texts = []
    for i in range(n):
        lines = [say(rng.randint(8, 60)) for _ in range(rng.randint(1, 5))]
        if i % 5 == 1:
            lines.append(lines[0] if rng.random() < 0.5 else "a common line of the one source, copied")
        if i % 11 == 2:
            lines[0] = f"{lines[0]} {items[i % 12][1]} {say(10)}"
        if i % 6 == 3:
            lines[-1] += " " + " ".join(rng.choice(["blargish", "snorfer", "grelks"]) for _ in range(4))
        if i % 9 == 4 and texts:
            own = rng.choice([t for t in texts if t]).split("\n")
            k = rng.randrange(len(own))
            lines = [*own[:k], own[k] + " " + say(1), *own[k + 1 :]]
        texts.append("\n".join(lines))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    if n:
        rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "solo", None, None, 4), (None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int("snorf" in t or "blarg" in t or "grelk" in t)) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def deduplicated(rows):
    """Rows with each line that equals an earlier one or lies within an edit of one left out; rows that lose all lines go."""
    seen, before, out = set(), [], []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = [] if t is None else t.split("\n")
        stay = []
        for line in own:
            s = line.strip(" \t\r")
            if not s:
                stay.append(line)
            elif s not in seen:
                seen.add(s)
                if not any(within_one(s, x) for x in before):
                    stay.append(line)
                before.append(s)
        if t is None or not any(x.strip(" \t\r") for x in own) or any(x.strip(" \t\r") for x in stay):
            out.append((d, None if t is None else "\n".join(stay)))
    return out


def one_of_each(rows):
    def shingles(t):
        w = common.word_ids(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if root(i) == i]


def clean_of(items, rows):
    df = collections.Counter(w for _, t in items for w in set(decontam.words(t)))
    ix = decontam.Index(items, df, len(items), sum(len(decontam.words(t)) for _, t in items) / len(items))
    weight = {(w, k): v for w, (ks, vs) in ix.postings.items() for k, v in zip(ks, vs)}

    def leaks(text):
        own, half = decontam.words(text), decontam.WINDOW // 2
        for w in range(len(own) // half + 2):
            here = set(own[max(0, (w - 1) * half) : (w + 1) * half])
            for k, (q, a) in enumerate(ix.texts):
                if sum(weight.get((t, k), 0) for t in here) >= decontam.SCORE:
                    more = max(half, len(q) + len(a))
                    span = own[max(0, (w - 1) * half - more) : (w + 1) * half + more]
                    if min(decontam.overlap(q, span), decontam.overlap(a, span)) >= decontam.OVERLAP:
                        return True
        return False

    return [r for r in rows if not leaks(r[1])]


def test_pipeline_against_plain_stages(spark, folder):
    from tokenizers import Tokenizer

    rows, items = make(spark, folder, 110)
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.train(docs, labels)
    p = chain.scores([t for _, t, *_ in rows])[:, chain.names.index("toxic")]
    now = [(d, t) for (d, t, *_), v in zip(rows, p) if not t or v < toxicity.THRESHOLD]
    gone = len(rows) - len(now)
    stages = [len(now)]
    for step in (deduplicated, one_of_each, lambda r: clean_of(items, r)):
        now = step(now)
        stages.append(len(now))
    assert gone >= 10 and stages[1] > stages[2] > stages[3]  # each filter had something to do
    model = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for d, t in now:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.asarray(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    out = corpus_pipeline.run(spark, folder).toPandas()
    got = [(None if d != d else int(d), *map(int, r)) for d, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 2048


def test_pipeline_on_empty_tables(spark, folder):
    make(spark, folder, 0)
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_are_those_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "neardup", "decontamination", "packing"]
    assert [f for _, f in corpus_pipeline.STAGES] == [toxicity.toxicity_stage, linedup.line_dedup_stage, neardup.neardup_stage, decontam.decontaminate_stage, packing.pack_stage]


@pytest.mark.parametrize("pair, near", [(("a", "b"), True), (("ab", "b"), True), (("abc", "b"), False), (("ab", "ba"), False)])
def test_plain_edit_check(pair, near):
    assert within_one(*pair) == near
