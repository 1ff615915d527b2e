"""Each text operator against a brute-force version, an exact round trip or held-out accuracy on small fixtures."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hodoscope.llm import common, decontam, langid, licenses, linedup, neardup, packing, pii, secrets, topk, toxicity


# --- line dedup ----------------------------------------------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


@pytest.mark.parametrize("least, chars", [(1, (1, 12)), (1, (18, 60)), (20, (18, 60))])
def test_lines_against_all_pairs(spark, least, chars):
    rng, rows = random.Random(5), []
    base = ["".join(rng.choice("abcdé xyz") for _ in range(rng.randint(*chars))) for _ in range(40)]
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p, o = rng.randrange(len(s) + 1), rng.randrange(3)  # an insertion, a substitution or a deletion
                s = s[:p] + (rng.choice("abq") if o else "") + s[p + (o != 1) :]
            lines.append(s)
        rows.append((i, "\n".join(lines)))
    order = sorted((d, k, s) for d, t in rows for k, s in enumerate(linedup.split_lines(t)) if s)
    first, kept, before = {}, collections.defaultdict(list), []
    for d, k, s in order:
        if s in first:
            continue
        first[s] = (d, k)
        if not (len(s) >= least and any(within_one(s, x) for x in before)):
            kept[d].append(k)
        if len(s) >= least:
            before.append(s)
    out = {r["doc_id"]: r for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()}
    for d, t in rows:
        assert out[d]["text"] == "\n".join(s for k, s in enumerate(t.split("\n")) if not s.strip() or k in kept[d])
    assert sum(r["n_near"] for r in out.values()) > 50


# --- language ------------------------------------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    size = np.array([0, 1, 5, 32, 33, 64, 100, 0, 70])
    scores, moves = rng.normal(size=(size.sum(), 4)), rng.normal(size=(4, 4))
    got, at = langid.posteriors(scores, size, moves), 0
    for n in size:
        s, a, b = scores[at : at + n], [], [np.ones(4)]
        for t in range(n):
            a.append(np.exp(s[t]) * (a[-1] @ np.exp(moves) if a else 1))
        for t in range(n - 2, -1, -1):
            b.append(np.exp(moves) @ (np.exp(s[t + 1]) * b[-1]))
        if n:
            m = np.array(a) * np.array(b[::-1])
            assert np.allclose(m / m.sum(1, keepdims=True), got[at : at + n])
        at += n


def test_language_of_held_out_texts(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ein", "ung", "er"], "cc": ["eau", "oi", "tion", "ez"]}
    word = lambda g: "".join(rng.choice(syllables[g]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(g) for _ in range(rng.randint(3, 80))), g) for i in range(300) for g in [rng.choice(list(syllables))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, langid.train(docs)).collect()
    truth = {i: g for i, _, g in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert len(held) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_code_switched_words():
    texts = [["ka", "moti", "ruka"] * 10, ["schein", "ung", "erein"] * 10] * 30
    t = langid.fit(texts, ["aa", "bb"] * 30, steps=60)
    own = ["moti", "ruka"] * 6 + ["erein", "schein"] * 3
    assert 0.55 < t.shares([own])[0][0] < 0.78  # two thirds of the words


# --- secrets and personal data -------------------------------------------------------------------------------------------

ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def test_secret_base_spans():
    rng = random.Random(1)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ": ", "'", '"', " ", "AKIA", "ABCD1234", "deadbeefdeadbeef0123", "é", "ß", "x", "ghp_", "secret", "passwd", "\n", "ſecret", "0123456789abcdef"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        want = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [s for s in secrets.scan(t) if s[0] in ("assign", "access", "hex")] == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_checksums_are_validated():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"é ghp_{body}{secrets.base62_crc(body.encode()).decode()} x"
    assert secrets.scan(good) == [("forge", 2, 42)]
    assert secrets.scan(good[:-3] + "!" + good[-2:]) == []
    assert secrets.scan(f"npm_{body}000000") == []
    assert [s[0] for s in secrets.scan("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc123")] == ["jwt"]


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_personal_base_spans():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x.com", ".", "1", "23", "4539578763621486", "4539 5787 6362 1486", "+1", " ", "-", "255", "256", "é", "(", "555", ")", "\n", "192.168.0.1", "%", "+"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.read(t)[0] == brute_pii(t)


def test_patterns_discover_unseen_identifiers(spark):
    rng = random.Random(2)
    rows = [(i, f"zu {rng.random():.9f} please call me on +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} today") for i in range(30)]
    rows += [(100, "oh please call me on 555 123 4567 today ok"), (101, "number 555 123 4567 of the lot"), (102, "lot 777 123 9999 is sold")]
    out = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100]["n_found"] == 1 and out[100]["spans"] == "x_phone:21:33"
    assert out[102]["n_found"] == 0 and all(out[i]["n_phone"] == 1 for i in range(30))


def test_discovered_identifiers_induce_patterns(spark):
    """Numbers that the seeds' pattern names stand in another context too; that one names further numbers, in a later round."""
    number = lambda i: f"555 123 {4000 + i}"
    rows = [(i, f"zu {i} please call me on +1 555 {100 + i} {2000 + i} today") for i in range(30)]
    rows += [(100 + i, f"oh please call me on {number(i)} today ok and later ring us at {number(i)} always so") for i in range(20)]
    rows += [(200, f"or ring us at {number(99)} always so"), (201, f"lot {number(98)} is sold")]
    out = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[200]["n_found"] == 1 and out[100]["n_found"] == 2 and out[201]["n_found"] == 0


def test_discovery_against_plain_loops(spark):
    rng = random.Random(12)
    edges = {("email", rng.randrange(60), f"p{rng.randrange(14)}") for _ in range(260)}
    seeds = {v for _, v, _ in edges if v < 30}
    data = [("email", v, v in seeds, [p]) for _, v, p in edges]
    got = {r["value"] for r in pii.discovered(spark.createDataFrame(data, "kind string, value long, seed boolean, patterns array<string>")).collect()}
    names = collections.defaultdict(set)
    for _, v, p in edges:
        names[p].add(v)
    s, found = {}, set()
    for _ in range(40):
        conf = {}
        for p, own in names.items():
            known = sum(v in seeds for v in own)
            c = (known + sum(s.get(v, 0) for v in own)) / (len(own) + 1)
            if known + len(own & found) >= pii.LEAST_KNOWN and c >= pii.CONFIDENT / 2 and any(v not in seeds for v in own):
                conf[p] = c
        s = {v: 1 - np.prod([1 - min(0.999, conf[p]) for p in conf if v in names[p]]) for v in {v for _, v, _ in edges} - seeds if any(v in names[p] for p in conf)}
        found = {v for v in s if s[v] >= pii.FOUND and max(conf[p] for p in conf if v in names[p]) >= pii.CONFIDENT}
    assert got == found


# --- near duplicates -----------------------------------------------------------------------------------------------------


def test_components_against_all_pairs(spark):
    rng, rows = random.Random(7), []
    for g in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 5, 12, 60, 150]))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), ""), (len(rows) + 1, None)]
    out = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def shingles(t):
        w = common.word_ids(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        assert out[i]["n_shingles"] == len(sets[i])
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert [out[i]["component_id"] for i in range(len(rows))] == [root(i) for i in range(len(rows))]
    assert all(out[i]["kept"] == (root(i) == i) for i in range(len(rows)))


@pytest.mark.parametrize("sizes", [(256, 64, 256, 64), (16, 16, 8, 64), (16, 8, 8, 2)])
def test_large_groups_in_chunks_blocks_and_windows(spark, sizes):
    rng, rows = random.Random(9), []
    base = [f"w{i}" for i in range(100)]
    for i in range(150):  # a hub and spokes, most of which link with the hub only, some with other spokes only
        own = list(base)
        for p in rng.sample(range(100), 0 if i == 0 else rng.randint(1, 3)):
            own[p] = f"x{rng.randint(0, 3)}"
        rows.append((i, " ".join(own)))
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), *sizes).collect()}
    sets = [set(neardup.shingle_set(t).tolist()) for _, t in rows]
    up = list(range(150))
    for _ in range(150):
        for i in range(150):
            for j in range(150):
                if up[i] != up[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    up[i] = up[j] = min(up[i], up[j])
        if all(up[i] == up[j] for i in range(150) for j in range(150) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])):
            break
    assert [out[i] for i in range(150)] == up


def test_strays_meet_their_whole_group_however_many_blocks(spark, monkeypatch):
    """The first and the last document are linked, but stand in far cells of the order; a group of more than max_blocks blocks."""

    def text(*places):
        return " ".join(f"x{k}" if k in places else f"w{k}" for k in range(200))

    rows = [(0, text(10)), *((k, text(*range(30, 190, 20), 180 + k)) for k in range(1, 11)), (11, text(20))]
    in_order = lambda reps: reps.select(F.lit(0).alias("tree"), F.col("id").alias("rank"), F.lit(b"\0" * 64).alias("order"), "id", "agree")
    monkeypatch.setattr(neardup, "forest", in_order)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 1, 1, 1).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {0: 0, 11: 0} | {k: 1 for k in range(1, 11)}


def test_window_neighbours_are_those_of_the_sorted_order(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 3, (60, neardup.VALUES)).astype(np.uint32)  # few values, so that prefixes are shared
    data = [(i, i, i, 1, v.astype(">u4").tobytes(), v.astype(np.uint8).tobytes()) for i, v in enumerate(values)]
    ranked = neardup.forest(spark.createDataFrame(data, "id long, s1 long, s2 long, n_shingles long, sig binary, agree binary").repartition(5))
    got = [(r["tree"], r["id"]) for r in ranked.orderBy("rank").collect()]
    want = []
    for t in range(neardup.TREES):
        order = sorted((tuple(np.roll(v, -4 * t)[: neardup.DEPTH].tolist()), i) for i, v in enumerate(values))
        heads = collections.Counter(o[: neardup.LEAST_DEPTH] for o, _ in order)
        want += [(t, i) for o, i in order if heads[o[: neardup.LEAST_DEPTH]] > 1]
    assert got == want and [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(len(want)))


def test_one_document_of_several_texts_joins_their_groups(spark):
    a, b = (" ".join(f"w{k}" for k in range(s, s + 40)) for s in (0, 100))
    rows = [(7, a), (7, b), (3, b), (9, a + " x"), (9, ""), (4, "q r s t u v")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == [(3, 36, 3), (4, 2, 4), (7, 36, 3), (7, 36, 3), (9, 0, 9), (9, 37, 3)]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == got[200] == got[100] == 100 and 7 in got


# --- toxicity ------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows():
    rng = random.Random(4)
    common_words = [f"w{i}" for i in range(300)]
    bad = ["blarg", "snorf", "grelk"]

    def doc(toxic):
        own = [rng.choice(common_words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(bad) + rng.choice(["", "ish", "er"]))
        return " ".join(own)

    data = [(doc(t), t) for t in (rng.random() < 0.2 for _ in range(1200))]
    y = np.array([[0, t, 0] for _, t in data[:800]], float)
    chain = toxicity.fit_chain([toxicity.features(t) for t, _ in data[:800]], y, list(toxicity.CATEGORIES))
    p = chain.scores([t for t, _ in data[800:]])[:, 1] >= toxicity.THRESHOLD
    truth = np.array([t for _, t in data[800:]])
    assert (p & truth).sum() >= 0.95 * truth.sum() and (p & ~truth).sum() == 0
    assert (chain.scores([t for t, _ in data[800:]])[:, 2] < 0.01).all()  # no examples, never predicted


def test_toxicity_fit_draws_12000_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit_chain", lambda hashed, y, names: len(hashed))
    docs = spark.range(12_500).selectExpr("id AS doc_id", "concat('word ', id % 7) AS text")
    labels = spark.range(12_500).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert toxicity.train(docs, labels) == 12_000
    assert toxicity.train(docs.limit(9_000), labels.where("doc_id < 9000")) == 9_000


# --- licenses ------------------------------------------------------------------------------------------------------------


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        v = rng.sample(range(50), rng.randint(0, 9))
        best = max((sum(1 for _ in c) for k in range(1 << len(v)) for c in [[v[i] for i in range(len(v)) if k >> i & 1]] if c == sorted(c)), default=0)
        got = [v[i] for i in licenses.increasing(v)]
        assert got == sorted(got) and len(got) == best


def test_license_texts_are_found():
    mit = licenses.TEMPLATES["MIT"].replace("hereby ", "").replace("merge, ", "blend, ")
    text = "foo bar\n" + mit + "\nbaz " + licenses.TEMPLATES["ISC"] + " x " + licenses.TEMPLATES["MIT statement"] + licenses.TEMPLATES["MIT statement"]
    found = licenses.scan(text)
    assert [f[0] for f in found] == ["MIT", "ISC", "MIT statement", "MIT statement"]
    assert 0.97 < found[0][1] < 1 and found[1][1] == 1
    assert licenses.scan("released software under no terms at all, mit is a school") == []


def test_adjacent_license_copies_are_all_found():
    rng = random.Random(4)
    for name, text in licenses.TEMPLATES.items():
        for n, gap in [(2, 0), (3, 0), (3, 4), (2, 40), (7, 1)]:
            between = " " + "lorem " * gap
            found = licenses.scan("foo bar baz " * 30 + between.join([text] * n) + " sit amet" * 40)
            assert [(f[0], f[1]) for f in found] == [(name, 1.0)] * n
    own = licenses.TEMPLATES["MIT"].split()
    for _ in range(20):
        worn = [" ".join(w if rng.random() > 0.04 else rng.choice(["", "foo", w + " bar"]) for w in own) for _ in range(3)]
        assert [f[0] for f in licenses.scan("foo bar baz " * 30 + " ".join(worn) + " sit amet" * 40)] == ["MIT"] * 3


def test_license_prefilters_lose_nothing():
    ends = "foo bar baz " * 30, " sit amet" * 40
    for name, cut in [("BSD-2-Clause", (86, 104)), ("MPL-2.0", (28, 35)), ("ISC", (78, 99)), ("Zlib", (3, 25)), ("Unlicense", (14, 23)), ("Apache-2.0", (54, 70))]:
        own = [w for w, _, _ in licenses.words(licenses.TEMPLATES[name])]
        found = licenses.scan(ends[0] + " ".join(own[: cut[0]] + own[cut[1] :]) + ends[1])
        assert [(f[0], f[1]) for f in found] == [(name, 1 - (cut[1] - cut[0]) / len(own))]
    for name, text in licenses.TEMPLATES.items():  # a number before each word, as of lines
        own = [w for w, _, _ in licenses.words(text)]
        found = licenses.scan(ends[0] + " ".join(f"x{i} {w}" for i, w in enumerate(own)) + ends[1])
        assert [f[0] for f in found] == [name]
    rng = random.Random(2)
    for _ in range(200):
        size, need = rng.randint(2, 12), rng.randint(1, 9)
        want = collections.Counter(rng.choice("abcdef") for _ in range(size))
        own = [rng.choice("abcdefghijklm") for _ in range(60)]
        inside = {i for a, b in licenses.regions(own, want, size, need) for i in range(a, b)}
        for i in range(60):
            part = own[i : i + 2 * size]
            if sum((collections.Counter(part) & want).values()) >= need:
                assert all(x in inside for x in range(i, i + len(part)) if own[x] in want)


# --- decontamination -----------------------------------------------------------------------------------------------------


def bench():
    rng = random.Random(6)
    words = [f"b{i}" for i in range(400)] + ["the", "of", "a"] * 40
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 60))) + ". " + " ".join(rng.choice(words) for _ in range(6))) for i in range(80)]
    df = collections.Counter(w for _, t in items for w in set(decontam.words(t)))
    return rng, words, items, decontam.Index(items, df, len(items), sum(len(decontam.words(t)) for _, t in items) / len(items))


def test_wand_finds_all_above_threshold():
    rng, words, items, ix = bench()
    for _ in range(400):
        own = {rng.choice(words) for _ in range(40)} | set(decontam.words(rng.choice(items)[1])[: rng.randint(0, 60)])
        least, brute = rng.choice([0.1, 0.3, 0.5]), collections.Counter()
        for w in own & set(ix.postings):
            for k, v in zip(*ix.postings[w]):
                brute[k] += v
        got = {k for k, _ in ix.search(own, least)}
        assert {k for k, v in brute.items() if v >= least + 1e-9} <= got and all(brute[k] >= least - 1e-9 for k in got)


def test_planted_passages_are_found_and_others_not():
    rng, words, items, ix = bench()
    for _ in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(0, 500))]
        assert ix.matches([" ".join(own)]) == []
        k, at = rng.randrange(len(items)), rng.randint(0, len(own))
        text = " ".join([*own[:at], items[k][1].upper(), *own[at:]])
        assert [(m[0], ix.ids[m[1]]) for m in ix.matches([text])] == [(0, items[k][0])]
        question = " ".join(decontam.question_answer(items[k][1])[0])
        assert ix.matches([" ".join([*own[:at], question, *own[at:]])]) == []  # without its answer it is no leak


def test_long_items_are_found():
    rng = random.Random(9)
    words = [f"b{i}" for i in range(3000)] + ["the", "of", "a"] * 300
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(q) + ". " + say(a)) for i, (q, a) in enumerate([(30, 6), (120, 6), (300, 6), (600, 6), (650, 40), (1500, 6), (40, 700)])]
    df = collections.Counter(w for _, t in items for w in set(decontam.words(t)))
    ix = decontam.Index(items, df, len(items), sum(len(decontam.words(t)) for _, t in items) / len(items))
    for i, t in items * 6:
        before, after = say(rng.randint(0, 700)), say(rng.randint(0, 700))
        assert [m[1] for m in ix.matches([f"{before} {t} {after}"])] == [i]
        assert ix.matches([f"{before} {' '.join(decontam.question_answer(t)[0])} {after}"]) == []
    assert ix.matches([say(5000)]) == []


# --- packing -------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = ["Straße am Fluß, it's 2 o'clock! <|endoftext|> x", "ΑΣ ΟΔΟΣ — ﬁ ﬃ ́", "don't they'll I'M", None, ""]
    texts += [" ".join(rng.choice(["Auß", "thanedble", "été,", "42nd", "the", "of!!", "don't"]) for _ in range(rng.choice([5, 80, 900, 3000]))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = packing.pack_documents(docs).toPandas()
    model = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(np.asarray(ids[k : k + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 2048
    plain = packing.Bins(out["length"].tolist(), 2048)
    plain.best_fit(list(range(len(out))))
    assert out["sequence_id"].nunique() <= len(plain.bins)


def test_genetic_packing_beats_best_fit():
    rng = random.Random(1)
    sizes = [rng.randint(200, 900) for _ in range(300)]
    plain = packing.Bins(sizes, 2048)
    plain.best_fit(list(range(300)))
    island = packing.Evolution(sizes, 2048, 3)
    begun = island.random_grouping()
    best = island.run([], 6, 60)
    assert sorted(i for b in best.bins for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 2048 for b in best.bins)
    assert len(best.bins) <= len(plain.bins) < len(begun.bins)
    assert island.crossovers >= 1 and island.gains >= 1
    child = packing.crossover(best, plain, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(300))


def test_genetic_packing_on_lengths_of_documents():
    """From random groupings, some 8 percent above the bound, crossovers come within one bin of it."""
    rng = random.Random(2)
    for seed in range(4):
        sizes = [min(2047, int(rng.lognormvariate(6.2, 1))) + 1 for _ in range(4096)]
        island = packing.Evolution(sizes, 2048, seed)
        begun, best = len(island.random_grouping().bins), island.run([], 4, 40)
        assert len(best.bins) <= island.least + 1 and begun > 1.04 * island.least
        assert island.crossovers >= 1 and island.gains >= 1


def test_packing_in_many_blocks(spark):
    items = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1 + pmod(hash(id), 1500) AS length", "0L AS ids_crc32")
    out = packing.pack(items, block_items=256).toPandas()
    assert len(out) == 3000 and (out.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert out["sequence_id"].nunique() <= 1.02 * out["length"].sum() / 2048 + 1


# --- top-k ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [(2048, 16384), (2, 7)])
def test_topk_against_all_pairs(spark, blocks):
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 6)]) for i in range(60)]
    v = spark.createDataFrame([(i, i, x) for i, x in rows], "id long, row long, v array<long>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v.where("id % 10 = 0"), v, 4, *blocks).orderBy("query_id", "rank").collect()]
    want = []
    for q, a in rows:
        if q % 10 == 0:
            best = sorted((-int(np.dot(a, b)), i) for i, b in rows if i != q)[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_the_driver_gives_back_what_the_toxicity_fit_took(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity, "give_back", lambda: calls.append(1))
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(40)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert calls == [1] and chain.names == list(toxicity.CATEGORIES)
