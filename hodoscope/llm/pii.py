"""Personal data by bootstrapped contextual extraction.

Entities that expressions find with certainty are seeds. The words around each span are its lexical patterns; identifiers
that no expression accepts (an address without a domain, a number without its prefix) are further instances. Patterns and
instances form a bipartite graph, whose scores Spark iterates: a pattern is as good as the share of its instances that are
known, an instance as good as the patterns that name it. Instances named by patterns of high confidence are discovered.
Scores use grouped sums over distinct (pattern, instance) pairs, so no group is ever gathered.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.llm.common import cut, map_rows

#: Base kinds as listed, then the kinds of discovered spans.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "x_email", "x_ip", "x_card", "x_phone"]
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Begun at the start of a run of digits only and without giving digits back: where that fails, a later start in the run does.
IP = re.compile(rb"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(rb"[0-9]")
#: Instances that may be identifiers: number groups, and tokens with an at sign.
NUMBER = re.compile(rb"(?<![A-Za-z0-9_])\(?[0-9][0-9().:-]*(?:\x20[0-9(][0-9().-]*)*(?![A-Za-z0-9_])")
AT = re.compile(rb"(?<![^\s@\"'<>()\[\],;|])[^\s@\"'<>()\[\],;|]++@[^\s@\"'<>()\[\],;|]++")
#: A pattern needs so many distinct known instances and that confidence; the score of a discovered instance; an end to rounds.
LEAST_KNOWN, CONFIDENT, FOUND, MAX_ROUNDS = 5, 0.8, 0.8, 20
LETTER = re.compile(r"[^\W\d_]")
NEAR = re.compile(r"\w+|[^\w\s]")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(buf: bytes) -> list[tuple[int, int]]:
    out, taken, at = [], 0, buf.find(b"@")
    while at >= 0:
        start = at
        while start > taken and buf[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(buf, at + 1) if start < at else None
        if m:
            taken = m.end()
            out.append((start, taken))
        at = buf.find(b"@", at + 1)
    return out


def base_spans(buf: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds in byte offsets, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(buf)] if b"@" in buf else []
    if DIGIT.search(buf):
        out += [("ip", *m.span()) for m in IP.finditer(buf) if all(int(p[-18:]) <= 255 and not p[:-18].strip(b"0") for p in m[0].split(b"."))]
        for m in CARD.finditer(buf):
            digits = m[0].replace(b" ", b"").replace(b"-", b"")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if b"+" in buf:
            out += [("phone", *m.span()) for m in PHONE.finditer(buf) if 8 <= sum(48 <= c <= 57 for c in m[0]) <= 15]
    return out


def guess(token: bytes) -> str | None:
    """The kind an identifier that is no base entity may be of, by its form."""
    if b"@" in token:
        return "email"
    digits = sum(48 <= c <= 57 for c in token)
    if 12 <= digits <= 19:
        return "card"
    if re.fullmatch(rb"[0-9]+(?:\.[0-9]+){3}(?::[0-9]+)?", token):
        return "ip"
    return "phone" if 7 <= digits <= 11 else None


def patterns(before: str, after: str) -> list[str]:
    """Lexical patterns of a place: two words before it, one before and one after, and two after; digits count as one sign."""
    left = [w if not w.isdigit() else "0" for w in NEAR.findall(before.lower())][-2:]
    right = [w if not w.isdigit() else "0" for w in NEAR.findall(after.lower())][:2]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(right) == 2:
        out.append(f"_ {right[0]} {right[1]}")
    return [p for p in out if LETTER.search(p)]  # signs alone name nothing


def _points(buf: bytes, places: list[int]) -> dict[int, int]:
    """Byte places of UTF-8 as code points."""
    if buf.isascii():
        return {p: p for p in places}
    starts = np.flatnonzero((np.frombuffer(buf, np.uint8) & 0xC0) != 0x80)
    return dict(zip(places, np.searchsorted(starts, places).tolist())) if places else {}


def read(text: str | None) -> tuple[list[tuple[str, int, int]], list[dict]]:
    """Base spans and all instances (seeds and candidates) of a text, in code points."""
    if not text:
        return [], []
    buf = text.encode("utf-8", "surrogatepass")
    base = base_spans(buf)
    covered = sorted((s, e) for _, s, e in base)
    rows = [(s, e, k, True) for k, s, e in base]
    found = [m.span() for m in AT.finditer(buf)] if b"@" in buf else []
    if DIGIT.search(buf):
        found += [m.span() for m in NUMBER.finditer(buf)]
    starts, last = [s for s, _ in covered], 0
    for s, e in sorted(found):
        while e > s and buf[e - 1] in b".:-( ":
            e -= 1
        if s < last or any(a < e and s < b for a, b in _near(covered, starts, s, e)):
            continue
        kind = guess(buf[s:e])
        if kind:
            rows.append((s, e, kind, False))
            last = e
    point = _points(buf, sorted({x for r in rows for x in r[:2]}))
    spans = [(k, point[s], point[e]) for k, s, e in base]
    cands = []
    for s, e, kind, seed in rows:
        before = buf[max(0, s - 64) : s].decode("utf-8", "ignore")
        after = buf[e : e + 64].decode("utf-8", "ignore")
        cands.append({"start": point[s], "end": point[e], "kind": kind, "seed": seed, "value": xxhash.xxh64_intdigest(kind.encode() + buf[s:e].lower()) - (1 << 63), "patterns": patterns(before, after)})
    return spans, cands


def _near(covered: list[tuple[int, int]], starts: list[int], s: int, e: int) -> list[tuple[int, int]]:
    """The covered spans that may meet s..e; base spans of different kinds can lie in one another, so some before s too."""
    return covered[max(0, bisect.bisect_left(starts, s) - 4) : bisect.bisect_left(starts, e)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def discovered(instances: DataFrame) -> DataFrame:
    """(kind, value) of identifiers beyond the seeds that confident patterns name. instances: kind, value, seed, patterns.

    Each round scores patterns by the instances known so far, and instances by their patterns; what is discovered is known in
    the next round, where it lends its own patterns the support to discover more. Rounds end when scores change no more.
    """
    edges = cut(instances.select("kind", "value", "seed", F.explode("patterns").alias("pattern")).distinct(), "edges")
    patterns_ = cut(edges.groupBy("kind", "pattern").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds")).where(F.col("n") > F.col("seeds")), "patterns")
    # only patterns of an instance that is open, and enough instances to count, ever name one
    open_ = cut(edges.where(~F.col("seed")).select("kind", "value", "pattern").join(patterns_.where(F.col("n") >= LEAST_KNOWN), ["kind", "pattern"]), "open")
    values, found = None, None
    for round_ in range(MAX_ROUNDS):
        if values is None:
            scored = open_.groupBy("kind", "pattern").agg(F.max("n").alias("n"), F.max("seeds").alias("seeds")).withColumns({"s": F.lit(0.0), "more": F.lit(0)})
        else:
            scored = open_.join(values, ["kind", "value"], "left").groupBy("kind", "pattern").agg(F.max("n").alias("n"), F.max("seeds").alias("seeds"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.count(F.when(F.col("found"), 1)).alias("more"))
        # a pattern's confidence: the share of its distinct instances that are known, with one unknown added
        p = ((F.col("seeds") + F.col("s")) / (F.col("n") + 1)).alias("p")
        scored = scored.where(F.col("seeds") + F.col("more") >= LEAST_KNOWN).select("kind", "pattern", p).where(F.col("p") >= CONFIDENT / 2)
        named = open_.join(scored, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999)))))).alias("s"), F.max("p").alias("best"))
        values = cut(named.withColumn("found", (F.col("s") >= FOUND) & (F.col("best") >= CONFIDENT)), f"scores{round_}")
        before, found = found, values.agg(F.count(F.when(F.col("found"), 1)), F.round(F.sum("s"), 3)).first()
        if found == before:
            break
    return values.where("found").select("kind", "value")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found for every row of docs.

    A null or empty text has no spans. Repeated rows give repeated results; rows of null doc_id are read like others; extra
    columns are ignored. n_found counts the discovered spans (kinds x_email, x_ip, x_card, x_phone).
    """

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = [read(t) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"],
            "rid": cols["rid"],
            **{f"n_{k}": [sum(s[0] == k for s in f[0]) for f in found] for k in BASE},
            "base": [joined(f[0]) for f in found],
            "cands": [f[1] for f in found],
        }

    src = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")
    one = cut(map_rows(src, run, "doc_id long, rid long, n_email long, n_ip long, n_card long, n_phone long, base string, cands array<struct<start:int,end:int,kind:string,seed:boolean,value:long,patterns:array<string>>>"), "spans")
    each = one.select("rid", F.explode("cands").alias("c")).select("rid", "c.*")
    values = discovered(each.select("kind", "value", "seed", "patterns"))
    new = each.where(~F.col("seed")).select("rid", "kind", "value", "start", "end").join(values, ["kind", "value"]).select("rid", "kind", "start", "end").distinct()
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(BASE) for x in (k, i)]), F.col("kind"))
    label = F.concat_ws(":", F.concat(F.lit("x_"), F.col("kind")), "start", "end")
    new = new.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "start", "end", label.alias("s")))).alias("x"))
    out = one.drop("cands").join(new, "rid", "left")
    extra = F.array_join(F.transform("x", lambda v: v.s), ",")
    spans = F.when(F.col("x").isNull(), F.col("base")).when(F.col("base") == "", extra).otherwise(F.concat_ws(",", "base", extra))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.when(F.col("x").isNull(), 0).otherwise(F.size("x")).cast("long").alias("n_found"))


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
