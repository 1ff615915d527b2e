"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions only at hits, then embedded checksum validation.

Texts are scanned as UTF-8 bytes (every expression is ASCII, so offsets fall on character borders) and offsets are turned
into code points for the spans found. Hexadecimal strings carry no keyword; their prefilter is a byte-class mask: a run of
24 always covers a whole aligned block of 12.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from hodoscope.llm.common import map_rows, once

#: The kinds in their listed order; the first three are the base kinds.
KINDS = ["assign", "access", "hex", "forge", "registry", "jwt", "pem"]
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(rb"[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign", "akia": "access", "ghp_": "forge", "gho_": "forge", "ghu_": "forge", "ghs_": "forge", "ghr_": "forge", "npm_": "registry", "eyj": "jwt", "-----begin ": "pem"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def _hex_blocks(buf: bytes) -> np.ndarray:
    """Starts of aligned blocks of 12 that are all [0-9a-f]."""
    table = np.zeros(256, bool)
    table[list(b"0123456789abcdef")] = True
    n = len(buf) // 12
    return np.flatnonzero(table[np.frombuffer(buf, np.uint8, n * 12)].reshape(n, 12).all(1)) * 12 if n else np.zeros(0, int)


def base62_crc(body: bytes) -> bytes:
    """The six-digit checksum that forge and registry tokens carry: CRC-32 of the body in base 62."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.encode()


def _valid(kind: str, m: re.Match) -> bool:
    """Embedded checks: a token's own checksum, a JSON header, or the length a DER key states of itself."""
    if kind in ("forge", "registry"):
        return m[2] == base62_crc(m[1])
    try:
        if kind == "jwt":
            head = m[0].split(b".")[0]
            return isinstance(json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4))).get("alg"), str)
        der = base64.b64decode(re.sub(rb"\s", b"", m[2]), validate=True)
        if m[1] == b"OPENSSH ":
            return der.startswith(b"openssh-key-v1\0")
        wide = der[1] & 0x7F if der[1] & 0x80 else 0
        size = int.from_bytes(der[2 : 2 + wide], "big") if wide else der[1]
        return der[0] == 0x30 and len(der) == 2 + wide + size
    except (ValueError, AttributeError, IndexError, RecursionError):
        return False


RULES = {"assign": ASSIGN, "access": ACCESS, "forge": CHECKED, "registry": CHECKED, "jwt": JWT, "pem": PEM}


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed; leftmost and non-overlapping per kind."""
    if not text:
        return []
    buf = text.encode("utf-8", "surrogatepass")
    spans: list[tuple[str, int, int]] = []
    taken = dict.fromkeys(KINDS, 0)
    hits = [(end + 1 - size, kind) for end, (kind, size) in once("secret keywords", _automaton).iter(buf.lower().decode("latin-1"))]
    for at, kind in sorted(hits):
        if at < taken[kind]:
            continue
        if not (m := RULES[kind].match(buf, at)):
            if kind == "jwt":  # what follows this run decides for every start in it
                taken[kind] = JWT_RUN.match(buf, at).end()
            continue
        taken[kind] = m.end()
        if kind == "assign":
            good = len(m[2]) >= 6
        elif kind == "access":
            good = len(m[0]) >= 20
        else:
            good = _valid(kind, m)
        if good:
            spans.append((kind, at, m.end()))
    for at in _hex_blocks(buf):
        if at < taken["hex"]:
            continue
        start = int(at)
        while start and buf[start - 1] in b"0123456789abcdef":
            start -= 1
        end = taken["hex"] = HEX.match(buf, start).end()
        if end - start >= 24:
            spans.append(("hex", start, end))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans if len(buf) == len(text) else in_code_points(buf, spans)


def in_code_points(buf: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets of UTF-8 as code points: the bytes before each that do not continue a character."""
    if not spans:
        return []
    starts = np.flatnonzero((np.frombuffer(buf, np.uint8) & 0xC0) != 0x80)
    at = np.searchsorted(starts, [(s, e) for _, s, e in spans])
    return [(k, int(s), int(e)) for (k, _, _), (s, e) in zip(spans, at)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked for every row of docs.

    A null or empty text has no spans. Repeated rows give repeated results; rows of null doc_id are scanned like others;
    extra columns are ignored; an empty table gives no rows. n_checked counts the spans confirmed by a checksum.
    """

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = [scan(t) for t in cols["text"]]
        base = [[s for s in f if s[0] in ("assign", "access", "hex")] for f in found]
        count = lambda kind: [sum(s[0] == kind for s in f) for f in base]
        return {
            "doc_id": cols["doc_id"],
            "n_assign": count("assign"),
            "n_access": count("access"),
            "n_hex": count("hex"),
            "base_sha256": [hashlib.sha256(joined(f).encode()).hexdigest() for f in base],
            "spans": [joined(f) for f in found],
            "n_checked": [len(f) - len(b) for f, b in zip(found, base)],
        }

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
