"""The track search of one event, candidate by candidate: what the columnar search is held against."""

from __future__ import annotations

import math
from typing import Any

from hodoscope.config import TrackConfig


class Sums:
    """Running sums of a line, extended by a point at a time."""

    __slots__ = ("v",)

    def __init__(self, v: tuple[float, ...] = (0.0,) * 9):
        self.v = v

    def plus(self, x: float, y: float, z: float) -> Sums:
        return Sums(tuple(a + b for a, b in zip(self.v, (1.0, z, z * z, x, y, x * z, y * z, x * x, y * y))))

    def line(self, sx: float, sy: float) -> tuple[float, float, float, float, float]:
        n, z, zz, x, y, xz, yz, xx, yy = self.v
        det = n * zz - z * z
        if abs(det) <= 1e-12:
            return math.nan, math.nan, math.nan, math.nan, math.inf
        kx, ky = (n * xz - z * x) / det, (n * yz - z * y) / det
        bx, by = (x - kx * z) / n, (y - ky * z) / n
        chi = max(xx - kx * xz - bx * x, 0.0) / sx**2 + max(yy - ky * yz - by * y, 0.0) / sy**2
        return kx, ky, bx, by, chi / max(1.0, 2 * n - 4)


def _predict(line: tuple[float, ...], g: dict[str, float]) -> tuple[float, float] | None:
    kx, ky, bx, by = line[:4]
    along = kx * g["r02"] + ky * g["r12"] + g["r22"]
    if abs(along) < 1e-12:
        return None
    z = ((g["px"] - bx) * g["r02"] + (g["py"] - by) * g["r12"] + g["pz"] * g["r22"]) / along
    if z < 0:
        return None
    d = (kx * z + bx - g["px"], ky * z + by - g["py"], z - g["pz"])
    return g["r00"] * d[0] + g["r10"] * d[1] + g["r20"] * d[2], g["r01"] * d[0] + g["r11"] * d[1] + g["r21"] * d[2]


def search_event(layers: list[tuple[dict[str, float], list[dict[str, Any]]]], n_layers: int, c: TrackConfig) -> list[dict[str, Any]]:
    """Tracks of one event: seeds from the outer layers, a beam through the inner ones, then the best set without shared hits.

    layers: the detectors that have hits, by z, each with its hits; n_layers: all detectors. Ties are settled by hit numbers.
    """
    least = n_layers if n_layers <= 3 else n_layers - 1
    if n_layers < 3 or len(layers) < least:
        return []
    sx, sy = c.resolution_x, c.resolution_y
    first, last = layers[0][1], layers[-1][1]
    beam = []
    for i, a in enumerate(first):
        for j, b in enumerate(last):
            if len(beam) >= c.max_candidates:
                break
            sums = Sums().plus(a["gx"], a["gy"], a["gz"]).plus(b["gx"], b["gy"], b["gz"])
            line = sums.line(sx, sy)
            if math.isfinite(line[4]):
                beam.append(((i, *[-1] * (len(layers) - 2), j), sums, line, 2))
    for at in range(1, len(layers) - 1):
        geometry, hits = layers[at]
        grown = []
        for chosen, sums, line, n in beam:
            p = _predict(line, geometry)
            if p is not None:
                near = sorted((((h["x"] - p[0]) / sx) ** 2 + ((h["y"] - p[1]) / sy) ** 2, k) for k, h in enumerate(hits))
                for d2, k in near[: c.max_branches_per_layer]:
                    if d2 > c.gate_sigma**2:
                        break
                    more = sums.plus(hits[k]["gx"], hits[k]["gy"], hits[k]["gz"])
                    new = more.line(sx, sy)
                    if math.isfinite(new[4]):
                        grown.append((chosen[:at] + (k,) + chosen[at + 1 :], more, new, n + 1))
            if least < n_layers:
                grown.append((chosen, sums, line, n))
        grown.sort(key=lambda t: (-t[3], t[2][4], t[0]))
        beam = grown[: c.max_candidates]
    seen: dict[tuple[int, ...], tuple] = {}
    for t in beam:
        if t[3] >= least and t[2][4] <= c.max_chi2_ndf:
            seen.setdefault(t[0], t)
    pool = [(100.0 * t[3] - min(99.0, t[2][4]), t) for t in seen.values()]
    pool.sort(key=lambda s: (-s[0], s[1][0]))
    pool = pool[: c.final_candidates]
    chosen = independent_set([s for s, _ in pool], [t[0] for _, t in pool], c.max_tracks, c.conflict_search_nodes)
    return [{"line": pool[k][1][2], "hits": pool[k][1][0], "score": pool[k][0]} for k in chosen]


def independent_set(scores: list[float], picks: list[tuple[int, ...]], most: int, nodes: int) -> list[int]:
    """Indices (scores falling) of the heaviest set of candidates that share no hit of a layer: branch and bound from a greedy start.

    The search stops at the node limit with the best set so far.
    """
    n = len(scores)
    clash = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if any(a >= 0 and a == b for a, b in zip(picks[i], picks[j])):
                clash[i] |= 1 << j
                clash[j] |= 1 << i
    best: list[int] = []
    blocked = 0
    for i in range(n):
        if len(best) < most and not blocked >> i & 1:
            best.append(i)
            blocked |= clash[i]
    top, used = sum(scores[i] for i in best), 0
    stack: list[tuple[int, float, int, tuple[int, ...]]] = [(0, 0.0, 0, ())]
    while stack and used < nodes:
        at, score, blocked, chosen = stack.pop()
        used += 1
        if score > top:
            top, best = score, list(chosen)
        while at < n and blocked >> at & 1:
            at += 1
        free = most - len(chosen)
        if at == n or free <= 0:
            continue
        bound, k = score, at
        while k < n and free:
            if not blocked >> k & 1:
                bound, free = bound + scores[k], free - 1
            k += 1
        if bound <= top:
            continue
        stack.append((at + 1, score, blocked | 1 << at, chosen))
        stack.append((at + 1, score + scores[at], blocked | clash[at] | 1 << at, (*chosen, at)))
    return best
