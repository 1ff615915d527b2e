"""Alignment: driver loops whose every step is one aggregate over cached rows; only a few numbers come to the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.config import AlignmentConfig, PadAlignmentConfig
from hodoscope.functions import geometry


@dataclass(frozen=True)
class Alignment:
    """Corrections per detector (dx, dy, dz, rx, ry, rz), the loss before and after, and the iterations used."""

    corrections: dict[int, tuple[float, ...]]
    before: float
    after: float
    iterations: int
    converged: bool


def corrections_table(spark, found: Alignment) -> DataFrame:
    """Alignment as rows, so that a later run can use it: (det, dx, dy, dz, rx, ry, rz, loss_before, loss_after)."""
    rows = [(d, *map(float, c), float(found.before), float(found.after)) for d, c in sorted(found.corrections.items())]
    return spark.createDataFrame(rows, "det int, dx double, dy double, dz double, rx double, ry double, rz double, loss_before double, loss_after double")


def _wide(points: DataFrame, ids: list[int]) -> DataFrame:
    """One row per event with lx_<det>, ly_<det> of its single local hit in each tracker."""
    pick = [F.max(F.when(F.col("det") == d, F.col(a))).alias(f"l{a}_{d}") for d in ids for a in ("x", "y")]
    return points.where(F.col("det").isin(*ids)).groupBy("entry").agg(*pick).dropna()


def batch_sums(rows: DataFrame, fn: Callable[[pd.DataFrame, np.ndarray], np.ndarray], points: list[np.ndarray]) -> np.ndarray:
    """Sums over all rows of fn(frame, point), a row of numbers per point: one pass, and a few partial sums per Arrow batch."""
    width = len(fn(rows.limit(1).toPandas(), points[0]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame([(k, j, float(v)) for k, p in enumerate(points) for j, v in enumerate(fn(frame, p))], columns=["k", "j", "v"])

    out = np.zeros((len(points), width))
    for r in rows.mapInPandas(run, "k int, j int, v double").groupBy("k", "j").agg(F.sum("v").alias("v")).collect():  # points x width
        out[r["k"], r["j"]] = r["v"]
    return out


def huber_sum(r: np.ndarray, k: float) -> float:
    a = np.abs(r)
    return float(np.where(a <= k, r * r / 2, k * (a - k / 2)).sum())


def tracker_losses(dets: list[dict[str, float]], shifts: dict[int, tuple[float, ...]], sigma: tuple[float, float], k: float, frame: pd.DataFrame) -> np.ndarray:
    """(rows, summed Huber loss of the pulls of leave-one-out residuals over all trackers) of event rows."""
    pts = []
    for g in dets:
        d, c = g["det"], shifts[g["det"]]
        r = geometry.rotation(g["rx"] + c[3], g["ry"] + c[4], g["rz"] + c[5])
        lx, ly = frame[f"lx_{d}"].to_numpy(), frame[f"ly_{d}"].to_numpy()
        pts.append([g[f"p{a}"] + c[i] + r[3 * i] * lx + r[3 * i + 1] * ly for i, a in enumerate("xyz")])
    v = np.array(pts)  # tracker, axis, row
    n, total = len(dets) - 1, 0.0
    z = v[:, 2]
    sz = z.sum(0) - z
    szz = (z * z).sum(0) - z * z - sz * sz / n
    away = z - sz / n
    lever = np.sqrt(1 + 1 / n + away**2 / szz)
    for a in (0, 1):
        u = v[:, a]
        su = u.sum(0) - u
        slope = ((u * z).sum(0) - u * z - su * sz / n) / szz
        total += huber_sum((u - su / n - slope * away) / (sigma[a] * lever), k)
    return np.array([len(frame) * 2 * len(dets), total])


def descend(losses, start: np.ndarray, step: np.ndarray, most: np.ndarray, iterations: int, relative: float, small: np.ndarray, patience: int) -> tuple[np.ndarray, float, float, int, bool]:
    """(point, its loss, the first loss, iterations, converged) of a quasi-Newton descent over a loss that Spark evaluates.

    losses(points) gives the losses of several points from one aggregate: per iteration one for the central differences and
    one for four step lengths. Steps are bounded by `most`; a direction that does not lower the loss ends the descent.
    """
    n, x = len(start), np.array(start, float)
    eye = np.eye(n)
    first = best = losses([x])[0]
    inverse, before, calm = None, None, 0
    for used in range(1, iterations + 1):
        around = np.array(losses([x + s * step[k] * eye[k] for k in range(n) for s in (1, -1)]))
        up, down = around[::2], around[1::2]
        slope = (up - down) / (2 * step)
        if not np.isfinite(slope).all():
            return x, best, first, used, False
        if inverse is None:
            inverse = np.diag(1 / np.maximum((up + down - 2 * best) / step**2, 1e-9))
        elif before is not None and (dg := slope - before[1]) @ (dx := x - before[0]) > 1e-300:
            rho = 1 / (dg @ dx)
            left = eye - rho * np.outer(dx, dg)
            inverse = left @ inverse @ left.T + rho * np.outer(dx, dx)
        move = np.clip(-inverse @ slope, -most, most)
        lengths = (1.0, 0.5, 0.2, 0.05)
        tries = losses([x + f * move for f in lengths])
        k = int(np.argmin(tries))
        if not tries[k] < best:
            return x, best, first, used, True
        before = (x, slope)
        x, gain, best = x + lengths[k] * move, best - tries[k], tries[k]
        calm = calm + 1 if (np.abs(lengths[k] * move) < small).all() or gain < relative * max(abs(best), 1e-12) else 0
        if calm >= patience:
            return x, best, first, used, True
    return x, best, first, iterations, False


def align_trackers(local: DataFrame, dets: DataFrame, c: AlignmentConfig, sigma: tuple[float, float] = (0.12, 0.12)) -> Alignment:
    """dx, dy and rz of all trackers but the first, on events with one hit in each: the robust loss of their pulls is descended."""
    known = sorted((r.asDict() for r in dets.where("role = 'tracker'").collect()), key=lambda d: (d["pz"], d["det"]))
    ids = [g["det"] for g in known]
    rows = _wide(local, ids).persist()
    try:
        none = {d: (0.0,) * 6 for d in ids}
        if len(ids) < 3 or rows.count() < c.min_tracks:
            return Alignment(none, math.nan, math.nan, 0, False)
        free = [(d, p) for d in ids[1:] for p in (0, 1, 5)]
        shift = np.array([p < 5 for _, p in free])

        def moved(delta: np.ndarray) -> dict[int, tuple[float, ...]]:
            new = {d: list(v) for d, v in none.items()}
            for (d, p), v in zip(free, delta):
                new[d][p] = float(v)
            return {d: tuple(v) for d, v in new.items()}

        def losses(points: list[np.ndarray]) -> list[float]:
            got = batch_sums(rows, lambda frame, p: tracker_losses(known, moved(p), sigma, c.huber_k, frame), points)
            return list(got[:, 1] / np.maximum(got[:, 0], 1))

        most_calls = max(1, c.max_function_calls // (2 * len(free) + 4))
        x, after, before, used, done = descend(losses, np.zeros(len(free)), np.where(shift, 0.01, 1e-4), np.where(shift, c.max_shift_step, c.max_rotation_step), min(c.max_iterations, most_calls), c.relative_loss_tolerance, np.where(shift, c.shift_tolerance, c.rotation_tolerance), c.convergence_patience)
        return Alignment(moved(x), before, after, used, done)
    finally:
        rows.unpersist()


def _predicted(g: dict[str, float], shift: tuple[float, ...], frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Local predictions of track rows at a plane detector with corrections; NaN where there are none."""
    r = geometry.rotation(g["rx"] + shift[3], g["ry"] + shift[4], g["rz"] + shift[5])
    p = [g[f"p{a}"] + shift[i] for i, a in enumerate("xyz")]
    kx, ky, bx, by = (frame[n].to_numpy(float) for n in ("kx", "ky", "bx", "by"))
    along = kx * r[2] + ky * r[5] + r[8]
    with np.errstate(all="ignore"):
        z = np.where(np.abs(along) >= 1e-12, ((p[0] - bx) * r[2] + (p[1] - by) * r[5] + p[2] * r[8]) / along, np.nan)
    d = [kx * z + bx - p[0], ky * z + by - p[1], z - p[2]]
    return r[0] * d[0] + r[3] * d[1] + r[6] * d[2], r[1] * d[0] + r[4] * d[1] + r[7] * d[2]


#: Annealing of the strip alignment: matching width in mm and least dominance of the best cluster.
STAGES = ((2.0, 0.0), (1.0, 0.55), (0.5, 0.75))


def align_strip_dut(tracks: DataFrame, clusters: DataFrame, detector: dict[str, float], iterations: int = 15, scan: int = 101, scan_range: float = 0.2, free: tuple[int, ...] = (0, 1, 3, 4, 5), region: tuple[float, float, float, float] | None = None) -> Alignment:
    """dx, dy, rx, ry, rz of a strip detector (dz stays), from tracks (entry, kx..by) and clusters (entry, axis, centre).

    rx starts at the best of a scan; then three stages of soft matching with narrowing width minimise the mean square
    residual plus penalties on its mean and on its slope along y. A residual's weight falls with its distance from the
    nearest cluster; the matches of an event are folded in expressions, so several points share one aggregate. region: the
    least and largest local x and y of predictions that count.
    """
    arr = F.sort_array(F.collect_list(F.when(F.col("axis") == "x", F.col("centre")))), F.sort_array(F.collect_list(F.when(F.col("axis") == "y", F.col("centre"))))
    own = clusters.groupBy("entry").agg(arr[0].alias("cx"), arr[1].alias("cy"))
    rows = tracks.select("entry", "kx", "ky", "bx", "by").join(own, "entry").where("size(cx) > 0 AND size(cy) > 0").persist()

    def soft(pred: np.ndarray, centres: pd.Series, width: float) -> tuple[np.ndarray, np.ndarray]:
        most = max(map(len, centres))
        res = np.array([[*c, *[np.nan] * (most - len(c))] for c in centres], float) - pred[:, None]
        low = np.nanmin(res**2, axis=1, keepdims=True)
        w = np.nan_to_num(np.exp((low - res**2) / (2 * width * width)))
        return (w * np.nan_to_num(res)).sum(1) / w.sum(1), 1 / w.sum(1)

    def terms(frame: pd.DataFrame, shift: np.ndarray, width: float, dominance: float) -> np.ndarray:
        px, py = _predicted(detector, tuple(shift), frame)
        (rx, dx), (ry, dy) = soft(px, frame["cx"], width), soft(py, frame["cy"], width)
        ok = (dx >= dominance) & (dy >= dominance) & np.isfinite(px)
        if region:
            ok &= (px >= region[0]) & (px <= region[1]) & (py >= region[2]) & (py <= region[3])
        rx, ry, u = rx[ok], ry[ok], py[ok]
        return np.array([ok.sum(), (rx**2 + ry**2).sum(), rx.sum(), ry.sum(), u.sum(), (u * u).sum(), (u * ry).sum()])

    def objectives(points: list[tuple[float, ...]], width: float, dominance: float) -> list[float]:
        n, c, x, y, u, uu, uy = batch_sums(rows, lambda frame, p: terms(frame, p, width, dominance), [np.array(p) for p in points]).T
        with np.errstate(all="ignore"):
            slope = np.nan_to_num((uy - u * y / n) / (uu - u * u / n))
            out = c / n + 1e4 * slope**2 + 100 * ((x / n) ** 2 + (y / n) ** 2)
        return np.where(n > 0, out, math.inf).tolist()

    try:
        zero = (0.0,) * 6
        start = objectives([zero], *STAGES[0])[0]
        angles = np.linspace(-scan_range, scan_range, scan)
        at = zero
        seen = objectives([(0.0, 0.0, 0.0, float(a), 0.0, 0.0) for a in angles], *STAGES[0])
        if min(seen) < start:
            at = (0.0, 0.0, 0.0, float(angles[int(np.argmin(seen))]), 0.0, 0.0)
        turn = np.array([i > 2 for i in free])
        used, value, done = 0, math.inf, False
        for stage in STAGES:
            f = lambda points, stage=stage: objectives([_with(zero, free, p) for p in points], *stage)
            best, value, _, n, done = descend(f, np.array([at[i] for i in free]), np.where(turn, 1e-3, 0.05), np.where(turn, 0.05, 2.0), iterations, 1e-4, np.where(turn, 1e-6, 1e-3), 2)
            at, used = _with(zero, free, best), used + n
        return Alignment({int(detector["det"]): at}, start, value, used, done)
    finally:
        rows.unpersist()


def _with(base: tuple[float, ...], free: tuple[int, ...], values: Any) -> tuple[float, ...]:
    new = list(base)
    for i, v in zip(free, values):
        new[i] = float(v)
    return tuple(new)


PAD_FREE = {"dx": 0, "dy": 1, "dz": 2, "rotX": 3, "rotY": 4, "rotZ": 5}


def alignment_metrics(matches: DataFrame, candidates: int) -> dict[str, float]:
    """Candidates, matches, mean and rms of the residuals of both axes."""
    r = matches.agg(F.count("*"), F.avg("res_x"), F.avg("res_y"), F.sqrt(F.avg(F.col("res_x") ** 2)), F.sqrt(F.avg(F.col("res_y") ** 2))).first()
    return dict(zip(("candidates", "matches", "mean_x", "mean_y", "rms_x", "rms_y"), (candidates, *r)))


def align_pad_dut(detector: dict[str, float], c: PadAlignmentConfig, match) -> Alignment:
    """Selected parameters of a pad detector: matches are frozen per pass, then a Huber loss is minimised.

    match(shift) -> rows (kx, ky, bx, by, x, y): tracks with the local position of their matched cluster under a correction.
    A pass counts only if it converged, lowered the loss and has enough matches; passes end when the change is small.
    """
    free = tuple(PAD_FREE[p] for p in c.parameters)
    delta = c.huber_delta if c.huber_delta > 0 else 0.5 * min(detector["pad_pitch_x"], detector["pad_pitch_y"])
    at = (0.0,) * 6
    first = last = math.nan
    done = False
    used = 0
    for used in range(1, c.max_passes + 1):
        rows = match(at).persist()
        try:
            if rows.count() < c.min_matches:
                break

            def losses(points: list[np.ndarray], rows: DataFrame = rows, at: tuple[float, ...] = at) -> list[float]:
                shifts = [_with(at, free, p) for p in points]

                def terms(frame: pd.DataFrame, shift: np.ndarray) -> np.ndarray:
                    px, py = _predicted(detector, tuple(shift), frame)
                    return np.array([len(frame), huber_sum(frame["x"].to_numpy() - px, delta) + huber_sum(frame["y"].to_numpy() - py, delta)])

                got = batch_sums(rows, terms, [np.array(s) for s in shifts])
                far = [any(abs(v) > (c.max_translation if i < 3 else c.max_rotation) for i, v in enumerate(s)) for s in shifts]
                return [math.inf if f else float(v) for f, v in zip(far, got[:, 1] / np.maximum(got[:, 0], 1))]

            old = np.array([at[i] for i in free])
            turn = np.array([i > 2 for i in free])
            best, value, before, _, ok = descend(losses, old, np.where(turn, 1e-4, 0.02), np.where(turn, 0.02, 5.0), 20, c.tolerance * 1e-2, np.where(turn, c.rotation_convergence, c.shift_convergence), 2)
            first = before if math.isnan(first) else first
            if not ok or value >= before:
                last = before
                break
            small = all(abs(b - o) < (c.shift_convergence if i < 3 else c.rotation_convergence) for b, o, i in zip(best, old, free))
            at, last = _with(at, free, best), value
            if small:
                done = True
                break
        finally:
            rows.unpersist()
    return Alignment({int(detector["det"]): at}, first, last, used, done)


def merged(*found: Alignment) -> Alignment:
    out = found[0]
    for f in found[1:]:
        out = replace(out, corrections=out.corrections | f.corrections)
    return out
