"""Small driver-side or per-group numerics: least squares, minimisers, binomial intervals. NumPy only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Fit:
    ok: bool
    params: np.ndarray
    errors: np.ndarray
    chi2: float
    ndf: int


def least_squares(model: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, start: np.ndarray, sigma: np.ndarray | None = None, steps: int = 60) -> Fit:
    """Levenberg-Marquardt with a central-difference Jacobian; errors from the curvature, scaled by chi2/ndf without sigma.

    model(x, p) also takes columns as parameters, for the values at x of several sets of them at once.
    """
    with np.errstate(all="ignore"):
        return _marquardt(model, x, y, start, sigma, steps)


def _marquardt(model: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, start: np.ndarray, sigma: np.ndarray | None, steps: int) -> Fit:
    p = np.asarray(start, float).copy()
    w = np.ones_like(y, float) if sigma is None else 1 / sigma
    residual = lambda q: (y - model(x, q)) * w
    r = residual(p)
    cost, damp, ok = float(r @ r), 1e-3, False
    jac = np.zeros((len(x), len(p)))
    if not math.isfinite(cost):
        return Fit(False, p, np.full(len(p), math.nan), math.nan, len(x) - len(p))
    for _ in range(steps):
        h = 1e-6 * np.maximum(1.0, np.abs(p))
        up, down = model(x, np.stack([p[:, None] + np.diag(h), p[:, None] - np.diag(h)], 1)[..., None])
        jac[:] = ((up - down) * w / (2 * h[:, None])).T
        if not np.isfinite(jac).all():
            break
        hess, grad = jac.T @ jac, jac.T @ r
        for _ in range(12):
            try:
                step = np.linalg.solve(hess + damp * np.diag(np.maximum(np.diag(hess), 1e-12)), grad)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            new = residual(p + step)
            value = float(new @ new)
            if math.isfinite(value) and value <= cost:
                break
            damp *= 4
        else:
            ok = True  # no step lowers the cost: at a minimum to the precision of the numbers
            break
        small = cost - value <= 1e-10 * max(cost, 1e-300) and np.all(np.abs(step) <= 1e-8 * np.maximum(1, np.abs(p)))
        p, r, cost, damp = p + step, new, value, max(damp / 5, 1e-12)
        if small or cost == 0:
            ok = True
            break
    ndf = len(x) - len(p)
    try:
        cov = np.linalg.inv(jac.T @ jac)
        scale = cost / ndf if sigma is None and ndf > 0 else 1.0
        errors = np.sqrt(np.maximum(np.diag(cov) * scale, 0))
    except np.linalg.LinAlgError:
        ok, errors = False, np.full(len(p), math.nan)
    return Fit(ok and bool(np.isfinite(p).all()), p, errors, cost, ndf)


def gaussian(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2)


def double_gaussian(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Two Gaussians of one mean: amplitude, mean, core width, tail amplitude, tail width."""
    return p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2) + p[3] * np.exp(-0.5 * ((x - p[1]) / p[4]) ** 2)


def _nonzero(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 1e-12, v)


def sigmoid_edge(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[0] / (1 + np.exp(-np.clip((x - p[2]) / _nonzero(p[3]), -700, 700))) + p[1]


def power_pulse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """amplitude, start, decay, baseline, power: amplitude * dt^power * exp(-dt/decay) after the start."""
    dt = np.maximum(x - p[1], 0)
    with np.errstate(all="ignore"):
        return np.where(dt > 0, p[0] * dt ** p[4] * np.exp(-np.clip(dt / _nonzero(p[2]), -700, 700)), 0) + p[3]


def histogram_fit(values: np.ndarray, bins: int, lo: float, hi: float, start: tuple[float, float, float] | None = None, within: tuple[float, float] | None = None) -> Fit:
    """Gaussian fit of a histogram's filled bins, weighted by the root of their counts; fewer than 20 entries do not fit."""
    counts, edges = np.histogram(values, bins, (lo, hi))
    return counts_fit(counts, (edges[1:] + edges[:-1]) / 2, start, within)


def counts_fit(counts: np.ndarray, centres: np.ndarray, start: tuple[float, float, float] | None = None, within: tuple[float, float] | None = None) -> Fit:
    bad = Fit(False, np.full(3, math.nan), np.full(3, math.nan), math.nan, 0)
    use = counts > 0
    if within:
        use &= (centres >= within[0]) & (centres <= within[1])
    if counts.sum() < 20 or use.sum() < 3:
        return bad
    c, x = counts[use].astype(float), centres[use]
    mean = float((c * x).sum() / c.sum())
    spread = math.sqrt(max(float((c * (x - mean) ** 2).sum() / c.sum()), 1e-24))
    fit = least_squares(gaussian, x, c, np.array(start or (c.max(), mean, spread)), np.sqrt(c))
    return Fit(fit.ok, np.array([fit.params[0], fit.params[1], abs(fit.params[2])]), fit.errors, fit.chi2, fit.ndf)


def core_gaussian(values: np.ndarray, bins: int = 160, reach: float = 2.5) -> Fit:
    """Gaussian of a distribution's core: seeded by median and scaled MAD, refitted within `reach` widths."""
    v = np.sort(values[np.isfinite(values)])
    if len(v) < 20:
        return Fit(False, np.full(3, math.nan), np.full(3, math.nan), math.nan, 0)
    mid = float(v[min(len(v) - 1, len(v) // 2)])
    mad = float(np.sort(np.abs(v - mid))[min(len(v) - 1, len(v) // 2)]) * 1.4826 or float(v.std()) or 1e-9
    lo, hi = mid - 6 * mad, mid + 6 * mad
    fit = histogram_fit(v, bins, lo, hi, (len(v) / bins, mid, mad))
    if fit.ok:
        again = histogram_fit(v, bins, lo, hi, tuple(fit.params), (fit.params[1] - reach * fit.params[2], fit.params[1] + reach * fit.params[2]))
        fit = again if again.ok else fit
    return fit


def log_beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * log_beta_cf(a, b, x) / a
    return 1 - front * log_beta_cf(b, a, 1 - x) / b


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if beta_cdf(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(passed: int, total: int, level: float = 0.683) -> tuple[float, float]:
    """Central binomial interval of a ratio."""
    alpha = (1 - level) / 2
    low = 0.0 if passed == 0 else beta_quantile(alpha, passed, total - passed + 1)
    high = 1.0 if passed == total else beta_quantile(1 - alpha, passed + 1, total - passed)
    return low, high


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, step: np.ndarray, calls: int = 600, tolerance: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """Downhill simplex: (point, value, whether it converged within the calls)."""
    n = len(start)
    simplex = [np.asarray(start, float)] + [np.asarray(start, float) + np.eye(n)[k] * step[k] for k in range(n)]
    values, used = [f(p) for p in simplex], n + 1
    while used < calls:
        order = np.argsort(values, kind="stable")
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + 1e-12) and all(np.all(np.abs(s - simplex[0]) <= 1e-4 * np.abs(step)) for s in simplex[1:]):
            return simplex[0], values[0], True
        centre = np.mean(simplex[:-1], 0)
        new = centre + (centre - simplex[-1])
        value = f(new)
        used += 1
        if value < values[0]:
            far = centre + 2 * (centre - simplex[-1])
            more = f(far)
            used += 1
            simplex[-1], values[-1] = (far, more) if more < value else (new, value)
        elif value < values[-2]:
            simplex[-1], values[-1] = new, value
        else:
            near = centre + 0.5 * ((new if value < values[-1] else simplex[-1]) - centre)
            less = f(near)
            used += 1
            if less < min(value, values[-1]):
                simplex[-1], values[-1] = near, less
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (s - simplex[0]) for s in simplex[1:]]
                values = [values[0]] + [f(s) for s in simplex[1:]]
                used += n
    k = int(np.argmin(values))
    return simplex[k], values[k], False


def cubic_fit(x: np.ndarray, y: np.ndarray, sigma: np.ndarray) -> np.ndarray | None:
    """Weighted cubic p0..p3, or None where it is not determined; points without an error are left out."""
    use = np.isfinite(y) & (sigma > 0)
    if use.sum() < 4:
        return None
    scale = max(np.abs(x[use]).max(), 1e-12)
    a = np.vander(x[use] / scale, 4, increasing=True) / sigma[use, None]
    p, _, rank, _ = np.linalg.lstsq(a, y[use] / sigma[use], rcond=None)
    return p / scale ** np.arange(4) if rank == 4 else None


def power_spectrum(wave: np.ndarray) -> np.ndarray:
    """|FFT|^2 / n of the non-negative frequencies."""
    return np.abs(np.fft.rfft(wave)) ** 2 / max(1, len(wave))
