"""Fits of many distributions at once: histograms of all keys in one aggregate, each fitted in a task of its own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodoscope.functions import numerics
from hodoscope.functions.columns import finite

SHAPES = ("gaussian", "double")
#: Normal-equation residual below which a fit counts as settled.
SETTLED = 1e-4
FIT = "entries long, used int, mean double, rms double, fitted boolean, centre double, sigma double, centre_error double, sigma_error double, core_sigma double, tail_sigma double, effective_sigma double, tail_fraction double, chi2 double, ndf int, gradient double"


def spans(rows: DataFrame, keys: list[str], value: str, reach: float, bins: int) -> DataFrame:
    """(keys, entries, mean, rms, low, width): a histogram's range, `reach` rms to both sides of the mean, from the data itself."""
    own = rows.where(finite(F.col(value))).groupBy(*keys).agg(F.count("*").alias("entries"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("rms"))
    rms = F.when(F.col("rms") > 0, F.col("rms")).otherwise(1e-9)
    return own.withColumns({"low": F.col("mean") - reach * rms, "width": 2 * reach * rms / bins})


def histograms(rows: DataFrame, keys: list[str], value: str, bins: int = 160, reach: float = 6.0) -> DataFrame:
    """(keys, bin from 0, count, and the columns of spans): counts over ranges that depend on the data, per key.

    Two aggregates: moments, then bins; the ranges, a row a key, are sent to the rows. Keys are parts of the set-up: rows that
    met by a few keys would meet in a few tasks.
    Values outside a range have no bin. Keys whose values all lie outside don't occur.
    """
    both = rows.where(finite(F.col(value))).join(F.broadcast(spans(rows, keys, value, reach, bins)), keys)
    at = F.floor((F.col(value) - F.col("low")) / F.col("width")).cast("int")
    return both.withColumn("bin", at).where(F.col("bin").between(0, bins - 1)).groupBy(*keys, "bin").agg(F.count("*").alias("count"), *(F.first(c).alias(c) for c in ("entries", "mean", "rms", "low", "width")))


def fit_histograms(hist: DataFrame, keys: list[str], shape: str = "gaussian") -> DataFrame:
    """One row a key of FIT: a least-squares fit of the filled bins, weighted by the roots of their counts.

    gaussian: centre and sigma with errors. double: two Gaussians of one centre; sigma is the core's, effective_sigma the
    root of the area-weighted mean variance, tail_fraction the tail's share of the area; where two can't be told apart, the
    tail is empty and as wide as the core. Fewer than 20 entries, or a fit that
    fails, give fitted = false with the moments. gradient: the largest normal-equation residual |J'W(n - f)|, each relative
    to its parameter's curvature and error: far below 1 at a minimum. A group is one key's bins.
    """
    if shape not in SHAPES:
        raise ValueError(f"shape is {shape!r}, not one of {SHAPES}")
    names = [f.split(" ")[0] for f in FIT.split(", ")]
    kinds = dict(hist.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), FIT])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        one = frame.iloc[0]
        n, x = frame["count"].to_numpy(float), one["low"] + (frame["bin"].to_numpy(float) + 0.5) * one["width"]
        out = dict.fromkeys(names) | {"entries": one["entries"], "used": len(n), "mean": one["mean"], "rms": one["rms"], "fitted": False, "centre": one["mean"], "sigma": one["rms"]}
        order = np.argsort(x)
        fit = numerics.counts_fit(n[order], x[order], (n.max(), one["mean"], one["rms"]))
        model, x, n = numerics.gaussian, x[order], n[order]
        if fit.ok and shape == "double":
            a, m, s = fit.params
            start = np.array([a * 0.8, m, s * 0.8, a * 0.2, s * 2.5])
            for _ in range(4):  # begun anew from where it stopped, until the normal equations hold
                two = numerics.least_squares(numerics.double_gaussian, x, n, start, np.sqrt(n), steps=200)
                start = two.params
                good = two.ok and min(two.params[0], two.params[3]) >= 0 and min(abs(two.params[2]), abs(two.params[4])) > 0
                if good and _gradient(numerics.double_gaussian, x, n, two.params) < SETTLED:
                    model, fit = numerics.double_gaussian, two
                    break
        if fit.ok:
            p = fit.params
            out |= {"fitted": True, "centre": p[1], "sigma": abs(p[2]), "centre_error": fit.errors[1], "sigma_error": fit.errors[2], "chi2": fit.chi2, "ndf": fit.ndf, "gradient": _gradient(model, x, n, p)}
            if shape == "double" and len(p) == 3:
                out |= {"core_sigma": abs(p[2]), "tail_sigma": abs(p[2]), "effective_sigma": abs(p[2]), "tail_fraction": 0.0}
            elif shape == "double":
                core, tail = sorted([(abs(p[2]), p[0]), (abs(p[4]), p[3])])
                area = core[0] * core[1] + tail[0] * tail[1]
                share = tail[0] * tail[1] / area if area else 0.0
                out |= {"sigma": core[0], "core_sigma": core[0], "tail_sigma": tail[0], "tail_fraction": share, "effective_sigma": math.sqrt(max((1 - share) * core[0] ** 2 + share * tail[0] ** 2, 0.0))}
        return pd.DataFrame([[*key, *(out[k] for k in names)]], columns=[*keys, *names])

    return hist.groupBy(*keys).applyInPandas(run, schema)


def _gradient(model, x: np.ndarray, n: np.ndarray, p: np.ndarray) -> float:
    jac = np.empty((len(x), len(p)))
    for k in range(len(p)):
        h = 1e-6 * max(1.0, abs(p[k]))
        step = np.zeros(len(p))
        step[k] = h
        jac[:, k] = (model(x, p + step) - model(x, p - step)) / (2 * h) / np.sqrt(n)
    r = (n - model(x, p)) / np.sqrt(n)
    return float(np.max(np.abs(jac.T @ r) / np.maximum(np.sqrt((jac**2).sum(0)), 1e-300)))


def fit_residuals(rows: DataFrame, keys: list[str], value: str, shape: str = "double", bins: int = 160, reach: float = 6.0) -> DataFrame:
    """fit_histograms of a residual, with the shares of all its rows within 3 and 5 sigma of the centre.

    All rows are in the denominators, also those without a finite value; keys without one have no row.
    """
    fit = fit_histograms(histograms(rows, keys, value, bins, reach), keys, shape)
    both = rows.join(F.broadcast(fit.select(*keys, "centre", "sigma")), keys)  # a row a key
    near = lambda k: (F.count_if(F.coalesce(F.abs(F.col(value) - F.col("centre")) < k * F.col("sigma"), F.lit(False))) / F.count("*")).alias(f"within_{k}sigma")
    return fit.join(both.groupBy(*keys).agg(near(3), near(5)), keys)
