"""Scalar and array expressions: finite checks, rounding, crossings, quantiles, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Whether a number is there and finite; Spark orders NaN above all numbers, so comparisons alone do not tell."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))


def half_away(x: Column) -> Column:
    """Round half away from zero."""
    return F.round(x)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def rising_crossing(wave: Column, target: Column, upto: Column) -> Column:
    """Interpolated sample of the first rise through target at samples 1..upto (0-based), or NULL."""
    at = F.get(F.filter(F.sequence(F.lit(1), upto), lambda i: (F.get(wave, i - 1) < target) & (F.get(wave, i) >= target)), F.lit(0))
    at = F.when(upto >= 1, at)
    y1, y2 = F.get(wave, at - 1).cast("double"), F.get(wave, at).cast("double")
    return (at - 1) + (target - y1) / (y2 - y1)


def falling_crossing(wave: Column, target: Column, after: Column) -> Column:
    """Interpolated sample of the first fall below target at samples after+1.. (0-based), or NULL."""
    last = F.size(wave) - 1
    steps = F.when(last > after, F.sequence(after + 1, last))
    at = F.get(F.filter(steps, lambda i: (F.get(wave, i - 1) >= target) & (F.get(wave, i) < target)), F.lit(0))
    y1, y2 = F.get(wave, at - 1).cast("double"), F.get(wave, at).cast("double")
    return (at - 1) + (y1 - target) / (y1 - y2)


def median_filter(wave: Column, window: int) -> Column:
    """Centred median of `window` samples, shrinking at the edges; the element at floor(n/2) of each neighbourhood."""
    radius = window // 2
    n = F.size(wave)

    def at(i: Column) -> Column:
        first = F.greatest(i - radius, F.lit(0))
        end = F.least(n, i + radius + 1)
        near = F.array_sort(F.slice(wave, first + 1, end - first))
        return F.get(near, F.floor(F.size(near) / 2).cast("int"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(wave)


#: Five rules for the element of n sorted values at fraction f; they differ, and each has its users.
QUANTILE_RULES = {
    "floor_fn": lambda f, n: F.least(n - 1, F.floor(F.lit(f) * n)),
    "floor_fn1": lambda f, n: F.floor(F.lit(f) * (n - 1)),
    "round_fn1": lambda f, n: F.round(F.lit(f) * (n - 1)),
    "upper_median": lambda f, n: F.floor(n / 2),
}


def array_quantile(values: Column, f: float, rule: str) -> Column:
    """Quantile of an array by a named rule, or by "median" (the mean of the two middle values)."""
    own = F.array_sort(values)
    n = F.size(own)
    if rule == "median":
        lo, hi = F.get(own, F.floor((n - 1) / 2).cast("int")), F.get(own, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (lo + hi) / 2)
    return F.when(n > 0, F.get(own, QUANTILE_RULES[rule](f, n).cast("int")))


#: Rows of a group that are ranked in one task; a larger group's wanted elements are narrowed down to fewer first.
RANKED_ROWS = 1_000_000
GRID = 2048


def group_quantile(df: DataFrame, keys: list[str], value: str, f: float, rule: str, name: str = "q") -> DataFrame:
    """Exact quantile per group; see group_quantiles."""
    return group_quantiles(df, keys, value, {name: (f, rule)})


def group_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]], ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """(keys, a column for each of wanted): exact quantiles per group, without sorting or gathering a whole large group.

    wanted: name -> (fraction, rule). A selection by repeated narrowing that carries all fractions of all groups: each pass
    counts the rows below and inside every bracket and takes a grid of approximate quantiles of those inside, from which the
    next bracket is chosen around the wanted rank; a pass leaves about a seven-hundredth of the rows. When a bracket holds at
    most ranked_rows rows, or one value, what is inside is ranked. Counts are exact, so a bracket that misses its rank is
    seen, and the one before it is ranked instead. Groups of at most ranked_rows rows are ranked at once, for all fractions
    together. Groups without a finite value have no row; rows with a null key take no part.
    """
    own = df.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("__v"))
    n = F.col("__n")

    def ranks(f: float, rule: str) -> tuple[Column, Column]:
        two = (F.floor((n - 1) / 2), F.floor(n / 2)) if rule == "median" else (QUANTILE_RULES[rule](f, n),) * 2
        return two[0].cast("long"), two[1].cast("long")

    grid = F.percentile_approx("__v", F.array(*(F.lit(k / GRID) for k in range(GRID + 1))), 5 * GRID)
    stats = own.groupBy(*keys).agg(F.count("*").alias("__n"))
    small = own.join(stats.where(n <= ranked_rows), keys).withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__v")) - 1)
    picks = {name: ranks(*of) for name, of in wanted.items()}
    few = small.groupBy(*keys).agg(*(F.avg(F.when(F.col("__k").between(*two), F.col("__v"))).alias(name) for name, two in picks.items()))
    large = stats.where(n > ranked_rows)
    if large.isEmpty():
        return few

    targets = F.inline(F.array(*(F.struct(F.lit(name).alias("__name"), two[0].alias("__first"), two[1].alias("__last")) for name, two in picks.items())))
    first = own.join(large.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("__n"), grid.alias("__grid"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    now = first.select(*keys, targets, F.lit(0).cast("long").alias("__below"), n.alias("__inside"), "__lo", "__hi", "__grid", F.lit(False).alias("__stop")).persist()
    wide = (F.col("__inside") > ranked_rows) & (F.col("__lo") < F.col("__hi")) & ~F.col("__stop")
    for _ in range(16):
        if now.where(wide).isEmpty():
            break
        place = lambda r: F.floor((F.col(r) - F.col("__below")) / F.col("__inside") * GRID).cast("int")
        ask = now.where(wide).withColumns({"__a": F.get("__grid", F.greatest(place("__first") - 1, F.lit(0))), "__b": F.get("__grid", F.least(place("__last") + 2, F.lit(GRID)))})
        rows = own.join(F.broadcast(ask.select(*keys, "__name", "__lo", "__hi", "__a", "__b")), keys).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
        inside = F.col("__v").between(F.col("__a"), F.col("__b"))
        kept = F.when(inside, F.col("__v"))
        got = rows.withColumn("__kept", kept).groupBy(*keys, "__name").agg(
            F.count_if(F.col("__v") < F.col("__a")).alias("__under"), F.count("__kept").alias("__in"), F.min("__kept").alias("__min"), F.max("__kept").alias("__max"),
            F.percentile_approx("__kept", F.array(*(F.lit(k / GRID) for k in range(GRID + 1))), 5 * GRID).alias("__next"),
        )
        both = ask.join(F.broadcast(got), [*keys, "__name"])
        below = F.col("__below") + F.col("__under")
        right = (below <= F.col("__first")) & (F.col("__last") < below + F.col("__in"))
        new = lambda c, old: F.when(right, F.col(c) if isinstance(c, str) else c).otherwise(F.col(old)).alias(old)
        stop = (~right | (F.col("__in") == F.col("__inside"))).alias("__stop")
        done = both.select(*keys, "__name", "__first", "__last", new(below, "__below"), new("__in", "__inside"), new("__min", "__lo"), new("__max", "__hi"), new("__next", "__grid"), stop)
        before, now = now, now.where(~wide).unionByName(done).persist()
        now.count()
        before.unpersist()
    ends = F.broadcast(now.where("__lo < __hi").select(*keys, "__name", "__first", "__last", "__below", "__lo", "__hi"))
    left = own.join(ends, keys).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
    rank = F.col("__below") + F.row_number().over(Window.partitionBy(*keys, "__name").orderBy("__v")) - 1
    found = left.withColumn("__k", rank).where(F.col("__k").between(F.col("__first"), F.col("__last"))).groupBy(*keys, "__name").agg(F.avg("__v").alias("__q"))
    found = found.unionByName(now.where("__lo = __hi").select(*keys, "__name", F.col("__lo").alias("__q")))
    return few.unionByName(found.groupBy(*keys).agg(*(F.max(F.when(F.col("__name") == name, F.col("__q"))).alias(name) for name in wanted)))


def bucket(x: Column, lo: float, hi: float, n: int) -> Column:
    """Histogram bin 1..n; 0 below the range, n+1 at or above its end, NULL for NaN and NULL."""
    return F.when(finite(x), F.when(x < lo, 0).when(x >= hi, n + 1).otherwise(F.least(F.floor((x - lo) / (hi - lo) * n) + 1, F.lit(n)))).cast("int")


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, n: int) -> DataFrame:
    """(keys, bin, count), with under- and overflow in bins 0 and n+1."""
    return df.withColumn("bin", bucket(F.col(value), lo, hi, n)).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count("*").alias("count"))


def histogram2d(df: DataFrame, keys: list[str], x: str, y: str, xr: tuple[float, float, int], yr: tuple[float, float, int]) -> DataFrame:
    binned = df.withColumns({"bin_x": bucket(F.col(x), *xr), "bin_y": bucket(F.col(y), *yr)}).where("bin_x IS NOT NULL AND bin_y IS NOT NULL")
    return binned.groupBy(*keys, "bin_x", "bin_y").agg(F.count("*").alias("count"))


def profile(df: DataFrame, keys: list[str], x: str, y: str, xr: tuple[float, float, int], yr: tuple[float, float] | None = None) -> DataFrame:
    """Mean of y per bin of x with its error (population spread over the root of the count); y outside yr is left out."""
    rows = df.withColumn("bin", bucket(F.col(x), *xr)).where(finite(F.col(y)) & F.col("bin").between(1, xr[2]))
    if yr:
        rows = rows.where(F.col(y).between(*yr))
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("count"), F.avg(y).alias("mean"), (F.stddev_pop(y) / F.sqrt(F.count("*"))).alias("error"))


def projection(hist: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """A 2-D histogram summed onto one axis ("bin_x" or "bin_y")."""
    return hist.groupBy(*keys, axis).agg(F.sum("count").alias("count"))


def huber(r: Column, k: float) -> Column:
    """Huber loss: quadratic up to k, linear beyond."""
    return F.when(F.abs(r) <= k, r * r / 2).otherwise(k * (F.abs(r) - k / 2))
