"""Descriptive statistics of a value column by group.

Every function takes a long table and the grouping columns; NULL values are left out. Standard deviations name their
divisor: `samp` is n - 1, `pop` is n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MEAN_FLOOR, TINY


def ratio(a: Column, b: Column, floor: float = TINY, default: float | None = None) -> Column:
    """a / b, or default where |b| is at most floor or either is missing."""
    return F.when(F.abs(b) > floor, a / b).otherwise(F.lit(default).cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both values; NULL where either is constant (`corr` would divide by zero)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / (sx * sy))


def unbiased_skew(v: str, n: Column) -> Column:
    return F.when((n > 2) & (F.stddev_pop(v) > TINY), F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_excess(v: str, n: Column) -> Column:
    return F.when((n > 3) & (F.stddev_pop(v) > TINY), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))


POINTS = [0.01, 0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975, 0.99]


def quantile(x: Column, p: float) -> Column:
    """Interpolated quantile of a sorted array, in the order of operations of `percentile`; NULL if it is empty."""
    at = (F.size(x) - 1) * F.lit(p)
    low, high = F.floor(at), F.ceil(at)
    a, b = F.get(x, low.cast("int")), F.get(x, high.cast("int"))
    return F.when(F.size(x) > 0, F.when(a == b, a).otherwise((high - at) * a + (at - low) * b))


def first_true(x: Column, holds) -> Column:
    """How many leading elements of an array fail a condition that holds for all after the first it holds for, by halving."""
    mid = lambda s: F.floor((s["a"] + s["b"]) / 2).cast("int")
    state = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    half = lambda s: F.when(s["a"] >= s["b"], s).when(holds(F.get(x, mid(s))), state(s["a"], mid(s))).otherwise(state(mid(s) + 1, s["b"]))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(x) + 1.0)).cast("int"))
    return F.aggregate(steps, state(F.lit(0), F.size(x)), lambda s, _: half(s), lambda s: s["a"])


def profiled(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """One row a group: its sorted values `x` and its moments, by one aggregation. The descriptions below are expressions on
    this row, so none of them reads or joins the long table again."""
    n = F.count(value)
    return long.groupBy(*by).agg(
        n.alias("n"), F.sum(F.col(value).isNull().cast("long")).alias("n_missing"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.skewness(value).alias("skew_biased"), F.kurtosis(value).alias("excess_biased"), unbiased_skew(value, n).alias("skew"), unbiased_excess(value, n).alias("excess"),
        F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("x"),
    )


def with_quantiles(p: DataFrame) -> DataFrame:
    """p01 to p99, median, ends and mad of profiled groups."""
    at = {"median" if q == 0.5 else f"p{str(q)[2:].ljust(2, "0")}": quantile(F.col("x"), q) for q in POINTS}
    out = p.withColumns(at | {"min": F.get("x", F.lit(0)), "max": F.get("x", F.size("x") - 1)})
    out = out.withColumn("__d", F.sort_array(F.transform("x", lambda v: F.abs(v - F.col("median")))))
    return out.withColumn("mad", quantile(F.col("__d"), 0.5)).drop("__d")


def with_ratios(d: DataFrame) -> DataFrame:
    return d.withColumns({
        "range": F.col("max") - F.col("min"),
        "iqr": F.col("p75") - F.col("p25"),
        "cv": ratio(F.col("std"), F.abs("mean"), MEAN_FLOOR),
        "snr": ratio(F.abs("mean"), F.col("std")),
        "robust_cv": ratio(F.col("p75") - F.col("p25"), F.abs("median")),
        "median_mean": ratio(F.col("median"), F.col("mean")),
        "bimodality": ratio(F.col("skew_biased") ** 2 + 1, F.col("excess_biased") + 3),
        "missing_ratio": F.col("n_missing") / (F.col("n") + F.col("n_missing")),
    })


def describe(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, missing, moments, quantiles and their ratios; all quantiles come from one sorted array."""
    return with_ratios(with_quantiles(profiled(long, by, value))).drop("x", "mad")


def median_and_mad(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """median and mad = median |x - median| by group, of one sorted array."""
    return with_quantiles(profiled(long, by, value)).select(*by, "median", "mad")


def with_runs(p: DataFrame, x: str, name: str) -> DataFrame:
    """Runs of equal elements of the sorted array `x` as structs (v, c)."""
    p = p.withColumn("__s", F.when(F.size(x) > 0, F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))))
    cut = F.transform("__s", lambda at, j: F.struct(F.get(x, at).alias("v"), (F.coalesce(F.get("__s", j + 1), F.size(x)) - at).cast("long").alias("c")))
    return p.withColumn(name, cut).drop("__s")


def with_shares(p: DataFrame, digits: int = 12) -> DataFrame:
    """mode_share, distinct_share and top of profiled groups, of values rounded to `digits`."""
    out = with_runs(p.withColumn("__v", F.transform("x", lambda v: F.round(v, digits))), "__v", "__r").drop("__v")
    most, some = F.array_max(F.transform("__r", lambda r: r["c"])), F.when(F.col("n") > 0, F.col("n"))
    return out.withColumn("__m", most).withColumns({
        "top": F.get(F.filter("__r", lambda r: r["c"] == F.col("__m")), F.lit(0))["v"], "mode_share": F.round(F.col("__m") / some, 6), "distinct_share": F.round(F.size("__r") / some, 6),
    }).drop("__r", "__m")


def value_shares(long: DataFrame, by: list[str], value: str = "value", digits: int = 12) -> DataFrame:
    """mode_share (rounded to 6), distinct_share (rounded to `digits`), top (smallest of the most common values)."""
    return with_shares(profiled(long, by, value), digits).where("n > 0").select(*by, "n", "top", "mode_share", "distinct_share")


def with_bins(p: DataFrame, bins: int | None) -> DataFrame:
    """Histogram `h` of profiled groups: filled bins as structs (v, c); bins None: round(sqrt n) in 10..200."""
    k = F.lit(bins) if bins else F.least(F.lit(200), F.greatest(F.lit(10), F.bround(F.sqrt("n"), 0).cast("int")))
    lo, hi = F.col("__lo"), F.col("__hi")
    out = p.withColumns({"bins": k.cast("long"), "__lo": F.get("x", F.lit(0)), "__hi": F.get("x", F.size("x") - 1)})
    at = lambda v: F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * F.col("bins")), F.col("bins") - 1)).otherwise(0).cast("long")
    return with_runs(out.withColumn("__b", F.transform("x", at)), "__b", "h").drop("__b", "__lo", "__hi")


def histogram(long: DataFrame, by: list[str], value: str = "value", bins: int | None = 20) -> DataFrame:
    """(by, bin, count, n, bins): equal-width bins, the right edge in the last; bins None: round(sqrt n) in 10..200."""
    # Outer, since the filter that is inferred from a plain one would repeat the expression of `h` many times over.
    return with_bins(profiled(long, by, value).where("n > 0"), bins).select(*by, "n", "bins", F.inline_outer("h")).withColumnsRenamed({"v": "bin", "c": "count"})


def with_entropy(p: DataFrame, bins: int = 20) -> DataFrame:
    """Shannon entropy in bits of the histogram of profiled groups, and how many bins are filled."""
    share = lambda r: r["c"] / F.col("n")
    return with_bins(p, bins).withColumns({"entropy": -F.aggregate("h", F.lit(0.0), lambda t, r: t + share(r) * F.log2(share(r))), "filled": F.size("h").cast("long")}).drop("h", "bins")


def entropy(long: DataFrame, by: list[str], value: str = "value", bins: int = 20) -> DataFrame:
    """Shannon entropy in bits of the histogram."""
    return with_entropy(profiled(long, by, value), bins).where("n > 0").select(*by, "entropy", "filled")


def histogram_modes(long: DataFrame, by: list[str], value: str = "value", smooth: int = 3, least: float = 0.15) -> DataFrame:
    """Peaks of the adaptive histogram after a moving average of `smooth` bins, at least a share of the highest."""
    half = smooth // 2
    h = with_bins(profiled(long, by, value), None).where("n > 0").select(*by, F.map_from_entries("h").alias("h"), F.sequence(F.lit(0).cast("long"), F.col("bins") - 1).alias("at"))
    h = h.withColumn("c", F.transform("at", lambda b: F.coalesce(F.try_element_at("h", b), F.lit(0).cast("long"))))
    around = lambda i: F.slice("c", F.greatest(i - half, F.lit(0)) + 1, i + half + 1 - F.greatest(i - half, F.lit(0)))
    h = h.withColumn("s", F.transform("at", lambda b, i: F.aggregate(around(i), F.lit(0).cast("long"), lambda t, v: t + v) / F.lit(float(smooth)))).withColumn("top", F.array_max("s"))
    near = lambda i: F.coalesce(F.get("s", i), F.lit(-1.0))
    peak = F.filter("s", lambda s, i: (s > near(i - 1)) & (s >= near(i + 1)) & (s >= least * F.col("top")))
    return h.select(*by, F.size(peak).cast("long").alias("peaks")).withColumn("multimodal", F.col("peaks") >= 2)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """All double columns rounded, negative zero as zero."""
    return df.select(*(F.round(F.col(c) + F.lit(0.0), digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))
