"""Sequence operators: differences, rolling and recursive statistics, trends, as-of and interval joins.

Series are rows (by, order, value). Windows partition by the series key, so a series is one task's unit of work; series
are many and each is short (sessions of a user).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import EPS, MEAN_FLOOR, TINY
from .describe import correlation, profiled, with_quantiles


def _w(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def first_seen_order(df: DataFrame, by: list[str], session: str, pos: str) -> DataFrame:
    """seq: order of sessions by first appearance, with rows of a session kept together."""
    first = F.min(pos).over(Window.partitionBy(*by, session))
    return df.withColumn("first", first).withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy("first", pos)).cast("long")).drop("first")


def differences(df: DataFrame, by: list[str], order: str, value: str, lag: int = 1) -> DataFrame:
    return df.withColumn("diff", F.col(value) - F.lag(value, lag).over(_w(by, order)))


def session_change(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Mean and standard deviation (n - 1) of the absolute change from one row to the next."""
    d = differences(df.where(F.col(value).isNotNull()), by, order, value)
    return d.groupBy(*by).agg(F.avg(F.abs("diff")).alias("change_mean"), F.stddev_samp(F.abs("diff")).alias("change_std"))


def autocorrelation(df: DataFrame, by: list[str], order: str, value: str, lags=(1, 2)) -> DataFrame:
    """Pearson correlation of the series with itself shifted; NULL where either part is constant."""
    w = _w(by, order)
    d = df.where(F.col(value).isNotNull()).withColumns({f"l{k}": F.lead(value, k).over(w) for k in lags})
    out = [correlation(F.col(value), F.col(f"l{k}")).alias(f"autocorr_{k}") for k in lags]
    return d.groupBy(*by).agg(*out)


def successive_ratio_variance(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    d = df.where(F.col(value).isNotNull()).withColumn("before", F.lag(value).over(_w(by, order)))
    return d.groupBy(*by).agg(F.var_samp(F.when(F.abs("before") > TINY, F.col(value) / F.col("before"))).alias("ratio_variance"))


def with_rank_dispersion(d: DataFrame) -> DataFrame:
    """The column of `rank_dispersion` for profiled groups with quantiles."""
    iqr = F.col("p75") - F.col("p25")
    return d.withColumn("rank_dispersion", F.when((F.col("n") > 1) & (iqr > TINY), (F.col("max") - F.col("min")) / (F.col("n") - 1) / iqr))


def rank_dispersion(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean gap of the sorted values over their interquartile range; the gaps sum to the range."""
    return with_rank_dispersion(with_quantiles(profiled(df, by, value))).select(*by, "rank_dispersion")


def rolling_cv(df: DataFrame, by: list[str], order: str, value: str, size: int = 5, factor: float = 1.3, positive: float = 0.5) -> DataFrame:
    """Drift by rolling coefficients of variation: mean of the later half over `factor` times the earlier's, rising."""
    w = _w(by, order)
    r = w.rowsBetween(1 - size, 0)
    # A rise is a comparison of neighbours that are often equal but for rounding, so squares are summed as the SQL's engine does.
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))
    mean = lambda s, x: s["m"] + (x - s["m"]) / (s["n"] + 1)
    add = lambda s, x: F.struct((s["n"] + 1).alias("n"), mean(s, x).alias("m"), (s["q"] + (x - mean(s, x)) * (x - s["m"])).alias("q"))
    std = F.aggregate(F.col("part"), start, add, lambda s: F.sqrt(s["q"] / F.lit(size - 1)))
    d = df.where(F.col(value).isNotNull()).withColumns({"part": F.collect_list(F.col(value).cast("double")).over(r), "avg": F.avg(value).over(r)})
    d = d.withColumn("cv", F.when((F.size("part") == size) & (F.abs("avg") > MEAN_FLOOR), std / F.abs("avg"))).drop("part", "avg")
    d = d.where(F.col("cv").isNotNull()).withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(*by)), "up": F.col("cv") - F.lag("cv").over(w)})
    half = F.floor(F.col("n") / 2)
    out = d.groupBy(*by).agg(
        F.max("n").alias("windows"), F.avg(F.when(F.col("k") <= half, F.col("cv"))).alias("early"), F.avg(F.when(F.col("k") > half, F.col("cv"))).alias("late"), F.sum((F.col("up") > 0).cast("long")).alias("rises"))
    return out.withColumn("drifting", F.coalesce((F.col("late") > factor * F.col("early")) & (F.col("rises") >= F.ceil(positive * (F.col("windows") - 1))), F.lit(False)))


def ewma(df: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """(by, k, ewma): recursive mean seeded with the first value, folded over the ordered array of each series."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(rows.alias("x"))
    fold = F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), F.slice("x", 1, 1), lambda acc, x: F.concat(acc, F.array(alpha * x + (1 - alpha) * F.element_at(acc, -1))))
    return out.select(*by, F.posexplode(fold).alias("k", "ewma")).withColumn("k", F.col("k").cast("long") + 1)


def longest_run(df: DataFrame, by: list[str], order: str, value: str, persistence: float = 0.3) -> DataFrame:
    """Longest run of one sign among differences (|d| <= EPS breaks it), against a share of the series' length."""
    w = _w(by, order)
    d = differences(df, by, order, value).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    d = d.where(F.col("diff").isNotNull()).withColumn("sign", F.when(F.col("diff") > EPS, 1).when(F.col("diff") < -EPS, -1).otherwise(0))
    d = d.withColumn("island", F.sum(F.when(F.col("sign") == F.lag("sign").over(w), 0).otherwise(1)).over(w))
    runs = d.groupBy(*by, "n", "island", "sign").agg(F.count(F.lit(1)).alias("length"))
    out = runs.groupBy(*by, "n").agg(*(F.coalesce(F.max(F.when(F.col("sign") == s, F.col("length"))), F.lit(0)).alias(name) for s, name in ((1, "up"), (-1, "down"))))
    need = F.ceil(persistence * F.col("n"))
    return out.withColumn("direction", F.when(F.col("up") >= need, "up").when(F.col("down") >= need, "down").otherwise("none"))


def half_shift(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Median of the first n div 2 values and of the rest, and their difference."""
    d = df.where(F.col(value).isNotNull()).withColumns({"k": F.row_number().over(_w(by, order)), "n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    first = F.col("k") <= F.floor(F.col("n") / 2)
    out = d.groupBy(*by).agg(F.median(F.when(first, F.col(value))).alias("median_first"), F.median(F.when(~first, F.col(value))).alias("median_second"))
    return out.withColumn("shift", F.col("median_second") - F.col("median_first"))


def trend(df: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """Least squares of value on x: slope, intercept, r2, t statistic and degrees of freedom."""
    y, t = F.col(value), F.when(F.col(value).isNotNull(), F.col(x).cast("double"))
    out = df.groupBy(*by).agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"), F.regr_r2(y, t).alias("r2"), F.count(y).alias("n"))
    stat = F.when((F.col("n") > 2) & (F.col("r2") < 1), F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))))
    return out.withColumns({"t": stat, "df": F.col("n") - 2})


def compacted(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows with a value, numbered from 0 without gaps as `x`."""
    return df.where(F.col(value).isNotNull()).withColumn("x", (F.row_number().over(_w(by, order)) - 1).cast("long"))


def mann_kendall(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """S, its variance with ties, and the continuity-corrected z, by a pair join within each (short) series."""
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(order).alias("o"), F.col(value).alias("v"))
    other = d.withColumnsRenamed({"o": "o2", "v": "v2"})
    s = d.join(other, by).where("o < o2").groupBy(*by).agg(F.sum(F.signum(F.col("v2") - F.col("v"))).cast("long").alias("s"))
    ties = d.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("tied"))
    out = ties.join(s, by).withColumn("var", (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("tied")) / F.lit(18.0))
    return out.withColumn("z", F.when(F.col("var") > 0, (F.col("s") - F.signum(F.col("s").cast("double"))) / F.sqrt("var")).otherwise(0.0)).drop("tied")


def average_rank(by: list[str], value: str) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman_drift(df: DataFrame, by: list[str], order: str, value: str, least: float = 0.3) -> DataFrame:
    """Spearman correlation of value with its order; n and t statistic for the p-value."""
    d = compacted(df, by, order, value).withColumn("r", average_rank(by, value))
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("r"), F.col("x")).alias("rho"))
    return out.withColumn("t", F.when((F.col("n") > 2) & (F.abs("rho") < 1), F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") ** 2)))).withColumn("strong", (F.col("n") > 10) & (F.abs("rho") > least))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, keep: list[str]) -> DataFrame:
    """For each left row the latest right row with right_time <= left_time: one sort of both sides, no pair join.

    `keep` are columns of right to take; at equal times right rows count as earlier.
    """
    taken = F.struct(F.col(right_time), *keep)
    l = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__k"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(taken.alias("r")).schema[0].dataType).alias("__r"))  # noqa: E741
    r = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__k"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), taken.alias("__r"))
    both = l.unionByName(r).withColumn("__last", F.last("__r", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("__k = 1").select("__l.*", F.col(f"__last.{right_time}").alias(f"{right_time}_asof"), *(F.col(f"__last.{c}").alias(f"{c}_asof") for c in keep))


def within(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, before: float, after: float) -> DataFrame:
    """Pairs with right_time in [left_time - before, left_time + after], by equality of time buckets, not a full pairing.

    Buckets are as wide as the interval, so each left row probes the two or three that it can reach.
    """
    width = before + after or 1.0
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    l = left.withColumn("__cell", F.explode(F.sequence(cell(F.col(left_time) - before), cell(F.col(left_time) + after))))  # noqa: E741
    r = right.withColumn("__cell", cell(F.col(right_time)))
    return l.join(r, [*by, "__cell"]).where(F.col(right_time).between(F.col(left_time) - before, F.col(left_time) + after)).drop("__cell")


def windows(df: DataFrame, by: list[str], order: str, value: str, size: int, stride: int) -> DataFrame:
    """(by, window, x): arrays of `size` values every `stride`, from the ordered series."""
    xs = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    starts = F.when(F.size("x") >= size, F.sequence(F.lit(0), F.size("x") - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(xs.alias("x")).select(*by, "x", F.posexplode(starts).alias("window", "start"))
    return out.select(*by, F.col("window").cast("long").alias("window"), F.slice("x", F.col("start") + 1, size).alias("x"))


def centred_mean(df: DataFrame, by: list[str], order: str, value: str, size: int) -> DataFrame:
    """Moving average of `size` values around each row, over those that exist at the ends."""
    half = size // 2
    return df.withColumn("smooth", F.avg(value).over(_w(by, order).rowsBetween(-half, size - 1 - half)))


def sampling_rate(df: DataFrame, by: list[str], ms: str, longest: float = 2000.0, grid: float = 5.0, default: float = 20.0) -> DataFrame:
    """Rate in Hz from the most common interval on a grid (smallest of ties); outside 1..200 Hz the default."""
    d = differences(df, by, ms, ms).where((F.col("diff") > 0) & (F.col("diff") <= longest)).withColumn("gap", F.bround(F.col("diff") / grid, 0) * grid)
    mode = d.where("gap > 0").groupBy(*by, "gap").agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(F.min(F.struct((-F.col("c")).alias("c"), "gap"))["gap"].alias("gap"))
    rate = 1000.0 / F.col("gap")
    every = df.select(*by).distinct()
    return every.join(mode, by, "left").select(*by, F.when(rate.between(1, 200), rate).otherwise(default).alias("hz"))
