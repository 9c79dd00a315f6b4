"""Quality control of feature distributions: outlier rules, tests, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tails import f_p, normal_p2, t_p
from ..model import EPS, TINY
from .describe import first_true, profiled, ratio, with_quantiles, with_ratios, with_shares

#: Fixed rule constants.
Z_SCALE, Z_LIMIT, MAD_SIGMA = 0.6745, 3.5, 1.4826


def with_limits(long: DataFrame, by: list[str]) -> DataFrame:
    """Each value with its group's quantiles, median, MAD, mean and deviation: the rows of a group are gathered once and
    given out again, without a join."""
    rest = [c for c in long.columns if c not in (*by, "value")]
    g = long.where(F.col("value").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.sort_array(F.collect_list(F.struct("value", *rest))).alias("rows"))
    g = with_quantiles(g.withColumn("x", F.col("rows.value")))
    return g.select(*by, "n", "mean", "std", "p025", "p25", "p75", "p975", "median", "mad", F.inline("rows"))


def modified_z(value: Column, median: Column, mad: Column) -> Column:
    """0.6745 |x - median| / MAD; with no spread 0 at the median, infinite elsewhere."""
    d = F.abs(value - median)
    return F.when(mad > TINY, Z_SCALE * d / mad).when(d <= TINY, 0.0).otherwise(F.lit(float("inf")))


def _rules(x: Column) -> dict[str, Column]:
    """The outlier rules on a value beside its group's limits."""
    iqr = F.col("p75") - F.col("p25")
    fence = lambda k: (x < F.col("p25") - k * iqr) | (x > F.col("p75") + k * iqr)
    sigma = F.when(F.col("mad") > TINY, MAD_SIGMA * F.col("mad")).otherwise(F.col("std"))
    return {
        "z": modified_z(x, F.col("median"), F.col("mad")), "iqr_outlier": fence(1.5), "iqr3_outlier": (iqr >= EPS) & fence(3.0), "tail_outlier": (x < F.col("p025")) | (x > F.col("p975")),
        "peak": x > F.col("mean") + 2 * F.col("mad"), "distance": ratio(F.abs(x - F.col("median")), sigma, TINY, 0.0), "g": ratio(F.abs(x - F.col("mean")), F.col("std"), TINY, 0.0),
    }


def outlier_marks(long: DataFrame, by: list[str]) -> DataFrame:
    """Per value: modified z, fences (1.5 and 3), 2.5 % tails, peak over threshold, robust distance, Grubbs' G."""
    return with_limits(long, by).withColumns(_rules(F.col("value")))


def with_outliers(d: DataFrame) -> DataFrame:
    """Counts and ends of the outlier rules over the values of profiled groups with quantiles. Every rule holds from some
    distance off the middle on, so its values are the ends of the sorted array: they are counted by halving, and z and G are
    largest at the ends."""
    v = F.col("x")
    low = lambda rule: first_true(v, lambda x: ~(rule(x) & (x < F.col("median"))))
    high = lambda rule: F.size(v) - first_true(v, lambda x: rule(x) & (x >= F.col("median")))
    n = lambda pick: (low(lambda x: pick(_rules(x))) + high(lambda x: pick(_rules(x)))).cast("long")
    top = lambda rule: F.greatest(*(_rules(F.col(c))[rule] for c in ("min", "max")))
    return d.withColumns({
        "z_max": top("z"), "z_outliers": n(lambda r: r["z"] > Z_LIMIT), "iqr_outliers": n(lambda r: r["iqr_outlier"]), "iqr3_outliers": n(lambda r: r["iqr3_outlier"]), "tail_outliers": n(lambda r: r["tail_outlier"]),
        "peaks": (F.size(v) - first_true(v, lambda x: _rules(x)["peak"])).cast("long"), "distance_outliers": n(lambda r: r["distance"] > Z_LIMIT), "g": top("g"),
    })


def outlier_profile(long: DataFrame, by: list[str]) -> DataFrame:
    out = with_outliers(with_quantiles(profiled(long, by))).where("n > 0")
    return out.select(*by, "n", "z_max", "z_outliers", "iqr_outliers", "iqr3_outliers", "tail_outliers", "peaks", "distance_outliers", "g")


def grubbs(profile: DataFrame) -> DataFrame:
    """Two-sided p-value of the largest deviation, at most 1."""
    n, g = F.col("n"), F.col("g")
    inner = n * (n - 2) * g * g / ((n - 1) * (n - 1) - n * g * g)
    t = F.when((n > 2) & ((n - 1) * (n - 1) > n * g * g), F.sqrt(inner))
    return profile.withColumn("t", t).withColumn("grubbs_p", F.least(F.lit(1.0), n * t_p(F.col("t"), (n - 2).cast("double")))).drop("t")


def jarque_bera(long: DataFrame, by: list[str]) -> DataFrame:
    """JB statistic from biased moments and p = exp(-JB / 2)."""
    n = F.count("value")
    jb = n / 6.0 * (F.skewness("value") ** 2 + F.kurtosis("value") ** 2 / 4.0)
    return long.groupBy(*by).agg(jb.alias("jb")).withColumn("jarque_bera_p", F.exp(-F.col("jb") / 2))


def dagostino(long: DataFrame, by: list[str]) -> DataFrame:
    """Omnibus K2 of skewness and kurtosis; its p-value is exp(-K2 / 2). Needs n of 8 or more."""
    d = long.groupBy(*by).agg(F.count("value").cast("double").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")).where("n >= 8")
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt((y / alpha) ** 2 + 1))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (F.col("g2") + 3 - mean) / F.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1)))
    part = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(part) * F.pow(F.abs(part), 1 / 3)) / F.sqrt(2 / (9 * a))
    return d.select(*by, (z1 * z1 + z2 * z2).alias("k2")).withColumn("dagostino_p", F.exp(-F.col("k2") / 2))


def levene_halves(df: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """Median-centred Levene statistic of the first n div 2 rows against the rest."""
    w = Window.partitionBy(*by)
    d = df.where(F.col(value).isNotNull()).withColumn("half", (F.row_number().over(w.orderBy(order)) > F.floor(F.count(F.lit(1)).over(w) / 2)).cast("int"))
    med = d.groupBy(*by, "half").agg(F.median(value).alias("m"))
    z = d.join(med, [*by, "half"]).withColumn("z", F.abs(F.col(value) - F.col("m")))
    g = z.groupBy(*by, "half").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("zm"), F.var_pop("z").alias("zv"))
    a = g.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("zv")).alias("within"), (F.sum(F.col("n") * F.col("zm") ** 2) - F.sum(F.col("n") * F.col("zm")) ** 2 / F.sum("n")).alias("between"))
    return a.select(*by, "n", F.when(F.col("within") > EPS, (F.col("n") - 2) * F.col("between") / F.col("within")).alias("w"))


def levene_p(stat: DataFrame) -> DataFrame:
    return stat.withColumn("levene_p", f_p(F.col("w"), F.lit(1.0), (F.col("n") - 2).cast("double")))


def mann_whitney(df: DataFrame, by: list[str], group: Column, value: str = "value") -> DataFrame:
    """U of the rows where group holds against the others, with tie-corrected z. Counts per value come first, so the
    window runs over distinct values only."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(group.cast("long")).alias("a"), F.sum((~group).cast("long")).alias("b"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum("b").over(w), F.lit(0)))
    out = c.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum(F.col("a") * (F.col("below") + F.col("b") / 2.0)).alias("u"), F.sum((F.col("a") + F.col("b")) ** 3 - (F.col("a") + F.col("b"))).alias("ties"))
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    var = n1 * n0 / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1)))
    return out.withColumn("z", F.when((n1 > 0) & (n0 > 0) & (var > 0), (F.col("u") - n1 * n0 / 2.0) / F.sqrt(var))).drop("ties")


def shift_p(mw: DataFrame) -> DataFrame:
    return mw.withColumn("p", normal_p2(F.col("z")))


def anova(df: DataFrame, by: list[str], group: str, value: str = "value") -> DataFrame:
    """One-way F statistic with its degrees of freedom."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    a = g.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"), (F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("between"))
    f = F.when((F.col("within") > EPS) & (F.col("n") > F.col("k")), F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k"))))
    return a.select(*by, "k", "n", f.alias("f"))


def anova_p(stat: DataFrame) -> DataFrame:
    return stat.withColumn("p", f_p(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))


def with_extremes(d: DataFrame) -> DataFrame:
    """The columns of `extremes` for profiled groups with quantiles."""
    largest = F.greatest(F.abs("min"), F.abs("max"))
    smallest = F.array_min(F.transform(F.filter("x", lambda v: v != 0), lambda v: F.abs(v)))
    return d.withColumns({"overflow": largest > 1e10, "mixed_scales": (largest > 1e6) & (smallest < 1e-3), "extreme": largest > 1e9, "max_to_median": ratio(F.col("max"), F.col("median")), "min_to_median": ratio(F.col("min"), F.col("median"))})


def extremes(long: DataFrame, by: list[str]) -> DataFrame:
    """Overflow, mixed scales, and the ratios of the ends to the median."""
    return with_extremes(with_quantiles(profiled(long, by))).select(*by, "overflow", "mixed_scales", "extreme", "max_to_median", "min_to_median")


#: (metric, red condition, blue condition) on finite values; scoring metrics only count in the health score.
STATUS_RULES = (
    ("n", "x < 8", "false"), ("n_missing", "x > 0", "false"), ("std", "x <= 1e-10 or x > 1e8", "false"), ("skew", "abs(x) > 3", "abs(x) > 1"), ("excess", "x > 5", "x > 3"),
    ("cv", "x > 1.5", "x > 0.5"), ("robust_cv", "x > 1.0", "x > 0.5"), ("snr", "x < 0.5", "x < 1.0"), ("z_max", "x > 5", "x > 3.5"), ("z_outlier_pct", "x > 5", "x > 2"),
    ("iqr_outlier_pct", "x > 10", "x > 5"), ("tail_outlier_pct", "x > 10", "x > 5"), ("entropy", "x < 0.5", "x < 1.5"), ("distinct_share", "x < 0.3", "x < 0.5"), ("peak_pct", "x > 10", "x >= 5"),
    ("max_to_median", "abs(x) > 1e6", "abs(x) > 1e3"), ("min_to_median", "abs(x) > 1e6", "abs(x) > 1e3"), ("mad_to_std", "x < 0.1", "x < 0.4 or x > 0.8"), ("rank_dispersion", "x > 0.25", "x > 0.10"),
)
UNSCORED = ("rank_dispersion",)


def metric_statuses(wide: DataFrame, by: list[str], rules=STATUS_RULES) -> DataFrame:
    """(by, metric, x, status): each metric's colour; values that are missing or not finite stay green."""
    names = [r[0] for r in rules if r[0] in wide.columns]
    long = wide.select(*by, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(by, names, "metric", "x")
    cond = lambda k: F.coalesce(*[F.when(F.col("metric") == r[0], F.expr(r[k])) for r in rules])
    ok = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    return long.withColumn("status", F.when(ok & cond(1), "red").when(ok & cond(2), "blue").otherwise("green"))


def health(statuses: DataFrame, by: list[str]) -> DataFrame:
    """100 - 15 for each red and 8 for each blue scoring metric, within 0..100, and the verdict."""
    scoring = ~F.col("metric").isin(*UNSCORED)
    n = lambda s, c: F.sum(((F.col("status") == s) & c).cast("long"))
    a = statuses.groupBy(*by).agg(n("red", F.lit(True)).alias("red"), n("blue", F.lit(True)).alias("blue"), n("red", scoring).alias("r"), n("blue", scoring).alias("b"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 15 * F.col("r") - 8 * F.col("b")))
    return a.select(*by, "red", "blue", score.alias("health"), F.when(score > 70, "HEALTHY").when(score >= 40, "SUSPICIOUS").otherwise("REJECT").alias("verdict"))


def session_outliers(long: DataFrame, by: list[str], session: str) -> DataFrame:
    """Values marked by any method: methods joined, their count and a confidence."""
    m = outlier_marks(long, by)
    methods = F.concat_ws(",", F.when(F.col("z") > Z_LIMIT, "modified_z"), F.when(F.col("iqr_outlier"), "iqr"), F.when(F.col("tail_outlier"), "percentile"))
    out = m.withColumn("methods", methods).where("methods <> ''").withColumn("count", F.size(F.split("methods", ",")).cast("long"))
    return out.select(*by, session, "value", "methods", "count", F.when(F.col("count") >= 3, "HIGH").when(F.col("count") == 2, "MEDIUM").otherwise("LOW").alias("confidence"))


def quality_record(long: DataFrame, by: list[str]) -> DataFrame:
    """Constant, near-zero mean, spread and outliers joined into reasons; no reason means the feature passes."""
    j = with_outliers(with_ratios(with_quantiles(profiled(long, by)))).where("n > 0").withColumn("outlier_share", F.col("iqr3_outliers") / F.col("n"))
    reasons = F.concat_ws(";", F.when(F.coalesce("std", F.lit(0.0)) <= EPS, "constant"), F.when(F.abs("mean") < 1e-6, "near_zero_mean"), F.when(F.col("cv") > 0.30, "high_cv"), F.when(F.col("outlier_share") > 0.05, "outliers"))
    return j.select(*by, "n", "cv", "outlier_share", reasons.alias("reasons"), (reasons == "").alias("passes"))


def deep_audit(long: DataFrame, by: list[str]) -> DataFrame:
    """Reasons of the deep audit, in a fixed order, and whether any fires."""
    j = with_shares(with_extremes(with_outliers(with_ratios(with_quantiles(profiled(long, by)))))).withColumn("z_share", F.when(F.col("n") > 0, F.col("z_outliers") / F.col("n")))
    rules = [
        ("all_missing", F.col("n") == 0), ("high_missing", F.col("missing_ratio") > 0.10), ("constant", F.col("std") < 1e-10), ("near_constant", (F.col("std") >= 1e-10) & (F.col("mode_share") >= 0.95)), ("extreme", F.col("extreme")),
        ("cv", F.col("cv") > 2), ("mad_median", (F.col("mad") > 0) & (F.col("mad") / F.abs("median") > 2)), ("iqr_median", F.col("robust_cv") > 3), ("spread", (F.col("p99") - F.col("p01")) / (F.abs("median") + 1e-8) > 1e6),
        ("outlier_share", (F.col("n") > 3) & (F.col("mad") > 0) & (F.col("z_share") > 0.1)), ("outlier_max", (F.col("n") > 3) & (F.col("mad") > 0) & (F.col("z_share") <= 0.1) & (F.col("z_max") > 5)), ("skew", F.abs("skew_biased") > 3), ("kurtosis", F.abs("excess_biased") > 8),
        ("bimodal", (F.col("n") > 3) & (F.col("bimodality") > 0.55)), ("quantised", F.col("mode_share") > 0.70),
    ]
    reasons = F.concat_ws(";", *(F.when(c, name) for name, c in rules))
    return j.select(*by, reasons.alias("reasons"), (reasons != "").alias("problematic"))
