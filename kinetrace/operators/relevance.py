"""Feature relevance, rankings and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = ["user_id", "feature"]


def auc(df: DataFrame, by: list[str], positive: Column, value: str = "value") -> DataFrame:
    """Area under the ROC curve by group. Rows are counted by distinct value first (combined before the shuffle), so the
    window that accumulates counts runs over distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = c.withColumn("area", F.col("p") * (below + F.col("q") / 2.0)).groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum("area").alias("area"), F.count(F.lit(1)).alias("values"))
    return a.withColumn("raw_auc", F.when(F.col("values") == 1, 0.5).when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("area") / (F.col("positives") * F.col("negatives")))).drop("area", "values")


def feature_auc(long: DataFrame) -> DataFrame:
    """Direction-free AUC of each user and feature, for users that have both classes."""
    a = auc(long, CELL, F.col("genuine") == 1).where("raw_auc is not null")
    return a.withColumns({"auc": F.greatest("raw_auc", 1 - F.col("raw_auc")), "direction": F.when(F.col("raw_auc") >= 0.5, "higher").otherwise("lower")})


def auc_details(aucs: DataFrame) -> DataFrame:
    """Per feature: median, deviation (n - 1), users, ends, and the direction most users have (ties: first by name)."""
    d = aucs.groupBy("feature", "direction").agg(F.count(F.lit(1)).alias("c")).groupBy("feature").agg(F.min(F.struct((-F.col("c")).alias("c"), "direction"))["direction"].alias("dominant_direction"))
    a = aucs.groupBy("feature").agg(F.median("auc").alias("median_auc"), F.stddev_samp("auc").alias("std_auc"), F.count(F.lit(1)).alias("num_users"), F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc"))
    return a.join(d, "feature", "left")


def noise_purge(details: DataFrame, least: float = 0.52) -> DataFrame:
    """Features whose median AUC reaches the floor, ranked by median, then steadiness, then name."""
    order = Window.orderBy(F.desc("median_auc"), F.asc_nulls_last("std_auc"), "feature")
    return details.where(F.col("median_auc") >= least).withColumn("rank", F.row_number().over(order).cast("long"))


def fisher_users(long: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Between-user over within-user variance, with sample (v1) and pooled population (v3) variances within."""
    u = long.where(F.col("value").isNotNull()).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("vs"), F.var_pop("value").alias("vp"), (F.stddev_samp("value") / F.avg("value")).alias("cv"))
    a = u.groupBy("feature").agg(F.sum("n").alias("n"), F.avg("vs").alias("within_mean"), (F.sum(F.col("n") * F.col("vp")) / F.sum("n")).alias("within_pooled"), (F.sum(F.col("n") * F.col("m") ** 2) / F.sum("n") - (F.sum(F.col("n") * F.col("m")) / F.sum("n")) ** 2).alias("between"), F.avg("cv").alias("cv_mean"))
    return a.withColumns({"fisher_v1": F.col("between") / (F.col("within_mean") + eps), "fisher_v3": F.col("between") / (F.col("within_pooled") + eps)})


def fisher_classes(long: DataFrame) -> DataFrame:
    """(m1 - m0)^2 / (v1 + v0) with population variances; 0 with fewer than two rows in a class or no spread."""
    g, x = F.col("genuine") == 1, F.col("value")
    a = long.groupBy(*CELL).agg(*(f(F.when(c, x)).alias(n) for n, c, f in (("m1", g, F.avg), ("m0", ~g, F.avg), ("v1", g, F.var_pop), ("v0", ~g, F.var_pop), ("n1", g, F.count), ("n0", ~g, F.count))))
    ok = (F.col("n1") >= 2) & (F.col("n0") >= 2) & (F.col("v1") + F.col("v0") > 0)
    return a.select(*CELL, F.when(ok, (F.col("m1") - F.col("m0")) ** 2 / (F.col("v1") + F.col("v0"))).otherwise(0.0).alias("fisher"))


def binned_information(long: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) of the class and the value in equal-width bins: an approximation, all in SQL."""
    from .describe import ratio

    d = long.where(F.col("value").isNotNull())
    ends = d.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.least(F.floor(ratio(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"), 0.0, 0.0) * bins), F.lit(bins - 1))
    # Without the user there is a row a feature: broadcast, since dealing rows by feature gives a task all rows of one.
    c = d.join(ends if "user_id" in by else F.broadcast(ends), by).groupBy(*by, "genuine", b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    n = lambda *k: F.sum("c").over(Window.partitionBy(*by, *k))
    return c.withColumn("t", F.col("c") / n() * F.log(F.col("c") * n() / (n("genuine") * n("bin")))).groupBy(*by).agg(F.sum("t").alias("information"))


def distance_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Distance correlation by a pair join within each (short) group: dCov^2 = S1 + S2 - 2 S3."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.monotonically_increasing_id().alias("i"))
    d = d.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("x", "y", "i")))
    p = d.join(d.withColumnsRenamed({"x": "x2", "y": "y2", "i": "j"}), by).select(*by, "i", F.abs(F.col("x") - F.col("x2")).alias("a"), F.abs(F.col("y") - F.col("y2")).alias("b"))
    r = p.groupBy(*by, "i").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb"), F.count(F.lit(1)).alias("n"))
    a = r.groupBy(*by).agg(F.max("n").cast("double").alias("n"), *(F.sum(c).alias(c) for c in ("ra", "rb", "ab", "aa", "bb")), F.sum(F.col("ra") * F.col("rb")).alias("rr"), F.sum(F.col("ra") ** 2).alias("raa"), F.sum(F.col("rb") ** 2).alias("rbb"))
    n = F.col("n")
    cov = lambda s, u, v, w: F.col(s) / n**2 + F.col(u) * F.col(v) / n**4 - 2 * F.col(w) / n**3
    xy, xx, yy = cov("ab", "ra", "rb", "rr"), cov("aa", "ra", "ra", "raa"), cov("bb", "rb", "rb", "rbb")
    return a.select(*by, F.when((xx > 1e-12) & (yy > 1e-12), F.sqrt(F.greatest(xy, F.lit(0.0)) / F.sqrt(xx * yy))).otherwise(0.0).alias("dcor"))


def percent_rank_average(c: str, descending: bool = False) -> Column:
    """Average rank over the row count, as a share; over all rows."""
    w = Window.partitionBy(F.lit(1))
    order = F.desc(c) if descending else F.asc(c)
    return (F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0) / F.count(F.lit(1)).over(w)


def min_rank(c: str) -> Column:
    return F.rank().over(Window.orderBy(F.desc(c))).cast("long")


def merged_scores(*scores: DataFrame, how: str = "inner") -> DataFrame:
    """Score tables joined by feature; tables of a row a feature are small, so Spark broadcasts them by their size."""
    out = scores[0]
    for s in scores[1:]:
        out = out.join(s, "feature", how)
    return out


def consensus_percentiles(scores: DataFrame, weights: dict[str, float], missing: float = 0.5) -> DataFrame:
    """Weighted mean and deviation (n - 1) of percentile ranks; a missing score ranks in the middle."""
    ranked = scores
    for c in weights:
        have = scores.where(F.col(c).isNotNull()).select("feature", percent_rank_average(c).alias(f"{c}_pct"))
        ranked = ranked.join(have, "feature", "left").withColumn(f"{c}_pct", F.coalesce(f"{c}_pct", F.lit(missing)))
    cols = [F.col(f"{c}_pct") for c in weights]
    mean = sum(cols[1:], cols[0]) / len(cols)
    avg = sum((F.col(f"{c}_pct") * w for c, w in weights.items()), F.lit(0.0))
    std = F.sqrt(sum(((c - mean) ** 2 for c in cols), F.lit(0.0)) / (len(cols) - 1))
    return ranked.withColumns({"avg_percentile": avg, "std_percentile": std})


def consensus_equal(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Mean percentile rank over methods, and its dense rank, best first."""
    out = scores.withColumns({f"{c}_pct": percent_rank_average(c) for c in columns})
    apr = sum((F.col(f"{c}_pct") for c in columns), F.lit(0.0)) / len(columns)
    return out.withColumn("apr_score", apr).withColumn("apr_rank", F.dense_rank().over(Window.orderBy(F.desc(F.round("apr_score", 9)))).cast("long"))


def consensus_ranks(scores: DataFrame, weights: dict[str, float], survivors: DataFrame) -> DataFrame:
    """Weighted mean of minimum ranks over survivors; one without a score takes the rank after the last."""
    out = survivors.select("feature")
    for c in weights:
        have = scores.where(F.col(c).isNotNull())
        out = out.join(have.select("feature", min_rank(c).alias(f"{c}_rank")), "feature", "left")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    out = out.withColumns({f"{c}_rank": F.coalesce(f"{c}_rank", n + 1) for c in weights})
    value = sum((F.col(f"{c}_rank") * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return out.withColumn("consensus", value).withColumn("final_rank", F.row_number().over(Window.orderBy(F.round("consensus", 9), "feature")).cast("long"))


def mrmr(relevance: dict[str, float], redundancy: dict[tuple[str, str], float], k: int) -> list[tuple[str, float]]:
    """Greedy selection on the driver from matrices of a row a feature: relevance less mean redundancy; ties by name."""
    chosen: list[tuple[str, float]] = []
    left = sorted(relevance)
    red = lambda a, b: redundancy.get((a, b), redundancy.get((b, a), 0.0))
    while left and len(chosen) < k:
        score = {f: relevance[f] - (sum(red(f, c) for c, _ in chosen) / len(chosen) if chosen else 0.0) for f in left}
        best = min(left, key=lambda f: (-score[f], f))
        chosen.append((best, score[best]))
        left.remove(best)
    return chosen


def leave_one_out_means(long: DataFrame) -> DataFrame:
    """For each target user and feature the mean over all other users' rows: totals less the user's own, no cross join."""
    u = long.where(F.col("value").isNotNull()).groupBy(*CELL).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    t = u.groupBy("feature").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return u.join(t, "feature").select(*CELL, (F.col("tn") - F.col("n")).alias("others"), F.when(F.col("tn") > F.col("n"), (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("mean_others"))
