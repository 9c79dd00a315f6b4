"""Cleansing, splits, imputation, scaling and label rules over the long feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import EPS, finite
from .describe import correlation

CELL = ["user_id", "feature"]


def label_contains(c: Column) -> Column:
    """1 if the lower-case label contains 'genuine' (so 'non-genuine' counts), else 0."""
    return F.when(F.contains(F.lower(c), F.lit("genuine")), 1).otherwise(0)


def label_exact(c: Column) -> Column:
    """1 if the trimmed lower-case label is 'genuine', 0 for any other, -1 for NULL."""
    return F.when(c.isNull(), -1).when(F.lower(F.trim(c)) == "genuine", 1).otherwise(0)


def numeric_share(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, column, numeric_share, strict): share of values that parse as numbers; strict: all that are present do."""
    texts = df.select(*by, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(by, columns, "column", "raw")
    parsed = F.col("raw").try_cast("double").isNotNull()
    return texts.groupBy(*by, "column").agg(F.avg(parsed.cast("double")).alias("numeric_share"), (F.sum((F.col("raw").isNotNull() & ~parsed).cast("long")) == 0).alias("strict"))


def majority_numeric(df: DataFrame, columns: list[str], by: list[str], least: float = 0.5) -> DataFrame:
    """Columns that are numeric in at least a share of the values of every group."""
    return numeric_share(df, columns, by).groupBy("column").agg(F.min("numeric_share").alias("worst")).where(F.col("worst") >= least)


def worst_missing(long: DataFrame, most: float) -> DataFrame:
    """Per feature the overall and the worst user's missing ratio, and whether it is to be dropped."""
    of = F.col("value").isNull().cast("double")
    users = long.groupBy(*CELL).agg(F.sum(of).alias("m"), F.count(F.lit(1)).alias("n"))
    out = users.groupBy("feature").agg((F.sum("m") / F.sum("n")).alias("missing"), F.max(F.col("m") / F.col("n")).alias("worst_user"))
    return out.withColumn("drop", F.col("worst_user") > most)


def constant_users(long: DataFrame, share: float = 0.8) -> DataFrame:
    """Per feature how many users see no spread (an empty series counts), and whether over `share` of them do."""
    users = long.groupBy(*CELL).agg((F.coalesce(F.stddev_pop("value"), F.lit(0.0)) == 0).alias("constant"))
    out = users.groupBy("feature").agg(F.sum(F.col("constant").cast("long")).alias("constant_users"), F.count(F.lit(1)).alias("users"))
    return out.withColumn("drop", F.col("constant_users") > share * F.col("users"))


def low_variance(long: DataFrame, least: float = 1e-8) -> DataFrame:
    return long.groupBy("feature").agg(F.var_samp("value").alias("variance")).withColumn("drop", F.coalesce(F.col("variance") < least, F.lit(True)))


def duplicate_features(long: DataFrame, keys: list[str]) -> DataFrame:
    """(feature, kept): features with equal values in every row, the first by name kept. Digests add up, so no column is gathered."""
    cell = F.xxhash64(*keys, F.coalesce(F.col("value").cast("string"), F.lit("")))
    marks = long.groupBy("feature").agg(F.sum(cell.cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), cell)).alias("b"), F.count(F.lit(1)).alias("n"))
    first = F.min("feature").over(Window.partitionBy("a", "b", "n"))
    return marks.select("feature", first.alias("same_as"), (F.col("feature") == first).alias("kept"))


def value_ranks(long: DataFrame, parts: int = 64) -> tuple[DataFrame, dict[str, int]]:
    """(feature, value, c, below, r) of each distinct value: its rows, the feature's rows below it and their average rank;
    and the rows of each feature.

    Counts come first; a feature's values are dealt into ranges, so that no task takes a whole feature.
    """
    c = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    points = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    found = c.groupBy("feature").agg(F.sum("c").alias("n"), F.percentile_approx("value", points, F.lit(1000)).alias("cuts")).collect()  # a row a feature
    # Taken to the driver and back, since the ranges must be the same wherever they are used.
    cuts = long.sparkSession.createDataFrame([(r.feature, r.cuts) for r in found], "feature string, cuts array<double>")
    b = c.join(F.broadcast(cuts), "feature").select("feature", "value", "c", F.size(F.filter("cuts", lambda q: q < F.col("value"))).alias("range"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    t = b.groupBy("feature", "range").agg(F.sum("c").alias("t")).select("feature", "range", F.coalesce(F.sum("t").over(earlier("feature").orderBy("range")), F.lit(0)).alias("base"))
    below = F.col("base") + F.coalesce(F.sum("c").over(earlier("feature", "range").orderBy("value")), F.lit(0))
    out = b.join(F.broadcast(t), ["feature", "range"]).withColumn("below", below)
    return out.select("feature", "value", "c", "below", (F.col("below") + (F.col("c") + 1) / 2.0).alias("r")), {r.feature: r.n for r in found}


def with_ranks(long: DataFrame, common: int = 20_000) -> DataFrame:
    """Rows with a value, the value replaced by its average rank within the feature. Values with over a `common`-th of the
    rows are fewer than `common` and broadcast, so that none of them fills a task; the others meet their rank in a shuffle."""
    d = long.where(F.col("value").isNotNull())
    ranks, n = value_ranks(d)
    often = F.col("c") > sum(n.values()) // common
    h = d.join(F.broadcast(ranks.where(often).select("feature", "value", "r")), ["feature", "value"], "left")
    rare = h.where(F.col("r").isNull()).drop("r").join(ranks.where(~often).select("feature", "value", "r"), ["feature", "value"])
    return h.where(F.col("r").isNotNull()).unionByName(rare).drop("value").withColumnRenamed("r", "value")


def feature_medians(long: DataFrame) -> dict[str, float]:
    """Exact median of each feature, from its counted values."""
    ranks, n = value_ranks(long)
    last = F.create_map(*(F.lit(x) for f, k in n.items() for x in (f, k - 1))) if n else F.create_map()
    end = F.col("below") + F.col("c")
    m = ranks.withColumn("last", last[F.col("feature")]).groupBy("feature").agg(*(F.min(F.when(end > f(F.col("last") * 0.5), F.col("value"))).alias(k) for k, f in (("a", F.floor), ("b", F.ceil))))
    return {r.feature: r.a if r.a == r.b else 0.5 * r.a + 0.5 * r.b for r in m.collect()}  # a row a feature


def feature_correlations(long: DataFrame, keys: list[str], per_user: bool, ranks: bool = False) -> DataFrame:
    """(user_id?, f1, f2, corr) of pairs f1 < f2 over rows where both have values; ranks: Spearman."""
    d = with_ranks(long) if ranks else long.where(F.col("value").isNotNull())
    # One array of the features of each row; pairs are formed within the row, so there is no self-join of the table.
    rows = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("x"))
    return _pair_correlations(rows, per_user)


def row_correlations(wide: DataFrame, features: list[str], per_user: bool) -> DataFrame:
    """The same for rows that hold all features: nothing is regrouped."""
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), finite(F.col(f).cast("double")).alias("value")) for f in sorted(features)))
    return _pair_correlations(wide.select("user_id", F.filter(cells, lambda c: c["value"].isNotNull()).alias("x")), per_user)


def _pair_correlations(rows: DataFrame, per_user: bool) -> DataFrame:
    """Correlations over rows with an array x of (feature, value), in the order of features."""
    user = ["user_id"] if per_user else []
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a["feature"].alias("f1"), b["feature"].alias("f2"), a["value"].alias("v1"), b["value"].alias("v2")))))
    return rows.select(*user, F.inline(pairs)).groupBy(*user, "f1", "f2").agg(correlation(F.col("v1"), F.col("v2")).alias("corr"), F.count(F.lit(1)).alias("n"))


def correlated_drops(correlations: DataFrame, variances: DataFrame, limit: float = 0.95) -> DataFrame:
    """For each pair over the limit the feature of lower variance goes; equal variances drop the earlier name."""
    v = lambda k: variances.select(F.col("feature").alias(f"f{k}"), F.col("variance").alias(f"var{k}"))
    pairs = correlations.where(F.abs("corr") > limit).join(v(1), "f1").join(v(2), "f2")
    return pairs.select(F.when(F.col("var1") <= F.col("var2"), F.col("f1")).otherwise(F.col("f2")).alias("feature")).distinct()


def leak_free_split(rows: DataFrame, share: float = 0.8, key: Column | None = None) -> DataFrame:
    """part: dev or holdout, by a hash order within user and class; classes of one row go to the holdout."""
    order = key if key is not None else F.xxhash64("user_id", "pos")
    w = Window.partitionBy("user_id", "genuine")
    n = F.count(F.lit(1)).over(w)
    n_dev = F.when(n == 1, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.bround(n * share, 0))))
    return rows.withColumn("k", F.row_number().over(w.orderBy(order, "pos"))).withColumn("part", F.when(F.col("k") <= n_dev, "dev").otherwise("holdout")).drop("k")


def early_late(rows: DataFrame, by: list[str], order: str, share: float = 0.8) -> DataFrame:
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    early = F.least(n - 1, F.greatest(F.lit(1), F.floor(n * share)))
    return rows.withColumn("part", F.when(F.row_number().over(w.orderBy(order)) <= early, "early").otherwise("late"))


def impute(long: DataFrame, train: Column) -> DataFrame:
    """Missing values filled with the median of the user's training rows, then with 0; both parts alike."""
    med = long.where(train).groupBy(*CELL).agg(F.median("value").alias("fill"))
    return long.join(med, CELL, "left").withColumn("value", F.coalesce("value", "fill", F.lit(0.0))).drop("fill")


def standardise(long: DataFrame, train: Column, by: list[str]) -> DataFrame:
    """(x - mean) / population deviation of the training rows; a deviation of 0 counts as 1."""
    s = long.where(train).groupBy(*by).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return long.join(s, by, "left").withColumn("value", (F.col("value") - F.col("m")) / F.when(F.col("s") > EPS, F.col("s")).otherwise(1.0)).drop("m", "s")


def min_max(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Scaled to 0..1 within by; constant groups become 0. Group ends come from an aggregation, so no window sorts."""
    e = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(e, by).withColumn(value, F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")


def distinct_ids(rows: DataFrame, session: str, source: str) -> DataFrame:
    """Session ids prefixed with their source only where the id occurs more than once."""
    n = F.count(F.lit(1)).over(Window.partitionBy(session))
    return rows.withColumn("unique_id", F.when(n > 1, F.concat_ws("_", source, F.col(session).cast("string"))).otherwise(F.col(session).cast("string")))


def first_seen(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with the position where each was first seen, and their order."""
    return df.groupBy(key).agg(F.min(pos).alias("first_pos")).withColumn("rank", F.row_number().over(Window.orderBy("first_pos", key)).cast("long"))


def phase_one(long: DataFrame, keys: list[str], missing: float = 0.6, limit: float = 0.95) -> DataFrame:
    """Per feature why it goes (duplicate, missing, variance, correlated) or NULL if it stays; each rule sees survivors.

    What a rule leaves to the next is a row a feature and goes through the driver, so no step deals all rows by feature.
    """
    spark, gaps = long.sparkSession, F.avg(F.col("value").isNull().cast("double"))
    found = duplicate_features(long, keys).join(F.broadcast(long.groupBy("feature").agg(gaps.alias("m"))), "feature").collect()
    reason = {r.feature: None if r.kept and r.m <= missing else "missing" if r.kept else "duplicate" for r in found}
    left = long.where(F.col("feature").isin([f for f, why in reason.items() if not why]))
    open_ = [r.feature for r in found if not reason[r.feature] and r.m > 0]
    if open_:
        fill = feature_medians(left.where(F.col("feature").isin(open_)))
        left = left.withColumn("value", F.coalesce("value", F.create_map(*(F.lit(x) for f, v in fill.items() for x in (f, v)))[F.col("feature")]))
    spread = {r.feature: (r.variance, r.drop) for r in low_variance(left).collect()}
    reason |= {f: "variance" for f, (_, low) in spread.items() if low}
    kept = [(f, v) for f, (v, low) in spread.items() if not low]
    if len(kept) > 1:
        pairs = feature_correlations(left.where(F.col("feature").isin([f for f, _ in kept])), keys, False, ranks=True)
        pairs = spark.createDataFrame([tuple(r) for r in pairs.select("f1", "f2", "corr").collect()], "f1 string, f2 string, corr double")  # a row a pair
        reason |= {r.feature: "correlated" for r in correlated_drops(pairs, spark.createDataFrame(kept, "feature string, variance double"), limit).collect()}
    return spark.createDataFrame(sorted(reason.items()), "feature string, reason string")
