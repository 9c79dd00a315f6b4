"""Descriptive queries over the session features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SESSIONS_SQL, features
from ..operators import describe as D
from ..registry import query

BY = ["user_id", "feature"]


@query("A1 A3 A4 A5 A6 A7 P13 P15", f"""WITH {SESSIONS_SQL}, b AS (
  SELECT user_id, feature, count(value) AS n, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
    quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75,
    quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, skewness(value) AS skew, kurtosis(value) AS excess, kurtosis_pop(value) AS excess_biased
  FROM feat GROUP BY 1, 2), c AS (SELECT *, CAST(skew AS DOUBLE) * (n - 2) / sqrt(CAST(n AS DOUBLE) * (n - 1)) AS skew_biased FROM b)
SELECT user_id, feature, n, n_missing, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(median, 6) AS median, round(p01, 6) AS p01, round(p05, 6) AS p05, round(p95, 6) AS p95, round(p99, 6) AS p99,
  round(max - min, 6) AS range, round(p75 - p25, 6) AS iqr, round(std / abs(mean), 6) AS cv, round(abs(mean) / std, 6) AS snr, round((p75 - p25) / abs(median), 6) AS robust_cv, round(median / mean, 6) AS median_mean,
  round(skew, 6) AS skew, round(excess, 6) AS excess, round((skew_biased * skew_biased + 1) / (excess_biased + 3), 6) AS bimodality, round(n_missing / (n + n_missing), 6) AS missing_ratio FROM c""")
def feature_descriptives(spark, sf_dir):
    d = D.describe(features(spark, sf_dir), BY)
    cols = "n n_missing mean std min max median p01 p05 p95 p99 range iqr cv snr robust_cv median_mean skew excess bimodality missing_ratio".split()
    return D.rounded(d.select(*BY, *cols))


@query("A2", f"""WITH {SESSIONS_SQL} SELECT user_id, feature, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM feat GROUP BY 1, 2""")
def feature_mad(spark, sf_dir):
    return D.rounded(D.median_and_mad(features(spark, sf_dir), BY))


@query("A11 A12", f"""WITH {SESSIONS_SQL}, c AS (SELECT user_id, feature, round(value, 12) AS v, count(*) AS c FROM feat WHERE value IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, feature ORDER BY c DESC, v) AS k FROM c)
SELECT user_id, feature, CAST(sum(c) AS BIGINT) AS n, max(CASE WHEN k = 1 THEN v END) AS top, round(max(c) / sum(c), 6) AS mode_share, round(count(*) / sum(c), 6) AS distinct_share FROM r GROUP BY 1, 2""")
def value_dominance(spark, sf_dir):
    return D.value_shares(features(spark, sf_dir), BY)


_BINS = """e AS (SELECT user_id, feature, min(value) AS lo, max(value) AS hi, count(value) AS n FROM feat WHERE value IS NOT NULL GROUP BY 1, 2),
h AS (SELECT f.user_id, f.feature, e.n, CAST(least(floor((value - lo) / (hi - lo) * {k}), {k} - 1) AS BIGINT) AS bin, {k} AS bins, count(*) AS count FROM feat f JOIN e USING (user_id, feature) WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


@query("A13", f"""WITH {SESSIONS_SQL}, {_BINS.format(k=20)}
SELECT user_id, feature, round(-sum(count / n * log2(count / n)), 6) AS entropy, count(*) AS filled FROM h GROUP BY 1, 2""")
def binned_entropy(spark, sf_dir):
    return D.rounded(D.entropy(features(spark, sf_dir), BY))


@query("A14 K9", f"""WITH {SESSIONS_SQL}, {_BINS.format(k='CAST(least(200, greatest(10, round_even(sqrt(n), 0))) AS BIGINT)')}
SELECT user_id, feature, bin, bins, count FROM h""")
def adaptive_histogram(spark, sf_dir):
    return D.histogram(features(spark, sf_dir), BY, bins=None).select(*BY, "bin", "bins", "count")


@query("Q11 Q12", f"""WITH {SESSIONS_SQL}, {_BINS.format(k='CAST(least(200, greatest(10, round_even(sqrt(n), 0))) AS BIGINT)')},
g AS (SELECT DISTINCT user_id, feature, unnest(range(0, bins)) AS bin FROM h),
s AS (SELECT g.user_id, g.feature, g.bin, sum(coalesce(count, 0)) OVER (PARTITION BY g.user_id, g.feature ORDER BY g.bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0 AS s FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.feature = h.feature AND g.bin = h.bin),
p AS (SELECT *, coalesce(lag(s) OVER w, -1) AS b, coalesce(lead(s) OVER w, -1) AS a, max(s) OVER (PARTITION BY user_id, feature) AS t FROM s WINDOW w AS (PARTITION BY user_id, feature ORDER BY bin))
SELECT user_id, feature, CAST(sum(CASE WHEN s > b AND s >= a AND s >= 0.15 * t THEN 1 ELSE 0 END) AS BIGINT) AS peaks, sum(CASE WHEN s > b AND s >= a AND s >= 0.15 * t THEN 1 ELSE 0 END) >= 2 AS multimodal FROM p GROUP BY 1, 2""")
def histogram_multimodality(spark, sf_dir):
    return D.histogram_modes(features(spark, sf_dir), BY)


@query("A15 A27 K8", f"""WITH {SESSIONS_SQL} SELECT user_id, split, count(*) AS n, CAST(sum(genuine) AS BIGINT) AS n_genuine, CAST(sum(1 - genuine) AS BIGINT) AS n_impostor, round(avg(price), 6) AS mean_price, round(var_samp(price), 4) AS var_price FROM sess GROUP BY 1, 2""")
def split_manifest(spark, sf_dir):
    from ..model import sessions

    return sessions(spark, sf_dir).groupBy("user_id", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("genuine").alias("n_genuine"), F.sum(1 - F.col("genuine")).alias("n_impostor"), F.round(F.avg("price"), 6).alias("mean_price"), F.round(F.var_samp("price"), 4).alias("var_price"))
