"""Quality-control queries over the session features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SERIES_SQL, SESSIONS_SQL, features, series
from ..operators import control as C
from ..operators import describe as D
from ..operators import sequence as S
from ..operators.describe import rounded
from ..registry import query

BY = ["user_id", "feature"]
_M = """q AS (SELECT user_id, feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median, mad(value) AS mad, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.025) AS p025, quantile_cont(value, 0.975) AS p975 FROM feat GROUP BY 1, 2),
m AS (SELECT f.user_id, f.feature, f.pos, f.split, f.value, q.n, 0.6745 * abs(value - median) / mad AS z, value < p25 - 1.5 * (p75 - p25) OR value > p75 + 1.5 * (p75 - p25) AS i15, value < p25 - 3 * (p75 - p25) OR value > p75 + 3 * (p75 - p25) AS i3,
  value < p025 OR value > p975 AS tail, value > mean + 2 * mad AS peak, abs(value - median) / (1.4826 * mad) AS dist, abs(value - mean) / std AS g FROM feat f JOIN q USING (user_id, feature) WHERE value IS NOT NULL)"""
_P = """p AS (SELECT user_id, feature, count(*) AS n, max(z) AS z_max, count(*) FILTER (z > 3.5) AS z_outliers, count(*) FILTER (i15) AS iqr_outliers, count(*) FILTER (i3) AS iqr3_outliers, count(*) FILTER (tail) AS tail_outliers, count(*) FILTER (peak) AS peaks, count(*) FILTER (dist > 3.5) AS distance_outliers, max(g) AS g FROM m GROUP BY 1, 2)"""


@query("Q1 Q2 Q3 Q5 Q6", f"WITH {SESSIONS_SQL}, {_M}, {_P} SELECT user_id, feature, n, round(z_max, 6) AS z_max, z_outliers, iqr_outliers, iqr3_outliers, tail_outliers, peaks, distance_outliers, round(g, 6) AS g FROM p")
def modified_z_outliers(spark, sf_dir):
    return rounded(C.outlier_profile(features(spark, sf_dir), BY))


@query("Q25 O5 O6", f"""WITH {SESSIONS_SQL}, {_M}, s AS (SELECT user_id, feature, pos, value, concat_ws(',', CASE WHEN z > 3.5 THEN 'modified_z' END, CASE WHEN i15 THEN 'iqr' END, CASE WHEN tail THEN 'percentile' END) AS methods FROM m)
SELECT *, len(string_split(methods, ',')) AS count, CASE WHEN len(string_split(methods, ',')) >= 3 THEN 'HIGH' WHEN len(string_split(methods, ',')) = 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s WHERE methods <> ''""")
def session_outlier_report(spark, sf_dir):
    return C.session_outliers(features(spark, sf_dir), BY, "pos")


@query("Q4")
def grubbs_test(spark, sf_dir):
    return C.grubbs(C.outlier_profile(features(spark, sf_dir), BY)).select(*BY, "n", "g", "grubbs_p", (F.col("grubbs_p") < 0.05).alias("is_outlier"))


_SK = "count(value) AS n, CAST(skewness(value) AS DOUBLE) * (count(value) - 2) / sqrt(CAST(count(value) AS DOUBLE) * (count(value) - 1)) AS g1, kurtosis_pop(value) AS g2"


@query("Q18", f"WITH {SERIES_SQL}, s AS (SELECT user_id, {_SK} FROM ser GROUP BY 1), j AS (SELECT user_id, n / 6.0 * (g1 * g1 + g2 * g2 / 4.0) AS jb FROM s) SELECT user_id, round(jb, 4) AS jb, round(exp(-jb / 2), 6) AS jarque_bera_p FROM j")
def jarque_bera(spark, sf_dir):
    out = C.jarque_bera(series(spark, sf_dir), ["user_id"])
    return rounded(out.withColumn("jb", F.round("jb", 4)))


@query("Q14", f"""WITH {SERIES_SQL}, s AS (SELECT user_id, {_SK} FROM ser GROUP BY 1 HAVING count(value) >= 8),
a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y, sqrt(2 * (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (g2 + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3))) AS b1 FROM s),
b AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS v, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a FROM a), c AS (SELECT *, ln(v + sqrt(v * v + 1)) / sqrt(0.5 * ln(w2)) AS z1, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS part FROM b),
d AS (SELECT *, (1 - 2 / (9 * a) - sign(part) * pow(abs(part), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM c) SELECT user_id, round(z1 * z1 + z2 * z2, 4) AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS dagostino_p FROM d""")
def dagostino_k2(spark, sf_dir):
    return rounded(C.dagostino(series(spark, sf_dir), ["user_id"]).withColumn("k2", F.round("k2", 4)))


_HALF = """h AS (SELECT user_id, value, CASE WHEN pos > count(*) OVER (PARTITION BY user_id) // 2 THEN 1 ELSE 0 END AS half FROM ser), z AS (SELECT user_id, half, abs(value - median(value) OVER (PARTITION BY user_id, half)) AS z FROM h),
g AS (SELECT user_id, half, count(*) AS n, avg(z) AS zm, var_pop(z) AS zv FROM z GROUP BY 1, 2)"""


@query("Q19", f"WITH {SERIES_SQL}, {_HALF} SELECT user_id, CAST(sum(n) AS BIGINT) AS n, round((sum(n) - 2) * (sum(n * zm * zm) - sum(n * zm) * sum(n * zm) / sum(n)) / sum(n * zv), 6) AS w FROM g GROUP BY 1")
def levene_statistic(spark, sf_dir):
    return rounded(C.levene_halves(series(spark, sf_dir), ["user_id"], "pos"))


@query("Q19")
def levene_p_values(spark, sf_dir):
    return C.levene_p(C.levene_halves(series(spark, sf_dir), ["user_id"], "pos"))


@query("Q20", f"""WITH {SESSIONS_SQL}, r AS (SELECT user_id, feature, split, rank() OVER w + (count(*) OVER (PARTITION BY user_id, feature, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY user_id, feature, value) AS c FROM feat WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id, feature ORDER BY value)),
a AS (SELECT user_id, feature, count(*) FILTER (split = 'train') AS n1, count(*) FILTER (split = 'test') AS n0, sum(r) FILTER (split = 'train') AS s, sum(c * c - 1) AS ties FROM r GROUP BY 1, 2)
SELECT user_id, feature, n1, n0, s - n1 * (n1 + 1) / 2.0 AS u, round((s - n1 * (n1 + 1) / 2.0 - n1 * n0 / 2.0) / sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1.0)))), 6) + 0.0 AS z FROM a""")
def train_test_shift(spark, sf_dir):
    out = C.mann_whitney(features(spark, sf_dir), BY, F.col("split") == "train")
    return out.withColumn("z", F.round("z", 6) + 0.0)


@query("Q20")
def train_test_shift_p(spark, sf_dir):
    return C.shift_p(C.mann_whitney(features(spark, sf_dir), BY, F.col("split") == "train")).withColumn("shifted", (F.col("p") < 0.01) & (F.col("n1") > 3) & (F.col("n0") > 3))


@query("Q21", f"""WITH {SESSIONS_SQL}, g AS (SELECT feature, user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM feat WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT feature, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, round((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 5) AS f FROM g GROUP BY 1""")
def anova_across_users(spark, sf_dir):
    return C.anova(features(spark, sf_dir), ["feature"], "user_id").withColumn("f", F.round("f", 5))


@query("Q21")
def anova_p_values(spark, sf_dir):
    return C.anova_p(C.anova(features(spark, sf_dir), ["feature"], "user_id"))


@query("W12 W14 W15")
def trend_p_values(spark, sf_dir):
    """p-values of the linear, rank-order and monotone trend tests."""
    from ..functions.tails import normal_p2, t_p

    s, u = series(spark, sf_dir), ["user_id"]
    lin = S.trend(S.compacted(s, u, "pos", "value"), u, "x", "value").select("user_id", "slope", t_p(F.col("t"), F.col("df").cast("double")).alias("linear_p"))
    rho = S.spearman_drift(s, u, "pos", "value").select("user_id", "rho", t_p(F.col("t"), (F.col("n") - 2).cast("double")).alias("spearman_p"))
    mk = S.mann_kendall(s, u, "pos", "value").select("user_id", normal_p2(F.col("z")).alias("mann_kendall_p"))
    return lin.join(rho, u).join(mk, u).withColumn("drifting", (F.col("linear_p") < 0.05) & (F.abs("slope") > 0.01))


@query("Q22", f"""WITH {SESSIONS_SQL}, a AS (SELECT user_id, feature, max(abs(value)) AS l, min(CASE WHEN abs(value) > 0 THEN abs(value) END) AS s, max(value) AS hi, min(value) AS lo, median(value) AS m FROM feat GROUP BY 1, 2)
SELECT user_id, feature, l > 1e10 AS overflow, l > 1e6 AND s < 1e-3 AS mixed_scales, l > 1e9 AS extreme, round(CASE WHEN abs(m) > 1e-10 THEN hi / m END, 6) AS max_to_median, round(CASE WHEN abs(m) > 1e-10 THEN lo / m END, 6) AS min_to_median FROM a""")
def extreme_values(spark, sf_dir):
    return rounded(C.extremes(features(spark, sf_dir), BY))


@query("Q26", f"""WITH {SESSIONS_SQL}, {_M}, {_P}, r AS (SELECT p.user_id, p.feature, p.n, q.std / abs(q.mean) AS cv, iqr3_outliers / p.n AS o, q.std, q.mean FROM p JOIN q USING (user_id, feature)),
t AS (SELECT *, concat_ws(';', CASE WHEN std <= 1e-9 THEN 'constant' END, CASE WHEN abs(mean) < 1e-6 THEN 'near_zero_mean' END, CASE WHEN cv > 0.3 THEN 'high_cv' END, CASE WHEN o > 0.05 THEN 'outliers' END) AS reasons FROM r)
SELECT user_id, feature, n, round(cv, 6) AS cv, round(o, 6) AS outlier_share, reasons, reasons = '' AS passes FROM t""")
def feature_quality(spark, sf_dir):
    return rounded(C.quality_record(features(spark, sf_dir), BY))


def metrics(spark, sf_dir):
    """One wide row of audit metrics for each user and feature."""
    d = C.with_outliers(D.with_ratios(D.with_quantiles(D.profiled(features(spark, sf_dir), BY)))).where("n > 0")
    d = d.withColumns({n: F.col(c) * 100 / F.col("n") for c, n in (("z_outliers", "z_outlier_pct"), ("iqr_outliers", "iqr_outlier_pct"), ("tail_outliers", "tail_outlier_pct"), ("peaks", "peak_pct"))})
    out = S.with_rank_dispersion(C.with_extremes(D.with_shares(D.with_entropy(d))))
    return out.withColumn("mad_to_std", F.col("mad") / F.col("std")).drop("x")


@query("Q23 Q28")
def metric_statuses(spark, sf_dir):
    return C.metric_statuses(metrics(spark, sf_dir), BY)


@query("Q24 K5")
def health_scores(spark, sf_dir):
    return C.health(C.metric_statuses(metrics(spark, sf_dir), BY), BY)


@query("Q27 K2")
def deep_audit(spark, sf_dir):
    return C.deep_audit(features(spark, sf_dir), BY)


@query("A22", f"""WITH {SESSIONS_SQL}, {_M}, {_P} SELECT feature, count(*) FILTER (iqr_outliers > 0) AS users_with_outliers, count(*) AS users FROM p GROUP BY 1""")
def issue_counts(spark, sf_dir):
    o = C.outlier_profile(features(spark, sf_dir), BY)
    return o.groupBy("feature").agg(F.sum((F.col("iqr_outliers") > 0).cast("long")).alias("users_with_outliers"), F.count(F.lit(1)).alias("users"))
