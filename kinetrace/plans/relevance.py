"""Ranking and consensus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import FEATURES, SERIES_SQL, SESSIONS_SQL, features, series, sessions
from ..operators import cleanse as C
from ..operators import relevance as R
from ..operators.describe import rounded
from ..registry import query

_AUC = """ar AS (SELECT user_id, feature, genuine, rank() OVER (PARTITION BY user_id, feature ORDER BY value) + (count(*) OVER (PARTITION BY user_id, feature, value) - 1) / 2.0 AS r FROM feat WHERE value IS NOT NULL),
au AS (SELECT user_id, feature, sum(genuine) AS p, sum(1 - genuine) AS q, sum(CASE WHEN genuine = 1 THEN r END) AS s FROM ar GROUP BY 1, 2),
aucs AS (SELECT user_id, feature, (s - p * (p + 1) / 2.0) / (p * q) AS raw_auc, greatest((s - p * (p + 1) / 2.0) / (p * q), 1 - (s - p * (p + 1) / 2.0) / (p * q)) AS auc, CASE WHEN (s - p * (p + 1) / 2.0) / (p * q) >= 0.5 THEN 'higher' ELSE 'lower' END AS direction FROM au WHERE p > 0 AND q > 0),
dd AS (SELECT feature, direction AS dominant_direction FROM (SELECT feature, direction, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, direction) AS k FROM aucs GROUP BY 1, 2) WHERE k = 1),
det AS (SELECT feature, median(auc) AS median_auc, stddev_samp(auc) AS std_auc, count(*) AS num_users, min(auc) AS min_auc, max(auc) AS max_auc, any_value(dominant_direction) AS dominant_direction FROM aucs JOIN dd USING (feature) GROUP BY 1)"""
_DET = "round(median_auc, 6) AS median_auc, round(std_auc, 6) AS std_auc, num_users, round(min_auc, 6) AS min_auc, round(max_auc, 6) AS max_auc, dominant_direction"


@query("R1 P5 P8 M5", f"WITH {SESSIONS_SQL}, {_AUC} SELECT user_id, feature, round(raw_auc, 6) AS raw_auc, round(auc, 6) AS auc FROM aucs")
def feature_auc(spark, sf_dir):
    return rounded(R.feature_auc(features(spark, sf_dir)).select("user_id", "feature", "raw_auc", "auc"))


@query("R1 R2 R19 A16 A17 O1 J6", f"WITH {SESSIONS_SQL}, {_AUC} SELECT feature, {_DET}, row_number() OVER (ORDER BY median_auc DESC, std_auc ASC NULLS LAST, feature) AS rank FROM det WHERE median_auc >= 0.52")
def auc_noise_purge(spark, sf_dir):
    return rounded(R.noise_purge(R.auc_details(R.feature_auc(features(spark, sf_dir)))))


_FISHER = """fu AS (SELECT user_id, feature, count(*) AS n, avg(value) AS m, var_samp(value) AS vs, var_pop(value) AS vp, stddev_samp(value) / avg(value) AS cv FROM feat WHERE value IS NOT NULL GROUP BY 1, 2),
fv AS (SELECT feature, CAST(sum(n) AS BIGINT) AS n, avg(vs) AS wm, sum(n * vp) / sum(n) AS wp, sum(n * m * m) / sum(n) - pow(sum(n * m) / sum(n), 2) AS b, avg(cv) AS cv_mean FROM fu GROUP BY 1)"""


@query("R3 R4 R5", f"WITH {SESSIONS_SQL}, {_FISHER} SELECT feature, n, round(b / (wm + 1e-10), 5) AS fisher_v1, round(b / (wp + 1e-10), 5) AS fisher_v3, round(cv_mean, 5) AS cv_mean FROM fv")
def fisher_user_score(spark, sf_dir):
    return rounded(R.fisher_users(features(spark, sf_dir)).select("feature", "n", "fisher_v1", "fisher_v3", "cv_mean"), 5)


_F4 = """f4 AS (SELECT user_id, feature, CASE WHEN count(*) FILTER (genuine = 1) >= 2 AND count(*) FILTER (genuine = 0) >= 2 AND var_pop(value) FILTER (genuine = 1) + var_pop(value) FILTER (genuine = 0) > 0
  THEN pow(avg(value) FILTER (genuine = 1) - avg(value) FILTER (genuine = 0), 2) / (var_pop(value) FILTER (genuine = 1) + var_pop(value) FILTER (genuine = 0)) ELSE 0 END AS fisher FROM feat WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query("R6", f"WITH {SESSIONS_SQL}, {_F4} SELECT user_id, feature, round(fisher, 6) + 0.0 AS fisher FROM f4")
def fisher_two_class(spark, sf_dir):
    return rounded(R.fisher_classes(features(spark, sf_dir)))


_MI = """mb AS (SELECT feature, genuine, least(floor((value - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS c FROM feat JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM feat GROUP BY 1) USING (feature) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
mi AS (SELECT feature, sum(c / n * ln(c * n / (g * b))) AS information FROM (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, genuine) AS g, sum(c) OVER (PARTITION BY feature, bin) AS b FROM mb) GROUP BY 1)"""


@query("R7", f"WITH {SESSIONS_SQL}, {_MI} SELECT feature, round(information, 9) AS information FROM mi")
def binned_mutual_information(spark, sf_dir):
    return R.binned_information(features(spark, sf_dir), ["feature"]).withColumn("information", F.round("information", 9))


@query("R11", f"""WITH {SERIES_SQL}, d AS (SELECT user_id, pos, CAST(pos AS DOUBLE) AS x, value AS y FROM ser), p AS (SELECT a.user_id, a.pos, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b FROM d a JOIN d b ON a.user_id = b.user_id),
r AS (SELECT user_id, pos, sum(a) AS ra, sum(b) AS rb, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb, count(*) AS n FROM p GROUP BY 1, 2),
t AS (SELECT user_id, CAST(max(n) AS DOUBLE) AS n, sum(ra) AS ra, sum(rb) AS rb, sum(ab) AS ab, sum(aa) AS aa, sum(bb) AS bb, sum(ra * rb) AS rr, sum(ra * ra) AS raa, sum(rb * rb) AS rbb FROM r GROUP BY 1)
SELECT user_id, round(sqrt(greatest(ab / n ** 2 + ra * rb / n ** 4 - 2 * rr / n ** 3, 0) / sqrt((aa / n ** 2 + ra * ra / n ** 4 - 2 * raa / n ** 3) * (bb / n ** 2 + rb * rb / n ** 4 - 2 * rbb / n ** 3))), 6) AS dcor FROM t""")
def distance_correlation(spark, sf_dir):
    return rounded(R.distance_correlation(series(spark, sf_dir), ["user_id"], "pos", "value"))


def scores(spark, sf_dir):
    """Per feature: median AUC, mean two-class Fisher, binned information, user Fisher."""
    long = features(spark, sf_dir)
    a = R.auc_details(R.feature_auc(long)).select("feature", F.col("median_auc").alias("auc"))
    f = R.fisher_classes(long).groupBy("feature").agg(F.avg("fisher").alias("fisher"))
    m = R.binned_information(long, ["feature"])
    return R.merged_scores(a, f, m).join(R.fisher_users(long).select("feature", F.col("fisher_v3").alias("users")), "feature", "left")


_SCORES = f"""{_AUC}, {_FISHER}, {_F4}, {_MI}, sc AS (SELECT d.feature, median_auc AS auc, f.fisher, information, b / (wp + 1e-10) AS users FROM det d JOIN (SELECT feature, avg(fisher) AS fisher FROM f4 GROUP BY 1) f USING (feature) JOIN mi USING (feature) LEFT JOIN fv USING (feature))"""
_PCT = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query("J1 J2 A24", f"WITH {SESSIONS_SQL}, {_SCORES} SELECT feature, round(auc, 6) AS auc, round(fisher, 6) AS fisher, round(information, 6) AS information, round(users, 5) AS users FROM sc")
def merge_scores(spark, sf_dir):
    return rounded(scores(spark, sf_dir).withColumn("users", F.round("users", 5)))


@query("R21 J3", f"""WITH {SESSIONS_SQL}, {_SCORES}, s AS (SELECT feature, CASE WHEN feature <> 'tax' THEN auc END AS auc, fisher, information FROM sc),
p AS (SELECT s.feature, coalesce(a.p, 0.5) AS a, {_PCT.format(c='fisher')} AS b, {_PCT.format(c='information')} AS c FROM s LEFT JOIN (SELECT feature, {_PCT.format(c='auc')} AS p FROM s WHERE auc IS NOT NULL) a USING (feature))
SELECT feature, round(0.5 * a + 0.15 * b + 0.35 * c, 6) AS avg_percentile, round(sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 2), 6) AS std_percentile FROM p""")
def consensus_three(spark, sf_dir):
    s = scores(spark, sf_dir)
    a = s.where("feature <> 'tax'").select("feature", "auc")
    full = a.join(s.select("feature", "fisher"), "feature", "full").join(s.select("feature", "information"), "feature", "full")
    out = R.consensus_percentiles(full, {"auc": 0.5, "fisher": 0.15, "information": 0.35})
    return rounded(out.select("feature", "avg_percentile", "std_percentile"))


@query("R22", f"""WITH {SESSIONS_SQL}, {_SCORES}, p AS (SELECT feature, ({_PCT.format(c='auc')} + {_PCT.format(c='fisher')} + {_PCT.format(c='information')} + {_PCT.format(c='users')}) / 4 AS s FROM sc)
SELECT feature, round(s, 6) AS apr_score, dense_rank() OVER (ORDER BY round(s, 9) DESC) AS apr_rank FROM p""")
def consensus_average_percentile(spark, sf_dir):
    return rounded(R.consensus_equal(scores(spark, sf_dir), ["auc", "fisher", "information", "users"]).select("feature", "apr_score", "apr_rank"))


@query("R23 J7 O3", f"""WITH {SESSIONS_SQL}, {_SCORES}, r AS (SELECT feature, rank() OVER (ORDER BY auc DESC) AS a, rank() OVER (ORDER BY fisher DESC) AS f, rank() OVER (ORDER BY information DESC) AS i FROM sc),
u AS (SELECT feature, CASE WHEN feature <> 'discount' THEN rank() OVER (ORDER BY CASE WHEN feature <> 'discount' THEN users END DESC NULLS LAST) END AS u FROM sc),
c AS (SELECT feature, a, f, i, coalesce(u, (SELECT count(*) FROM sc) + 1) AS u FROM r JOIN u USING (feature)) SELECT feature, a AS auc_rank, f AS fisher_rank, i AS information_rank, u AS users_rank, round((2.0 * a + f + i + u) / 5, 6) AS consensus, row_number() OVER (ORDER BY round((2.0 * a + f + i + u) / 5, 9), feature) AS final_rank FROM c""")
def consensus_weighted_ranks(spark, sf_dir):
    s = scores(spark, sf_dir)
    gaps = s.withColumn("users", F.when(F.col("feature") != "discount", F.col("users")))
    return rounded(R.consensus_ranks(gaps, {"auc": 2.0, "fisher": 1.0, "information": 1.0, "users": 1.0}, s))


@query("J14", f"""WITH {SESSIONS_SQL}, u AS (SELECT user_id, feature, sum(value) AS s, count(value) AS n FROM feat GROUP BY 1, 2) SELECT user_id, feature, CAST(sum(n) OVER (PARTITION BY feature) - n AS BIGINT) AS others, round((sum(s) OVER (PARTITION BY feature) - s) / (sum(n) OVER (PARTITION BY feature) - n), 5) AS mean_others FROM u""")
def leave_one_user_out(spark, sf_dir):
    return rounded(R.leave_one_out_means(features(spark, sf_dir)), 5)


@query("R20")
def mrmr_selection(spark, sf_dir):
    """Both matrices have a row for each feature or pair of features, however many sessions there are."""
    long = features(spark, sf_dir)
    rel = {r.feature: r.median_auc for r in R.auc_details(R.feature_auc(long)).collect()}
    c = C.row_correlations(sessions(spark, sf_dir), list(FEATURES), True).groupBy("f1", "f2").agg(F.avg(F.abs("corr")).alias("c"))
    red = {(r.f1, r.f2): r.c or 0.0 for r in c.collect()}
    return spark.createDataFrame([(i + 1, f, round(s, 6)) for i, (f, s) in enumerate(R.mrmr(rel, red, 40))], "rank long, feature string, mrmr_score double")


@query("R25 O2 J8", f"""WITH {SESSIONS_SQL}, {_AUC}, t AS (SELECT feature FROM det ORDER BY median_auc DESC, feature LIMIT 2) SELECT user_id, feature, round(auc, 6) AS auc FROM aucs SEMI JOIN t USING (feature)""")
def auc_baseline(spark, sf_dir):
    a = R.feature_auc(features(spark, sf_dir))
    top = R.auc_details(a).orderBy(F.desc("median_auc"), "feature").limit(2)
    return rounded(a.join(top.select("feature"), "feature", "left_semi").select("user_id", "feature", "auc"))
