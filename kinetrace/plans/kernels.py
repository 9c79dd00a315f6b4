"""Queries of grouped numerical operators; their results have no SQL form and are tested on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import features, series, sessions
from ..operators import cleanse as C
from ..operators import evaluate as E
from ..operators import grouped as G
from ..operators import relevance as R
from ..operators import sequence as S
from ..operators.describe import correlation
from ..registry import query

NAMES = ["quantity", "price", "discount", "tax"]


def split_rows(spark, sf_dir):
    return C.leak_free_split(sessions(spark, sf_dir)).withColumn("dev", F.col("part") == "dev")


@query("Q7 Q8 Q9 Q10 Q13 Q15 Q16 Q17")
def distribution_kernels(spark, sf_dir):
    return G.distribution_kernels(series(spark, sf_dir), ["user_id"])


@query("W19")
def change_points(spark, sf_dir):
    return G.change_point(series(spark, sf_dir), ["user_id"])


@query("W20 A20 A21")
def drift_verdicts(spark, sf_dir):
    """Any of the four drift rules, and whether the series is long enough to be relied on."""
    s, u = series(spark, sf_dir), ["user_id"]
    lin = S.trend(S.compacted(s, u, "pos", "value"), u, "x", "value").select("user_id", "slope", "n", (F.abs("slope") > 0.01).alias("linear"))
    roll = S.rolling_cv(s, u, "pos", "value").select("user_id", F.col("drifting").alias("rolling"))
    e = S.ewma(s, u, "pos", "value")
    run = S.longest_run(e, u, "k", "ewma").select("user_id", (F.col("direction") != "none").alias("persistent"))
    brk = G.change_point(s, u).select("user_id", F.col("changed").alias("broken"))
    out = lin.join(roll, u, "left").join(run, u, "left").join(brk, u, "left")
    return out.withColumns({"drifting": F.col("linear") | F.coalesce("rolling", F.lit(False)) | F.coalesce("persistent", F.lit(False)) | F.coalesce("broken", F.lit(False)), "reliable": F.col("n") >= 20})


@query("R7 R8 R9 R10")
def neighbour_rankings(spark, sf_dir):
    return G.feature_kernels(sessions(spark, sf_dir), NAMES)


@query("M1 M9 M10 M11")
def one_class_validation(spark, sf_dir):
    """Per user: rates on held-out sessions at -0.3, equal error rate and AUC of a model of its own sessions."""
    s = G.one_class_scores(split_rows(spark, sf_dir), NAMES, "dev").where("not dev and score is not null and not isnan(score)")
    rates = E.decision_rates(s, ["user_id"], -0.3)
    auc = E.auc(s, ["user_id"], F.col("genuine") == 1, "score").select("user_id", F.col("raw_auc").alias("auc"))
    return rates.join(E.equal_error_rate(s, ["user_id"]), "user_id", "left").join(auc, "user_id", "left")


@query("M9 C9")
def late_session_rejections(spark, sf_dir):
    """Train on the first 80 % of sessions; rejection rate of the rest and its correlation with their order."""
    s = C.early_late(sessions(spark, sf_dir).where("genuine = 1"), ["user_id"], "pos").withColumn("early", F.col("part") == "early")
    d = G.one_class_scores(s, NAMES, "early").where("not early")
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") < -0.3).cast("double")).alias("frr"), correlation(F.col("score"), F.col("pos")).alias("trend")).withColumn("high_frr", F.col("frr") > 0.15)


@query("K7 D14")
def model_table(spark, sf_dir):
    return G.model_table(sessions(spark, sf_dir), NAMES)


@query("R15 R16")
def model_importance(spark, sf_dir):
    return G.importance(sessions(spark, sf_dir), NAMES)


@query("M6 M7")
def feature_count_selection(spark, sf_dir):
    """Mean rates over users for each number of ranked features."""
    order = [r.feature for r in R.auc_details(R.feature_auc(features(spark, sf_dir))).orderBy(F.desc("median_auc"), "feature").select("feature").collect()]
    return E.half_total_error(G.k_grid(split_rows(spark, sf_dir), order, [1, 2, 3, 4]), ["k"])
