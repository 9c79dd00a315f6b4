"""Evaluation queries: a session's score is how near it is to its user's mean price."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import SESSIONS_SQL, sessions, table
from ..operators import evaluate as E
from ..operators.describe import rounded
from ..registry import query

_S = "scd AS (SELECT user_id, pos, genuine, round(0.5 - abs(price - avg(price) OVER w) / stddev_pop(price) OVER w, 9) AS score FROM sess WINDOW w AS (PARTITION BY user_id))"
_R = """dr AS (SELECT user_id, {k} AS k, count(*) FILTER (genuine = 1 AND score >= {t}) / count(*) FILTER (genuine = 1) AS tar, count(*) FILTER (genuine = 1 AND score < {t}) / count(*) FILTER (genuine = 1) AS frr,
  count(*) FILTER (genuine = 0 AND score >= {t}) / count(*) FILTER (genuine = 0) AS far, count(*) FILTER (CASE WHEN score >= {t} THEN 1 ELSE 0 END = genuine) / count(*) AS accuracy FROM {f} GROUP BY ALL)"""


def scored(spark, sf_dir):
    w = Window.partitionBy("user_id")
    score = F.round(0.5 - F.abs(F.col("price") - F.avg("price").over(w)) / F.stddev_pop("price").over(w), 9)
    return sessions(spark, sf_dir).select("user_id", "pos", "genuine", score.alias("score"))


@query("M2", f"WITH {SESSIONS_SQL}, {_S}, {_R.format(k=0, t=-0.3, f='scd')} SELECT user_id, round(tar, 6) AS tar, round(frr, 6) AS frr, round(far, 6) AS far, round(accuracy, 6) AS accuracy FROM dr")
def decision_rates(spark, sf_dir):
    return rounded(E.decision_rates(scored(spark, sf_dir), ["user_id"], -0.3))


@query("M3 A26 O4", f"""WITH {SESSIONS_SQL}, {_S}, g AS (SELECT scd.*, k, k / 100.0 - 0.5 AS t FROM scd, (SELECT unnest(range(10, 60, 10)) AS k)), {_R.format(k='k', t='t', f='g')},
a AS (SELECT k, avg(tar) AS tar, avg(frr) AS frr, avg(far) AS far, max(far) AS max_far, avg(accuracy) AS accuracy FROM dr GROUP BY 1) SELECT k, round(tar, 6) AS tar, round(frr, 6) AS frr, round(far, 6) AS far, round(max_far, 6) AS max_far, round(accuracy, 6) AS accuracy, round((frr + far) / 2, 6) AS hter FROM a""")
def threshold_grid(spark, sf_dir):
    """A grid of five thresholds against all sessions: each row takes part in every cell, so rows are exploded."""
    s = scored(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(10), F.lit(50), F.lit(10)).cast("array<bigint>")))
    s = s.withColumn("score", F.when(F.col("score") >= F.col("k") / 100.0 - 0.5, 1.0).otherwise(-1.0))
    return rounded(E.half_total_error(E.decision_rates(s, ["user_id", "k"], 0.0), ["k"]))


_EER = """ec AS (SELECT user_id, score, sum(genuine) AS p, sum(1 - genuine) AS q FROM scd GROUP BY 1, 2), ew AS (SELECT user_id, score, sum(q) OVER d / sum(q) OVER w AS far, 1 - sum(p) OVER d / sum(p) OVER w AS frr FROM ec WINDOW w AS (PARTITION BY user_id), d AS (PARTITION BY user_id ORDER BY score DESC)),
el AS (SELECT *, coalesce(lag(far) OVER d, 0) AS far0, coalesce(lag(frr) OVER d, 1) AS frr0 FROM ew WINDOW d AS (PARTITION BY user_id ORDER BY score DESC)), eer AS (SELECT user_id, far0 + (frr0 - far0) / ((frr0 - far0) + (far - frr)) * (far - far0) AS eer FROM el WHERE far >= frr AND far0 < frr0)"""


@query("M4", f"WITH {SESSIONS_SQL}, {_S}, {_EER} SELECT user_id, round(eer, 6) AS eer FROM eer")
def equal_error_rate(spark, sf_dir):
    return rounded(E.equal_error_rate(scored(spark, sf_dir), ["user_id"]))


@query("A25 M5", f"""WITH {SESSIONS_SQL}, {_S}, {_EER}, r AS (SELECT user_id, genuine, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS r FROM scd), a AS (SELECT user_id, (sum(r) FILTER (genuine = 1) - sum(genuine) * (sum(genuine) + 1) / 2.0) / (sum(genuine) * sum(1 - genuine)) AS auc FROM r GROUP BY 1)
SELECT 'price' AS method, round(median(eer), 6) AS median_eer, round(avg(eer), 6) AS mean_eer, round(stddev_samp(eer), 6) AS std_eer, round(median(auc), 6) AS median_auc, count(DISTINCT user_id) AS users FROM eer JOIN a USING (user_id)""")
def validation_summary(spark, sf_dir):
    s = scored(spark, sf_dir)
    r = E.equal_error_rate(s, ["user_id"]).join(E.auc(s, ["user_id"], F.col("genuine") == 1, "score").select("user_id", F.col("raw_auc").alias("auc")), "user_id").withColumn("method", F.lit("price"))
    return rounded(E.validation_summary(r))


@query("M6 M7 O4", f"""WITH {SESSIONS_SQL}, {_S}, g AS (SELECT scd.*, k, k / 100.0 - 0.5 AS t FROM scd, (SELECT unnest(range(10, 60, 10)) AS k)), {_R.format(k='k', t='t', f='g')},
a AS (SELECT k, round(avg(tar), 9) AS tar, max(far) AS max_far, round((avg(frr) + avg(far)) / 2, 9) AS hter FROM dr GROUP BY 1) SELECT (SELECT k FROM a ORDER BY hter, k LIMIT 1) AS k_min_hter, (SELECT k FROM a WHERE max_far <= 0.9 ORDER BY tar DESC, k LIMIT 1) AS k_max_tar""")
def best_threshold(spark, sf_dir):
    t = threshold_grid(spark, sf_dir)
    return E.best_k(t, 0.9)


@query("F1 F2 F3 J17", """WITH p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.label = b.label AS same, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT id_a, id_b, same, round(s, 6) + 0.0 AS similarity, s >= 0.25 AS same_person FROM p""")
def verify_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("id_a"), F.col("label").alias("la"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("id_b"), F.col("label").alias("lb"), F.col("embedding").alias("b"))
    out = E.verify(a.join(b, F.col("id_b") == F.col("id_a") + 1))
    return out.select("id_a", "id_b", (F.col("la") == F.col("lb")).alias("same"), (F.round("similarity", 6) + 0.0).alias("similarity"), "same_person")


@query("A29 A30", """WITH p AS (SELECT a.label = b.label AS same, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 2) WHERE a.label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) >= 2))
SELECT same, count(*) AS n, round(avg(s), 6) + 0.0 AS mean, round(min(s), 6) + 0.0 AS least, round(max(s), 6) + 0.0 AS most FROM p GROUP BY 1""")
def similarity_summary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("label").alias("la"), F.col("embedding").alias("a"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("vec_id"))
    people = e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.col("label").alias("la"))
    p = a.join(people, "la", "left_semi").join(e.withColumnRenamed("embedding", "b"), "vec_id")
    s = p.select((F.col("la") == F.col("label")).alias("same"), E.cosine(F.col("a"), F.col("b")).alias("s"))
    return rounded(s.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean"), F.min("s").alias("least"), F.max("s").alias("most")))


@query("J16 D11", """WITH p AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY d, neighbour) AS rank FROM p)
SELECT label, vec_id, neighbour, round(d, 6) AS distance, rank FROM r WHERE rank <= 5""")
def nearest_sessions(spark, sf_dir):
    return rounded(E.nearest_within(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 5))


@query("K11", """WITH s AS (SELECT event_type, list_sort(list(value)) AS x, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(mean, 6) AS mean, x[CAST(floor(n * 0.5) AS INT) + 1] AS p50, x[CAST(floor(n * 0.95) AS INT) + 1] AS p95, x[CAST(floor(n * 0.99) AS INT) + 1] AS p99 FROM s""")
def latency_percentiles(spark, sf_dir):
    return rounded(E.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value"))
