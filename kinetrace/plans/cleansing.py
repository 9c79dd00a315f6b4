"""Cleansing, splitting, imputing and scaling queries; label and set rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import FEATURES, SESSIONS_SQL, features, sessions, table
from ..operators import cleanse as C
from ..operators.describe import rounded
from ..registry import query

KEYS = ["user_id", "split", "pos", "genuine"]


@query("P6 P7 P8 P9", """SELECT o_orderkey, o_orderpriority AS raw, CASE WHEN contains(lower(lab), 'genuine') THEN 1 ELSE 0 END AS by_contains, CASE WHEN lab IS NULL THEN -1 WHEN lower(trim(lab)) = 'genuine' THEN 1 ELSE 0 END AS by_match
FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN ' Genuine ' WHEN '2-HIGH' THEN 'non-genuine' WHEN '3-MEDIUM' THEN NULL ELSE 'impostor' END AS lab FROM orders)""")
def label_rules(spark, sf_dir):
    p = F.col("o_orderpriority")
    lab = F.when(p == "1-URGENT", " Genuine ").when(p == "2-HIGH", "non-genuine").when(p == "3-MEDIUM", None).otherwise("impostor")
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("raw"), C.label_contains(F.coalesce(lab, F.lit(""))).alias("by_contains"), C.label_exact(lab).alias("by_match"))


@query("P1 P2 P3 P4 P5", """WITH t AS (SELECT l_linestatus AS g, 'flag' AS "column", l_returnflag AS raw FROM lineitem UNION ALL SELECT l_linestatus, 'qty', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem UNION ALL SELECT l_linestatus, 'mixed', CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE CAST(l_partkey AS VARCHAR) END FROM lineitem)
SELECT g, "column", round(avg(CASE WHEN try_cast(raw AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS numeric_share, sum(CASE WHEN raw IS NOT NULL AND try_cast(raw AS DOUBLE) IS NULL THEN 1 ELSE 0 END) = 0 AS strict FROM t GROUP BY 1, 2""")
def numeric_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("g"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").cast("string").alias("qty"), F.when(F.col("l_partkey") % 3 == 0, "x").otherwise(F.col("l_partkey").cast("string")).alias("mixed"))
    return rounded(C.numeric_share(df, ["flag", "qty", "mixed"], ["g"]))


@query("A7 A8 C4", f"""WITH {SESSIONS_SQL}, u AS (SELECT user_id, feature, sum(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) AS m, count(*) AS n FROM feat GROUP BY 1, 2)
SELECT feature, round(sum(m) / sum(n), 6) AS missing, round(max(m / n), 6) AS worst_user, max(m / n) > 0.3 AS drop FROM u GROUP BY 1""")
def missing_drop(spark, sf_dir):
    return rounded(C.worst_missing(features(spark, sf_dir), 0.3))


@query("A9 A10", f"""WITH {SESSIONS_SQL}, u AS (SELECT user_id, feature, coalesce(stddev_pop(value), 0) = 0 AS c FROM feat GROUP BY 1, 2), k AS (SELECT feature, CAST(sum(CASE WHEN c THEN 1 ELSE 0 END) AS BIGINT) AS constant_users, count(*) AS users FROM u GROUP BY 1), v AS (SELECT feature, var_samp(value) < 1e-8 AS low_variance FROM feat GROUP BY 1)
SELECT feature, constant_users, users, constant_users > 0.8 * users AS drop, low_variance FROM k JOIN v USING (feature)""")
def constant_drop(spark, sf_dir):
    long = features(spark, sf_dir)
    return C.constant_users(long).join(C.low_variance(long).select("feature", F.col("drop").alias("low_variance")), "feature")


@query("C1 C2 A32", "SELECT * FROM (VALUES ('copy', 'duplicate'), ('sparse', 'missing'), ('flat', 'variance'), ('quantity', 'correlated'), ('twin', NULL), ('price', NULL), ('discount', NULL)) t(feature, reason)")
def phase_one_cleanse(spark, sf_dir):
    """Sessions with planted faults: a copy, a sparse, a constant and a collinear feature."""
    from ..model import to_long

    s = sessions(spark, sf_dir).withColumns({"copy": F.col("price"), "sparse": F.when(F.col("pos") % 4 == 0, F.col("tax")), "flat": F.lit(1.0), "twin": F.col("quantity") * 2 + 1})
    long = to_long(s, ["quantity", "price", "discount", "copy", "sparse", "flat", "twin"])
    # The copy sorts before its source; the rule keeps the first name, so the source is renamed for a stable report.
    long = long.withColumn("feature", F.when(F.col("feature") == "copy", "price_copy").otherwise(F.col("feature")))
    return C.phase_one(long, KEYS).withColumn("feature", F.regexp_replace("feature", "^price_copy$", "copy"))


@query("J13 A23", f"""WITH {SESSIONS_SQL}, p AS (SELECT a.user_id, a.feature AS f1, b.feature AS f2, abs(corr(a.value, b.value)) AS c FROM feat a JOIN feat b ON a.user_id = b.user_id AND a.pos = b.pos AND a.split = b.split AND a.feature < b.feature AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2, 3)
SELECT f1, f2, round(sum(coalesce(c, 0)) / count(*), 6) AS avg_abs_corr, count(*) AS users FROM p GROUP BY 1, 2""")
def mean_feature_correlation(spark, sf_dir):
    c = C.row_correlations(sessions(spark, sf_dir), list(FEATURES), True)
    return rounded(c.groupBy("f1", "f2").agg((F.sum(F.coalesce(F.abs("corr"), F.lit(0.0))) / F.count(F.lit(1))).alias("avg_abs_corr"), F.count(F.lit(1)).alias("users")))


@query("C2", f"""WITH {SESSIONS_SQL}, r AS (SELECT feature, user_id, pos, split, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM feat WHERE value IS NOT NULL)
SELECT a.feature AS f1, b.feature AS f2, round(corr(a.r, b.r), 6) AS corr, count(*) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND a.pos = b.pos AND a.split = b.split AND a.feature < b.feature GROUP BY 1, 2""")
def spearman_matrix(spark, sf_dir):
    return rounded(C.feature_correlations(features(spark, sf_dir), KEYS, False, ranks=True))


_SPLIT = """sp AS (SELECT user_id, pos, genuine, split, quantity, tax, row_number() OVER (PARTITION BY user_id, genuine ORDER BY (pos * 48271) % 2147483647, pos) AS k, count(*) OVER (PARTITION BY user_id, genuine) AS n FROM sess),
pt AS (SELECT *, CASE WHEN k <= CASE WHEN n = 1 THEN 0 ELSE least(n - 1, greatest(1, round_even(n * 0.8, 0))) END THEN 'dev' ELSE 'holdout' END AS part FROM sp)"""


@query("C3", f"WITH {SESSIONS_SQL}, {_SPLIT} SELECT user_id, pos, genuine, part FROM pt")
def leakage_free_split(spark, sf_dir):
    return C.leak_free_split(sessions(spark, sf_dir), key=(F.col("pos") * 48271) % 2147483647).select("user_id", "pos", "genuine", "part")


@query("C5 C6 C7", f"""WITH {SESSIONS_SQL}, {_SPLIT}, m AS (SELECT user_id, median(tax) AS fill FROM pt WHERE part = 'dev' GROUP BY 1), f AS (SELECT pt.*, coalesce(tax, fill, 0) AS v FROM pt JOIN m USING (user_id)),
s AS (SELECT user_id, avg(v) AS mu, stddev_pop(v) AS sd FROM f WHERE part = 'dev' GROUP BY 1) SELECT user_id, pos, part, round((v - mu) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END, 6) + 0.0 AS value FROM f JOIN s USING (user_id)""")
def impute_and_scale(spark, sf_dir):
    s = C.leak_free_split(sessions(spark, sf_dir), key=(F.col("pos") * 48271) % 2147483647)
    long = s.select("user_id", "pos", "part", F.lit("tax").alias("feature"), F.col("tax").alias("value"))
    dev = F.col("part") == "dev"
    out = C.standardise(C.impute(long, dev), dev, C.CELL)
    return out.select("user_id", "pos", "part", (F.round("value", 6) + 0.0).alias("value"))


@query("C8", f"""WITH {SESSIONS_SQL} SELECT user_id, pos, round(CASE WHEN max(price) OVER w > min(price) OVER w THEN (price - min(price) OVER w) / (max(price) OVER w - min(price) OVER w) ELSE 0 END, 6) AS price FROM sess WINDOW w AS (PARTITION BY user_id)""")
def min_max_per_user(spark, sf_dir):
    return rounded(C.min_max(sessions(spark, sf_dir).select("user_id", "pos", "price"), ["user_id"], "price"))


@query("C9", f"""WITH {SESSIONS_SQL}, n AS (SELECT user_id, pos, count(*) OVER (PARTITION BY user_id) AS n FROM sess) SELECT user_id, pos, CASE WHEN pos <= least(n - 1, greatest(1, floor(n * 0.8))) THEN 'early' ELSE 'late' END AS part FROM n""")
def early_late_split(spark, sf_dir):
    return C.early_late(sessions(spark, sf_dir), ["user_id"], "pos").select("user_id", "pos", "part")


@query("S7 S8 S9 U1", """WITH a AS (SELECT 'train' AS src, l_orderkey AS sid, l_linenumber AS n, l_quantity AS qty, NULL AS tax FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT 'test', l_orderkey, l_linenumber, NULL, l_tax FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT src, sid, n, CAST(qty AS DOUBLE) AS qty, CAST(tax AS DOUBLE) AS tax, CASE WHEN count(*) OVER (PARTITION BY sid) > 1 THEN src || '_' || sid ELSE CAST(sid AS VARCHAR) END AS unique_id FROM a""")
def union_train_test(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pick = lambda src, keep, *cols: l.where(keep).select(F.lit(src).alias("src"), F.col("l_orderkey").alias("sid"), F.col("l_linenumber").alias("n"), *cols)
    both = pick("train", F.col("l_linenumber") % 2 == 1, F.col("l_quantity").cast("double").alias("qty")).unionByName(pick("test", F.col("l_linenumber") % 2 == 0, F.col("l_tax").cast("double").alias("tax")), allowMissingColumns=True)
    return C.distinct_ids(both, "sid", "src")


@query("U2 U3", """WITH c AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT count(DISTINCT user_id) AS n FROM c), h AS (SELECT event_type, count(*) AS users FROM c GROUP BY 1)
SELECT event_type, users, users = n AS in_all FROM h, n UNION ALL SELECT * FROM (VALUES ('missing_a', CAST(0 AS BIGINT), false)) t""")
def column_intersection(spark, sf_dir):
    """Names that every user has, and requested names that nobody has."""
    c = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    n = c.agg(F.countDistinct("user_id").alias("n"))
    have = c.groupBy("event_type").agg(F.count(F.lit(1)).alias("users")).join(F.broadcast(n)).select("event_type", "users", (F.col("users") == F.col("n")).alias("in_all"))
    asked = spark.createDataFrame([("click",), ("missing_a",)], "event_type string")
    gone = asked.exceptAll(c.select("event_type").distinct()).select("event_type", F.lit(0).cast("long").alias("users"), F.lit(False).alias("in_all"))
    return have.unionByName(gone)


@query("U4 S10", """WITH f AS (SELECT p_brand, min(p_partkey) AS first_pos FROM part GROUP BY 1) SELECT p_brand, first_pos, row_number() OVER (ORDER BY first_pos, p_brand) AS rank FROM f""")
def first_seen_distinct(spark, sf_dir):
    return C.first_seen(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("W1", """WITH f AS (SELECT o_custkey, o_orderstatus, o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS first FROM orders) SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY first, o_orderkey) AS seq FROM f""")
def chronological_order(spark, sf_dir):
    from ..operators.sequence import first_seen_order

    return first_seen_order(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey").select("o_custkey", "o_orderkey", "seq")


@query("P12 P14", """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / 1080.0, 6) + 0.0 AS x, round(CAST(embedding[2] AS DOUBLE) / 1920.0, 6) + 0.0 AS y, regexp_replace('user ' || label || '/v', '[^A-Za-z0-9_-]', '_', 'g') AS file_name FROM embeddings""")
def screen_normalised(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    part = lambda i, s: (F.round(F.col("embedding")[i].cast("double") / s, 6) + 0.0)
    return e.select("vec_id", part(0, 1080.0).alias("x"), part(1, 1920.0).alias("y"), F.regexp_replace(F.concat(F.lit("user "), F.col("label").cast("string"), F.lit("/v")), "[^A-Za-z0-9_-]", "_").alias("file_name"))
