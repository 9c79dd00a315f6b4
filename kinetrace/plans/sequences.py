"""Sequence queries over the events of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SERIES_SQL, SESSIONS_SQL, features, series
from ..operators import sequence as S
from ..operators.describe import rounded
from ..registry import query

U = ["user_id"]
HOUR = 3_600_000.0


@query("W2 W8 W9 W10", f"""WITH {SERIES_SQL}, d AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS l1, lead(value, 2) OVER w AS l2 FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, round(avg(abs(value - b)), 6) AS change_mean, round(stddev_samp(abs(value - b)), 6) AS change_std, round(corr(value, l1), 6) AS autocorr_1, round(corr(value, l2), 6) AS autocorr_2,
  round(var_samp(CASE WHEN abs(b) > 1e-10 THEN value / b END), 4) AS ratio_variance FROM d GROUP BY 1""")
def successive_statistics(spark, sf_dir):
    s = series(spark, sf_dir)
    out = S.session_change(s, U, "pos", "value").join(S.autocorrelation(s, U, "pos", "value"), U).join(S.successive_ratio_variance(s, U, "pos", "value"), U)
    return rounded(out.withColumn("ratio_variance", F.round("ratio_variance", 4)))


@query("W11", f"""WITH {SERIES_SQL} SELECT user_id, round((max(value) - min(value)) / (count(*) - 1) / (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) AS rank_dispersion FROM ser GROUP BY 1""")
def rank_dispersion(spark, sf_dir):
    return rounded(S.rank_dispersion(series(spark, sf_dir), U, "value"))


@query("W3 W4", f"""WITH {SERIES_SQL}, c AS (SELECT user_id, pos, stddev_samp(value) OVER w / abs(avg(value) OVER w) AS cv, count(*) OVER w AS k5 FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
f AS (SELECT user_id, cv, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, cv - lag(cv) OVER w AS up FROM c WHERE k5 = 5 WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT user_id, max(n) AS windows, avg(CASE WHEN k <= n // 2 THEN cv END) AS early, avg(CASE WHEN k > n // 2 THEN cv END) AS late, CAST(sum(CASE WHEN up > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rises FROM f GROUP BY 1)
SELECT user_id, windows, round(early, 6) AS early, round(late, 6) AS late, rises, late > 1.3 * early AND rises >= ceil(0.5 * (windows - 1)) AS drifting FROM g""")
def rolling_cv_drift(spark, sf_dir):
    return rounded(S.rolling_cv(series(spark, sf_dir), U, "pos", "value"))


@query("W5", f"""WITH RECURSIVE {SERIES_SQL}, r AS (SELECT user_id, pos AS k, value AS ewma FROM ser WHERE pos = 1 UNION ALL SELECT s.user_id, s.pos, 0.1 * s.value + 0.9 * r.ewma FROM r JOIN ser s ON s.user_id = r.user_id AND s.pos = r.k + 1)
SELECT user_id, k, round(ewma, 6) AS ewma FROM r""")
def ewma_series(spark, sf_dir):
    return rounded(S.ewma(series(spark, sf_dir), U, "pos", "value"))


@query("W6", f"""WITH {SERIES_SQL}, d AS (SELECT user_id, pos, value - lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS diff, count(*) OVER (PARTITION BY user_id) AS n FROM ser),
s AS (SELECT *, CASE WHEN diff > 1e-9 THEN 1 WHEN diff < -1e-9 THEN -1 ELSE 0 END AS sign FROM d WHERE diff IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) - row_number() OVER (PARTITION BY user_id, sign ORDER BY pos) AS island FROM s),
r AS (SELECT user_id, n, sign, island, count(*) AS length FROM i GROUP BY ALL), m AS (SELECT user_id, n, coalesce(max(CASE WHEN sign = 1 THEN length END), 0) AS up, coalesce(max(CASE WHEN sign = -1 THEN length END), 0) AS down FROM r GROUP BY 1, 2)
SELECT user_id, n, up, down, CASE WHEN up >= ceil(0.3 * n) THEN 'up' WHEN down >= ceil(0.3 * n) THEN 'down' ELSE 'none' END AS direction FROM m""")
def longest_runs(spark, sf_dir):
    return S.longest_run(series(spark, sf_dir), U, "pos", "value")


@query("W7", f"""WITH {SERIES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ser), m AS (SELECT user_id, median(CASE WHEN pos <= n // 2 THEN value END) AS a, median(CASE WHEN pos > n // 2 THEN value END) AS b FROM n GROUP BY 1)
SELECT user_id, round(a, 6) AS median_first, round(b, 6) AS median_second, round(b - a, 6) AS shift FROM m""")
def half_median_shift(spark, sf_dir):
    return rounded(S.half_shift(series(spark, sf_dir), U, "pos", "value"))


_TREND = """SELECT user_id, feature, round(regr_slope(value, x), 6) AS slope, round(regr_intercept(value, x), 5) AS intercept, round(regr_r2(value, x), 6) AS r2, count(value) AS n FROM {t} GROUP BY 1, 2"""


@query("W1 W12 P10", f"WITH {SESSIONS_SQL}, c AS (SELECT user_id, feature, value, row_number() OVER (PARTITION BY user_id, feature ORDER BY pos) - 1 AS x FROM feat WHERE value IS NOT NULL) " + _TREND.format(t="c"))
def linear_trend(spark, sf_dir):
    by = ["user_id", "feature"]
    out = S.trend(S.compacted(features(spark, sf_dir), by, "pos", "value"), by, "x", "value")
    return rounded(out.select(*by, "slope", F.round("intercept", 5).alias("intercept"), "r2", "n"))


@query("W13", f"WITH {SESSIONS_SQL}, c AS (SELECT user_id, feature, value, CASE WHEN value IS NOT NULL THEN pos END AS x FROM feat) " + _TREND.format(t="c"))
def linear_trend_with_gaps(spark, sf_dir):
    by = ["user_id", "feature"]
    out = S.trend(features(spark, sf_dir), by, "pos", "value")
    return rounded(out.select(*by, "slope", F.round("intercept", 5).alias("intercept"), "r2", "n"))


@query("W14", f"""WITH {SERIES_SQL}, s AS (SELECT a.user_id, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s FROM ser a JOIN ser b ON a.user_id = b.user_id AND a.pos < b.pos GROUP BY 1),
t AS (SELECT user_id, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tied FROM (SELECT user_id, value, count(*) AS c FROM ser GROUP BY 1, 2) GROUP BY 1), v AS (SELECT user_id, CAST(n AS BIGINT) AS n, s, (n * (n - 1) * (2 * n + 5) - tied) / 18.0 AS var FROM t JOIN s USING (user_id))
SELECT user_id, n, s, round(var, 6) AS var, round((s - sign(s)) / sqrt(var), 6) AS z FROM v""")
def mann_kendall(spark, sf_dir):
    return rounded(S.mann_kendall(series(spark, sf_dir), U, "pos", "value"))


@query("W15", f"""WITH {SERIES_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS r FROM ser), c AS (SELECT user_id, count(*) AS n, corr(r, pos) AS rho FROM r GROUP BY 1)
SELECT user_id, n, round(rho, 6) AS rho, n > 10 AND abs(rho) > 0.3 AS strong FROM c""")
def spearman_drift(spark, sf_dir):
    return rounded(S.spearman_drift(series(spark, sf_dir), U, "pos", "value").select("user_id", "n", "rho", "strong"))


@query("W16", f"""WITH {SERIES_SQL} SELECT user_id, pos, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS rank_min, dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS rank_dense,
  round((rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0) / count(*) OVER (PARTITION BY user_id), 6) AS rank_pct FROM ser""")
def ranking_functions(spark, sf_dir):
    from pyspark.sql.window import Window

    down = Window.partitionBy("user_id").orderBy(F.desc("value"))
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return series(spark, sf_dir).select("user_id", "pos", F.rank().over(down).cast("long").alias("rank_min"), F.dense_rank().over(down).cast("long").alias("rank_dense"), F.round(S.average_rank(U, "value") / n, 6).alias("rank_pct"))


@query("W17", f"""WITH {SERIES_SQL}, n AS (SELECT user_id, count(*) AS n FROM ser GROUP BY 1), w AS (SELECT user_id, unnest(range(0, CASE WHEN n >= 16 THEN (n - 16) // 8 + 1 ELSE 0 END)) AS window FROM n)
SELECT w.user_id, w.window, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM w JOIN ser s ON s.user_id = w.user_id AND s.pos > w.window * 8 AND s.pos <= w.window * 8 + 16 GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    w = S.windows(series(spark, sf_dir), U, "pos", "value", 16, 8)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return w.select("user_id", "window", F.size("x").cast("long").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.array_max("x"), 6).alias("max"))


@query("W18", f"""WITH {SERIES_SQL} SELECT user_id, pos, round(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM ser""")
def moving_average(spark, sf_dir):
    return rounded(S.centred_mean(series(spark, sf_dir), U, "pos", "value", 5).select("user_id", "pos", "smooth"))


@query("W21 E16", f"""WITH {SERIES_SQL}, d AS (SELECT user_id, (ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms)) / 3600 AS diff FROM ser), g AS (SELECT user_id, round_even(diff / 5, 0) * 5 AS gap FROM d WHERE diff > 0 AND diff <= 2000),
m AS (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, gap) AS k FROM g WHERE gap > 0 GROUP BY 1, 2)
SELECT u.user_id, round(CASE WHEN 1000.0 / gap BETWEEN 1 AND 200 THEN 1000.0 / gap ELSE 20 END, 6) AS hz FROM (SELECT DISTINCT user_id FROM ser) u LEFT JOIN m ON m.user_id = u.user_id AND k = 1""")
def sampling_rate(spark, sf_dir):
    # Events are hours apart; seconds stand for hours here.
    return rounded(S.sampling_rate(series(spark, sf_dir).withColumn("ms", F.col("ms") / 3600), U, "ms"))


@query("J9 E13 P11", f"""WITH {SERIES_SQL}, t AS (SELECT s.user_id, s.pos, s.ms, max(n.ms) AS nav FROM ser s LEFT JOIN ser n ON n.user_id = s.user_id AND n.screen = 'view' AND n.ms <= s.ms WHERE s.screen <> 'view' GROUP BY 1, 2, 3),
r AS (SELECT user_id, (ms - nav) / 3600 AS reaction FROM t WHERE (ms - nav) / 3600 BETWEEN 100 AND 50000)
SELECT user_id, count(*) AS n, round(avg(reaction), 6) AS mean, round(median(reaction), 6) AS median, round(stddev_pop(reaction), 6) AS std, round(quantile_cont(reaction, 0.95), 6) AS p95, round(min(reaction), 6) AS fastest, round(max(reaction), 6) AS slowest FROM r GROUP BY 1 HAVING count(*) >= 3""")
def touch_asof_reaction(spark, sf_dir):
    s = series(spark, sf_dir)
    nav = s.where("screen = 'view'").select("user_id", F.col("ms").alias("nav"))
    r = S.as_of(s.where("screen <> 'view'"), nav, U, "ms", "nav", []).withColumn("reaction", (F.col("ms") - F.col("nav_asof")) / 3600).where(F.col("reaction").between(100, 50000))
    out = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("reaction").alias("mean"), F.median("reaction").alias("median"), F.stddev_pop("reaction").alias("std"), F.percentile("reaction", F.lit(0.95)).alias("p95"), F.min("reaction").alias("fastest"), F.max("reaction").alias("slowest"))
    return rounded(out.where("n >= 3"))


@query("J10 J11", f"""WITH {SERIES_SQL} SELECT t.user_id, t.pos, count(*) AS n, round(avg(s.value), 6) AS mean, round(max(s.value), 6) AS max FROM ser t JOIN ser s ON s.user_id = t.user_id AND s.screen <> 'click' AND s.ms BETWEEN t.ms - {6 * HOUR} AND t.ms + {6 * HOUR}
WHERE t.screen = 'click' GROUP BY 1, 2 HAVING count(*) >= 2""")
def touch_interval_sensors(spark, sf_dir):
    s = series(spark, sf_dir)
    touch = s.where("screen = 'click'").select("user_id", "pos", F.col("ms").alias("down"))
    sensors = s.where("screen <> 'click'").select("user_id", "ms", "value")
    pairs = S.within(touch, sensors, U, "down", "ms", 6 * HOUR, 6 * HOUR)
    return rounded(pairs.groupBy("user_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max")).where("n >= 2"))


@query("J12 E3", f"""WITH {SERIES_SQL}, l AS (SELECT user_id, (lead(ms) OVER w - ms) / 1000 AS d, (lead(ms, 2) OVER w - ms) / 1000 AS t FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT user_id, count(d) AS digraphs, count(t) AS trigraphs, round(avg(d), 4) AS flight_mean, round(avg(t), 4) AS trigraph_mean, round(stddev_pop(t), 4) AS trigraph_std FROM l GROUP BY 1""")
def lag_pairs(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("pos")
    l = series(spark, sf_dir).select("user_id", ((F.lead("ms").over(w) - F.col("ms")) / 1000).alias("d"), ((F.lead("ms", 2).over(w) - F.col("ms")) / 1000).alias("t"))  # noqa: E741
    return l.groupBy("user_id").agg(F.count("d").alias("digraphs"), F.count("t").alias("trigraphs"), F.round(F.avg("d"), 4).alias("flight_mean"), F.round(F.avg("t"), 4).alias("trigraph_mean"), F.round(F.stddev_pop("t"), 4).alias("trigraph_std"))
