"""Session features from events, reports, and learned rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import features, table
from ..operators import control as Q
from ..operators import extract as X
from ..operators.describe import rounded
from ..registry import query
from ..sources import readers, writers

_WEEK = """w AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(user_id AS VARCHAR) || '-' || CAST(floor(epoch_us(ts) / 1000.0 / 604800000.0) AS BIGINT) AS session_id, epoch_us(ts) / 1000.0 / 3600.0 AS t, event_type, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS p, event_id FROM events)"""


def nested(spark, sf_dir):
    return X.sessions_from_events(table(spark, sf_dir, "events"))


@query("S1 D1 D2 D3 D4 D5", f"""WITH {_WEEK} SELECT user_id, session_id, count(*) FILTER (event_type IN ('view', 'signup')) AS navigations, count(*) FILTER (event_type IN ('click', 'purchase')) AS touches, count(*) AS samples FROM w GROUP BY 1, 2""")
def nested_sessions(spark, sf_dir):
    return nested(spark, sf_dir).select("user_id", "session_id", *(F.size(c).cast("long").alias(n) for c, n in (("navigation_events", "navigations"), ("touch_events", "touches"), ("sensor_events", "samples"))))


@query("E1", f"""WITH {_WEEK}, n AS (SELECT user_id, session_id, t, CAST(p AS BIGINT) % 5 + 1 AS place, row_number() OVER k AS i, t - lag(t) OVER k AS gap, lag(CAST(p AS BIGINT) % 5 + 1) OVER k AS before FROM w WHERE event_type IN ('view', 'signup') WINDOW k AS (PARTITION BY session_id ORDER BY t, event_id)),
a AS (SELECT session_id, count(*) AS c, avg(gap) AS gm, (max(t) - min(t)) / 1000 AS s, CAST(sum(CASE WHEN place <> i THEN 1 ELSE 0 END) AS BIGINT) AS dev, CAST(sum(CASE WHEN before > place THEN 1 ELSE 0 END) AS BIGINT) AS back FROM n GROUP BY 1 HAVING count(*) >= 2)
SELECT DISTINCT w.user_id, w.session_id, coalesce(c, 0) AS nav_count, round(coalesce(gm, 0), 4) AS nav_gap_mean, round(coalesce(s, 0), 6) AS nav_seconds, coalesce(dev, 0) AS nav_flow_deviation, coalesce(back, 0) AS nav_back FROM w LEFT JOIN a USING (session_id)""")
def navigation_features(spark, sf_dir):
    n = X.navigation(nested(spark, sf_dir))
    return n.select("user_id", "session_id", "nav_count", F.round("nav_gap_mean", 4).alias("nav_gap_mean"), F.round("nav_seconds", 6).alias("nav_seconds"), "nav_flow_deviation", "nav_back")


@query("E2 E3 E4")
def touch_features(spark, sf_dir):
    s = nested(spark, sf_dir)
    return rounded(X.touches(s).join(X.swipes(s), X.KEY))


@query("E5 E7 E8 E9")
def sensor_features(spark, sf_dir):
    s = nested(spark, sf_dir)
    return rounded(X.sensors(s).join(X.sensors(s, "gyroscope"), X.KEY).join(X.touch_sensors(s), X.KEY).join(X.orientation(s), X.KEY))


@query("E13 E14")
def reaction_features(spark, sf_dir):
    s = nested(spark, sf_dir)
    return rounded(X.reaction(s).join(X.cognitive_load(s), X.KEY))


@query("E6 E7 E10 E11 E12 E15")
def spectral_features(spark, sf_dir):
    return X.spectral(nested(spark, sf_dir))


@query("E17 D6")
def session_feature_table(spark, sf_dir):
    return X.session_features(nested(spark, sf_dir))


@query("A18 K3")
def selected_features(spark, sf_dir):
    return writers.pass_shares(Q.quality_record(features(spark, sf_dir), ["user_id", "feature"]))


@query("K4 A19 A20")
def summary_report(spark, sf_dir):
    from .kernels import drift_verdicts

    return writers.summary_lines(Q.quality_record(features(spark, sf_dir), ["user_id", "feature"]), drift_verdicts(spark, sf_dir))


@query("S14")
def generated_defects(spark, sf_dir):
    """The generated data set by kind of feature: its missing share and how many of its series are constant."""
    g = readers.generated(spark, features=120)
    kind = F.when(F.col("feature") <= "feature_0040", "sparse").when(F.col("feature") <= "feature_0065", "constant").otherwise("plain")
    s = g.groupBy("user_id", "feature").agg(F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("s"), F.sum(F.col("value").isNull().cast("long")).alias("m"), F.count(F.lit(1)).alias("n"))
    return s.groupBy(kind.alias("kind")).agg((F.sum("m") / F.sum("n")).alias("missing"), F.sum((F.col("s") == 0).cast("long")).alias("constant_series"), F.count(F.lit(1)).alias("series"))
