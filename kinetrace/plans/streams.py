"""Streaming queries run to completion over the stored events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..model import sessions, table
from ..operators import grouped as G
from ..registry import query
from ..streaming import sessions as S
from .kernels import NAMES


def drained(spark, stream, mode: str = "append"):
    """What a finite stream puts out, as a table in memory: for results that are small by nature."""
    name = f"stream_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("W17", """SELECT time_bucket(INTERVAL 12 HOURS, ts) - to_hours(12 * k) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest(range(0, 2)) AS k) GROUP BY 1, 2""")
def stream_sliding_counts(spark, sf_dir):
    path = f"{sf_dir}/events.parque[t]"  # a pattern, so that a single file is as good as a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(spark, S.sliding_counts(stream), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("E1", """WITH d AS (SELECT user_id, ts, value, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id, min(ts) AS start, count(*) AS n, count(DISTINCT event_type) AS kinds, round(avg(value), 6) AS mean_value FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.session_summary(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "kinds", F.round("mean_value", 6).alias("mean_value"))


@query("M1 M2")
def stored_model_scores(spark, sf_dir):
    """Every session scored by its user's stored model."""
    rows = sessions(spark, sf_dir)
    return S.model_scores(rows.select("user_id", "pos", "genuine", *NAMES), G.model_table(rows, NAMES), NAMES).select("user_id", "pos", "genuine", "score", "accepted")
