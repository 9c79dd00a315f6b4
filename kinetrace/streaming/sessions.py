"""Streaming forms: session windows over events, and scoring rows with stored models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_summary(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Per user and session window (closed by a gap): events, kinds, mean value. Works on streams and tables alike; on a
    stream a session is final once the watermark has passed its end."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.session_window("ts", gap).alias("w")
    out = events.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("event_type")).cast("long").alias("kinds"), F.avg("value").alias("mean_value"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "kinds", "mean_value")


def sliding_counts(events: DataFrame, size: str = "1 day", step: str = "12 hours", late: str = "1 day") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _table_scores(rows: DataFrame, models: DataFrame, features: list[str], threshold: float) -> DataFrame:
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(r, m):
        r = r if len(m) else r[:0]
        score = np.zeros(len(r))
        if len(r):
            z = (np.nan_to_num(r[features].to_numpy(dtype=float)) - m["mean"].iloc[0]) / m["scale"].iloc[0]
            support = np.stack(m["support"].to_numpy())
            distance = sum((z[:, f, None] - support[None, :, f]) ** 2 for f in range(len(features)))
            score = np.exp(-m["gamma"].iloc[0] * distance) @ m["alpha"].to_numpy() - m["rho"].iloc[0]
        return r.assign(score=score, accepted=score >= threshold)

    return rows.groupBy("user_id").cogroup(models.groupBy("user_id")).applyInPandas(run, f"{kinds}, score double, accepted boolean")


def model_scores(rows: DataFrame, models: DataFrame, features: list[str], threshold: float = -0.3) -> DataFrame:
    """Score of each row by its user's stored support vectors. Tables hand each user's rows and vectors over once; streams join
    the stored models and score in column expressions, which are interpreted for each vector and so far slower."""
    if not rows.isStreaming:
        return _table_scores(rows, models, features, threshold)
    packed = models.groupBy("user_id").agg(F.collect_list(F.struct("support", "alpha")).alias("sv"), F.first("rho").alias("rho"), F.first("gamma").alias("gamma"), F.first("mean").alias("mean"), F.first("scale").alias("scale"))
    x = F.array(*(F.coalesce(F.col(f), F.lit(0.0)) for f in features))
    z = F.zip_with(F.zip_with(x, "mean", lambda a, m: a - m), "scale", lambda a, s: a / s)
    d2 = lambda sv: F.aggregate(F.zip_with("z", sv, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    score = F.aggregate("sv", F.lit(0.0), lambda t, s: t + s["alpha"] * F.exp(-F.col("gamma") * d2(s["support"]))) - F.col("rho")
    out = rows.join(packed, "user_id").withColumn("z", z).withColumn("score", score)
    return out.select(*rows.columns, "score", (F.col("score") >= threshold).alias("accepted"))
