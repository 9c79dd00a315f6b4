"""Decision rates, equal error rates, selection of K, vector similarity and latency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.kernels import IS_NAN, nearest_units
from .relevance import auc


def decision_rates(scored: DataFrame, by: list[str], threshold: float, strict: bool = False) -> DataFrame:
    """TAR, FRR, FAR and accuracy of accepting score >= threshold (> if strict)."""
    yes = F.col("score") > threshold if strict else F.col("score") >= threshold
    g = F.col("genuine") == 1
    n = lambda c: F.sum(c.cast("long"))
    a = scored.groupBy(*by).agg(n(g & yes).alias("tp"), n(g & ~yes).alias("fn"), n(~g & yes).alias("fp"), n(~g & ~yes).alias("tn"))
    rate = lambda x, y: F.when(F.col(x) + F.col(y) > 0, F.col(x) / (F.col(x) + F.col(y)))
    return a.select(*by, rate("tp", "fn").alias("tar"), rate("fn", "tp").alias("frr"), rate("fp", "tn").alias("far"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"))


def half_total_error(rates: DataFrame, by: list[str]) -> DataFrame:
    return rates.groupBy(*by).agg(F.avg("tar").alias("tar"), F.avg("frr").alias("frr"), F.avg("far").alias("far"), F.max("far").alias("max_far"), F.avg("accuracy").alias("accuracy"), ((F.avg("frr") + F.avg("far")) / 2).alias("hter"))


def equal_error_rate(scored: DataFrame, by: list[str]) -> DataFrame:
    """Error rate where false acceptance and rejection meet: between the neighbouring thresholds around the crossing,
    linearly. Thresholds are the distinct scores; no threshold is dropped."""
    g = F.col("genuine") == 1
    c = scored.groupBy(*by, "score").agg(F.sum(g.cast("long")).alias("p"), F.sum((~g).cast("long")).alias("q"))
    w = Window.partitionBy(*by)
    down = w.orderBy(F.desc("score"))
    c = c.withColumns({"far": F.sum("q").over(down) / F.sum("q").over(w), "frr": 1 - F.sum("p").over(down) / F.sum("p").over(w)})
    c = c.withColumns({"far0": F.coalesce(F.lag("far").over(down), F.lit(0.0)), "frr0": F.coalesce(F.lag("frr").over(down), F.lit(1.0))})
    crossing = c.where((F.col("far") >= F.col("frr")) & (F.col("far0") < F.col("frr0")))
    d0, d1 = F.col("frr0") - F.col("far0"), F.col("far") - F.col("frr")
    share = d0 / (d0 + d1)
    return crossing.select(*by, (F.col("far0") + share * (F.col("far") - F.col("far0"))).alias("eer"))


def validation_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("method").agg(F.median("eer").alias("median_eer"), F.avg("eer").alias("mean_eer"), F.stddev_samp("eer").alias("std_eer"), F.median("auc").alias("median_auc"), F.countDistinct("user_id").alias("users"))


def best_k(table: DataFrame, limit: float = 0.005) -> DataFrame:
    """The K of least half total error, and the K of most acceptance with no user's FAR over the limit; ties: least K."""
    return table.agg(F.min(F.struct("hter", "k"))["k"].alias("k_min_hter"), F.min(F.when(F.col("max_far") <= limit, F.struct((-F.col("tar")).alias("t"), F.col("k").alias("k"))))["k"].alias("k_max_tar"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def verify(pairs: DataFrame, threshold: float = 0.25) -> DataFrame:
    """similarity and same_person of pairs (a, b)."""
    return pairs.withColumn("similarity", cosine(F.col("a"), F.col("b"))).withColumn("same_person", F.col("similarity") >= threshold)


def nearest_within(vectors: DataFrame, by: str, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(by, key, neighbour, distance, rank): k nearest by Euclidean distance within each group, exact; ties at nine digits by
    neighbour, missing distances last.

    All pairs are needed, so the work is quadratic in a group's size. Groups are dealt into blocks by a hash, each pair of
    blocks is a task's unit of work, so memory does not grow with the groups, and pairs never become rows: k for each row leave a unit.
    """
    v = vectors.select(by, key, vector)
    largest = v.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()  # one row
    blocks = max(1, -(-(largest[0] or 0) // block))
    own, every = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    v = v.withColumn("own", own)
    sides = v.select(by, key, vector, F.lit(True).alias("asks"), F.col("own").alias("q"), every.alias("c")).unionByName(v.select(by, key, vector, F.lit(False).alias("asks"), every.alias("q"), F.col("own").alias("c")))
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (by, key)}

    def run(group, df):
        asks = df["asks"].to_numpy(dtype=bool)
        q, c = df[asks], df[~asks]
        row, at, units = nearest_units(q[vector].to_numpy(), c[vector].to_numpy(), q[key].to_numpy(), c[key].to_numpy(), k)
        return pd.DataFrame({by: group[0], key: q[key].to_numpy()[row], "neighbour": c[key].to_numpy()[at], "units": units})

    tiles = sides.repartition(min(4000, max(1, (largest[1] or 0) * blocks * blocks)), by, "q", "c").groupBy(by, "q", "c")
    best = tiles.applyInPandas(run, f"{by} {kinds[by]}, {key} {kinds[key]}, neighbour {kinds[key]}, units long")
    w = Window.partitionBy(by, key).orderBy("units", "neighbour")
    distance = F.when(F.col("units") < IS_NAN, F.col("units") / F.lit(1e9)).when(F.col("units") == IS_NAN, F.lit(float("nan")))
    return best.select(by, key, "neighbour", distance.alias("distance"), F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= k)


def nearest_rank(df: DataFrame, by: list[str], value: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """mean and sorted[int(n * p)] percentiles."""
    s = df.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("x"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return s.select(*by, "n", "mean", *(F.col("x")[F.least(F.col("n") - 1, F.floor(F.col("n") * p)).cast("int")].alias(f"p{int(p * 100)}") for p in points))


__all__ = ["auc", "best_k", "cosine", "decision_rates", "dot", "equal_error_rate", "half_total_error", "nearest_rank", "nearest_within", "validation_summary", "verify"]
