"""Data model: the long feature table, constants, and adapters from the tables at hand.

The canonical table is long: (user_id, split, pos, genuine, feature, value), one row for each session and feature, so
that hundreds of features cost rows, not columns. Missing values are NULL; NaN and infinities become NULL on loading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Floors below which a spread, a mean or a denominator counts as zero.
EPS, TINY, MEAN_FLOOR = 1e-9, 1e-10, 1e-6
#: Stored bytes of a table for each partition that a user's rows are dealt to.
SHARE = 4 << 20
FEATURES = ("quantity", "price", "discount", "tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows of a user together, in as many partitions as the stored size asks for, so that a task's share stays the same
    on larger tables. What is grouped by user after it needs no other shuffle."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(min(20_000, max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))), by)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sessions of a supplier: wide rows with an order, a label, a split and a feature with gaps."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return dealt(table(spark, sf_dir, "lineitem"), "l_suppkey").select(
        F.col("l_suppkey").alias("user_id"),
        F.row_number().over(order).cast("long").alias("pos"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("genuine"),
        F.when(F.col("l_linenumber") % 2 == 0, "test").otherwise("train").alias("split"),
        F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_extendedprice").cast("double").alias("price"),
        F.col("l_discount").cast("double").alias("discount"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_tax").cast("double")).alias("tax"),
    )


def to_long(wide: DataFrame, features=FEATURES, keys=("user_id", "split", "pos", "genuine")) -> DataFrame:
    """Wide feature columns as rows (feature, value); NaN and infinities become NULL. Unlike `unpivot` it keeps the partitioning."""
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), finite(F.col(f).cast("double")).alias("value")) for f in features))
    return wide.select(*keys, F.inline(cells))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(sessions(spark, sf_dir))


def to_wide(long: DataFrame, names=FEATURES, keys=("user_id", "split", "pos", "genuine")) -> DataFrame:
    return long.groupBy(*keys).pivot("feature", list(names)).agg(F.first("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one time series for each user: (user_id, pos from 1, ms, screen, value)."""
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000.0)
    return dealt(table(spark, sf_dir, "events"), "user_id").select(
        "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("pos"), ms.alias("ms"), F.col("event_type").alias("screen"), F.col("value").cast("double").alias("value")
    )


#: The same adapters in SQL, for oracles.
SESSIONS_SQL = """sess AS (
  SELECT l_suppkey AS user_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS pos,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS genuine, CASE WHEN l_linenumber % 2 = 0 THEN 'test' ELSE 'train' END AS split,
    CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount,
    CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_tax AS DOUBLE) END AS tax FROM lineitem),
feat AS (
  SELECT user_id, split, pos, genuine, 'quantity' AS feature, quantity AS value FROM sess UNION ALL
  SELECT user_id, split, pos, genuine, 'price', price FROM sess UNION ALL
  SELECT user_id, split, pos, genuine, 'discount', discount FROM sess UNION ALL
  SELECT user_id, split, pos, genuine, 'tax', tax FROM sess)"""
SERIES_SQL = """ser AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, epoch_us(ts) / 1000.0 AS ms, event_type AS screen, value FROM events)"""
