"""Writers: tables, split tables, selection payloads, text reports. All overwrite their folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet; with `by` a folder for each of its values, such as healthy and problematic features."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def selected_payload(ranked: DataFrame) -> DataFrame:
    """One JSON document of the selected features in order; a row a feature goes in."""
    of = F.sort_array(F.collect_list(F.struct("rank", "feature")))
    return ranked.agg(of.alias("all")).select(F.to_json(F.struct(F.size("all").alias("count"), F.transform("all", lambda x: x["feature"]).alias("selected"))).alias("value"))


def pass_shares(quality: DataFrame, least: float = 0.5) -> DataFrame:
    """Per feature: users, how many pass, and whether it is selected (over `least`) or excluded."""
    a = quality.groupBy("feature").agg(F.count(F.lit(1)).alias("users"), F.sum(F.col("passes").cast("long")).alias("passed"))
    share = F.col("passed") / F.col("users")
    return a.select("feature", "users", "passed", share.alias("pass_share"), (share > least).alias("selected"), ((1 - share) >= least).alias("excluded"))


def summary_lines(quality: DataFrame, drift: DataFrame) -> DataFrame:
    """(section, rank, line): overview, the five worst features by spread and by exclusion, drifting users."""
    total = quality.agg(F.count(F.lit(1)).alias("n"), F.avg("cv").alias("cv"), F.median("cv").alias("m")).select(F.lit("overview").alias("section"), F.lit(1).alias("rank"), F.format_string("%d series, cv mean %.4f, median %.4f", "n", "cv", "m").alias("line"))
    worst = quality.groupBy("feature").agg(F.avg("cv").alias("cv"), F.avg((~F.col("passes")).cast("double")).alias("out")).orderBy(F.desc("cv"), "feature").limit(5)
    from pyspark.sql.window import Window

    lines = worst.select(F.lit("worst").alias("section"), F.row_number().over(Window.orderBy(F.desc("cv"), "feature")).alias("rank"), F.format_string("%s: cv %.4f, excluded for %.4f of users", "feature", "cv", "out").alias("line"))
    d = drift.agg(F.sum(F.col("drifting").cast("long")).alias("k"), F.count(F.lit(1)).alias("n")).select(F.lit("drift").alias("section"), F.lit(1).alias("rank"), F.format_string("%d of %d users drift", "k", "n").alias("line"))
    return total.unionByName(lines).unionByName(d)


def text_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("section", "rank").select("line").coalesce(1).write.mode("overwrite").text(path)
