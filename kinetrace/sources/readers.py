"""Readers: nested session documents, session-feature files, feature lists, configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.cleanse import label_exact

_XYZ = "struct<x: double, y: double, z: double>"
#: Schema of one user's document; readers give it, so no pass over the data infers types.
DOCUMENT = f"""data struct<profile: struct<user_id: string>, sessions: array<struct<session_id: string, session_label: string, device_info: struct<screen_width: double, screen_height: double>,
navigation_events: array<struct<timestamp: double, to_screen: string>>,
touch_events: array<struct<touch_down_ts: double, touch_up_ts: double, x: double, y: double, x_down: double, y_down: double, x_up: double, y_up: double, gesture_type: string>>,
sensor_events: array<struct<timestamp: double, accelerometer: {_XYZ}, gyroscope: {_XYZ}>>>>>"""


def session_documents(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, pos, session...) from JSON documents of one user each; session order is reversed, as they are newest first."""
    d = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    s = d.select(F.col("data.profile.user_id").alias("user_id"), F.size("data.sessions").alias("n"), F.posexplode("data.sessions").alias("p", "session"))
    return s.select("user_id", (F.col("n") - F.col("p")).cast("long").alias("pos"), "session.*")


def feature_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Rows of <user>_<kind>_sessions.csv with user_id from the file name; faulty lines become NULL cells."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(f"{folder}/*_{kind}_sessions.csv")
    return df.withColumn("user_id", F.regexp_extract(F.col("_metadata.file_name"), f"^(.*)_{kind}_sessions[.]csv$", 1))


def first_users(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first n users by name."""
    users = df.select("user_id").distinct().orderBy("user_id").limit(n)
    return df.join(F.broadcast(users), "user_id", "left_semi")  # n rows


def labelled(df: DataFrame, candidates=("session_label", "label", "test_type")) -> DataFrame:
    """genuine (1, 0 or -1) from the first label column that exists."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        raise ValueError(f"none of the label columns {candidates}")
    return df.withColumn("genuine", label_exact(F.col(have[0]))).drop(*have)


def train_test(spark: SparkSession, folder: str) -> DataFrame:
    """Both files of each user that has both: training rows are genuine whatever their label; rows without label go."""
    train, test = feature_files(spark, folder, "training"), feature_files(spark, folder, "testing")
    users = train.select("user_id").distinct().intersect(test.select("user_id").distinct())
    train = train.drop("session_label", "label", "test_type").withColumns({"genuine": F.lit(1), "split": F.lit("train")})
    test = labelled(test).where("genuine >= 0").withColumn("split", F.lit("test"))
    return train.unionByName(test, allowMissingColumns=True).join(users, "user_id", "left_semi")


def common_features(df: DataFrame, keys=("user_id", "split", "session_id", "device_owner_id", "genuine"), least: float = 0.5) -> list[str]:
    """Feature columns that are numeric in at least a share of every user's rows in both splits; a row a column is collected."""
    from ..operators.cleanse import majority_numeric

    names = [c for c in df.columns if c not in keys and not c.startswith("_")]
    return sorted(r["column"] for r in majority_numeric(df, names, ["user_id", "split"], least).collect())


def feature_lists(spark: SparkSession, path: str, as_json: bool = False) -> DataFrame:
    """(feature, rank): a name a line, or a JSON array; trimmed, first occurrence kept."""
    raw = spark.read.option("wholetext", as_json).text(path).withColumn("line", F.monotonically_increasing_id())
    if as_json:
        raw = raw.select("line", F.posexplode(F.from_json("value", "array<string>")).alias("p", "value"))
    else:
        raw = raw.withColumn("p", F.lit(0))
    names = raw.select(F.trim("value").alias("feature"), "line", "p").where("feature <> ''")
    first = names.groupBy("feature").agg(F.min(F.struct("line", "p")).alias("at"))
    return first.select("feature", F.row_number().over(Window.orderBy("at")).cast("long").alias("rank"))


def ranking_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ranking tables with a given schema, so that feature names of digits stay strings."""
    return spark.read.schema(schema).option("header", True).csv(path)


@dataclass
class Settings:
    """Thresholds and weights of a run."""

    missing: float = 0.3
    constant_users: float = 0.8
    auc_floor: float = 0.52
    elite: int = 100
    final: int = 40
    dev_share: float = 0.8
    seed: int = 42
    nu: float = 0.1
    weights: dict = field(default_factory=lambda: {"auc": 2.0, "fisher": 1.0, "information": 1.0, "relief": 1.0, "laplacian": 1.0})

    @classmethod
    def load(cls, text: str) -> Settings:
        """From flat or one-level nested `key: value` lines; unknown keys are errors."""
        values, section = {}, None
        for line in text.splitlines():
            body = line.split("#")[0].rstrip()
            if not body.strip():
                continue
            key, _, value = (x.strip() for x in body.partition(":"))
            if not value:
                section, values[key] = key, {}
            elif body[0].isspace() and section:
                values[section][key] = float(value)
            else:
                section, values[key] = None, value
        out = cls()
        for k, v in values.items():
            if not hasattr(out, k):
                raise ValueError(f"unknown setting {k}")
            setattr(out, k, v if isinstance(v, dict) else type(getattr(out, k))(v))
        return out


def generated(spark: SparkSession, users: int = 17, train: int = 25, genuine: int = 10, impostors: int = 16, features: int = 1350, seed: int = 42) -> DataFrame:
    """Long test data with planted faults: features 1-40 about 70 % missing, 41-65 constant for users up to 15."""
    rows = spark.range(users * (train + genuine + impostors)).select((F.col("id") / (train + genuine + impostors)).cast("long").alias("u"), (F.col("id") % (train + genuine + impostors)).alias("r"))
    f = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(features))).alias("f"))
    unit = lambda *k: F.pmod(F.xxhash64(*k, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    who = F.when(F.col("r") < train + genuine, F.col("u")).otherwise(F.col("u") + 1000)
    normal = F.sqrt(-2 * F.log(1 - unit("u", "r", "f", F.lit(1)))) * F.cos(2 * 3.141592653589793 * unit("u", "r", "f", F.lit(2)))
    value = unit(who, "f", F.lit(3)) * 6 - 3 + 0.4 * normal
    value = F.when((F.col("f") <= 40) & (unit("u", "r", "f", F.lit(4)) < 0.7), None).when(F.col("f").between(41, 65) & (F.col("u") < 15), 1.0).otherwise(value)
    return f.select(
        F.format_string("user_%03d", F.col("u") + 1).alias("user_id"), F.when(F.col("r") < train, "train").otherwise("test").alias("split"), F.col("r").alias("pos"),
        F.when(F.col("r") < train + genuine, 1).otherwise(0).alias("genuine"), F.format_string("feature_%04d", F.col("f")).alias("feature"), value.alias("value"))
