"""Session features from nested events. Sessions are rows (user_id, pos, session_id, ...arrays of events...).

Relational extractors explode an event array once and aggregate by session; spectral ones hand one session's arrays to
numpy. Times are milliseconds. Sessions with too few events get zeros, as stated at each extractor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as K
from .describe import correlation
from .sequence import as_of, within

KEY = ["user_id", "session_id"]
FLOW = ("home", "list", "detail", "confirm", "done")


def _events(s: DataFrame, column: str) -> DataFrame:
    return s.select(*KEY, F.posexplode(column).alias("k", "e")).select(*KEY, "k", "e.*")


def _spread(c: str, name: str) -> list[Column]:
    q = F.percentile(c, F.array(F.lit(0.05), F.lit(0.95), F.lit(0.25), F.lit(0.75)))
    return [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), q[0].alias(f"{name}_p5"), q[1].alias(f"{name}_p95"), (q[3] - q[2]).alias(f"{name}_iqr")]


def _zeros(s: DataFrame, out: DataFrame) -> DataFrame:
    """Every session, absent ones with zeros."""
    names = [c for c in out.columns if c not in KEY]
    return s.select(*KEY).distinct().join(out, KEY, "left").fillna(0.0, names).fillna(0, names)


def navigation(s: DataFrame, flow=FLOW) -> DataFrame:
    """Count, distinct screens, interval mean and deviation, total seconds, deviation from the flow, moves back; < 2 events: zeros."""
    w = Window.partitionBy(*KEY).orderBy("timestamp", "k")
    at = F.array_position(F.array(*map(F.lit, flow)), F.col("to_screen"))
    e = _events(s, "navigation_events").withColumns({"gap": (F.col("timestamp") - F.lag("timestamp").over(w)), "i": F.row_number().over(w), "at": at}).withColumn("before", F.lag("at").over(w))
    out = e.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("nav_count"), F.countDistinct("to_screen").alias("nav_screens"), F.avg("gap").alias("nav_gap_mean"), F.stddev_pop("gap").alias("nav_gap_std"), ((F.max("timestamp") - F.min("timestamp")) / 1000).alias("nav_seconds"),
        F.sum((F.col("at") != F.col("i")).cast("long")).alias("nav_flow_deviation"), F.sum(((F.col("at") > 0) & (F.col("before") > F.col("at"))).cast("long")).alias("nav_back"))
    return _zeros(s, out.where("nav_count >= 2"))


def touches(s: DataFrame) -> DataFrame:
    """Durations, gaps, speeds (from the last lift to this press, normalised by screen), share of taps; flights over three touches."""
    w = Window.partitionBy(*KEY).orderBy("touch_down_ts", "k")
    size = s.select(*KEY, F.col("device_info.screen_width").alias("sw"), F.col("device_info.screen_height").alias("sh"))
    e = _events(s, "touch_events").join(size, KEY).withColumns({"duration": F.col("touch_up_ts") - F.col("touch_down_ts"), "gap": F.col("touch_down_ts") - F.lag("touch_down_ts").over(w), "dt": (F.col("touch_down_ts") - F.lag("touch_up_ts").over(w)) / 1000})
    dist = F.sqrt(((F.col("x") - F.lag("x").over(w)) / F.col("sw")) ** 2 + ((F.col("y") - F.lag("y").over(w)) / F.col("sh")) ** 2)
    flight = F.lead("touch_down_ts", 2).over(w) - F.col("touch_up_ts")
    e = e.withColumns({"dist": dist, "flight": F.when(flight >= 0, flight)}).withColumn("speed", F.when(F.col("dt") > 1e-6, F.col("dist") / F.col("dt")))
    out = e.groupBy(*KEY).agg(F.count(F.lit(1)).alias("touch_count"), *_spread("duration", "touch_duration"), *_spread("gap", "touch_gap"), *_spread("speed", "touch_speed"), F.avg((F.col("gesture_type") == "tap").cast("double")).alias("tap_ratio"), F.avg("flight").alias("trigraph_mean"), F.stddev_pop("flight").alias("trigraph_std"))
    return _zeros(s, out.where("touch_count >= 2"))


def swipes(s: DataFrame) -> DataFrame:
    """Angle, length and straightness (1 for a chord) of gestures with both ends."""
    e = _events(s, "touch_events").where("gesture_type = 'swipe' and x_down is not null and x_up is not null")
    dx, dy = F.col("x_up") - F.col("x_down"), F.col("y_up") - F.col("y_down")
    out = e.groupBy(*KEY).agg(F.count(F.lit(1)).alias("swipe_count"), F.avg(F.atan2(dy, dx)).alias("swipe_angle_mean"), F.stddev_pop(F.atan2(dy, dx)).alias("swipe_angle_std"), F.avg(F.sqrt(dx * dx + dy * dy)).alias("swipe_length_mean"), F.max(F.lit(1.0)).alias("swipe_straightness"))
    return _zeros(s, out)


def sensors(s: DataFrame, part: str = "accelerometer", least: int = 5) -> DataFrame:
    """Magnitude, jerk and axis statistics of one sensor; fewer than `least` samples: zeros."""
    w = Window.partitionBy(*KEY).orderBy("timestamp", "k")
    e = _events(s, "sensor_events").where(F.col(part).isNotNull()).select(*KEY, "k", "timestamp", f"{part}.*").withColumn("m", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    dt = (F.col("timestamp") - F.lag("timestamp").over(w)) / 1000
    e = e.withColumn("jerk", F.when(dt > 1e-6, (F.col("m") - F.lag("m").over(w)) / dt))
    p = part[:4]
    aggs = [a for c in ("x", "y", "z", "m") for a in (F.avg(c).alias(f"{p}_{c}_mean"), F.stddev_pop(c).alias(f"{p}_{c}_std"))]
    out = e.groupBy(*KEY).agg(F.count(F.lit(1)).alias(f"{p}_count"), *aggs, F.skewness("m").alias(f"{p}_m_skew"), F.kurtosis("m").alias(f"{p}_m_excess"), F.avg(F.abs("jerk")).alias(f"{p}_jerk_mean"), F.stddev_pop("jerk").alias(f"{p}_jerk_std"))
    return _zeros(s, out.where(F.col(f"{p}_count") >= least))


def touch_sensors(s: DataFrame, reach: float = 100.0, least: int = 5) -> DataFrame:
    """Accelerometer statistics and axis correlations within `reach` ms of presses; overlapping presses count rows again."""
    t = _events(s, "touch_events").select(*KEY, F.col("touch_down_ts").alias("down"))
    a = _events(s, "sensor_events").where("accelerometer is not null").select(*KEY, "timestamp", "accelerometer.*")
    p = within(t, a, KEY, "down", "timestamp", reach, reach)
    corr = lambda a, b: F.coalesce(correlation(F.col(a), F.col(b)), F.lit(0.0)).alias(f"near_{a}{b}")
    out = p.groupBy(*KEY).agg(F.count(F.lit(1)).alias("near_count"), *(x for c in ("x", "y", "z") for x in _spread(c, f"near_{c}")), corr("x", "y"), corr("x", "z"), corr("y", "z"))
    return _zeros(s, out.where(F.col("near_count") >= least))


def orientation(s: DataFrame, reach: float = 100.0) -> DataFrame:
    """Pitch and roll from gravity around touches: means and differences from one touch to the next and next but one; < 2 touches: zeros."""
    t = _events(s, "touch_events").select(*KEY, "k", F.col("touch_down_ts").alias("down"), (F.col("touch_up_ts") - F.col("touch_down_ts")).alias("long"))
    a = _events(s, "sensor_events").where("accelerometer is not null").select(*KEY, "timestamp", F.atan2(-F.col("accelerometer.x"), F.sqrt(F.col("accelerometer.y") ** 2 + F.col("accelerometer.z") ** 2)).alias("pitch"), F.atan2("accelerometer.y", "accelerometer.z").alias("roll"))
    longest = 2000.0
    p = within(t, a, KEY, "down", "timestamp", reach, longest + reach).where(F.col("timestamp") <= F.col("down") + F.least(F.col("long"), F.lit(longest)) + reach)
    m = p.groupBy(*KEY, "k").agg(F.avg("pitch").alias("pitch"), F.avg("roll").alias("roll"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    w = Window.partitionBy(*KEY).orderBy("k")
    d = m.withColumns({f"{c}{i}": F.lead(c, i).over(w) - F.col(c) for c in ("pitch", "roll") for i in (1, 2)})
    out = d.groupBy(*KEY).agg(F.count(F.lit(1)).alias("fused_touches"), *(f(c).alias(f"fused_{c}_{n}") for c in ("pitch", "roll", "pitch1", "roll1", "pitch2", "roll2") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    return _zeros(s, out.where("fused_touches >= 2"))


def reaction(s: DataFrame, low: float = 100.0, high: float = 5000.0) -> DataFrame:
    """Time from the last screen change to each press, within a realistic range; fewer than 3: zeros."""
    nav = _events(s, "navigation_events").select(*KEY, F.col("timestamp").alias("shown"))
    t = _events(s, "touch_events").select(*KEY, "touch_down_ts")
    r = as_of(t, nav, KEY, "touch_down_ts", "shown", []).withColumn("reaction", F.col("touch_down_ts") - F.col("shown_asof")).where(F.col("reaction").between(low, high))
    out = r.groupBy(*KEY).agg(F.count(F.lit(1)).alias("reaction_count"), F.median("reaction").alias("reaction_median"), *_spread("reaction", "reaction"))
    return _zeros(s, out.where("reaction_count >= 3"))


def cognitive_load(s: DataFrame) -> DataFrame:
    """0.4 share of hesitations over 500 ms + 0.3 clipped variation / 2 + 0.3 share of moves back; fewer than 5 touches: zero."""
    w = Window.partitionBy(*KEY).orderBy("touch_down_ts", "k")
    t = _events(s, "touch_events").withColumn("gap", F.col("touch_down_ts") - F.lag("touch_down_ts").over(w)).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("gap") > 500).cast("double")).alias("hesitation"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv"))
    back = navigation(s).select(*KEY, (F.col("nav_back") / F.greatest(F.lit(1), F.col("nav_count"))).alias("back"))
    load = 0.4 * F.coalesce("hesitation", F.lit(0.0)) + 0.3 * F.least(F.lit(1.0), F.coalesce("cv", F.lit(0.0)) / 2) + 0.3 * F.col("back")
    return _zeros(s, t.where("n >= 5").join(back, KEY).select(*KEY, load.alias("cognitive_load")))


def spectral(s: DataFrame, fs: float = 16.0, least: int = 20) -> DataFrame:
    """Windowed, spectral, cepstral, wavelet and path descriptors of each session's magnitude signals, in one hand-over."""
    names = [f"{p}_{n}" for p in ("acce", "gyro") for n in ("peak", "energy", "entropy", "low", "high", "centroid", "medoid", *(f"mfcc{i}" for i in range(6)), "a_std", "d_std", "d_energy", "window_std_mean", "window_std_std", "gravity_mean")]
    names += ["jerk_deviation", "jerk_ratio"]

    def signal(events, part):
        rows = [e for e in (events if events is not None else []) if e is not None and e[part] is not None]
        rows.sort(key=lambda e: e["timestamp"])
        return np.array([np.sqrt(e[part]["x"] ** 2 + e[part]["y"] ** 2 + e[part]["z"] ** 2) for e in rows], dtype=float)

    def describe(x: np.ndarray) -> list[float]:
        if len(x) < least:
            return [0.0] * 19
        size = int(5 * fs)
        wins = [x[i : i + size] for i in range(0, max(1, len(x) - size + 1), max(1, size // 2))]
        a, d = K.wavelet_level(x)
        gravity = K.low_pass(x, fs, 0.3)
        stds = [w.std() for w in wins]
        return [*K.spectrum_descriptors(x, fs).values(), *K.cepstrum(x, fs), a.std(), d.std(), float((d * d).sum()), np.mean(stds), np.std(stds), gravity.mean()]

    def run(batches):
        for df in batches:
            out = []
            for user, sid, sensor, touch in zip(df.user_id, df.session_id, df.sensor_events, df.touch_events, strict=True):
                t = sorted((e["touch_down_ts"], e["x"], e["y"]) for e in (touch if touch is not None else []) if e is not None)
                path = K.minimum_jerk(*np.array(t, dtype=float).T) if len(t) >= 3 else {"deviation": 0.0, "jerk_ratio": 0.0}
                out.append((user, sid, *describe(signal(sensor, "accelerometer")), *describe(signal(sensor, "gyroscope")), path["deviation"], path["jerk_ratio"]))
            yield pd.DataFrame(out, columns=[*KEY, *names])

    return s.select(*KEY, "sensor_events", "touch_events").mapInPandas(run, "user_id string, session_id string, " + ", ".join(f"{n} double" for n in names))


def session_features(s: DataFrame) -> DataFrame:
    """All extractors of a session in one row, with its label."""
    s = s.withColumn("user_id", F.col("user_id").cast("string"))
    out = s.select(*KEY, "pos", "session_label")
    for part in (navigation(s), touches(s), swipes(s), sensors(s), sensors(s, "gyroscope"), touch_sensors(s), orientation(s), reaction(s), cognitive_load(s), spectral(s)):
        out = out.join(part, KEY, "left")
    return out


def sessions_from_events(events: DataFrame, gap_days: int = 7) -> DataFrame:
    """Events as nested sessions of a user and week: views navigate, clicks and purchases touch, every event is a sensor sample."""
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0
    week = F.floor(ms / (gap_days * 86_400_000.0)).cast("long")
    e = events.select(F.col("user_id").cast("string").alias("user_id"), week.alias("week"), (ms / 3600.0).alias("t"), "event_type", F.col("value").cast("double").alias("v"), F.get_json_object("props", "$.k").try_cast("double").alias("p"), "event_id")
    kind = lambda *k: F.col("event_type").isin(*k)
    d = lambda c: c.cast("double")
    nav = F.when(kind("view", "signup"), F.struct(F.col("t").alias("timestamp"), F.element_at(F.array(*map(F.lit, FLOW)), (F.pmod(F.col("p"), F.lit(5)) + 1).cast("int")).alias("to_screen")))
    touch = F.when(kind("click", "purchase"), F.struct(F.col("t").alias("touch_down_ts"), (F.col("t") + 80 + F.col("p")).alias("touch_up_ts"), d(F.col("p") * 10).alias("x"), d(F.col("v") * 5).alias("y"), d(F.col("p")).alias("x_down"), d(F.col("v")).alias("y_down"), d(F.col("p") + 5).alias("x_up"), d(F.col("v") * 2).alias("y_up"), F.when(kind("click"), "tap").otherwise("swipe").alias("gesture_type")))
    xyz = lambda *c: F.struct(*(d(x).alias(n) for x, n in zip(c, "xyz", strict=True)))
    sensor = F.struct(F.col("t").alias("timestamp"), xyz(F.sin("p"), F.cos("p"), F.col("v") / 100).alias("accelerometer"), F.when(~kind("error"), xyz(F.col("v"), F.col("p"), F.sin("v"))).alias("gyroscope"))
    g = e.groupBy("user_id", "week").agg(*(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("t", "event_id", c.alias("e"))))), lambda x: x["e"]).alias(n) for n, c in (("navigation_events", nav), ("touch_events", touch), ("sensor_events", sensor))))
    w = Window.partitionBy("user_id").orderBy("week")
    return g.select("user_id", F.row_number().over(w).cast("long").alias("pos"), F.concat_ws("-", "user_id", "week").alias("session_id"), F.lit("genuine").alias("session_label"), F.struct(F.lit(1080.0).alias("screen_width"), F.lit(1920.0).alias("screen_height")).alias("device_info"), "navigation_events", "touch_events", "sensor_events")
