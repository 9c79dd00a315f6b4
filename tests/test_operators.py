"""Degenerate cases, invariants, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from kinetrace.operators import cleanse as C
from kinetrace.operators import control as Q
from kinetrace.operators import describe as D
from kinetrace.operators import evaluate as E
from kinetrace.operators import relevance as R
from kinetrace.operators import sequence as S
from kinetrace.sources import readers, writers

LONG = "user_id string, split string, pos long, genuine int, feature string, value double"


def long(spark, values, user="a", feature="f"):
    return spark.createDataFrame([(user, "train", i, i % 2, feature, v) for i, v in enumerate(values)], LONG)


@pytest.mark.parametrize("values", [[None, None], [1.0], [2.0, 2.0, 2.0], [0.0, 0.0, 5.0], [1e-9, -1e-9, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0]])
def test_descriptions_survive(spark, values):
    df, by = long(spark, values), ["user_id", "feature"]
    d = D.describe(df, by).first()
    assert d.n == sum(v is not None for v in values)
    for f in (Q.outlier_profile, D.entropy, D.value_shares, Q.deep_audit, Q.quality_record, Q.extremes, D.histogram_modes):
        assert f(df, by).count() <= 1
    assert S.trend(df, by, "pos", "value").count() == 1
    assert S.ewma(df, by, "pos", "value").count() == d.n
    assert S.rolling_cv(df, by, "pos", "value").count() == 0


def test_modified_z_without_spread(spark):
    m = Q.outlier_marks(long(spark, [1.0, 1.0, 1.0, 9.0]), ["feature"]).orderBy("value").collect()
    assert m[0].z == 0 and m[-1].z == float("inf")


def test_non_finite_becomes_null(spark):
    from kinetrace.model import to_long

    w = spark.createDataFrame([("a", float("nan"), float("inf"), 1.0)], "user_id string, x double, y double, z double")
    assert [r.value for r in to_long(w, ["x", "y", "z"], ["user_id"]).orderBy("feature").collect()] == [None, None, 1.0]


def test_auc_ends(spark):
    rows = [("a", "train", i, int(i >= 5), "f", float(i)) for i in range(10)] + [("b", "train", i, i % 2, "f", 1.0) for i in range(4)] + [("c", "train", 0, 1, "f", 1.0)]
    out = {r.user_id: r for r in R.feature_auc(spark.createDataFrame(rows, LONG)).collect()}
    assert out["a"].raw_auc == 1.0 and out["b"].auc == 0.5
    assert all(0.5 <= r.auc <= 1 for r in out.values())


def test_split_is_disjoint_and_leaves_a_holdout(spark):
    rows = [("a", "train", i, 1, "f", 1.0) for i in range(10)] + [("a", "train", 99, 0, "f", 1.0)]
    s = C.leak_free_split(spark.createDataFrame(rows, LONG))
    got = {(r.genuine, r.part): r["count"] for r in s.groupBy("genuine", "part").count().collect()}
    assert got == {(1, "dev"): 8, (1, "holdout"): 2, (0, "holdout"): 1}


def test_as_of_takes_equal_times_and_none_before(spark):
    nav = spark.createDataFrame([("a", 10.0), ("a", 20.0)], "user_id string, nav double")
    t = spark.createDataFrame([("a", 5.0), ("a", 10.0), ("a", 19.0), ("a", 25.0)], "user_id string, ms double")
    assert [r.nav_asof for r in S.as_of(t, nav, ["user_id"], "ms", "nav", []).orderBy("ms").collect()] == [None, 10.0, 10.0, 20.0]


def test_interval_join_equals_pairing(spark):
    a = spark.range(40).select(F.lit("a").alias("u"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    b = spark.range(60).select(F.lit("a").alias("u"), (F.col("id") * 53 % 103).cast("double").alias("y"))
    want = a.join(b, "u").where("y between x - 7 and x + 3").count()
    assert S.within(a, b, ["u"], "x", "y", 7.0, 3.0).count() == want


def test_eer_of_separated_and_mixed_scores(spark):
    rows = [("a", 1, 2.0), ("a", 1, 3.0), ("a", 0, 0.0), ("a", 0, 1.0), ("b", 1, 1.0), ("b", 0, 1.0)]
    out = {r.user_id: r.eer for r in E.equal_error_rate(spark.createDataFrame(rows, "user_id string, genuine int, score double"), ["user_id"]).collect()}
    assert out == {"a": 0.0, "b": 0.5}


def test_rates_sum(spark):
    s = spark.createDataFrame([("a", 1, 1.0), ("a", 1, -1.0), ("a", 0, 0.5)], "user_id string, genuine int, score double")
    r = E.decision_rates(s, ["user_id"], 0.0).first()
    assert r.tar + r.frr == 1 and r.far == 1


def test_health_within_bounds(spark):
    rows = [("a", m, "red") for m in ("x", "y", "z", "u", "v", "w", "k")] + [("b", "x", "green")]
    out = {r.f: (r.health, r.verdict) for r in Q.health(spark.createDataFrame(rows, "f string, metric string, status string"), ["f"]).collect()}
    assert out == {"a": (0, "REJECT"), "b": (100, "HEALTHY")}


def test_mrmr_breaks_ties_by_name():
    assert [f for f, _ in R.mrmr({"b": 0.7, "a": 0.7, "c": 0.69}, {("a", "b"): 0.9, ("a", "c"): 0.0}, 3)] == ["a", "c", "b"]


def test_files(spark, tmp_path):
    for user, kind, body in (("user_001", "training", "session_id,f1,label\ns1,1.5,x\ns2,,genuine\n"), ("user_001", "testing", "session_id,f1,label\ns3,2,Genuine \ns4,x,impostor\ns5,3,\n"), ("user_002", "training", "session_id,f1\ns9,1\n")):
        (tmp_path / f"{user}_{kind}_sessions.csv").write_text(body)
    d = readers.train_test(spark, str(tmp_path))
    got = {(r.session_id, r.genuine, r.split) for r in d.collect()}
    assert got == {("s1", 1, "train"), ("s2", 1, "train"), ("s3", 1, "test"), ("s4", 0, "test")}
    assert readers.common_features(d) == ["f1"]
    (tmp_path / "names.txt").write_text(" b \na\nb\n\n")
    assert [(r.feature, r["rank"]) for r in readers.feature_lists(spark, str(tmp_path / "names.txt")).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    (tmp_path / "names.json").write_text('["z", " y", "z"]')
    assert [r.feature for r in readers.feature_lists(spark, str(tmp_path / "names.json"), True).orderBy("rank").collect()] == ["z", "y"]
    s = readers.Settings.load("missing: 0.4 # share\nweights:\n  auc: 3\nseed: 7\n")
    assert (s.missing, s.weights, s.seed) == (0.4, {"auc": 3.0}, 7)
    with pytest.raises(ValueError):
        readers.Settings.load("other: 1")


def test_documents_and_session_features(spark, tmp_path):
    from kinetrace.operators import extract as X

    touch = [{"touch_down_ts": 1000.0 * i, "touch_up_ts": 1000.0 * i + 90, "x": 10.0 * i, "y": 5.0, "gesture_type": "tap"} for i in range(1, 7)]
    sensor = [{"timestamp": 62.5 * i, "accelerometer": {"x": 0.1 * (i % 3), "y": 0.2, "z": 9.8}, "gyroscope": None} for i in range(120)]
    nav = [{"timestamp": 500.0, "to_screen": "home"}, {"timestamp": 2500.0, "to_screen": "detail"}]
    doc = {"data": {"profile": {"user_id": "user_001"}, "sessions": [{"session_id": s, "session_label": "genuine", "device_info": {"screen_width": 100.0, "screen_height": 200.0}, "navigation_events": n, "touch_events": t, "sensor_events": e} for s, n, t, e in (("new", nav, touch, sensor), ("old", [], [], None))]}}
    (tmp_path / "u.json").write_text(json.dumps(doc))
    d = readers.session_documents(spark, str(tmp_path / "u.json"))
    assert [r.session_id for r in d.orderBy("pos").collect()] == ["old", "new"]
    f = {r.session_id: r for r in X.session_features(d).collect()}
    assert f["new"].nav_count == 2 and f["new"].touch_count == 6 and f["new"].acce_count == 120 and f["new"].reaction_count == 6 and f["new"].near_count > 0
    assert f["old"].touch_count == 0 and f["old"].acce_count == 0


def test_writers(spark, tmp_path):
    r = spark.createDataFrame([(2, "b"), (1, "a")], "rank int, feature string")
    assert json.loads(writers.selected_payload(r).first().value) == {"count": 2, "selected": ["a", "b"]}
    writers.parquet(r, str(tmp_path / "p"), "rank")
    assert (tmp_path / "p" / "rank=1").exists()
    writers.csv(r, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_generated_data_has_its_defects(spark):
    from kinetrace.model import to_wide

    g = readers.generated(spark, users=17, features=70)
    w = C.constant_users(g)
    assert {r.feature for r in w.where("drop").collect()} == {f"feature_{i:04d}" for i in range(41, 66)}
    m = C.worst_missing(g, 0.3).where("drop")
    assert m.count() == 40
    assert to_wide(g, ["feature_0066"]).count() == 17 * 51


def test_stream_equals_table(spark, tmp_path):
    from kinetrace.plans.streams import drained
    from kinetrace.streaming.sessions import session_summary

    e = spark.range(200).select(F.timestamp_seconds(F.col("id") * 3000 + 1_700_000_000).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"))
    e.write.parquet(str(tmp_path / "e"))
    whole = session_summary(spark.read.parquet(str(tmp_path / "e")), "10 minutes")
    stream = session_summary(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "10 minutes", "0 seconds")
    got = {tuple(r) for r in drained(spark, stream).collect()}
    assert got and got <= {tuple(r) for r in whole.collect()}


def test_each_user_is_left_out_once_and_numbers_are_the_surveys(spark, monkeypatch):
    from kinetrace.operators import learned as L
    from kinetrace.plans import learned as P

    wide, held = spark.createDataFrame([(u, 1.0) for u in range(40)], "user_id long, a double"), []

    def ranker(rest, names):
        held.extend(set(range(40)) - {r.user_id for r in rest.collect()})
        return spark.createDataFrame([("a", 1.0)], "feature string, importance double")

    assert L.leave_user_out(wide, ["a"], 10, ranker).first().importance == 1.0
    assert sorted(held) == list(range(40))
    seen = {}
    for name in ("boosted_importance", "sparse_stability", "shadow_selection", "forest_importance"):
        monkeypatch.setattr(L, name, lambda w, f, n, name=name: seen.__setitem__(name, n))
    monkeypatch.setattr(L, "leave_user_out", lambda w, f, folds, r: r(w, f))
    monkeypatch.setattr(P, "sessions", lambda spark, sf_dir: wide)
    for q in (P.boosted_trees, P.sparse_stability, P.shadow_selection, P.forest_leave_user_out):
        q(spark, "")
    assert seen == {"boosted_importance": 200, "sparse_stability": 50, "shadow_selection": 100, "forest_importance": 300}


def test_nearest_of_all_pairs_in_blocks(spark):
    rows = [(g, i, [float(i * 37 % 11), float(i * 53 % 7)] if (g, i) != ("b", 3) else None) for g, n in (("a", 60), ("b", 5)) for i in range(n)]
    v = spark.createDataFrame(rows, "g string, i long, v array<float>")
    got = {(r.g, r.i, r["rank"]): (r.neighbour, r.distance) for r in E.nearest_within(v, "g", "i", "v", 3, block=16).collect()}
    want = {}
    for g, i, x in rows:
        d = sorted((float("inf") if x is None or y is None else round(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5, 9), j) for h, j, y in rows if h == g and j != i)
        want |= {(g, i, r): (j, None if e == float("inf") else e) for r, (e, j) in enumerate(d[:3], 1)}
    assert got == want
    # Pairs must not become rows: no join of a group with itself.
    plan = E.nearest_within(v, "g", "i", "v", 3, block=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_shuffles_follow_the_size_of_the_table(spark, monkeypatch):
    from kinetrace import model
    from kinetrace.plans import control as P

    def exchanges(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    sf = "/root/testdata/sf0.001"
    for q, most in ((P.session_outlier_report, 1), (P.metric_statuses, 1), (P.health_scores, 2), (P.deep_audit, 1)):
        plan = exchanges(q(spark, sf))
        assert plan.count("Exchange") <= most and "Join" not in plan  # one shuffle of the wide rows, and one of metrics
    monkeypatch.setattr(model, "SHARE", 1000)
    assert model.sessions(spark, sf).rdd.getNumPartitions() > 50
    users = model.features(spark, sf).select("user_id", F.spark_partition_id().alias("p")).distinct()
    assert users.count() == users.select("user_id").distinct().count()


def test_bins_of_all_rows_are_not_dealt_by_feature(spark):
    d = spark.range(1000).select((F.col("id") % 7).alias("user_id"), (F.col("id") % 2).cast("int").alias("genuine"), F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.binned_information(d, ["feature"])
        assert out.count() == 1
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranks_over_a_feature_need_no_window_over_all_its_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 300).astype(float), rng.normal(size=300)
    rows = [(i % 5, "train", i, 1, f, float(v) if (i + k) % 11 else None) for k, (f, x) in enumerate((("a", a), ("b", b))) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, LONG.replace("user_id string", "user_id long"))
    rank = lambda x: (x[:, None] > x[None]).sum(1) + ((x[:, None] == x[None]).sum(1) + 1) / 2
    kept = {f: {r[2]: r[5] for r in rows if r[4] == f and r[5] is not None} for f in "ab"}
    r = {f: dict(zip(x, rank(np.array(list(x.values()))), strict=True)) for f, x in kept.items()}
    assert {(x.feature, x.pos): x.value for x in C.with_ranks(d, 50).collect()} == {(f, i): v for f in "ab" for i, v in r[f].items()}
    both = sorted(set(r["a"]) & set(r["b"]))
    out = C.feature_correlations(d, ["user_id", "pos"], False, ranks=True)
    got = out.first()
    assert got.n == len(both) and got["corr"] == pytest.approx(np.corrcoef([r["a"][i] for i in both], [r["b"][i] for i in both])[0, 1])
    assert C.feature_medians(d) == {f: float(np.median(list(x.values()))) for f, x in kept.items()}
    # Windows run within ranges of a feature or over a row for each range, never over a feature's rows.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("range" in line for line in plan.splitlines() if "Window [" in line)


@pytest.fixture
def coarse(spark):
    """Rows of three features with few values, so that bins are the values themselves."""
    return spark.range(3000).select((F.col("id") % 12).alias("user_id"), F.col("id").alias("pos"), (F.xxhash64("id") % 7).cast("double").alias("a"), (F.xxhash64("id", F.lit(1)) % 5).cast("double").alias("b"), (F.xxhash64("id", F.lit(2)) % 9).cast("double").alias("c")).withColumn(
        "genuine", (F.col("a") * 2 + F.col("b") + (F.xxhash64("pos", F.lit(3)) % 9) > 3).cast("int"))


def test_trees_on_counted_cells_are_those_of_the_rows(spark, coarse, monkeypatch):
    from kinetrace.operators import learned as L

    names = ["a", "b", "c"]
    by = lambda df: {r.feature: r.importance for r in df.collect()}
    cells = by(L.boosted_importance(coarse, names, 6)), by(L.forest_importance(coarse, names, 60))
    monkeypatch.setattr(L, "CELLS", -1)
    rows = by(L.boosted_importance(coarse, names, 6)), by(L.forest_importance(coarse, names, 60))
    assert cells[0] == pytest.approx(rows[0], abs=1e-6)
    assert cells[1] == pytest.approx(rows[1], abs=0.04)


def test_l1_steps_reach_the_fit_of_the_library(spark, coarse):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression

    from kinetrace.functions import kernels as K
    from kinetrace.operators import learned as L

    names, rows = ["a", "b", "c"], coarse.toPandas()
    x, y = rows[names].to_numpy(), rows["genuine"].to_numpy().astype(float)
    fit = LogisticRegression(featuresCol="x", labelCol="genuine", elasticNetParam=1.0, regParam=0.05, maxIter=200, tol=1e-10).fit(L.assembled(coarse, names))
    z, beta = np.c_[x, np.ones(len(x))], np.zeros(4)
    penalty = 0.05 * len(x) * np.r_[x.std(0, ddof=1), 0.0]
    for _ in range(20):
        g, h = K.newton_sums(z, y, np.ones((len(x), 1)), beta[None])
        beta = K.sparse_step(beta, g[0], h[0], penalty)
    assert beta[:3] == pytest.approx(list(fit.coefficients), abs=1e-4) and beta[3] == pytest.approx(fit.intercept, abs=1e-4)
    draws = np.array([K.poisson_draws(np.arange(20_000, dtype=np.uint64), s) for s in range(5)])
    assert abs(draws.mean() - 1) < 0.02 and abs(draws.var() - 1) < 0.03 and abs(np.corrcoef(draws)[0, 1]) < 0.03


def test_learned_rankings_take_few_jobs(spark, coarse):
    """Jobs must not grow with trees, rounds and folds: a forest for each fold took hundreds."""
    from kinetrace.operators import learned as L

    names = ["a", "b", "c"]
    for i, f in enumerate((lambda: L.leave_user_out(coarse, names, 10, L.Forests(30)), lambda: L.boosted_importance(coarse, names, 40), lambda: L.shadow_selection(coarse, names, 12), lambda: L.sparse_stability(coarse, names, 20))):
        spark.sparkContext.setJobGroup(f"learned{i}", "")
        assert f().count() == 3
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"learned{i}")) < 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
