from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddrank.config import Config
from oddrank.functions import columns as fx
from oddrank.operators import detectors as det
from oddrank.operators import encode, evaluate, explain, history, profile, ranks, scoring, temporal
from oddrank.plans import detection, feature_plan
from oddrank.sources import readers, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ranks_equal_a_plain_window(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 40, 500).astype(float)
    df = frame(spark, [(i, float(v), int(v) % 3) for i, v in enumerate(values)], "id long, x double, g int")
    got = {(r.g, r.x): (r.below, r.n, r.total) for r in ranks.cumulative(ranks.counted(df, "x", ["g"]), "x", ["g"]).collect()}
    for (g, x), (below, n, total) in got.items():
        own = values[(values % 3) == g]
        assert (below, n, total) == ((own < x).sum(), (own == x).sum(), len(own))


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id"), ((F.col("id") * 37) % 101).cast("double").alias("x"))
    one = ranks.value_ranks(df.coalesce(1), "x").orderBy("x").collect()
    many = ranks.value_ranks(df.repartition(17), "x").orderBy("x").collect()
    assert one == many


@pytest.mark.parametrize("rate", [0.01, 0.05, 0.5])
def test_exact_k_with_ties(spark, rate):
    df = spark.range(130).select("id", (F.col("id") % 4).cast("double").alias("s"))
    flagged = [r.id for r in scoring.exact_k(df, "s", "id", rate).where("flagged").collect()]
    expected = sorted(range(130), key=lambda i: (-(i % 4), i))[: round(130 * rate)]
    assert sorted(flagged) == sorted(expected)


def test_classification_rules(spark):
    rows = [(i, float(i % 7), "abc"[i % 3], None, 5.0, f"{i:032x}", f"a rather long sentence number {i}", i % 2 == 0) for i in range(60)]
    df = frame(spark, rows, "id long, x double, c string, e string, k double, h string, t string, b boolean")
    cfg = profile.ProfilingConfig()
    got = {p.name: profile.classify(p, cfg)[0] for p in profile.profile(df, cfg)}
    assert got == {"id": "identifier_like", "x": "numeric", "c": "categorical", "e": "empty", "k": "constant",
                   "h": "identifier_like", "t": "free_text", "b": "boolean"}


def test_group_keys_are_typed_and_null_safe(spark):
    a = frame(spark, [(None,), ("",), ("None",), ("1",)], "g string")
    b = frame(spark, [(1,)], "g int")
    keys = [r.k for r in a.select(fx.group_key(["g"], dict(a.dtypes)).alias("k")).collect()]
    keys += [r.k for r in b.select(fx.group_key(["g"], dict(b.dtypes)).alias("k")).collect()]
    assert len(set(keys)) == 5


def test_one_hot_null_and_unseen(spark):
    df = frame(spark, [("a",), ("z",), (None,)], "c string")
    enc = encode.Encoding("c", "one_hot", {"categories": ["a", "b"]})
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in enc.features()]).collect()]
    assert got == [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0)]


def test_reserved_names_are_told_apart():
    enc = encode.Encoding("c", "one_hot", {"categories": ["_other"]})
    assert [n for n, _ in enc.features()] == ["c__other", "c__other__1"]


def test_constant_column_scales_to_one(spark):
    df = frame(spark, [(3.0,), (3.0,)], "x double")
    assert encode.robust_parameters(df, ["x"]) == {"x": (3.0, 1.0)}


def test_correlated_components_are_transitive():
    pairs = [("a", "b", 0.96), ("b", "c", -0.97), ("a", "c", 0.1), ("c", "d", float("nan"))]
    assert encode.correlation_survivors(pairs, ["a", "b", "c", "d"]) == ["a", "d"]


def test_hbos_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, 400), 3)
    df = frame(spark, [(float(v),) for v in x], "x double")
    model = det.fit_hbos(df, ["x"])["x"]
    counts, _ = np.histogram(x, bins=len(model.counts))
    assert abs(np.array(model.counts) - counts).sum() <= 4  # edges may round either way


@pytest.mark.parametrize("kind", ["point", "clustered"])
@pytest.mark.parametrize("name", sorted(det.REGISTRY))
def test_detectors_rank_planted_rows_first(kind, name):
    x, y = evaluate.scenario(kind, 400, 8)
    model = det.REGISTRY[name].fit(x[y == 0] if name in ("lof", "one_class_svm") else x, ["a", "b", "c", "d"], 7)
    s = model.score(x)
    order = np.argsort(-s)
    assert y[order[:8]].mean() >= 0.75
    assert np.allclose(model.score(x[:50]), s[:50])


def test_wilson_and_newcombe(spark):
    df = frame(spark, [(81, 263, 15, 100)], "c long, n long, d long, m long")
    low, high = fx.wilson(F.col("c"), F.col("n"))
    a, b = fx.newcombe(F.lit(56), F.lit(70), F.lit(48), F.lit(80))
    r = df.select(low, high, a, b).first()
    assert [round(v, 4) for v in r] == [0.2553, 0.3662, 0.0524, 0.3339]


def test_dates_in_texts(spark):
    df = frame(spark, [("31/01/2026", "01/02/2026", "10:30", "2026-01-02"), ("01/02/2026", "02/01/2026", "23:59:59", "2026-03-04")],
               "d string, amb string, t string, iso string")
    got = {c: temporal.resolve(temporal.detection(df, c)) for c in df.columns}
    assert got == {"d": "day_first", "amb": "ambiguous", "t": "time", "iso": "iso"}


def test_weekend_rolls_to_friday(spark):
    df = frame(spark, [("2024-01-06",), ("2024-01-07",), ("2024-01-08",)], "d string")
    got = [r[0] for r in df.select(fx.period_label(F.to_timestamp("d"), "day", True)).collect()]
    assert got == ["2024-01-05", "2024-01-05", "2024-01-08"]


def test_numeric_psi():
    base = [float(i) for i in range(101)]
    assert history.numeric_psi(base, base, 100, 100) < 1e-9
    assert history.numeric_psi(base, [x + 60 for x in base], 100, 100) > 1


def test_holm_and_bootstrap(spark):
    p = {"a": 0.01, "b": 0.04, "c": 0.03}
    assert evaluate.holm(p) == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})
    df = frame(spark, list(p.items()), "name string, p double")
    assert {r["name"]: r.adjusted for r in evaluate.holm_frame(df, "name", "p").collect()} == pytest.approx(evaluate.holm(p))
    assert evaluate.paired_bootstrap([0.1, 0.2, 0.15, 0.12])[0] < 0.01


def test_blend_and_direction(spark):
    out = explain.blend([np.array([[3.0, 4.0], [0.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 2.0]])], [0.5, 0.5])
    assert np.allclose(out, [[0.8, 0.4], [0.0, 1.0]])


def test_plan_round_trip_and_schema_check(spark):
    df = readers.with_row_id(spark.range(200).select("id", (F.col("id") % 13).cast("double").alias("x"),
                             F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("c")), id_column="id")
    cfg = Config.from_dict({"columns": {"id_column": "id"}})
    plan = feature_plan.build(df, cfg)
    again = feature_plan.FeaturePlan.from_json(plan.to_json())
    assert again.digest() == plan.digest()
    assert feature_plan.apply(df, again).count() == 200
    with pytest.raises(feature_plan.PlanError):
        feature_plan.apply(df.drop("c"), plan)


def test_score_forward_equals_the_fit(spark):
    x, y = evaluate.scenario("point", 300, 6)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = readers.with_row_id(frame(spark, rows, "id long, a double, b double, c double, d double"), id_column="id")
    cfg = Config.from_dict({"columns": {"id_column": "id"}, "scoring": {"detectors": ["isolation_forest", "kmeans_distance"], "contamination": 0.02}})
    fitted, ranked = detection.run_detection(df, cfg)
    first = {r[readers.ROW_ID]: (round(r.score, 9), r.flagged) for r in ranked.collect()}
    again = detection.score_forward(df.repartition(7), detection.Fitted.from_json(fitted.to_json()), cfg)
    assert {r[readers.ROW_ID]: (round(r.score, 9), r.flagged) for r in again.collect()} == first
    flagged = {i for i, (_, f) in first.items() if f}
    assert len(flagged & set(np.flatnonzero(y))) >= 5
    why = detection.reasons(df, ranked, fitted, cfg).collect()
    assert {r[readers.ROW_ID] for r in why} == flagged


def test_infinite_values_are_named(spark):
    df = readers.with_row_id(frame(spark, [(i, float("inf") if i == 3 else float(i % 9)) for i in range(40)], "id long, x double"), id_column="id")
    with pytest.raises(feature_plan.PlanError, match="x"):
        detection.fit(df, Config.from_dict({"columns": {"id_column": "id"}}))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.tsf").write_text("@relation r\n@attribute name string\n@data\ns1:1,2,?\ns2:4\n")
    got = readers.read(spark, str(tmp_path / "a.tsf")).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("s1", 1.0, 2.0, None), ("s2", 4.0, None, None)]
    (tmp_path / "b.csv").write_text("a;b\n1;2\n3;4\n")
    with pytest.raises(readers.SourceError):
        readers.read(spark, str(tmp_path / "b.csv"))
    assert readers.canonical_uri("HTTP://U:p@Ex.org:80/a#x") == "http://ex.org/a"
    assert readers.redacted_uri("https://h/a?token=1&b=2") == "https://h/a?token=***&b=2"
    df = spark.range(50).withColumn("t", F.lit("=1"))
    assert sinks.digest(df) == sinks.digest(df.repartition(9))
    with pytest.raises(ValueError):
        sinks.write_result(df.withColumn("id", F.lit(1)), str(tmp_path / "out"), "x", "r", ["id"])


def test_roc_auc_ties_and_single_class(spark):
    df = frame(spark, [(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "s double, y int")
    r = evaluate.ranking_metrics(df, "s", "y").first()
    assert r.roc_auc == pytest.approx(0.875)
    one = evaluate.ranking_metrics(df.withColumn("y", F.lit(1)), "s", "y").first()
    assert one.roc_auc is None or math.isnan(one.roc_auc)


def test_components_are_orthonormal_and_explain(spark):
    from oddrank.operators import reduce

    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (200, 1)) @ np.array([[3.0, 1.0, 0.5]]) + rng.normal(0, 0.1, (200, 3))
    df = frame(spark, [tuple(map(float, v)) for v in x], "a double, b double, c double")
    c = reduce.fit_components(df, ["a", "b", "c"])
    w = np.array(c.loadings)
    assert np.allclose(w @ w.T, np.eye(2), atol=1e-9) and c.explained[0] > 0.98
    got = np.array([list(r) for r in df.select(*c.columns()).collect()])
    assert np.allclose(got, (x - x.mean(0)) @ w.T)


def test_cli(spark, tmp_path, capsys):
    from oddrank import cli

    assert cli.main(["detectors"]) == 0 and "isolation_forest" in capsys.readouterr().out
    (tmp_path / "c.json").write_text('{"scoring": {"combination": "most"}}')
    assert cli.main(["config", str(tmp_path / "c.json")]) == 2
    assert cli.main(["config", str(tmp_path / "none.json")]) == 3
    spark.range(30).write.parquet(str(tmp_path / "t.parquet"))
    assert cli.main(["inspect", str(tmp_path / "t.parquet")]) == 0 and "identifier_like" in capsys.readouterr().out


def test_backtest_prefers_nothing_on_ties(spark):
    from oddrank.plans import backtest

    x, y = evaluate.scenario("point", 150, 5)
    df = frame(spark, [(i, *map(float, v)) for i, v in enumerate(x)], "__row_id long, a double, b double, c double, d double")
    labels = frame(spark, [(i, int(v)) for i, v in enumerate(y)], "__row_id long, y int")
    out = backtest.backtest(df, labels, Config.from_dict({"scoring": {"detectors": ["isolation_forest", "kmeans_distance"]}}), replicates=2)
    assert out["base"] == "intersection@1" and set(out["verdict"].values()) <= {"adopt", "keep", "reject"}


def test_streamed_scores_equal_batch(spark, tmp_path):
    from oddrank.streaming import score

    x, _ = evaluate.scenario("point", 120, 4)
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = frame(spark, rows, "__row_id long, a double, b double, c double, d double")
    cfg = Config.from_dict({"scoring": {"detectors": ["isolation_forest", "kmeans_distance"]}})
    fitted, ranked = detection.run_detection(df, cfg)
    df.write.parquet(str(tmp_path / "in"))
    stream = score.scored_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), fitted, cfg)
    q = stream.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r[0]: round(r[1], 9) for r in spark.sql("SELECT __row_id, score FROM streamed").collect()}
    assert got == {r[readers.ROW_ID]: round(r.score, 9) for r in ranked.collect()}


def test_detectors_train_on_the_whole_cap(spark, monkeypatch):
    seen = {}

    class Probe:
        name = "probe"

        def fit(x, features, seed):  # noqa: N805  called on the class
            seen["rows"] = x
            return "model"

        score = None

    monkeypatch.setitem(det.REGISTRY, "probe", Probe)
    df = spark.range(60_000).select("id", F.col("id").cast("double").alias("x")).repartition(7)
    assert det.fit_detector("probe", df, "id", ["x"]) == "model" and len(seen["rows"]) == 60_000
    det.fit_detector("probe", df, "id", ["x"], cap=30_000)
    drawn = seen["rows"][:, 0]
    det.fit_detector("probe", df.repartition(3), "id", ["x"], cap=30_000)
    assert len(set(drawn)) == 30_000 and (seen["rows"][:, 0] == drawn).all()
    det.fit_detector("probe", df, "id", ["x"], cap=0)
    assert len(seen["rows"]) == 60_000
    with pytest.raises(ValueError, match="train_row_caps"):
        Config.from_dict({"scoring": {"train_row_caps": {"lof": -1}}})


def test_kernel_and_neighbour_models_cut_nothing():
    x = np.random.default_rng(3).normal(size=(6000, 2))
    assert len(det.LocalOutlierFactor.fit(x, ["a", "b"], 7).points) == 6000
    svm = det.OneClassSVM.fit(x, ["a", "b"], 7)
    assert len(svm.vectors) >= 600 and abs((svm.score(x) > 0).mean() - 0.1) < 0.01


def test_long_frequency_maps_keep_every_value(spark):
    n = encode.MAP_VALUES + 500
    df = spark.range(3 * n).select(F.col("id").alias(readers.ROW_ID), F.concat(F.lit("v"), (F.col("id") % n).cast("string")).alias("c"))
    cfg = Config.from_dict({"profiling": {"one_hot_max_cardinality": 5}})
    plan = feature_plan.FeaturePlan.from_json(feature_plan.build(df, cfg).to_json())
    assert [e.treatment for e in plan.encodings] == ["frequency"]
    assert {r[1] for r in feature_plan.raw_features(df, plan).collect()} == {1 / n}
    other = frame(spark, [(1, "v0"), (2, f"v{n - 1}"), (3, "never seen"), (4, None)], f"{readers.ROW_ID} long, c string")
    got = {r[0]: r[1] for r in feature_plan.raw_features(other, plan).collect()}
    assert got == {1: 1 / n, 2: 1 / n, 3: 0.0, 4: 0.0}
    assert feature_plan.apply(other, plan).count() == 4


def test_groups_are_fitted_cut_and_ranked_by_themselves(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "big" if i < 300 else "small" if i < 420 else "tiny", float(v)) for i, v in enumerate(rng.normal(size=430))]
    rows = [(i, g, v if g == "big" else v / 100 + (3 if i == 419 else 0)) for i, g, v in rows]  # odd in its group only
    df = readers.with_row_id(frame(spark, rows, "id long, g string, x double"), id_column="id")
    cfg = Config.from_dict({"columns": {"id_column": "id", "group_by": ["g"]}, "scoring": {"detectors": ["kmeans_distance"], "contamination": 0.01}})
    fitted, ranked = detection.run_detection(df, cfg)
    assert sorted(fitted.manifest["too_few_records"].values()) == [10] and len(fitted.groups) == 2
    got = ranked.collect()
    flagged = {r[readers.ROW_ID]: r.flag_rank for r in got if r.flagged}
    assert len(got) == 420 and flagged[419] == 1 and sorted(flagged.values()) == [1, 1, 2, 3]
    again = detection.score_forward(df, detection.Fitted.from_json(fitted.to_json()), cfg).where("flagged").collect()
    assert {r[readers.ROW_ID]: r.flag_rank for r in again} == flagged


def test_composites_leave_bad_members_out(spark, monkeypatch):
    rows = [(i, float(i % 17), float(i % 23)) for i in range(120)]
    df = frame(spark, rows, "__row_id long, a double, b double")
    monkeypatch.setattr(scoring, "bad_members", lambda d, cols, row_id: ["cal_lof"])
    names = ["isolation_forest", "kmeans_distance", "lof"]
    fitted = detection.fit(df, Config.from_dict({"scoring": {"detectors": names, "combination": "composite"}}))
    assert fitted.dropped == ["lof"] and fitted.weights == [0.5, 0.5, 0.0]


@pytest.mark.parametrize("name", ["ecod", "hbos"])
def test_ecod_and_hbos_score_new_rows(name):
    x = np.random.default_rng(5).normal(size=(2000, 2))
    model = det.REGISTRY[name].fit(x, ["a", "b"], 7)
    assert abs((model.score(x) > model.threshold).mean() - 0.05) < 0.01
    raw = model.to_dict()
    again = det.REGISTRY[raw.pop("detector")](**raw)
    new = np.array([[0.0, 0.0], [50.0, -50.0]])
    assert again.score(new)[1] > model.threshold > again.score(new)[0]


def test_calibrators_are_exact_up_to_ten_thousand_scores(spark):
    df = spark.range(6000).select(F.col("id").cast("double").alias("s"))
    points = scoring.calibrators(df, {"m": "s"})["m"]
    assert len(points) == 6000
    got = df.select("s", scoring.calibrate_against(F.col("s"), points).alias("c")).collect()
    assert all(abs(r.c - (r.s + 0.5) / 6000) < 1e-12 for r in got)
    many = spark.range(10_001).select(F.col("id").cast("double").alias("s"))
    assert len(scoring.calibrators(many, {"m": "s"})["m"]) <= scoring.STORED_POINTS + 1
