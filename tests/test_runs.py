"""Whole runs: identity, cuts, explanations, results, history and commands."""

from __future__ import annotations

import io
import itertools
import json
import math
import urllib.error
from email.message import Message

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddrank import cli
from oddrank.config import Config
from oddrank.operators import detectors as det
from oddrank.operators import evaluate, explain, history, ledger, periods, ranks, scenarios, scoring, temporal
from oddrank.plans import detection, explanation, feature_plan, run, trend
from oddrank.sources import fetch, readers, sinks


@pytest.mark.parametrize("parts", [3, 16])
def test_row_ids_are_dense_and_in_order(spark, parts):
    n = 400_000
    df = spark.range(n).select((F.xxhash64("id") % 1000).alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), (F.col("id") % 3).alias("c"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = readers.with_row_id(df, ["a", "b"]).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = got.sort_values(readers.ROW_ID)
    assert got[readers.ROW_ID].tolist() == list(range(n))
    assert got[["a", "b"]].equals(got[["a", "b"]].sort_values(["a", "b"]))


def test_row_ids_of_equal_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, None)] * 50 + [(None, "x")] * 3, "a long, b string")
    assert sorted(r[readers.ROW_ID] for r in readers.with_row_id(df).collect()) == list(range(53))
    assert readers.with_row_id(df.limit(0)).count() == 0


def test_numbered_in_groups(spark):
    rows = [(i, i % 3 if i % 7 else None, float(i * 37 % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g long, x double")
    got = {r.id: r.at for r in ranks.numbered(df, ["g"], [F.desc("x"), F.col("id")], "at").collect()}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("nearest", [False, True])
def test_quantiles_are_exact(spark, nearest):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else "b", float(round(v, 1))) for i, v in enumerate(rng.normal(size=700))] + [("a", None), ("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    for r in ranks.quantiles(df, "x", ["g"], shares, nearest).collect():
        own = np.array(sorted(x for g, x in rows if g == r.g and x is not None))
        want = [own[round(s * (len(own) - 1))] for s in shares] if nearest else np.percentile(own, [100 * s for s in shares])
        assert list(r.q) == pytest.approx(list(want))
    assert ranks.quantile(df, "x", 0.5) == pytest.approx(np.median([x for _, x in rows if x is not None]))


def test_exact_k_by_group_and_without_rows(spark):
    df = spark.range(100).select("id", (F.col("id") % 4).cast("double").alias("s"), F.when(F.col("id") > 9, F.col("id") % 2).alias("g"))
    got = scoring.exact_k(df, "s", "id", 0.1, ["g"]).where("flagged").groupBy("g").count().collect()
    sizes = {None: 10, 0: 45, 1: 45}
    assert {r.g: r["count"] for r in got} == {g: round(n * 0.1) for g, n in sizes.items()}
    assert scoring.exact_k(df.limit(0), "s", "id", 0.1).count() == 0
    ranked = scoring.flag_ranks(df.withColumn("flagged", F.col("id") % 5 == 0), "s", "id", ["g"])
    assert ranked.count() == 100 and ranked.where("NOT flagged AND flag_rank <> 0").count() == 0


# --- explanations -------------------------------------------------------------------------------


def path(tree, x):
    node = 0
    while tree["feature"][node] >= 0:
        node = tree["left"][node] + int(x[tree["feature"][node]] > tree["cut"][node])
    return tree["path"][node]


def test_tree_shapley_against_all_coalitions():
    rng = np.random.default_rng(7)
    data = rng.normal(size=(200, 4)).round(1)
    forest = det.IsolationForest.fit(data, list("abcd"), 1, trees=6, size=32)
    rows, background, weights = rng.normal(size=(5, 4)) * 2, data[:3], np.array([0.5, 0.3, 0.2])
    got = explain.tree_shapley(forest.trees, rows, background, weights)
    for x, own in zip(rows, got, strict=True):
        want = np.zeros(4)
        for z, w in zip(background, weights, strict=True):
            value = {s: np.mean([path(t, np.where([i in s for i in range(4)], x, z)) for t in forest.trees]) for k in range(5) for s in itertools.combinations(range(4), k)}
            for i in range(4):
                for k in range(4):
                    for s in itertools.combinations([j for j in range(4) if j != i], k):
                        share = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                        want[i] -= w * share * (value[tuple(sorted((*s, i)))] - value[s])
        assert own == pytest.approx(want)


def test_terms_sum_to_the_score():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 4, 300), np.full(300, 2.0)])
    for kind in (det.Ecod, det.Hbos):
        model = kind.fit(x, list("abc"), 0)
        probe = np.concatenate([x[:20], [[9.0, 7, 2], [0, 1, 3]]])
        assert model.terms(probe).sum(1) == pytest.approx(model.score(probe))


def test_blend_leaves_out_what_says_nothing():
    a, b = np.array([[3.0, 4.0], [0.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 2.0]])
    assert explain.blend([a, b], [0.5, 0.5]).tolist() == [[0.8, 0.4], [0.0, 1.0]]
    # the medians of the whole run decide, not those of the batch
    tiny = np.array([[1e-9, 0.0]])
    assert explain.blend([tiny, np.array([[0.0, 1.0]])], [0.5, 0.5], [5.0, 1.0]).tolist() == [[0.0, 1.0]]


def planted(spark, n=300, odd=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.normal()), float(rng.normal()), "ab"[i % 2], f"2024-01-{1 + i % 28:02d}") for i in range(n)]
    rows += [(n + i, 9.0 + i, float(rng.normal()), "a", "2024-01-15") for i in range(odd)]
    return spark.createDataFrame(rows, "id long, x double, y double, kind string, day string")


ALL = ["isolation_forest", "kmeans_distance", "one_class_svm", "lof", "ecod", "hbos"]


@pytest.fixture(scope="module")
def explained(spark):
    cfg = Config.from_dict({"columns": {"id_column": "id"}, "scoring": {"detectors": ALL, "contamination": 0.03}, "explain": {"max_rows": 4}})
    df = readers.with_row_id(planted(spark), id_column="id")
    fitted, ranked = detection.run_detection(df, cfg)
    rows, records = detection.explain(df, ranked, fitted, cfg)
    return cfg, df, fitted, ranked, rows.collect(), records.collect()


def test_every_flagged_row_is_explained(explained):
    cfg, df, fitted, ranked, rows, records = explained
    flagged = {r[readers.ROW_ID]: r.flag_rank for r in ranked.where("flagged").collect()}
    assert len(flagged) == round(308 * 0.03)
    assert {r[readers.ROW_ID]: r.flag_rank for r in rows} == flagged
    for r in rows:  # detectors that are called over and over explain the first rows, and the status says so
        if r.flag_rank <= cfg.explain.max_rows:
            assert "not_covered" not in (r.explain_issue or "")
        else:
            assert r.explain_status == "partial" and "lof" in r.explain_issue and "one_class_svm" in r.explain_issue
        assert r.reason_1 and r.attribution_kind == "heuristic"
    far = [r for r in records if r[readers.ROW_ID] >= 300]
    first = [r for r in far if r.reason_rank == 1]
    assert all(r.original_field == "x" and r.direction == "above" and float(r.raw_value) >= 9 for r in first)
    for r in records:
        assert r.contribution_magnitude >= abs(r.signed_contribution) - 1e-9
        told = sum(m.weight * m.signed_contribution for m in r.methods)
        assert told == pytest.approx(r.signed_contribution, abs=1e-6)
        assert sum(m.weight for m in r.methods) == pytest.approx(1.0)
        assert r.reference_id == "consensus_normal" and "unsigned_method:kmeans_distance" in r.approximation_flags
    assert {r.direction for r in records if r.original_field == "kind"} <= {"same", "different"}


def test_explanations_do_not_hang_on_batches(spark, explained):
    cfg, df, fitted, ranked, _, records = explained
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        again = detection.explain(df, ranked, fitted, cfg)[1].collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    key = lambda r: (r[readers.ROW_ID], r.reason_rank)
    assert [(key(r), r.original_field, pytest.approx(r.signed_contribution)) for r in sorted(again, key=key)] == [
        (key(r), r.original_field, r.signed_contribution) for r in sorted(records, key=key)
    ]


def test_frozen_models_keep_their_reference(spark, explained):
    cfg, df, fitted, ranked, _, records = explained
    back = detection.Fitted.from_json(fitted.to_json())
    assert back.summary == fitted.summary
    again = detection.score_forward(df, back, cfg)
    assert {r[readers.ROW_ID]: r.flag_rank for r in again.where("flagged").collect()} == {r[readers.ROW_ID]: r.flag_rank for r in ranked.where("flagged").collect()}
    back.manifest["versions"] = {"numpy": "0.1"}
    with pytest.raises(feature_plan.PlanError, match="numpy"):
        detection.score_forward(df, back, cfg)


def test_without_ordinary_rows_there_is_no_explanation(spark):
    df = readers.with_row_id(spark.createDataFrame([(i, float(i)) for i in range(8)], "id long, x double"), id_column="id")
    cfg = Config.from_dict({"columns": {"id_column": "id"}, "scoring": {"detectors": ["ecod"], "contamination": 0.25}, "profiling": {"identifier_detection": "off"}})
    fitted, ranked = detection.run_detection(df, cfg)
    rows = detection.explain(df, ranked, fitted, cfg)[0].collect()
    assert [(r.explain_status, r.explain_issue) for r in rows] == [("unavailable", "no_reference")] * 2


def test_components_in_a_run(spark):
    cfg = Config.from_dict({"columns": {"id_column": "id"}, "features": {"pca": True, "pca_components": 2}, "scoring": {"detectors": ["ecod", "kmeans_distance"], "contamination": 0.02}})
    df = readers.with_row_id(planted(spark), id_column="id")
    fitted, ranked = detection.run_detection(df, cfg)
    assert fitted.plan.model_features == ["pc_1", "pc_2"]
    back = feature_plan.FeaturePlan.from_json(fitted.plan.to_json())
    assert back.digest() == fitted.plan.digest()
    records = detection.explain(df, ranked, fitted, cfg)[1].collect()
    assert {f.feature for r in records for f in r.transformed_features} <= set(fitted.plan.features)
    assert all("component_back_projection" in r.approximation_flags for r in records)


def test_dates_in_texts_become_features(spark):
    df = planted(spark)
    cfg = Config.from_dict({"columns": {"id_column": "id"}})
    plan = feature_plan.build(readers.with_row_id(df, id_column="id"), cfg)
    assert plan.temporal == {"day": "iso"} and "day_month" not in plan.origin or plan.temporal == {"day": "iso"}
    assert {"day_dayofweek", "day_day"} <= set(plan.origin)
    assert plan.time_column == "day"
    off = Config.from_dict({"columns": {"id_column": "id", "detect_dates": False}})
    assert feature_plan.build(readers.with_row_id(df, id_column="id"), off).temporal == {}
    both = spark.createDataFrame([("03/04/2024",), ("05/06/2024",)], "d string")
    found, warned = temporal.detect(both, cfg)
    assert found == {} and "temporal.ambiguous" in warned[0]
    forced = Config.from_dict({"columns": {"formats": {"t": "epoch_s"}}})
    stamps = spark.createDataFrame([(0,), (86400,)], "t long")
    assert [str(r.t) for r in temporal.replay(stamps, temporal.detect(stamps, forced)[0]).collect()] == ["1970-01-01 00:00:00", "1970-01-02 00:00:00"]


# --- groups and refusals -----------------------------------------------------------------------------


def test_group_selectors(spark):
    df = readers.with_row_id(planted(spark), id_column="id")
    base = {"columns": {"id_column": "id", "group_by": ["kind"]}, "scoring": {"detectors": ["ecod"], "min_records": 10, "contamination": 0.02}}
    named = lambda **g: {x["label"] for x in detection.select_groups(df, Config.from_dict(base | {"groups": g})).values()}
    assert named() == {"a", "b"} and named(labels=["b"]) == {"b"} and named(pattern="^a") == {"a"} and named(limit=1) == {"a"}
    with pytest.raises(feature_plan.PlanError, match="selectors"):
        named(labels=["z"])
    nulls = df.withColumn("kind", F.when(F.col("id") % 2 == 0, F.lit("None")))
    assert {x["label"] for x in detection.select_groups(nulls, Config.from_dict(base)).values()} == {"None", "(null)"}


def test_groups_are_fitted_apart(spark):
    rows = [(i, "big", float(i % 50)) for i in range(200)] + [(200 + i, "small", float(i % 5)) for i in range(60)] + [(300, "small", 30.0)]
    df = readers.with_row_id(spark.createDataFrame(rows, "id long, g string, x double"), id_column="id")
    cfg = Config.from_dict({"columns": {"id_column": "id", "group_by": ["g"]}, "scoring": {"detectors": ["ecod", "hbos"], "min_records": 20, "contamination": 0.01}})
    fitted, ranked = detection.run_detection(df, cfg)
    assert 300 in {r[readers.ROW_ID] for r in ranked.where("flagged").collect()}
    assert ranked.count() == 261 and len(fitted.groups) == 2


def test_what_is_refused(spark):
    with pytest.raises(ValueError, match="unknown detectors"):
        Config.from_dict({"scoring": {"detectors": ["nonesuch"]}})
    with pytest.raises(ValueError, match="can't set"):
        Config.from_dict({"scoring": {"params": {"lof": {"seed": 3}}}})
    df = planted(spark)
    cfg = Config.from_dict({"columns": {"id_column": "id", "time_column": "day"}, "period": {"start": "2030-01-01"}})
    with pytest.raises(run.RunError, match="2024-01-01"):
        run.in_period(run.prepared(spark, cfg, df), cfg)
    twice = df.unionByName(df.limit(1))
    with pytest.raises(run.RunError, match="name more"):
        run.prepared(spark, cfg, twice)
    strict = Config.from_dict({"run": {"max_rows": 5, "strict": True}})
    with pytest.raises(run.RunError, match="run.max_rows"):
        run.capped(readers.with_row_id(df, id_column="id"), strict, run.Run("x"))
    loose, state = Config.from_dict({"run": {"max_rows": 5}}), run.Run("x")
    assert sorted(r.id for r in run.capped(readers.with_row_id(df, id_column="id"), loose, state).collect()) == [0, 1, 2, 3, 4]
    assert state.warnings[0]["code"] == "run.max_rows"


def test_hashes_of_configurations():
    a, b = Config(), Config.from_dict({"period": {"start": "2024-01-01"}})
    assert a.hash() == b.hash() and a.hash() != Config.from_dict({"scoring": {"combination": "union"}}).hash()
    assert a.scope_hash() == Config.from_dict({"scoring": {"combination": "union"}, "run": {"seed": 7}}).scope_hash()


# --- a run's results, history, commands ---------------------------------------------------------------


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    return str(tmp_path_factory.mktemp("runs"))


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal() + (2 if d >= 4 else 0)), "ab"[i % 2], f"2024-03-{d + 1:02d} 10:00:00") for d in range(8) for i in range(d * 100, d * 100 + 60 + 5 * d)]
    return spark.createDataFrame(rows, "id long, x double, kind string, at string").withColumn("at", F.to_timestamp("at"))


CFG = {"columns": {"id_column": "id", "time_column": "at"}, "scoring": {"detectors": ["ecod", "hbos"], "contamination": 0.05}}


def test_a_run_writes_its_results(spark, root, daily):
    cfg = Config.from_dict(CFG)
    done = run.execute(spark, cfg, root, daily)
    assert done.status == "complete" and done.rows == daily.count() and done.flagged == round(done.rows * 0.05)
    again = run.execute(spark, cfg, root, daily)
    assert again.run_id == done.run_id
    found = {n: sinks.read_result(spark, root, n, done.run_id) for n in ("anomalies", "ranked", "explanations", "attributions")}
    assert found["anomalies"].count() == found["explanations"].count() == done.flagged
    assert found["ranked"].count() == 20 and "kind" in found["ranked"].columns
    assert found["attributions"].groupBy(readers.ROW_ID, "reason_rank").count().where("count > 1").count() == 0
    told = json.loads(sinks.read_text(spark, f"{root}/runs/{done.run_id}/report.json"))
    assert told["facts"]["flagged"] == done.flagged and len(told["preview"]) == 20
    assert "<h2>Reasons</h2>" in sinks.read_text(spark, f"{root}/runs/{done.run_id}/report.html")
    book = ledger.Ledger(spark, f"{root}/ledger")
    totals = book.table("totals").where(F.col("run_id") == done.run_id)
    assert totals.agg(F.sum("population"), F.sum("anomaly_count")).first() == (done.rows, done.flagged)
    assert book.rows("period", cfg.hash(), "status = 'complete'") == [f"2024-03-{d:02d}" for d in range(1, 9)]
    frozen = run.execute(spark, cfg, root, daily, models=sinks.read_text(spark, f"{root}/runs/{done.run_id}/models.json"))
    assert frozen.flagged == done.flagged and frozen.run_id != done.run_id


def test_backfill_and_history(spark, tmp_path, daily):
    cfg, root = Config.from_dict(CFG | {"explain": {"enabled": False}}), str(tmp_path)
    early = Config.from_dict(CFG | {"explain": {"enabled": False}, "period": {"start": "2024-03-01", "end": "2024-03-05"}})
    first = run.execute(spark, early, root, daily)
    states = run.backfill(spark, cfg, root, "2024-03-07", daily, lookback=2, anchor=first.run_id)
    assert states == {"2024-03-05": "complete", "2024-03-06": "complete"}
    assert run.backfill(spark, cfg, root, "2024-03-07", daily, lookback=6) == {}
    assert set(run.backfill(spark, cfg, root, "2024-03-05", daily, lookback=2, forced=["2024-03-04", "2024-03-20"], anchor=first.run_id)) == {"2024-03-04"}
    told = run.history(spark, cfg, root, "2024-03-05", (1,), anchor=first.run_id)
    (w,) = told["windows"]
    assert (w["counts"]["current_population"], w["counts"]["prior_population"]) == (80, 75)
    assert w["population"]["fields"]["x"]["band"] in ("moderate", "major")
    a = w["anchor"]
    assert a["anchor_run_id"] == first.run_id and a["cells_used"] == 2
    assert a["volume"] + a["score_drift"] + a["threshold_drift"] == pytest.approx(a["count_change"])
    assert 0 < a["tail_share"] <= 1
    assert w["verdicts"]["counts"][0] == "caveats" and w["verdicts"]["scores"][0] == "ok"
    assert run.history(spark, cfg, root)["reference_period"] == "2024-03-06"


def test_periods():
    assert periods.step("2024-01", "month", -1) == "2023-12" and periods.step("2024-02-28", "day", 2) == "2024-03-01"
    assert periods.span("2024-03-01", "2024-03-05", "day", True) == ["2024-03-01", "2024-03-04", "2024-03-05"]
    assert periods.step("2024-03-01T23", "hour", 1) == "2024-03-02T00"
    assert periods.backfill(None, "2024-03-05", "day", 3, 9, 60) == ["2024-03-02", "2024-03-03", "2024-03-04"]
    assert periods.backfill("2024-03-02", "2024-03-05", "day", 3, 9, 60) == ["2024-03-03", "2024-03-04"]
    assert periods.backfill("2024-03-05", "2024-03-05", "day", 3, 4, 2) == ["2024-03-03", "2024-03-04"]
    assert periods.backfill("2024-01-01", "2024-03-05", "day", 3, 2, 60) == ["2024-03-03", "2024-03-04"]
    assert periods.default_reference(["2024-03-01", "2024-03-04"], "2024-03-04") == ("2024-03-01", False)
    assert periods.default_reference(["2024-03-04"], "2024-03-04") == ("2024-03-04", True)
    assert periods.default_reference([], "2024-03-04") == (None, False)
    assert periods.windows("2024-03", 2, "month") == (["2024-02", "2024-03"], ["2023-12", "2024-01"])


@pytest.mark.parametrize(("granularity", "labels"), [("hour", ["2024-03-01T23", "2024-03-02T00"]), ("week", ["2024-02-26", "2024-03-04"]), ("month", ["2023-12", "2024-01"])])
def test_windows_of_any_granularity(spark, granularity, labels):
    tot = spark.createDataFrame([("g", x, 10 + i, 100) for i, x in enumerate(labels)], "group_key string, period_label string, anomaly_count long, population long")
    (r,) = history.rolling_windows(tot, labels[1], [1], ["group_key"], granularity=granularity).collect()
    assert (r.current_count, r.prior_count) == (11, 10)


def test_comparability_codes(spark):
    tot = spark.createDataFrame([("g", "2024-03-02", 1, 50), ("h", "2024-03-01", 1, 50)], "group_key string, period_label string, anomaly_count long, population long")
    w = history.rolling_windows(tot, "2024-03-02", [1], ["group_key"])
    got = history.comparability(w, other_configs=True, versions=2, incomplete=(False, True)).first().comparability
    assert set(got) >= {"other_config_in_span", "mixed_library_versions", "incomplete_prior", "group_mix_changed", "low_volume"}


def test_drift_between_summaries():
    rng = np.random.default_rng(0)
    doc = lambda v, missing=0: {"kind": "numeric", "n": len(v), "missing": missing, "percentiles": np.percentile(v, range(101)).tolist()}
    a, b = rng.normal(size=3000), rng.normal(size=3000)
    assert trend.numeric_drift([doc(a[:1000]), doc(a[1000:])], [doc(b)]) < 0.02
    assert trend.numeric_drift([doc(a)], [doc(b + 2)]) > 0.25
    assert trend.numeric_drift([doc(a)], [doc(b, 3000)]) > 0.25
    cat = lambda n, m: {"kind": "categorical", "n": n + m, "missing": 0, "other": 0, "top": [{"value": "x", "n": n}, {"value": "y", "n": m}]}
    assert trend.categorical_drift([cat(50, 50)], [cat(50, 50)]) == 0
    got = trend.population_drift([{"population": {"f": cat(50, 50), "n": doc(a), "gone": doc(a)}}], [{"population": {"f": cat(90, 10), "n": cat(1, 1)}}])
    assert got["f"]["band"] == "major" and got["n"] == {"psi": None, "band": "not_comparable", "kind": "categorical/numeric"}
    assert got["gone"]["psi"] is None


def test_commands(spark, tmp_path, daily, capsys):
    source, conf, out = f"{tmp_path}/daily.parquet", tmp_path / "conf.json", f"{tmp_path}/out"
    daily.write.parquet(source)
    conf.write_text(json.dumps(CFG))
    common = ["--config", str(conf)]
    assert cli.main(["run", source, "--out", out, *common]) == 0
    run_id = capsys.readouterr().out.split()[0]
    assert cli.main(["score", source, "--out", out, "--run", run_id, *common]) == 0
    for args in (["runs"], ["show", "--run", run_id], ["report", "--run", run_id], ["anomalies", "--run", run_id, "--top", "3"], ["workspace", "du"], ["workspace", "ls"]):
        assert cli.main([*args, "--out", out]) == 0, args
        assert run_id in capsys.readouterr().out
    assert cli.main(["history", "--out", out, *common]) == 0
    assert json.loads(capsys.readouterr().out)["reference_period"] == "2024-03-08"
    assert cli.main(["workspace", "prune", "--out", out, "--before", "2999-01-01"]) == 0
    assert run_id in capsys.readouterr().out
    assert cli.main(["anomalies", "--out", out, "--run", "nonesuch"]) in (0, 3)
    assert cli.main(["evidence", "--out", out]) == 3
    assert cli.main(["score", source, "--out", out, "--run", "nonesuch", *common]) == 3
    assert cli.main(["inspect", source]) == 0 and "at\ttimestamp\ttemporal" in capsys.readouterr().out
    assert cli.main(["explain-plan", source, *common]) == 0
    assert cli.main(["run", source, "--out", out, "--config", f"{tmp_path}/none.json"]) == 3
    assert cli.main(["init", f"{tmp_path}/new.json"]) == 0 and cli.main(["init", f"{tmp_path}/new.json"]) == 2
    assert cli.main(["config", "check", f"{tmp_path}/new.json"]) == 0 and cli.main(["config", "schema"]) == 0
    assert cli.main(["detectors"]) == 0 and "ecod" in capsys.readouterr().out
    bad = tmp_path / "bad.json"
    bad.write_text('{"scoring": {"detectors": ["no"]}}')
    assert cli.main(["config", "check", str(bad)]) == 2


# --- sources behind http -------------------------------------------------------------------------------------


class Answer(io.BytesIO):
    headers = {"ETag": "v1"}


def test_fetch(tmp_path):
    asked = []

    def opener(request, timeout):
        asked.append((request.full_url, dict(request.header_items())))
        if "/moved.csv" in request.full_url:
            headers = Message()
            headers["Location"] = "/data.csv"
            raise urllib.error.HTTPError(request.full_url, 302, "found", headers, None)
        if request.get_header("If-none-match"):
            raise urllib.error.HTTPError(request.full_url, 304, "same", Message(), None)
        return Answer(b"a,b\n1,2\n")

    told = dict(cache=str(tmp_path), opener=opener, check=lambda host: None)
    path = fetch.fetch("https://me:secret@example.com/moved.csv?token=abc", **told)
    assert open(path, "rb").read() == b"a,b\n1,2\n" and path.endswith(".csv")
    assert [u for u, _ in asked] == ["https://example.com/moved.csv?token=abc", "https://example.com/data.csv"]
    assert all("secret" not in p.read_text() and "abc" not in p.read_text() for p in tmp_path.glob("*.json"))
    assert fetch.fetch("https://example.com/x.csv", **told) == fetch.fetch("https://example.com/x.csv", **told)
    with pytest.raises(readers.SourceError, match="more than 3 bytes"):
        fetch.fetch("https://example.com/y.csv", most=3, **told)
    with pytest.raises(readers.SourceError, match="public"):
        fetch.public("inner", lambda host, port: [(0, 0, 0, "", ("10.1.2.3", 0))])
    with pytest.raises(readers.SourceError, match="not http"):
        fetch.fetch("ftp://example.com/x", **told)
    fetch.public("out", lambda host, port: [(0, 0, 0, "", ("93.184.216.34", 0))])
    assert fetch.local("file:///a/b.csv") == "/a/b.csv" and fetch.local("/a/b.csv") == "/a/b.csv"


# --- planted tables --------------------------------------------------------------------------------------------


def test_scale_frame(spark):
    df = scenarios.scale_frame(spark, 20_000, 3)
    assert len(df.columns) == 15 and df.agg(F.sum("label")).first()[0] == pytest.approx(100, abs=40)
    a = df.where("id < 50").orderBy("id").collect()
    assert a == scenarios.scale_frame(spark.newSession(), 20_000, 3).repartition(7).where("id < 50").orderBy("id").collect()
    r = df.agg(F.avg("quantity"), F.corr("temp", "pressure"), F.count_distinct("merchant"), F.avg(F.col("is_member").cast("int"))).first()
    assert r[0] == pytest.approx(4, abs=0.1) and r[1] > 0.7 and 250 < r[2] <= 401 and r[3] == pytest.approx(0.4, abs=0.02)


@pytest.mark.parametrize("kind", scenarios.KINDS)
def test_scenarios(spark, kind):
    table, labels = scenarios.small(kind, 2, 120, 8)
    assert {len(v) for v in table.values()} == {len(labels)} and 8 <= sum(labels) < 160
    df = scenarios.frame(spark, table, labels)
    assert df.where("label = 1").count() == sum(labels)


def test_swamping_pair_and_bounds():
    pair = scenarios.swamping(1)
    assert pair["clean"]["num_0"] == pair["stained"]["num_0"][:800] and len(pair["at_risk"]["num_0"]) == 150
    got = scenarios.check_bounds("point", {"average_precision": 0.5, "over_flag_ratio": 1.2, "flag_precision": math.nan})
    assert {b: ok for b, _, _, ok in got} == {"min_average_precision": False, "max_over_flag_ratio": True}
    assert [b for b, *_ in scenarios.check_bounds("swamping", {"average_precision": 0.0, "false_positive_budget_ratio": 0.5})] == ["max_false_positive_budget_ratio"]


def test_candidates_and_decisions():
    assert evaluate.candidate("discrete-composite@1", ["categorical", "boolean"])["combination"] == "composite"
    assert evaluate.candidate("discrete-budget@2", ["categorical"])["bags"] == 5
    assert evaluate.candidate("discrete-budget@1", ["categorical", "numeric"])["flags"] == "own"
    good, base = [0.8, 0.82, 0.79, 0.81, 0.8] * 4, [0.5, 0.52, 0.49, 0.5, 0.51] * 4
    assert evaluate.decide_across({"a": (good, base)})["outperforms"]
    assert not evaluate.decide_across({"a": (good, base), "b": (base, good)}, "all")["outperforms"]
    assert evaluate.decide_across({"a": (good, base)}, regressions={"a": ["slower"]})["reasons"] == ["a: slower"]


def test_forward_folds(spark):
    from oddrank.plans import backtest

    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal() + (12 + i / 10 if i % 40 == 0 else 0)), f"2024-{1 + i // 100:02d}-15") for i in range(400)]
    df = readers.with_row_id(spark.createDataFrame(rows, "id long, x double, at string").withColumn("at", F.to_date("at")), id_column="id")
    labels = df.select(readers.ROW_ID, (F.col("id") % 40 == 0).cast("int").alias("y"))
    cfg = Config.from_dict({"columns": {"id_column": "id"}, "profiling": {"include_only": ["x"]}, "scoring": {"detectors": ["ecod", "hbos"]}})
    got = backtest.forward(df, labels, cfg, "at", folds=2)
    assert all(len(v) == 2 and min(v) > 0.3 for v in got["average_precision"].values())
    with pytest.raises(feature_plan.PlanError, match="periods"):
        backtest.forward(df, labels, cfg, "at", folds=9)


def test_kernel_shapley_against_all_coalitions():
    rng = np.random.default_rng(9)
    score = lambda x: x[:, 0] * x[:, 1] + np.abs(x[:, 2]) - x[:, 3] ** 2
    x, z, w = rng.normal(size=(3, 4)), rng.normal(size=(2, 4)), np.array([0.7, 0.3])
    got = explain.kernel_shapley(score, x, z, w)
    for row, own in zip(x, got, strict=True):
        value = {s: w @ score(np.where([i in s for i in range(4)], row, z)) for k in range(5) for s in itertools.combinations(range(4), k)}
        for i in range(4):
            want = sum(
                math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value[tuple(sorted((*s, i)))] - value[s])
                for k in range(4) for s in itertools.combinations([j for j in range(4) if j != i], k)
            )
            assert own[i] == pytest.approx(want)
    many = rng.normal(size=(1, 12))
    wide = explain.kernel_shapley(lambda v: v @ np.arange(12.0), many, np.zeros((1, 12)), np.ones(1), samples=200)
    assert wide[0] == pytest.approx(many[0] * np.arange(12.0))
    assert explain.permutation_importance(lambda v: 3 * v[:, 0] + v[:, 1], rng.normal(size=(200, 3))).argmax() == 0


def test_changed_models_are_refused(explained):
    told = json.loads(explained[2].to_json())
    told["thresholds"]["ecod"] += 1
    with pytest.raises(feature_plan.PlanError, match="changed"):
        detection.Fitted.from_json(json.dumps(told))


def test_detectors_fitted_side_by_side_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.normal(6, 1, (200, 3))])
    caps = {"ecod": 0, "isolation_forest": 400, "kmeans_distance": 450, "hbos": 100}
    params = {"isolation_forest": {"trees": 5}}
    alone = det.fit_detectors(spark, x, list("abc"), caps, params, 3)
    monkeypatch.setattr(det, "SPREAD_NUMBERS", 10)
    spread = det.fit_detectors(spark, x, list("abc"), caps, params, 3)
    assert list(spread) == list(alone)
    for n in caps:
        assert spread[n].score(x) == pytest.approx(alone[n].score(x))


def test_encoding_guard(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes("a,b\nx,ä�\n".encode())
    (tmp_path / "bad.csv").write_bytes("a,b\nx,ä\n".encode("latin-1"))
    assert readers.read(spark, f"{tmp_path}/good.csv").first().b == "ä�"
    with pytest.raises(readers.SourceError, match="UTF-8"):
        readers.read(spark, f"{tmp_path}/bad.csv")


def test_correlations_of_many_columns(spark):
    from oddrank.operators import encode

    rng = np.random.default_rng(8)
    x = rng.normal(1e6, 1, (400, 12))
    x[:, 3] = 2 * x[:, 1] - 5
    x[:, 7] = 4.0
    x[::5, 2] = np.nan
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(5)
    for r in encode.correlations(df, names).collect():
        a, b = x[:, int(r.a[1:])], x[:, int(r.b[1:])]
        both = ~np.isnan(a) & ~np.isnan(b)
        if "c7" in (r.a, r.b):
            assert r.r is None
        else:
            assert r.r == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-6)


def test_grouped_runs_rank_their_own_rows_exactly(spark):
    """Over ten thousand distinct scores in a group: thinned points are for new rows only."""
    rows = spark.range(46_000).select("id", (F.xxhash64("id") % 1_000_003 / 7.0).alias("x"), F.when(F.col("id") < 23_000, "a").otherwise("b").alias("g"))
    cfg = Config.from_dict({"columns": {"id_column": "id", "group_by": ["g"]}, "scoring": {"detectors": ["ecod"], "contamination": 0.03}})
    fitted, ranked = detection.run_detection(readers.with_row_id(rows, id_column="id"), cfg)
    assert all(len(f.calibrators["ecod"]) <= scoring.STORED_POINTS + 1 for f in fitted.groups.values())
    got = ranked.toPandas()
    of = got.groupby(detection.GROUP)["raw_ecod"]
    assert of.nunique().min() > scoring.EXACT_POINTS
    want = (of.rank() - 0.5) / of.transform("size")
    assert np.abs(got["cal_ecod"] - want).max() < 1e-12
    first = got.sort_values(["cal_ecod", readers.ROW_ID], ascending=[False, True]).groupby(detection.GROUP).head(690)
    assert got["flagged"].sum() == 1380 and first["flagged"].all()


@pytest.mark.parametrize("most", [300, 60])
def test_ecod_and_hbos_are_fitted_on_all_rows(spark, monkeypatch, most):
    """Over the cap by aggregates; 60 is less than a column's distinct values too, so ECOD's scores are joined."""
    rng = np.random.default_rng(4)
    x = np.column_stack([np.round(rng.normal(size=900) * 20) / 20, rng.integers(0, 9, 900).astype(float)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, c double").repartition(3)
    for n in ("ecod", "hbos"):
        monkeypatch.setitem(det.CAPS, n, most)
    cfg = Config.from_dict({"columns": {"id_column": "id"}, "scoring": {"detectors": ["hbos", "ecod"], "contamination": 0.05}})
    fitted, ranked = detection.run_detection(readers.with_row_id(df, id_column="id"), cfg)
    got = ranked.toPandas().sort_values(readers.ROW_ID)
    assert (fitted.tails is not None) == (most == 60)
    of = feature_plan.apply(readers.with_row_id(df, id_column="id"), fitted.plan).toPandas().sort_values(readers.ROW_ID)
    whole = of[fitted.plan.model_features].to_numpy(float)
    for kind in (det.Ecod, det.Hbos):
        alone = kind.fit(whole, fitted.plan.model_features, 0)
        assert got[f"raw_{kind.name}"].to_numpy() == pytest.approx(alone.score(whole))
        assert fitted.thresholds[kind.name] == pytest.approx(alone.threshold)
    bounded = Config.from_dict({"columns": {"id_column": "id"}, "scoring": {"detectors": ["ecod"], "train_row_caps": {"ecod": 50}}})
    assert detection.fit(readers.with_row_id(df, id_column="id"), bounded).models["ecod"].rows == 50


def test_scores_are_rounded_as_sql_rounds(spark):
    import duckdb

    from oddrank import queries

    df = spark.range(0, 3_600_000, 899).select((F.col("id") / 3_600_000).alias("score")).union(spark.range(400).select((F.col("id") * 18 + 9) / 3_600_000 + 0.3785))
    got = df.select("score", queries._as_sql("score").alias("r")).toPandas()
    assert (duckdb.sql("SELECT round(score, 6) AS w FROM got").df()["w"] == got["r"]).all()


def test_explanations_have_the_terms_of_all_rows(spark, monkeypatch):
    """ECOD's terms are exact over its cap too, and those of rows that the stored model scored are the stored model's."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(700, 2)), 3)
    df = readers.with_row_id(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, c double"), id_column="id")
    monkeypatch.setitem(det.CAPS, "ecod", 60)
    cfg = Config.from_dict({"columns": {"id_column": "id"}, "features": {"correlation_reduction": False}, "scoring": {"detectors": ["ecod"], "contamination": 0.05}})
    fitted, ranked = detection.run_detection(df, cfg)
    assert fitted.tails is not None
    model = det.Ecod.fit(x, ["a", "c"], 0)
    records = detection.explain(df, ranked, fitted, cfg)[1].collect()
    assert len(records) == 70
    for r in records:
        assert r.contribution_magnitude == pytest.approx(model.terms(x)[r[readers.ROW_ID], "ac".index(r.original_field)])
    later = detection.score_forward(df, fitted, cfg)
    found = detection.explain(df, later, fitted, cfg)[1].groupBy(readers.ROW_ID).agg(F.sum("contribution_magnitude").alias("s"))
    for r in found.join(later, readers.ROW_ID).collect():
        assert r.s == pytest.approx(r.raw_ecod)
