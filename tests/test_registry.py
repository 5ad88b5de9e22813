"""Run log, versions and champion/challenger on hand-made runs (FIXTURES section 4)."""

import datetime as dt

from intentlab.operators import registry


def _runs(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [
        ("r1", "LR_baseline", t, {"model_type": "LR_baseline", "wdr_mode": "lower", "wdr_lower": "0.3"},
         {"roc_auc": 0.80, "f1": 0.5}),
        ("r2", "DT_medium", t + dt.timedelta(minutes=1), {"model_type": "DT_medium", "wdr_mode": "range",
                                                          "wdr_lower": "0.3", "wdr_upper": "0.7"},
         {"roc_auc": 0.90, "f1": 0.6, "precision": 0.4}),
        ("r3", "RF_baseline", t + dt.timedelta(minutes=2), {"model_type": "RF_baseline"}, {"roc_auc": 0.90}),
        ("r4", "XGBoost", t + dt.timedelta(minutes=3), {"model_type": "XGBoost"}, {}),  # no AUC
        ("r5", "data_validation", t, {"model_type": ""}, {"row_count": 12330.0}),
        ("r0", "LR_baseline", t - dt.timedelta(days=1), {"model_type": "LR_baseline"}, {"roc_auc": 0.85}),
    ]
    return spark.createDataFrame(rows, registry.RUN_LOG_SCHEMA)


def test_scan_keeps_model_runs_with_auc(spark):
    runs = registry.model_runs(_runs(spark))
    assert sorted(r.run_id for r in runs.collect()) == ["r0", "r1", "r2", "r3"]


def test_champion_challenger_ties_by_version(spark):
    runs = registry.model_runs(_runs(spark))
    versions = registry.number_versions(runs)
    roles = registry.champion_challenger(registry.versions_join_runs(versions, runs)).collect()
    assert [(r.role, r.run_id) for r in roles] == [("champion", "r2"), ("challenger", "r3")]


def test_single_version_has_no_challenger(spark):
    runs = registry.model_runs(_runs(spark)).where("run_id = 'r1'")
    roles = registry.champion_challenger(registry.versions_join_runs(registry.number_versions(runs), runs)).collect()
    assert [r.role for r in roles] == ["champion"]


def test_versions_without_run_drop_out(spark):
    runs = registry.model_runs(_runs(spark))
    versions = spark.createDataFrame([(1, "r1"), (2, "missing"), (3, "r4")], "version int, run_id string")
    got = registry.versions_join_runs(versions, runs).collect()
    assert [(r.version, r.run_id) for r in got] == [(1, "r1")]


def test_run_history_best_first(spark):
    hist = registry.run_history(registry.model_runs(_runs(spark))).collect()
    lr = [h for h in hist if h.model_type == "LR_baseline"][0]
    assert lr.run_count == 2 and lr.best_roc_auc == 0.85 and lr.best_run_id == "r0"
    assert hist[0].best_roc_auc == 0.90


def test_alias_details_fallbacks_and_texts(spark):
    runs = registry.model_runs(_runs(spark))
    roles = registry.champion_challenger(registry.versions_join_runs(registry.number_versions(runs), runs))
    got = {r.role: r for r in registry.alias_details(roles, runs).collect()}
    assert got["champion"].threshold_text == "30% – 70%" and got["champion"].precision == 0.4
    assert got["challenger"].threshold_text == "< 30%"  # falls back to the live config
    assert got["challenger"].wdr_label == "Wasted Discount" and got["challenger"].f1 is None


def test_threshold_config_round_trip(spark, tmp_path):
    path = str(tmp_path / "threshold")
    assert registry.read_threshold(spark, path) == {"mode": "lower", "lower": 0.30, "upper": 0.70}
    registry.write_threshold(spark, path, "range", 0.2, 0.6)
    assert registry.read_threshold(spark, path) == {"mode": "range", "lower": 0.2, "upper": 0.6}


def test_run_log_append_and_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    registry.append_runs(_runs(spark), path)
    registry.append_runs(_runs(spark).limit(1), path)
    assert registry.read_run_log(spark, path).count() == 7
