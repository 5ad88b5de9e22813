"""Invariants of the Spark ML side (M5-M15): probabilities, persistence, importances, training job."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from intentlab.config import materialize, scratch_path
from intentlab.operators import models, prepare, registry, split
from intentlab.sources.tables import load_sessions

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    labeled = prepare.project_features(load_sessions(spark, SF_SMALL))
    s = materialize(split.assign_split(labeled, "label"), "test-models-split")
    return s.where(~F.col("is_test")), s.where(F.col("is_test"))


def test_override_params_merge():
    p = models.model_params({"LR_baseline": {"C": 0.5, "unknown": 1}, "RF_baseline": {"n_estimators": 10}})
    assert p["LR_baseline"] == {"C": 0.5, "solver": "lbfgs"}
    assert p["RF_baseline"]["n_estimators"] == 10 and p["RF_baseline"]["max_depth"] == 12
    assert models.threshold_options({"_threshold": {"mode": "range"}}) == {"mode": "range", "lower": 0.30, "upper": 1.0}
    assert models.preprocessor_options({})["numeric_imputer_strategy"] == "median"


def test_probabilities_and_save_load(spark, data):
    train, test = data
    model = models.build_pipeline("DT_medium", models.model_params()["DT_medium"]).fit(train)
    scored = models.score(model, test)
    bounds = scored.agg(F.min("p"), F.max("p")).first()
    assert 0.0 <= bounds[0] <= bounds[1] <= 1.0
    path = scratch_path(spark, "dt-model")
    model.write().overwrite().save(path)
    again = models.score(PipelineModel.load(path), test)
    a = scored.select("session_id", F.col("p").alias("a"))
    b = again.select("session_id", F.col("p").alias("b"))
    assert a.join(b, "session_id").where(F.col("a") != F.col("b")).count() == 0
    imp = models.feature_importance(model, scored)
    total = imp.agg(F.sum("importance")).first()[0]
    assert abs(total - 1.0) < 1e-9


def test_logistic_complement_and_cv(spark, data):
    train, test = data
    params = models.model_params()["LR_baseline"]
    model = models.build_pipeline("LR_baseline", params).fit(train)
    scored = models.score(model, test)
    from pyspark.ml.functions import vector_to_array
    arr = scored.select(vector_to_array("probability").alias("v"))
    assert arr.where(F.abs(F.col("v")[0] + F.col("v")[1] - 1) > 1e-12).count() == 0
    folds = models.cross_validate("LR_baseline", params, train).collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3, 4]
    assert all(0.0 <= r.auc <= 1.0 for r in folds)


def test_train_all_logs_runs_and_ranks(spark):
    from intentlab.plans.training import TrainingAborted, train_all
    log = scratch_path(spark, "test-run-log")
    sess = load_sessions(spark, SF_SMALL)
    res = train_all(spark, sess, log, model_names=["LR_baseline", "DT_medium"])
    runs = registry.read_run_log(spark, log)
    assert runs.count() == 3  # validation run + two models
    roles = res.roles.collect()
    assert [r.role for r in roles] == ["champion", "challenger"]
    assert res.leaderboard.count() == 2
    with pytest.raises(TrainingAborted):
        train_all(spark, sess.limit(100), scratch_path(spark, "test-run-log2"), model_names=["LR_baseline"])


def test_train_all_with_overrides_logs_merged_params(spark):
    from intentlab.plans.training import train_all
    log = scratch_path(spark, "test-run-log-overrides")
    overrides = {
        "LR_baseline": {"C": 0.5},
        "_preprocessor": {"excluded_features": ["Technical"], "drop_duplicates": True},
        "_threshold": {"mode": "range", "lower": 0.2, "upper": 0.6},
    }
    res = train_all(spark, load_sessions(spark, SF_SMALL), log, overrides=overrides, model_names=["LR_baseline"])
    runs = registry.read_run_log(spark, log)
    lr = runs.where(F.col("run_name") == "LR_baseline").first()
    assert lr.params["C"] == "0.5" and lr.params["wdr_mode"] == "range" and lr.params["wdr_upper"] == "0.6"
    assert "Technical" in lr.params["excluded_features"]
    assert 0.0 <= lr.metrics["roc_auc"] <= 1.0 and "cv_roc_auc_std" in lr.metrics
    assert res.models["LR_baseline"].stages[-1].numFeatures < 77  # the Technical one-hot blocks are gone


def test_models_by_role(spark, data):
    """Published together, loaded with fallback, scored in one pass as each alone."""
    from intentlab.operators import roles
    train, test = data
    prepared = models.PreparedFolds(train)
    model_dir, path = scratch_path(spark, "role-models"), scratch_path(spark, "role-aliases")
    fitted = {}
    for name in ("DT_medium", "LR_baseline"):
        params = models.model_params()[name]
        fitted[name] = prepared.pipeline(name, params, prepared.fitted(name, params, [None])[None])
        fitted[name].write().overwrite().save(f"{model_dir}/{name}")
    with pytest.raises(LookupError):
        roles.load(spark, path)
    one = spark.createDataFrame([("champion", "LR_baseline", "LR_baseline")], "role string, model_type string, run_id string")
    two = one.unionAll(spark.createDataFrame([("challenger", "DT_medium", "DT_medium")], one.schema))
    assert [roles.publish(spark, path, r, model_dir) for r in (one, two, one)] == [1, 2, 3]
    alone, both = roles.load(spark, path), roles.load(spark, path, version=2)
    assert roles.chosen(alone, "challenger")[0] == "champion" and roles.chosen(both, "challenger")[0] == "challenger"
    got = roles.score_by_role(test, both).select("session_id", F.expr("scores['champion']").alias("a"), F.expr("scores['challenger']").alias("b"))
    for c, name in (("a", "LR_baseline"), ("b", "DT_medium")):
        want = models.score(fitted[name], test).select("session_id", "p")
        assert got.join(want, "session_id").where(F.abs(F.col(c) - F.col("p")) > 1e-12).count() == 0
    assert roles.compare(test, alone).where("challenger_intervene IS NOT NULL").count() == 0
    assert roles.compare(test, both).agg(F.sum("sessions")).first()[0] == test.count()
