"""Classifiers, class weights, cross-validation, hold-out evaluation.

Four model families with the reference's default hyperparameters, as
estimators behind the exact preprocessing, which every fold's complement fits
anew: from one cube of fold statistics (``foldcube``), with the features of a complement
written once for all models. The tree has exact splits (``exacttree``), boosting is
second-order over histograms (``boosting``), the forest has binned splits (``forest``);
all grow all complements in the same jobs, over the same kind of blocks (``blocks``).
"""

from __future__ import annotations

import copy
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..config import materialize
from . import blocks, foldcube, metrics
from .boosting import SecondOrderBooster
from .exacttree import ExactTree
from .features import build_preprocessor, feature_names
from .forest import Forest

MODEL_NAMES = list(S.MODEL_DEFAULTS)


def model_params(overrides: dict | None = None) -> dict[str, dict]:
    """Per-model hyperparameters, overrides over defaults (last wins)."""
    overrides = overrides or {}
    out = {}
    for name, defaults in S.MODEL_DEFAULTS.items():
        p = dict(defaults)
        p.update({k: v for k, v in overrides.get(name, {}).items() if k in defaults})
        out[name] = p
    return out


def preprocessor_options(overrides: dict | None = None) -> dict:
    """The ``_preprocessor`` section (imputer strategy, exclusions, de-duplication)."""
    pre = (overrides or {}).get("_preprocessor", {})
    return {
        "numeric_imputer_strategy": pre.get("numeric_imputer_strategy", "median"),
        "excluded_features": list(pre.get("excluded_features", [])),
        "drop_duplicates": bool(pre.get("drop_duplicates", False)),
    }


def threshold_options(overrides: dict | None = None) -> dict:
    """The ``_threshold`` section; training defaults lower .30, upper 1.0."""
    t = (overrides or {}).get("_threshold", {})
    return {k: t.get(k, v) for k, v in S.TRAINING_THRESHOLD.items()}


class ClassWeighter(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A30 as a pipeline stage: ``balanced`` (n / (2 n_c), from the fit data) or
    ``positive`` (a fixed weight for the positive class)."""

    mode = Param(Params._dummy(), "mode", "balanced or positive", TypeConverters.toString)
    positiveWeight = Param(Params._dummy(), "positiveWeight", "weight of positives", TypeConverters.toFloat)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "output weight column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, mode="balanced", positiveWeight=1.0, labelCol="label", weightCol="weight"):
        super().__init__()
        self._setDefault(mode="balanced", positiveWeight=1.0, labelCol="label", weightCol="weight")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ClassWeighterModel":
        lab = self.getOrDefault(self.labelCol)
        if self.getOrDefault(self.mode) == "positive":
            w0, w1 = 1.0, float(self.getOrDefault(self.positiveWeight))
        else:
            row = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(lab) == 1, 1)).alias("n1")).first()
            n, n1 = row["n"], row["n1"]
            n0 = n - n1
            w0 = n / (2.0 * n0) if n0 else 1.0
            w1 = n / (2.0 * n1) if n1 else 1.0
        return ClassWeighterModel(labelCol=lab, weightCol=self.getOrDefault(self.weightCol), weight0=w0, weight1=w1)


class ClassWeighterModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "output weight column", TypeConverters.toString)
    weight0 = Param(Params._dummy(), "weight0", "weight of class 0", TypeConverters.toFloat)
    weight1 = Param(Params._dummy(), "weight1", "weight of class 1", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, labelCol="label", weightCol="weight", weight0=1.0, weight1=1.0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        lab, wc = self.getOrDefault(self.labelCol), self.getOrDefault(self.weightCol)
        w0, w1 = self.getOrDefault(self.weight0), self.getOrDefault(self.weight1)
        if lab not in df.columns:
            return df.withColumn(wc, F.lit(1.0))
        return df.withColumn(wc, F.when(F.col(lab) == 1, F.lit(w1)).otherwise(F.lit(w0)))


class PenalisedLogistic(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """M6: L2 logistic regression with sklearn's C: regParam = 1 / (C * sum of weights).

    sklearn minimises C * sum(w * loss) + |b|^2 / 2; Spark minimises
    sum(w * loss) / sum(w) + regParam * |b|^2 / 2. Features are already
    standardised, so Spark's own standardisation is off. Features are written
    once before the solver, which reads them twice and would derive them each time;
    ``written`` says that they come from a written table already.
    """

    C = Param(Params._dummy(), "C", "inverse regularisation strength", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    written = Param(Params._dummy(), "written", "the rows are a written table", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, C=1.0, maxIter=1000, written=False):
        super().__init__()
        self._setDefault(C=1.0, maxIter=1000, written=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        if not self.getOrDefault(self.written):
            df = materialize(df.select("features", "label", "weight"), "logistic-rows")
        total_w = df.agg(F.sum("weight")).first()[0] or 1.0
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                maxIter=self.getOrDefault(self.maxIter), elasticNetParam=0.0,
                                regParam=1.0 / (self.getOrDefault(self.C) * total_w), standardization=False,
                                tol=1e-6)
        return lr.fit(df)


MAX_DEPTH = 30  # as in Spark ML's trees


def build_classifier(name: str, params: dict, seed: int = S.RANDOM_STATE):
    """M6-M9: the estimator for a model name with its (merged) parameters."""
    if name == "LR_baseline":
        return PenalisedLogistic(C=float(params["C"]))
    if name == "DT_medium":
        return ExactTree(depth=int(params["max_depth"]), minLeaf=int(params["min_samples_leaf"]), criterion=str(params["criterion"]))
    if name == "RF_baseline":
        if int(params["max_depth"]) > MAX_DEPTH:
            raise ValueError(f"max_depth {params['max_depth']} is above the limit of {MAX_DEPTH}")
        return Forest(trees=int(params["n_estimators"]), depth=int(params["max_depth"]), nodeColumns=str(params["max_features"]), seed=seed)
    if name == "XGBoost":
        return SecondOrderBooster(rounds=int(params["n_estimators"]), rate=float(params["learning_rate"]), depth=int(params["max_depth"]),
                                  rowShare=float(params["subsample"]), columnShare=float(params["colsample_bytree"]), seed=seed)
    raise ValueError(f"unknown model {name!r}")


def build_pipeline(name: str, params: dict, preprocessing: dict | None = None) -> Pipeline:
    """Preprocessing + class weights + classifier as one Pipeline."""
    pre = preprocessing or {}
    prep = build_preprocessor(pre.get("numeric_imputer_strategy", "median"), pre.get("excluded_features"))
    if name == "XGBoost":
        weighter = ClassWeighter(mode="positive", positiveWeight=float(params.get("scale_pos_weight", 5)))
    else:
        weighter = ClassWeighter(mode="balanced")
    return Pipeline(stages=[*prep.getStages(), weighter, build_classifier(name, params)])


def positive_probability(df: DataFrame, prob_col: str = "probability", out: str = "p") -> DataFrame:
    """Probability of class 1 from the model's probability vector."""
    return df.withColumn(out, vector_to_array(F.col(prob_col))[1])


def score(model: Model, df: DataFrame) -> DataFrame:
    """Model output with ``p`` (class-1 probability) and integer ``prediction``."""
    out = positive_probability(model.transform(df))
    return out.withColumn("prediction", F.col("prediction").cast("int"))


class PreparedFolds:
    """The training part with the features of every fold's complement, and of all rows, fitted from one fold cube.

    Each complement's features are written once (key, label, fold, features of every training row)
    and read by all models.
    """

    def __init__(self, train: DataFrame, preprocessing: dict | None = None, fold_col: str = "fold", label: str = "label"):
        pre = preprocessing or {}
        self.fold_col, self.label = fold_col, label
        self.cube = foldcube.measure(train, fold_col, label, pre.get("numeric_imputer_strategy", "median"), pre.get("excluded_features"))
        self.statistics = {k: self.cube.statistics(k) for k in self.cube.complements()}
        self.preprocessors = {k: foldcube.preprocessor(self.cube, train, k) for k in self.cube.complements()}
        kept = [c for c in (S.KEY, label, fold_col) if c in train.columns]

        def write(k):
            return materialize(self.preprocessors[k].transform(train).select(*kept, "features"), "fold-features")
        with ThreadPoolExecutor(max_workers=len(self.preprocessors)) as pool:
            self.tables = dict(zip(self.preprocessors, pool.map(write, self.preprocessors)))
        self._summaries, self._summarising = {}, Lock()

    def summaries(self, left_out: list) -> dict:
        """By number the column summaries of the sets that leave out these folds, taken once for all models (``blocks.summarise``)."""
        key = tuple(left_out)
        with self._summarising:
            if key not in self._summaries:
                self._summaries[key] = blocks.summarise([self._kept(self.tables[k], k) for k in left_out], label=self.label)
            return self._summaries[key]

    def _kept(self, rows: DataFrame, k) -> DataFrame:
        return rows if k is None else rows.where(F.col(self.fold_col) != k)

    def weighter(self, k, name: str, params: dict) -> "ClassWeighterModel":
        w0, w1 = self.statistics[k].class_weights()
        if name == "XGBoost":
            w0, w1 = 1.0, float(params.get("scale_pos_weight", 5))
        return ClassWeighterModel(labelCol=self.label, weightCol="weight", weight0=w0, weight1=w1)

    def fitted(self, name: str, params: dict, left_out: list, parallelism: int | None = None) -> dict:
        """Per left-out fold (``None``: nothing) the classifier fitted on the rest."""
        sets = []
        for k in left_out:
            sets.append(self._kept(self.weighter(k, name, params).transform(self.tables[k]), k))
        classifier = build_classifier(name, params)
        if isinstance(classifier, PenalisedLogistic):
            classifier.set(classifier.written, True)
        if hasattr(classifier, "fit_many"):  # grown in the same jobs
            weights = [(w.getOrDefault(w.weight0), w.getOrDefault(w.weight1)) for w in (self.weighter(k, name, params) for k in left_out)]
            summaries = {i: blocks.with_class_weights(s, weights[i]) for i, s in self.summaries(left_out).items()}
            return dict(zip(left_out, classifier.fit_many(sets, summaries)))
        # each fit is a distributed job of its own; submitted together, their tasks interleave
        with ThreadPoolExecutor(max_workers=max(1, parallelism or len(sets))) as pool:
            return dict(zip(left_out, pool.map(classifier.fit, sets)))

    def pipeline(self, name: str, params: dict, classifier: Model, k=None) -> PipelineModel:
        return PipelineModel([*self.preprocessors[k].stages, self.weighter(k, name, params), classifier])

    def held_out_auc(self, models: dict) -> DataFrame:
        """(fold, auc) of the left-out folds, each scored by the model that has not seen it."""
        out = None
        for k, model in models.items():
            rows = score(model, self.tables[k].where(F.col(self.fold_col) == k)).select(
                F.lit(k).cast("int").alias("fold"), F.col(self.label).alias("label"), "p")
            out = rows if out is None else out.unionByName(rows)
        auc = metrics.roc_auc(materialize(out, "held-out-scores"), "label", "p", by=["fold"])
        return auc.select("fold", F.col("roc_auc").alias("auc"))


def cross_validate(name: str, params: dict, train: DataFrame, preprocessing: dict | None = None,
                   fold_col: str = "fold", parallelism: int | None = None, prepared: PreparedFolds | None = None) -> DataFrame:
    """AUC of each fold, preprocessing and classifier refitted on the other folds.

    ``prepared`` shares the features among models. Returns a (fold, auc) frame for ``metrics.cv_summary``.
    """
    prepared = prepared or PreparedFolds(train, preprocessing, fold_col)
    return prepared.held_out_auc(prepared.fitted(name, params, prepared.cube.folds, parallelism))


def evaluate_holdout(scored_test: DataFrame, threshold: dict | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1, exact ROC AUC, confusion counts and
    the realised wasted-discount rate, as one row.

    The confusion counts and the flagged counts come from ONE aggregation
    over the scored rows; the AUC is the only other (ordered) pass.
    """
    t = {**S.TRAINING_THRESHOLD, **(threshold or {})}
    y, yh = F.col("label"), F.col("prediction")
    flag = C.intervene("p", t["mode"], t["lower"], t["upper"])
    counts = scored_test.agg(
        F.count(F.when((y == 0) & (yh == 0), 1)).alias("true_negatives"),
        F.count(F.when((y == 0) & (yh == 1), 1)).alias("false_positives"),
        F.count(F.when((y == 1) & (yh == 0), 1)).alias("false_negatives"),
        F.count(F.when((y == 1) & (yh == 1), 1)).alias("true_positives"),
        F.count(F.when(flag, 1)).alias("intervention_count"),
        F.count(F.when(flag & (y == 1), 1)).alias("_wasted"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    ratio = metrics._ratio
    row = counts.select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "true_negatives", "false_positives", "false_negatives", "true_positives",
        ratio(F.col("_wasted"), F.col("intervention_count")).alias("wasted_discount_rate"),
        "intervention_count",
    )
    auc = metrics.roc_auc(scored_test, "label", "p").select("roc_auc")
    return row.join(auc, how="left_outer", on=F.lit(True))


def feature_importance(model: PipelineModel, scored: DataFrame) -> DataFrame | None:
    """M12 + J4: (feature, importance) for tree models, names from the vector metadata."""
    clf = model.stages[-1]
    if not hasattr(clf, "featureImportances"):
        return None
    names = feature_names(scored)
    imp = clf.featureImportances.toArray().tolist()
    spark = scored.sparkSession
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")


def merged_overrides(base: dict | None, extra: dict | None) -> dict:
    out = copy.deepcopy(base or {})
    for k, v in (extra or {}).items():
        if isinstance(v, dict):
            out.setdefault(k, {}).update(v)
        else:
            out[k] = v
    return out
