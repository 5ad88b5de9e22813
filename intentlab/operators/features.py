"""Exact preprocessing estimators (M1-M5).

Spark ML's ``Imputer`` takes an approximate median and ``StandardScaler``
the sample standard deviation; the semantics here are the exact median
(mean of the two middle values) or mean, the population standard
deviation (zero -> 1), and the most frequent category with ties going to
the smallest value. Fitting is distributed (one counting pass per
statistic, no values collected); only the fitted numbers (one per column)
reach the driver, as for any Spark ML model.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from . import selection


def numeric_fill_values(df: DataFrame, cols: list[str], strategy: str = "median") -> dict[str, float]:
    """M1: exact median (or mean) per column over non-null values."""
    if strategy == "mean":
        row = df.agg(*[F.avg(C.nan_to_null(F.col(c).cast("double"))).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy != "median":
        raise ValueError(f"unknown strategy {strategy!r}")
    return selection.medians(df, cols)


def mean_and_scale(df: DataFrame, cols: list[str], fills: dict[str, float]) -> tuple[dict, dict]:
    """M3: mean and population std of the imputed columns (std 0 -> 1), one pass."""
    imputed = {c: F.coalesce(C.nan_to_null(F.col(c).cast("double")), F.lit(fills[c])) for c in cols}
    aggs = []
    for c in cols:
        aggs.append(F.avg(imputed[c]).alias(f"m_{c}"))
        aggs.append(F.stddev_pop(imputed[c]).alias(f"s_{c}"))
    row = df.agg(*aggs).first()
    means = {c: row[f"m_{c}"] for c in cols}
    scales = {c: (row[f"s_{c}"] if row[f"s_{c}"] not in (None, 0.0) else 1.0) for c in cols}
    return means, scales


def categorical_text(col: str) -> F.Column:
    """Category text of a column: Weekend as "True"/"False"/"nan", codes as digits."""
    if col == "Weekend":
        return C.weekend_to_text(col)
    return F.col(col).cast("string")


def mode_values(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """M2: most frequent value per column; ties -> smallest (numeric order for codes).

    One aggregation over (feature, value) pairs; the per-feature pick is a
    min over a struct (-count, numeric value, text), so no sort.
    """
    parts = []
    for c in cols:
        num = f"`{c}`" if c in S.INTEGER_COLUMNS else "NULL"
        text = "coalesce(initcap(CAST(`Weekend` AS STRING)), 'nan')" if c == "Weekend" else f"CAST(`{c}` AS STRING)"
        parts.append(f"'{c}', {text}, CAST({num} AS DOUBLE)")
    stack = "stack({}, {}) as (feature, value, num)".format(len(cols), ", ".join(parts))
    long = df.selectExpr(stack).where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value", "num").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("num"), F.col("value"))).alias("b")
    )
    got = {r["feature"]: r["b"]["value"] for r in best.collect()}  # one row per column
    return {c: got.get(c) for c in cols}


class _Fitted(Params):
    fills = Param(Params._dummy(), "fills", "fill value per input column", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean per input column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "scale per input column", TypeConverters.toListFloat)


class ExactScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M1 + M3: impute numeric columns (exact median/mean), then standardise (population std)."""

    strategy = Param(Params._dummy(), "strategy", "median or mean", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, strategy="median"):
        super().__init__()
        self._setDefault(strategy="median")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ExactScalerModel":
        cols = self.getInputCols()
        fills = numeric_fill_values(df, cols, self.getOrDefault(self.strategy))
        means, scales = mean_and_scale(df, cols, fills)
        return ExactScalerModel(
            inputCols=cols, outputCols=self.getOutputCols(),
            fills=[fills[c] if fills[c] is not None else 0.0 for c in cols],
            means=[means[c] if means[c] is not None else 0.0 for c in cols],
            scales=[scales[c] for c in cols],
        )


class ExactScalerModel(Model, HasInputCols, HasOutputCols, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, fills=None, means=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, outs = self.getInputCols(), self.getOutputCols()
        fills, means, scales = (self.getOrDefault(p) for p in (self.fills, self.means, self.scales))
        new = {
            o: (F.coalesce(C.nan_to_null(F.col(c).cast("double")), F.lit(f)) - F.lit(m)) / F.lit(s)
            for c, o, f, m, s in zip(cols, outs, fills, means, scales)
        }
        return df.withColumns(new)

    def statistics(self, spark) -> DataFrame:
        rows = list(zip(self.getInputCols(), *(self.getOrDefault(p) for p in (self.fills, self.means, self.scales))))
        return spark.createDataFrame(rows, "feature string, fill double, mean double, scale double")


class ModeImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M2: categorical texts with nulls replaced by the training mode."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        cols = self.getInputCols()
        modes = mode_values(df, cols)
        return ModeImputerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                modes=[modes[c] if modes[c] is not None else "" for c in cols])


class ModeImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    modes = Param(Params._dummy(), "modes", "mode per input column", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, modes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, outs, modes = self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.modes)
        return df.withColumns({o: F.coalesce(categorical_text(c), F.lit(m)) for c, o, m in zip(cols, outs, modes)})


def build_preprocessor(numeric_imputer_strategy: str = "median", excluded_features: list[str] | None = None,
                       features_col: str = "features") -> Pipeline:
    """M5: numeric block (impute + scale) then categorical block (mode + one-hot), others dropped.

    One-hot: ``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder(dropLast)``:
    the dropped last slot is the unknown one, so unseen categories encode
    as all zeros. No category is dropped otherwise.
    """
    from .prepare import active_features
    num, cat = active_features(excluded_features)
    stages = []
    num_out = [f"_num_{c}" for c in num]
    if num:
        stages.append(ExactScaler(inputCols=num, outputCols=num_out, strategy=numeric_imputer_strategy))
    cat_txt = [f"_cat_{c}" for c in cat]
    cat_idx = [f"_idx_{c}" for c in cat]
    cat_vec = [f"{c}" + "_oh" for c in cat]
    if cat:
        stages.append(ModeImputer(inputCols=cat, outputCols=cat_txt))
        stages.append(StringIndexer(inputCols=cat_txt, outputCols=cat_idx, stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=cat_idx, outputCols=cat_vec, dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=num_out + cat_vec, outputCol=features_col, handleInvalid="keep"))
    return Pipeline(stages=stages)


def feature_names(df: DataFrame, features_col: str = "features") -> list[str]:
    """Names of the assembled vector slots, in slot order (numeric, then one-hot)."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    names = [None] * meta.get("num_attrs", len(attrs))
    for a in attrs:
        n = a.get("name", str(a["idx"]))
        names[a["idx"]] = n.replace("_num_", "", 1) if n.startswith("_num_") else n
    return names
