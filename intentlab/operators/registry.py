"""Run log, versions and the champion/challenger ranking.

A run is one evaluated model. The run log is an append-only table
``(run_id, run_name, started_at, params MAP<STRING,STRING>,
metrics MAP<STRING,DOUBLE>, artifacts MAP<STRING,STRING>)`` whose appends are committed as versions
(``sources.versioned``); versions number the model runs in the order of their commits, so
a number never changes later. Ranking is
a query over all runs ever logged, not stored state. The run log grows
with the number of trainings, not with the session data, so its windows
are small; the per-run work (scoring and metrics) is where data size
matters and runs as grouped aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C
from ..sources import versioned
from . import metrics
from .decide import realised_wasted_rate

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("run_name", T.StringType(), True),
    T.StructField("started_at", T.TimestampType(), True),
    T.StructField("params", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), True),
])

#: artifacts are texts: importances (JSON), data_rows and data_hash of the training input
STORED_SCHEMA = T.StructType([*RUN_LOG_SCHEMA.fields, T.StructField("artifacts", T.MapType(T.StringType(), T.StringType()), True)])

METRIC_NAMES = ["roc_auc", "accuracy", "precision", "recall", "f1", "wasted_discount_rate",
                "intervention_count", "cv_roc_auc_mean", "cv_roc_auc_std"]
PARAM_NAMES = ["model_type", "wdr_mode", "wdr_lower", "wdr_upper", "fold"]

# Scorecard variants evaluated as models: name -> excluded features.
SCORECARD_VARIANTS = {
    "scorecard": (),
    "scorecard_no_engagement": ("BounceRates", "ExitRates", "PageValues"),
    "scorecard_no_visitor": ("VisitorType",),
}


def variant_scores(df: DataFrame, variants: dict | None = None) -> DataFrame:
    """Long form (key, label, fold, model_type, p): every session under every variant."""
    vs = variants or SCORECARD_VARIANTS
    arr = F.array(*[F.struct(F.lit(name).alias("model_type"), C.scorecard(excluded=tuple(ex)).alias("p"))
                    for name, ex in vs.items()])
    return df.select(S.KEY, "label", "fold", F.explode(arr).alias("v")).select(
        S.KEY, "label", "fold", "v.model_type", "v.p")


def evaluation_runs(split_df: DataFrame, variants: dict | None = None, threshold: dict | None = None) -> DataFrame:
    """Runs derived from the data: each scorecard variant evaluated on each
    training fold (grouped aggregations over all sessions).

    Flat layout: run_id, model_type, fold, metrics columns, wdr params.
    """
    t = {**S.TRAINING_THRESHOLD, **(threshold or {})}
    long = variant_scores(split_df.where(F.col("fold").isNotNull()), variants).withColumn(
        "prediction", C.predicted_class("p"))
    by = ["model_type", "fold"]
    cls = metrics.classification_metrics(long, "label", "prediction", by=by)
    auc = metrics.roc_auc(long, "label", "p", by=by).select(*by, "roc_auc")
    wdr = realised_wasted_rate(long, "p", "label", t, by=by)
    runs = cls.join(auc, by).join(wdr, by)
    return runs.select(
        F.md5(F.concat_ws(":", "model_type", F.col("fold").cast("string"))).alias("run_id"),
        "model_type", "fold", "roc_auc", "accuracy", "precision", "recall", "f1",
        "wasted_discount_rate", F.col("intervention_count").cast("double").alias("intervention_count"),
        F.lit(t["mode"]).alias("wdr_mode"), F.lit(float(t["lower"])).alias("wdr_lower"),
        F.lit(float(t["upper"])).alias("wdr_upper"),
    )


def to_run_log(flat: DataFrame, started_at=None) -> DataFrame:
    """S5 layout: params and metrics as maps (absent metrics are left out)."""
    present_m = [m for m in METRIC_NAMES if m in flat.columns]
    present_p = [p for p in PARAM_NAMES if p in flat.columns]
    metric_map = F.map_filter(
        F.create_map(*[x for m in present_m for x in (F.lit(m), F.col(m).cast("double"))]), lambda k, v: v.isNotNull())
    param_map = F.map_filter(
        F.create_map(*[x for p in present_p for x in (F.lit(p), F.col(p).cast("string"))]), lambda k, v: v.isNotNull())
    ts = started_at if started_at is not None else F.current_timestamp()
    return flat.select(
        F.col("run_id"),
        F.coalesce(F.col("model_type"), F.lit("data_validation")).alias("run_name"),
        ts.alias("started_at"),
        param_map.alias("params"),
        metric_map.alias("metrics"),
    )


def append_runs(run_log: DataFrame, path: str) -> int:
    """Appends runs to the log as one commit; returns its number."""
    none = F.lit(None).cast(STORED_SCHEMA["artifacts"].dataType)
    full = run_log if "artifacts" in run_log.columns else run_log.withColumn("artifacts", none)
    return versioned.append(full.select(*STORED_SCHEMA.fieldNames()), path)


def read_run_log(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """The committed runs (up to commit ``as_of``), with the number of their commit."""
    return versioned.read(spark, path, STORED_SCHEMA, as_of)


def model_runs(run_log: DataFrame) -> DataFrame:
    """Runs with a non-empty model_type and a roc_auc, flattened."""
    p, m = F.col("params"), F.col("metrics")
    mt = F.element_at(p, F.lit("model_type"))
    auc = F.element_at(m, F.lit("roc_auc"))
    return run_log.where(mt.isNotNull() & (mt != "") & auc.isNotNull()).select(
        "run_id", "run_name", "started_at",
        mt.alias("model_type"),
        auc.alias("roc_auc"),
        *[F.element_at(m, F.lit(k)).alias(k) for k in METRIC_NAMES if k != "roc_auc"],
        F.element_at(p, F.lit("wdr_mode")).alias("wdr_mode"),
        F.element_at(p, F.lit("wdr_lower")).cast("double").alias("wdr_lower"),
        F.element_at(p, F.lit("wdr_upper")).cast("double").alias("wdr_upper"),
        F.element_at(p, F.lit("fold")).cast("int").alias("fold"),
        *[F.col(c) for c in ("artifacts", versioned.VERSION) if c in run_log.columns],
    )


def number_versions(runs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Registry versions (1, 2, ...) in registration order: (version, run_id).

    Runs of a log are numbered by commit, then id: a later append only adds numbers.
    """
    o = order or [versioned.VERSION if versioned.VERSION in runs.columns else "started_at", "run_id"]
    w = Window.orderBy(*[F.col(c) for c in o])  # run-log sized, not data sized
    return runs.select(F.row_number().over(w).cast("int").alias("version"), "run_id")


def versions_join_runs(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Per version its run's roc_auc and model_type; versions without a
    run or an AUC drop out (inner join)."""
    r = runs.select("run_id", "model_type", "roc_auc").where(F.col("roc_auc").isNotNull())
    return versions.join(r, "run_id", "inner").select("version", "run_id", "model_type", "roc_auc")


def champion_challenger(version_aucs: DataFrame) -> DataFrame:
    """O1: the top two versions by AUC (ties: lower version first); #1 champion, #2 challenger."""
    top = version_aucs.orderBy(F.desc("roc_auc"), F.asc("version")).limit(2)
    w = Window.orderBy(F.desc("roc_auc"), F.asc("version"))  # two rows
    return top.withColumn("_r", F.row_number().over(w)).select(
        F.when(F.col("_r") == 1, F.lit("champion")).otherwise(F.lit("challenger")).alias("role"),
        "version", "run_id", "model_type", "roc_auc",
    )


def run_history(runs: DataFrame) -> DataFrame:
    """Per model type the run count, best AUC and its run (ties: smallest run_id)."""
    r = runs.where(F.col("model_type").isNotNull() & (F.col("model_type") != "") & F.col("roc_auc").isNotNull())
    best = F.min(F.struct((-F.col("roc_auc")).alias("neg_auc"), F.col("run_id").alias("run_id")))
    return (
        r.groupBy("model_type")
        .agg(F.count(F.lit(1)).alias("run_count"), F.max("roc_auc").alias("best_roc_auc"), best.alias("_b"))
        .select("model_type", "run_count", "best_roc_auc", F.col("_b.run_id").alias("best_run_id"))
        .orderBy(F.desc("best_roc_auc"), "model_type")
    )


def run_leaderboard(session_runs: DataFrame, roles: DataFrame) -> DataFrame:
    """O2: one training session's models by AUC, marked if they are the global champion/challenger."""
    return (
        session_runs.select("run_id", "model_type", "roc_auc")
        .join(F.broadcast(roles.select("run_id", "role")), "run_id", "left")
        .orderBy(F.desc("roc_auc"), "model_type")
    )


def alias_details(roles: DataFrame, runs: DataFrame, live_threshold: dict | None = None) -> DataFrame:
    """J2 + P16: champion/challenger with their run metrics (null when missing)
    and the threshold text and wasted-discount label shown beside them."""
    live = {**S.SCORING_THRESHOLD, **(live_threshold or {})}
    r = runs.select("run_id", "f1", "precision", "wasted_discount_rate", "intervention_count",
                    "wdr_mode", "wdr_lower", "wdr_upper")
    j = roles.join(r, "run_id", "left")
    return j.select(
        "role", "version", "run_id", F.coalesce(F.col("model_type"), F.lit("—")).alias("model_name"),
        F.coalesce(F.col("roc_auc"), F.lit(0.0)).alias("roc_auc"),
        "f1", "precision", "wasted_discount_rate", "intervention_count",
        C.threshold_text("wdr_mode", "wdr_lower", "wdr_upper", F.lit(live["mode"]), F.lit(float(live["lower"])),
                         F.lit(float(live["upper"]))).alias("threshold_text"),
        C.wdr_label("wdr_mode", "wdr_lower", "wdr_upper").alias("wdr_label"),
    )


def compare_decisions(scores: DataFrame, roles: DataFrame, threshold: dict | None = None,
                      score_map: str = "scores") -> DataFrame:
    """The same sessions under champion and challenger; counts per decision pair.

    ``scores`` holds one row per session with a ``map<model_type, p>`` of
    every candidate's score; the roles become a one-row frame (champion and
    challenger model types) attached to every row, so each session picks
    its two scores in place: no shuffle by session, only the final tiny
    aggregation. Without a challenger its decision is null.
    """
    t = {**S.SCORING_THRESHOLD, **(threshold or {})}
    picked = roles.agg(
        F.max(F.when(F.col("role") == "champion", F.col("model_type"))).alias("_champ"),
        F.max(F.when(F.col("role") == "challenger", F.col("model_type"))).alias("_chal"),
    )
    j = scores.join(F.broadcast(picked), how="left_outer", on=F.lit(True))
    pc = F.element_at(F.col(score_map), F.col("_champ"))
    pl = F.element_at(F.col(score_map), F.col("_chal"))
    return j.groupBy(
        C.intervene(pc, t["mode"], t["lower"], t["upper"]).alias("champion_intervene"),
        C.intervene(pl, t["mode"], t["lower"], t["upper"]).alias("challenger_intervene"),
    ).agg(F.count(F.lit(1)).alias("sessions"))


def variant_score_map(df: DataFrame, variants: dict | None = None) -> DataFrame:
    """Key + ``scores`` map of every scorecard variant's p (one row per session)."""
    vs = variants or SCORECARD_VARIANTS
    m = F.create_map(*[x for name, ex in vs.items() for x in (F.lit(name), C.scorecard(excluded=tuple(ex)))])
    return df.select(S.KEY, m.alias("scores"))


# --- threshold configuration (S9) --------------------------------------------------------

THRESHOLD_SCHEMA = "mode string, lower double, upper double, valid_from long"


def write_threshold(spark: SparkSession, path: str, mode: str, lower: float, upper: float, valid_from: int = 0) -> int:
    """Appends (mode, lower, upper) as a dated row, valid from micro-batch ``valid_from`` on; returns its version.

    Rows are never overwritten, so a reader sees the old row or the new one.
    """
    row = spark.createDataFrame([(mode, float(lower), float(upper), int(valid_from))], THRESHOLD_SCHEMA)
    return versioned.append(row.coalesce(1), path)


def read_threshold(spark: SparkSession, path: str) -> dict:
    """The newest config (mode, lower, upper); scoring defaults when nothing is stored."""
    return {k: v for k, v in valid_threshold(spark, path).items() if k != "version"}


def valid_threshold(spark: SparkSession, path: str, batch: int | None = None, version: int | None = None) -> dict:
    """The row valid at ``batch`` (the newest of all, if None), with its version.

    Valid is the row of largest ``valid_from`` up to the batch; of several, the latest appended. ``version`` reads one version
    whatever came later. Scoring defaults, as version 0, when nothing is valid. A damaged table raises.
    """
    rows = versioned.read(spark, path, THRESHOLD_SCHEMA, version)
    if version is not None:
        rows = rows.where(F.col(versioned.VERSION) == version)
    elif batch is not None:
        rows = rows.where(F.col("valid_from") <= batch)
    order = [versioned.VERSION] if batch is None else ["valid_from", versioned.VERSION]
    row = rows.orderBy(*[F.desc(c) for c in order]).first()
    if row is None:
        return {**S.SCORING_THRESHOLD, "version": 0}
    return {"mode": row["mode"], "lower": row["lower"], "upper": row["upper"], "version": row[versioned.VERSION]}
