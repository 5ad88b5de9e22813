"""Decisions over scores: flags, confidence, summaries (takes any DataFrame with p).

Flags and buckets use the unrounded p; histograms, sensitivity, box
statistics and the expected wasted-discount rate use p rounded to 4
places, as the scoring output does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from .ranking import exact_quantiles, row_number_by

# fixed values: the 19 thresholds of the sensitivity curve, 0.05 .. 0.95
SENSITIVITY_THRESHOLDS = [round(k * 0.05, 2) for k in range(1, 20)]


def with_decisions(df: DataFrame, p: str = "p", threshold: dict | None = None, model_name: str = "scorecard",
                   keep: list[str] | None = None) -> DataFrame:
    """M13 record per session: probabilities, class, flag, threshold, model, confidence.

    ``intervention_threshold`` reports ``lower`` in every mode, as the
    scoring service does.
    """
    t = {**S.SCORING_THRESHOLD, **(threshold or {})}
    pr, npr = C.complement_round(p)
    keep = keep if keep is not None else [S.KEY]
    return df.select(
        *keep,
        pr.alias("purchase_probability"),
        npr.alias("no_purchase_probability"),
        C.predicted_class(p).alias("prediction"),
        C.intervene(p, t["mode"], t["lower"], t["upper"]).alias("intervene"),
        F.lit(float(t["lower"])).alias("intervention_threshold"),
        F.lit(model_name).alias("model_name"),
        C.confidence_bucket(p).alias("confidence"),
    )


def batch_summary(decided: DataFrame, flag: str = "intervene") -> DataFrame:
    """Total, flagged count, flagged share rounded to 4 (null on an empty batch)."""
    return decided.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count(F.when(F.col(flag), 1)).alias("intervention_count"),
    ).select(
        "total_sessions",
        "intervention_count",
        F.round(F.try_divide(F.col("intervention_count").cast("double"), F.col("total_sessions")), 4).alias(
            "intervention_rate"
        ),
    )


def expected_wasted_rate(decided: DataFrame, prob: str = "purchase_probability", flag: str = "intervene") -> DataFrame:
    """A20 + A21: mean rounded p over flagged (0 when none) and over all.

    The rounded p has 4 places, so it is summed exactly as an integer
    count of ten-thousandths (no float drift over billions of rows).
    """
    p4 = F.round(F.col(prob) * 10000).cast("long")
    return decided.agg(
        F.sum(F.when(F.col(flag), p4)).alias("_sf"), F.count(F.when(F.col(flag), p4)).alias("_nf"),
        F.sum(p4).alias("_s"), F.count(p4).alias("_n"),
    ).select(
        F.coalesce(F.col("_sf").cast("double") / F.col("_nf") / 10000, F.lit(0.0)).alias("expected_wasted_rate"),
        (F.col("_s").cast("double") / F.col("_n") / 10000).alias("average_score"),
    )


def realised_wasted_rate(scored: DataFrame, p: str = "p", label: str = S.TARGET, threshold: dict | None = None,
                         by: list[str] | None = None) -> DataFrame:
    """Flagged-and-purchased / flagged (0 when none flagged), and the flagged count.

    Training default threshold: lower 0.30, upper 1.0.
    """
    t = {**S.TRAINING_THRESHOLD, **(threshold or {})}
    flag = C.intervene(p, t["mode"], t["lower"], t["upper"])
    lab = F.col(label).cast("int") == 1
    g = scored.groupBy(*(by or []))
    return g.agg(
        F.count(F.when(flag, 1)).alias("intervention_count"),
        F.count(F.when(flag & lab, 1)).alias("_wasted"),
    ).select(
        *(by or []),
        F.coalesce(F.try_divide(F.col("_wasted").cast("double"), F.col("intervention_count")), F.lit(0.0)).alias(
            "wasted_discount_rate"
        ),
        "intervention_count",
    )


def score_histogram(decided: DataFrame, prob: str = "purchase_probability", flag: str = "intervene",
                    bins: int = 20) -> DataFrame:
    """Counts of rounded p in fixed bins [k/bins, (k+1)/bins) per status; last bin closed."""
    b = F.least(F.floor(F.col(prob) * bins).cast("int"), F.lit(bins - 1))
    return (
        decided.where(F.col(prob).isNotNull())
        .groupBy(b.alias("bin"), C.status_label(flag).alias("status"))
        .agg(F.count(F.lit(1)).alias("sessions"))
        .select(
            "bin",
            (F.col("bin") / F.lit(float(bins))).alias("bin_lo"),
            ((F.col("bin") + 1) / F.lit(float(bins))).alias("bin_hi"),
            "status",
            "sessions",
        )
    )


def threshold_sensitivity(decided: DataFrame, prob: str = "purchase_probability",
                          thresholds: list[float] | None = None) -> DataFrame:
    """A16 (and the J6 nested loop): share in percent of rounded p < t, per threshold.

    One scan with one conditional count per threshold (map-side partial
    aggregation); the wide row is then unpivoted to one row per threshold.
    """
    ts = thresholds or SENSITIVITY_THRESHOLDS
    p4 = F.col(prob)
    wide = decided.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(p4 < F.lit(t), 1)).alias(f"_c{i}") for i, t in enumerate(ts)],
    )
    stack = "stack({}, {}) as (threshold, _cnt)".format(
        len(ts), ", ".join(f"CAST({t!r} AS DOUBLE), _c{i}" for i, t in enumerate(ts))
    )
    return wide.selectExpr("_n", stack).select(
        "threshold", (F.try_divide(F.col("_cnt").cast("double"), F.col("_n")) * 100).alias("intervention_rate_pct")
    )


def thresholds_per_session(decided: DataFrame, prob: str = "purchase_probability",
                           thresholds: list[float] | None = None) -> DataFrame:
    """J6 per row: at how many of the thresholds, and from which one on, a session is flagged."""
    ts = thresholds or SENSITIVITY_THRESHOLDS
    arr = F.array(*[F.lit(t) for t in ts])
    flagged_at = F.filter(arr, lambda t: F.col(prob) < t)
    return decided.select(
        S.KEY,
        prob,
        F.size(flagged_at).cast("long").alias("flagged_thresholds"),
        F.array_min(flagged_at).alias("first_flag_threshold"),
    )


def confidence_breakdown(decided: DataFrame, conf: str = "confidence") -> DataFrame:
    """Sessions per confidence bucket, most first."""
    return decided.groupBy(conf).agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("sessions"), conf)


def score_box_stats(decided: DataFrame, prob: str = "purchase_probability", cls: str = "prediction") -> DataFrame:
    """Exact quartiles, min and max of rounded p per predicted class."""
    long = decided.select(C.prediction_label(cls).alias("predicted_class"), F.col(prob).alias("_v"))
    # rounded p lies in [0, 1]: 1024 fixed-width bins are monotone in it and hold
    # at most ~10 distinct 4-place values each, so no quantile pass is needed
    fixed_bins = F.least(F.greatest(F.floor(F.col("_v") * 1024), F.lit(0)), F.lit(1023)).cast("int")
    q = exact_quantiles(long, "predicted_class", "_v", (0.25, 0.5, 0.75), midpoint="interpolate", bucket=fixed_bins)
    return q.select(
        "predicted_class",
        F.col("n").alias("sessions"),
        F.col("v_min").alias("p_min"),
        F.col("q_0").alias("p_q1"),
        F.col("q_1").alias("p_median"),
        F.col("q_2").alias("p_q3"),
        F.col("v_max").alias("p_max"),
    )


def session_numbers(decided: DataFrame, key: str = S.KEY) -> DataFrame:
    """1-based number of each result row in key order (distributed row number)."""
    return row_number_by(decided, [key], out="session_number")


def result_table(decided: DataFrame) -> DataFrame:
    """P15 + W4: the displayed results table with text columns."""
    numbered = session_numbers(decided)
    return numbered.select(
        "session_number",
        S.KEY,
        C.percent_text("purchase_probability").alias("purchase_prob_text"),
        C.percent_text("no_purchase_probability").alias("no_purchase_prob_text"),
        C.prediction_label("prediction").alias("prediction_label"),
        F.when(F.col("intervene"), F.lit("YES")).otherwise(F.lit("No")).alias("intervene_text"),
        "confidence",
    )
