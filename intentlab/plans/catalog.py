"""Registered queries: one per operator ID, each with its oracle SQL.

Every query reads the test tables (orders, customer, lineitem) and derives
the session table from them, so its work grows with the data. The oracle
SQL derives the same sessions independently (``intentlab.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..operators import decide, explore, metrics, prepare, quality, split
from ..oracle import HASH_ORDER, P_EXPR, with_scored, with_sessions
from ..sources.tables import load_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# --- shared inputs -------------------------------------------------------------

def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return load_sessions(spark, sf)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).withColumn("p", C.scorecard())


def decided(spark: SparkSession, sf: str, threshold: dict | None = None) -> DataFrame:
    return decide.with_decisions(scored(spark, sf), threshold=threshold,
                                 keep=[S.KEY, "PageValues", S.TARGET, "p"])


DECIDED_SQL = """
decided AS (
  SELECT session_id, PageValues, Revenue, p,
         round(p, 4) AS purchase_probability,
         round(1.0E0 - p, 4) AS no_purchase_probability,
         CAST(p > 5.0E-1 AS INTEGER) AS prediction,
         p < 3.0E-1 AS intervene,
         3.0E-1 AS intervention_threshold,
         'scorecard' AS model_name,
         CASE WHEN abs(p - 5.0E-1) > 3.5E-1 THEN 'High'
              WHEN abs(p - 5.0E-1) > 1.5E-1 THEN 'Medium' ELSE 'Low' END AS confidence
  FROM scored
)"""


def with_decided(body: str, extra: str = "") -> str:
    return with_scored(body, DECIDED_SQL + ("," + extra if extra else ""))


SPLIT_SQL = f"""
ranked AS (
  SELECT *, CAST(Revenue AS INTEGER) AS label,
         row_number() OVER (PARTITION BY Revenue ORDER BY {HASH_ORDER}) AS rk,
         CAST(round(count(*) OVER (PARTITION BY Revenue) * 2.0E-1) AS BIGINT) AS k
  FROM scored
),
splitted AS (
  SELECT *, rk <= k AS is_test, CASE WHEN rk > k THEN CAST((rk - k - 1) % 5 AS INTEGER) END AS fold
  FROM ranked
)"""


def split_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored sessions with label, hold-out flag and fold, written once to the
    shared folder: the queries built on it make several passes (quantile
    bounds, then the ordered pass), and each pass then starts from this
    table instead of re-running the joins."""
    from ..config import materialize
    s = scored(spark, sf).withColumn("label", C.target_int(S.TARGET))
    return materialize(split.assign_split(s, "label"), "split-scored")


def auc_sql(source: str, group: str | None = None) -> str:
    """Exact mid-rank AUC per group in SQL (ties count one half)."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
auc_g AS (
  SELECT {g}p, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg
  FROM {source} GROUP BY {g}p
),
auc_c AS (
  SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM auc_g
),
auc AS (
  SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
              THEN CAST(sum(2 * CAST(pos AS HUGEINT) * below + CAST(pos AS HUGEINT) * neg) AS DOUBLE)
                   / CAST(2 * CAST(sum(pos) AS HUGEINT) * sum(neg) AS DOUBLE) END AS roc_auc,
         CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
  FROM auc_c {"GROUP BY " + group if group else ""}
)"""


# --- sources ---------------------------------------------------------------------

@register("scan_sessions_csv", with_sessions(
    "SELECT " + ", ".join([S.KEY] + S.ALL_FEATURES + [S.TARGET]) + " FROM sessions"))
def q_scan_sessions_csv(spark, sf):
    from ..config import scratch_path
    from ..sources.files import read_sessions_csv, write_sessions_csv
    path = scratch_path(spark, "sessions-csv")
    write_sessions_csv(sessions(spark, sf), path)
    return read_sessions_csv(spark, path)


@register("scan_sessions_json", with_sessions(
    "SELECT " + ", ".join([S.KEY] + S.ALL_FEATURES) + " FROM sessions"))
def q_scan_sessions_json(spark, sf):
    from ..config import scratch_path
    from ..sources.files import read_sessions_json, write_sessions_json
    path = scratch_path(spark, "sessions-json")
    write_sessions_json(sessions(spark, sf).drop(S.TARGET), path)
    return read_sessions_json(spark, path)


@register("require_columns", with_sessions("SELECT " + ", ".join([S.KEY] + S.ALL_FEATURES) + " FROM sessions"))
def q_require_columns(spark, sf):
    from ..sources.files import require_columns
    return require_columns(sessions(spark, sf).withColumn("extra_column", F.lit(1)), keep=[S.KEY])


@register("sink_scored_csv", with_decided(
    "SELECT s.session_id, " + ", ".join("s." + c for c in S.ALL_FEATURES)
    + ", d.purchase_probability, d.intervene, CASE WHEN d.prediction = 1 THEN 'Purchase' ELSE 'No Purchase' END"
    " AS prediction FROM sessions s JOIN decided d ON s.session_id = d.session_id"))
def q_sink_scored_csv(spark, sf):
    from ..config import scratch_path
    from ..sources.files import read_scored_csv, scored_output, write_scored_csv
    out = scored_output(decide.with_decisions(scored(spark, sf), keep=[S.KEY, *S.ALL_FEATURES]))
    path = scratch_path(spark, "scored-csv")
    write_scored_csv(out, path)
    return read_scored_csv(spark, path)


# --- projections, casts, decisions ------------------------------------------------

@register("project_features", with_sessions("SELECT session_id, " + ", ".join(S.ALL_FEATURES)
                                            + ", CAST(Revenue AS INTEGER) AS label FROM sessions"))
def q_project_features(spark, sf):
    return prepare.project_features(sessions(spark, sf))


_NUM_KEPT, _CAT_KEPT = prepare.active_features(["Technical", "Engagement"])


@register("exclude_feature_groups", with_sessions("SELECT session_id, " + ", ".join(_NUM_KEPT + _CAT_KEPT)
                                                  + ", CAST(Revenue AS INTEGER) AS label FROM sessions"))
def q_exclude_feature_groups(spark, sf):
    return prepare.project_features(sessions(spark, sf), excluded=["Technical", "Engagement"])


@register("target_cast", with_sessions("SELECT session_id, CAST(Revenue AS INTEGER) AS label FROM sessions"))
def q_target_cast(spark, sf):
    return sessions(spark, sf).select(S.KEY, C.target_int().alias("label"))


@register("weekend_to_text", with_sessions(
    "SELECT session_id, coalesce(CASE WHEN Weekend THEN 'True' WHEN NOT Weekend THEN 'False' END, 'nan')"
    " AS weekend_text FROM sessions"))
def q_weekend_to_text(spark, sf):
    return sessions(spark, sf).select(S.KEY, C.weekend_to_text().alias("weekend_text"))


@register("weekend_from_text", with_sessions(
    """SELECT session_id,
       coalesce(t1 IN ('True', 'true', '1'), false) AS from_title,
       coalesce(t2 IN ('True', 'true', '1'), false) AS from_upper,
       coalesce(t3 IN ('True', 'true', '1'), false) AS from_digit,
       coalesce(t4 IN ('True', 'true', '1'), false) AS from_null
    FROM (SELECT session_id,
                 CASE WHEN Weekend THEN 'True' ELSE 'False' END AS t1,
                 upper(CASE WHEN Weekend THEN 'True' ELSE 'False' END) AS t2,
                 CAST(CAST(Weekend AS INTEGER) AS VARCHAR) AS t3,
                 CASE WHEN Weekend THEN NULL ELSE 'False' END AS t4
          FROM sessions)"""))
def q_weekend_from_text(spark, sf):
    s = sessions(spark, sf)
    t1 = F.initcap(F.col("Weekend").cast("string"))
    return s.select(
        S.KEY,
        C.weekend_from_text(t1).alias("from_title"),
        C.weekend_from_text(F.upper(t1)).alias("from_upper"),
        C.weekend_from_text(F.col("Weekend").cast("int").cast("string")).alias("from_digit"),
        C.weekend_from_text(F.when(~F.col("Weekend"), F.lit("False"))).alias("from_null"),
    )


@register("integer_normalise", with_sessions(
    """SELECT session_id,
       CAST(trunc(ProductRelated_Duration / 7) AS INTEGER) AS duration_per_7,
       CAST(trunc(BounceRates * 1000) AS INTEGER) AS bounce_permille,
       CAST(trunc(-PageValues) AS INTEGER) AS neg_page_value,
       CAST(trunc(CAST(Browser AS DOUBLE) + 9.0E-1) AS INTEGER) AS browser
    FROM sessions"""))
def q_integer_normalise(spark, sf):
    s = sessions(spark, sf)
    return s.select(
        S.KEY,
        C.integer_normalise(F.col("ProductRelated_Duration") / 7).alias("duration_per_7"),
        C.integer_normalise(F.col("BounceRates") * 1000).alias("bounce_permille"),
        C.integer_normalise(-F.col("PageValues")).alias("neg_page_value"),
        C.integer_normalise(F.col("Browser").cast("double") + 0.9).alias("browser"),
    )


@register("label_maps", with_decided(
    """SELECT session_id,
       CASE WHEN Revenue THEN 'Purchase' WHEN NOT Revenue THEN 'No Purchase' END AS purchased,
       CASE WHEN prediction = 1 THEN 'Purchase' ELSE 'No Purchase' END AS prediction_label,
       CASE WHEN intervene THEN 'Intervene' ELSE 'No Intervention' END AS status
    FROM decided"""))
def q_label_maps(spark, sf):
    d = decided(spark, sf)
    return d.select(S.KEY, C.purchased_label().alias("purchased"),
                    C.prediction_label().alias("prediction_label"), C.status_label().alias("status"))


@register("weekend_label", with_sessions(
    """SELECT session_id, CASE WHEN wk = 'True' THEN 'Weekend' WHEN wk = 'False' THEN 'Weekday' END AS weekend_label
    FROM (SELECT session_id, CASE WHEN Weekend THEN 'True' ELSE 'False' END AS wk FROM sessions)"""))
def q_weekend_label(spark, sf):
    s = sessions(spark, sf)
    return s.select(S.KEY, C.weekend_label(C.weekend_to_text()).alias("weekend_label"))


def _domain_sql() -> str:
    sel, checks = [], []
    for c in S.ALL_FEATURES:
        lo, hi, d = S.DOMAINS[c]
        lit = f"'{d}'" if isinstance(d, str) else ("false" if d is False else repr(float(d)) if isinstance(d, float) else str(d))
        v = f"coalesce({c}, {lit})"
        sel.append(f"{v} AS {c}")
        conds = []
        if lo is not None:
            conds.append(f"{v} < {lo!r}")
        if hi is not None:
            conds.append(f"{v} > {hi!r}")
        if conds:
            checks.append(f"CASE WHEN {' OR '.join(conds)} THEN '{c}' END")
    viol = "list_filter([" + ", ".join(checks) + "], lambda x: x IS NOT NULL)"
    return with_sessions(
        f"SELECT session_id, {', '.join(sel)}, array_to_string({viol}, ',') AS violation_text,"
        f" len({viol}) = 0 AS accepted FROM sessions")


@register("domain_validate_rows", _domain_sql())
def q_domain_validate_rows(spark, sf):
    s = sessions(spark, sf).drop(S.TARGET)
    v = prepare.domain_validate_rows(s)
    return v.select(S.KEY, *S.ALL_FEATURES, F.array_join("violations", ",").alias("violation_text"), "accepted")


@register("complement_round", with_decided(
    "SELECT session_id, purchase_probability, no_purchase_probability FROM decided"))
def q_complement_round(spark, sf):
    return decided(spark, sf).select(S.KEY, "purchase_probability", "no_purchase_probability")


@register("intervene_lower", with_scored("SELECT session_id, p, p < 3.0E-1 AS intervene FROM scored"))
def q_intervene_lower(spark, sf):
    return scored(spark, sf).select(S.KEY, "p", C.intervene_lower("p", 0.30).alias("intervene"))


@register("intervene_range", with_scored(
    "SELECT session_id, p, p BETWEEN 3.0E-1 AND 7.0E-1 AS intervene FROM scored"))
def q_intervene_range(spark, sf):
    return scored(spark, sf).select(S.KEY, "p", C.intervene("p", "range", 0.30, 0.70).alias("intervene"))


@register("confidence_bucket", with_decided("SELECT session_id, confidence FROM decided"))
def q_confidence_bucket(spark, sf):
    return decided(spark, sf).select(S.KEY, "confidence")


@register("predicted_class", with_decided("SELECT session_id, prediction FROM decided"))
def q_predicted_class(spark, sf):
    return decided(spark, sf).select(S.KEY, "prediction")


@register("month_ordinal", with_sessions(
    "SELECT session_id, Month, CASE WHEN list_position(['" + "','".join(S.MONTH_ORDER)
    + "'], Month) > 0 THEN CAST(list_position(['" + "','".join(S.MONTH_ORDER)
    + "'], Month) AS INTEGER) END AS month_order FROM sessions"))
def q_month_ordinal(spark, sf):
    return sessions(spark, sf).select(S.KEY, "Month", C.month_ordinal().alias("month_order"))


@register("percent_format", with_decided(
    """SELECT row_number() OVER (ORDER BY session_id) AS session_number, session_id,
       printf('%.1f%%', purchase_probability * 100) AS purchase_prob_text,
       printf('%.1f%%', no_purchase_probability * 100) AS no_purchase_prob_text,
       CASE WHEN prediction = 1 THEN 'Purchase' ELSE 'No Purchase' END AS prediction_label,
       CASE WHEN intervene THEN 'YES' ELSE 'No' END AS intervene_text,
       confidence
    FROM decided"""))
def q_percent_format(spark, sf):
    return decide.result_table(decided(spark, sf))


def _clip_sql() -> str:
    sel = []
    for c in S.ALL_FEATURES:
        if c not in S.CLIP_ROUND:
            sel.append(c)
            continue
        lo, hi, places = S.CLIP_ROUND[c]
        e = c
        if hi is not None:
            e = f"least({hi!r}, {e})"
        if lo is not None:
            e = f"greatest({lo!r}, {e})"
        if places is not None:
            e = f"round({e}, {places})"
        sel.append(f"{e} AS {c}")
    return with_sessions(f"SELECT session_id, {', '.join(sel)} FROM sessions")


@register("clip_round_domain", _clip_sql())
def q_clip_round_domain(spark, sf):
    return prepare.clip_round_domain(sessions(spark, sf).drop(S.TARGET))


@register("scorecard_propensity", with_scored("SELECT session_id, p FROM scored"))
def q_scorecard(spark, sf):
    return scored(spark, sf).select(S.KEY, "p")


@register("outlier_flag", with_sessions(
    """SELECT session_id, coalesce(ProductRelated >= 150 AND ProductRelated_Duration >= 8000
                                  AND PageValues >= 80, false) AS outlier FROM sessions"""))
def q_outlier_flag(spark, sf):
    return prepare.flag_outliers(sessions(spark, sf)).select(S.KEY, "outlier")


# --- scoring and decisions ---------------------------------------------------------

@register("score_batch", with_decided(
    """SELECT session_id, purchase_probability, no_purchase_probability, prediction, intervene,
       intervention_threshold, model_name, confidence FROM decided"""))
def q_score_batch(spark, sf):
    return decide.with_decisions(scored(spark, sf))


@register("batch_summary", with_decided(
    """SELECT count(*) AS total_sessions, count(CASE WHEN intervene THEN 1 END) AS intervention_count,
       round(CAST(count(CASE WHEN intervene THEN 1 END) AS DOUBLE) / count(*), 4) AS intervention_rate
    FROM decided"""))
def q_batch_summary(spark, sf):
    return decide.batch_summary(decided(spark, sf))


@register("expected_wasted_rate", with_decided(
    """SELECT coalesce(CAST(sum(CASE WHEN intervene THEN CAST(round(purchase_probability * 10000) AS BIGINT) END)
                            AS DOUBLE) / count(CASE WHEN intervene THEN 1 END) / 10000, 0.0E0) AS expected_wasted_rate
    FROM decided"""))
def q_expected_wasted_rate(spark, sf):
    return decide.expected_wasted_rate(decided(spark, sf)).select("expected_wasted_rate")


@register("average_score", with_decided(
    """SELECT CAST(sum(CAST(round(purchase_probability * 10000) AS BIGINT)) AS DOUBLE) / count(purchase_probability)
              / 10000 AS average_score FROM decided"""))
def q_average_score(spark, sf):
    return decide.expected_wasted_rate(decided(spark, sf)).select("average_score")


@register("realised_wasted_rate", with_scored(
    """SELECT coalesce(CAST(count(CASE WHEN p < 3.0E-1 AND Revenue THEN 1 END) AS DOUBLE)
                       / nullif(count(CASE WHEN p < 3.0E-1 THEN 1 END), 0), 0.0E0) AS wasted_discount_rate,
       count(CASE WHEN p < 3.0E-1 THEN 1 END) AS intervention_count
    FROM scored"""))
def q_realised_wasted_rate(spark, sf):
    return decide.realised_wasted_rate(scored(spark, sf))


@register("realised_wasted_rate_range", with_scored(
    """SELECT coalesce(CAST(count(CASE WHEN p BETWEEN 3.0E-1 AND 7.0E-1 AND Revenue THEN 1 END) AS DOUBLE)
                       / nullif(count(CASE WHEN p BETWEEN 3.0E-1 AND 7.0E-1 THEN 1 END), 0), 0.0E0)
              AS wasted_discount_rate,
       count(CASE WHEN p BETWEEN 3.0E-1 AND 7.0E-1 THEN 1 END) AS intervention_count
    FROM scored"""))
def q_realised_wasted_rate_range(spark, sf):
    return decide.realised_wasted_rate(scored(spark, sf), threshold={"mode": "range", "lower": 0.30, "upper": 0.70})


@register("score_histogram", with_decided(
    """SELECT bin, bin / 2.0E1 AS bin_lo, (bin + 1) / 2.0E1 AS bin_hi, status, count(*) AS sessions
    FROM (SELECT least(CAST(floor(purchase_probability * 20) AS INTEGER), 19) AS bin,
                 CASE WHEN intervene THEN 'Intervene' ELSE 'No Intervention' END AS status
          FROM decided WHERE purchase_probability IS NOT NULL)
    GROUP BY bin, status"""))
def q_score_histogram(spark, sf):
    return decide.score_histogram(decided(spark, sf))


_TS = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in decide.SENSITIVITY_THRESHOLDS)


@register("threshold_sensitivity", with_decided(
    f"""SELECT t.threshold,
       CAST(count(CASE WHEN d.purchase_probability < t.threshold THEN 1 END) AS DOUBLE) / count(*) * 100
         AS intervention_rate_pct
    FROM decided d, (VALUES {_TS}) AS t(threshold) GROUP BY t.threshold"""))
def q_threshold_sensitivity(spark, sf):
    return decide.threshold_sensitivity(decided(spark, sf))


@register("threshold_cross", with_decided(
    f"""SELECT d.session_id, d.purchase_probability,
       count(CASE WHEN d.purchase_probability < t.threshold THEN 1 END) AS flagged_thresholds,
       min(CASE WHEN d.purchase_probability < t.threshold THEN t.threshold END) AS first_flag_threshold
    FROM decided d, (VALUES {_TS}) AS t(threshold) GROUP BY d.session_id, d.purchase_probability"""))
def q_threshold_cross(spark, sf):
    return decide.thresholds_per_session(decided(spark, sf))


@register("confidence_breakdown", with_decided(
    "SELECT confidence, count(*) AS sessions FROM decided GROUP BY confidence ORDER BY sessions DESC"))
def q_confidence_breakdown(spark, sf):
    return decide.confidence_breakdown(decided(spark, sf))


@register("score_box_stats", with_decided(
    """SELECT CASE WHEN prediction = 1 THEN 'Purchase' ELSE 'No Purchase' END AS predicted_class,
       count(purchase_probability) AS sessions,
       min(purchase_probability) AS p_min,
       quantile_cont(purchase_probability, 0.25) AS p_q1,
       quantile_cont(purchase_probability, 0.5) AS p_median,
       quantile_cont(purchase_probability, 0.75) AS p_q3,
       max(purchase_probability) AS p_max
    FROM decided GROUP BY 1"""))
def q_score_box_stats(spark, sf):
    return decide.score_box_stats(decided(spark, sf))


@register("session_number", with_decided(
    "SELECT row_number() OVER (ORDER BY session_id) AS session_number, session_id, purchase_probability FROM decided"))
def q_session_number(spark, sf):
    return decide.session_numbers(decided(spark, sf)).select("session_number", S.KEY, "purchase_probability")


@register("attach_scores", with_decided(
    "SELECT s.session_id, " + ", ".join("s." + c for c in S.ALL_FEATURES)
    + ", d.purchase_probability, d.intervene, d.confidence FROM sessions s JOIN decided d USING (session_id)"))
def q_attach_scores(spark, sf):
    scores = decide.with_decisions(scored(spark, sf), keep=[S.KEY, *S.ALL_FEATURES])
    return scores.select(S.KEY, *S.ALL_FEATURES, "purchase_probability", "intervene", "confidence")


# --- validation ---------------------------------------------------------------------

@register("check_row_count", with_sessions("SELECT count(*) AS row_count, count(*) < 500 AS too_few FROM sessions"))
def q_check_row_count(spark, sf):
    c = quality.check_columns(sessions(spark, sf))
    return c.select("row_count", (F.col("row_count") < S.MIN_TRAINING_ROWS).alias("too_few"))


@register("check_missing_columns", with_sessions(
    """SELECT false AS passed,
       'Missing columns: [''PageValues'', ''Weekend'']'
         || CASE WHEN count(*) < 500 THEN '; ' || printf('Too few rows: %d (minimum 500)', count(*)) ELSE '' END
         AS error_text,
       '' AS warning_text, count(*) AS row_count, CAST(NULL AS DOUBLE) AS purchase_rate,
       CAST(NULL AS BIGINT) AS duplicate_rows, CAST(NULL AS BIGINT) AS columns_with_nulls
    FROM sessions"""))
def q_check_missing_columns(spark, sf):
    s = sessions(spark, sf).drop(S.KEY, "PageValues", "Weekend")
    return quality.report_flat(quality.validation_report(s))


@register("check_target_binary", with_sessions(
    """SELECT count(CASE WHEN Revenue IS NOT NULL AND CAST(Revenue AS INTEGER) NOT IN (0, 1) THEN 1 END)
              AS target_non_binary FROM sessions"""))
def q_check_target_binary(spark, sf):
    return quality.check_columns(sessions(spark, sf)).select(
        (F.col("target_non_binary") + F.col("target_unreadable")).alias("target_non_binary"))


_NN = ", ".join(f"count({c}) AS non_null_{c}" for c in S.ALL_FEATURES + [S.TARGET])
_FULLY_NULL = "list_filter([" + ", ".join(
    f"CASE WHEN non_null_{c} = 0 THEN '{c}' END" for c in S.ALL_FEATURES + [S.TARGET]) + "], lambda x: x IS NOT NULL)"


@register("check_all_null_columns", with_sessions(
    f"""SELECT len({_FULLY_NULL}) AS fully_null_count, array_to_string({_FULLY_NULL}, ',') AS fully_null_columns
    FROM (SELECT {_NN} FROM sessions)"""))
def q_check_all_null_columns(spark, sf):
    c = quality.check_columns(sessions(spark, sf))
    arr = F.filter(F.array(*[F.when(F.col(f"non_null_{x}") == 0, F.lit(x)) for x in quality.EXPECTED]),
                   lambda v: v.isNotNull())
    return c.select(F.size(arr).cast("long").alias("fully_null_count"),
                    F.array_join(arr, ",").alias("fully_null_columns"))


@register("check_purchase_rate", with_sessions(
    """SELECT round(avg(CAST(Revenue AS INTEGER)), 4) AS purchase_rate,
       avg(CAST(Revenue AS INTEGER)) < 1.0E-2 AS rate_low, avg(CAST(Revenue AS INTEGER)) > 7.0E-1 AS rate_high
    FROM sessions"""))
def q_check_purchase_rate(spark, sf):
    c = quality.check_columns(sessions(spark, sf))
    r = F.col("purchase_rate_raw")
    return c.select(F.round(r, 4).alias("purchase_rate"), (r < S.PURCHASE_RATE_LOW).alias("rate_low"),
                    (r > S.PURCHASE_RATE_HIGH).alias("rate_high"))


@register("check_rate_range", with_sessions(
    """SELECT count(CASE WHEN BounceRates < 0 OR BounceRates > 1 THEN 1 END) AS out_of_range_BounceRates,
       count(CASE WHEN ExitRates < 0 OR ExitRates > 1 THEN 1 END) AS out_of_range_ExitRates FROM sessions"""))
def q_check_rate_range(spark, sf):
    return quality.check_columns(sessions(spark, sf)).select("out_of_range_BounceRates", "out_of_range_ExitRates")


_BUSINESS = ", ".join(S.BUSINESS_COLUMNS)


@register("check_duplicates", with_sessions(
    f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS n FROM sessions GROUP BY {_BUSINESS})"""))
def q_check_duplicates(spark, sf):
    return quality.duplicate_rows(sessions(spark, sf))


_NULL_PCT = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round((count(*) - count({c})) * 100.0E0 / count(*), 2) AS null_pct FROM sessions"
    for c in S.ALL_FEATURES + [S.TARGET])


@register("null_profile", with_sessions(f"SELECT * FROM ({_NULL_PCT}) WHERE null_pct > 0"))
def q_null_profile(spark, sf):
    return quality.null_profile(sessions(spark, sf))


_VAL_SQL = with_sessions(f"""
SELECT len(errs) = 0 AS passed, array_to_string(errs, '; ') AS error_text, array_to_string(warns, '; ') AS warning_text,
       row_count, purchase_rate, duplicate_rows, columns_with_nulls
FROM (
  SELECT row_count, round(rate, 4) AS purchase_rate, duplicate_rows,
         CAST({" + ".join(f"CASE WHEN non_null_{c} < row_count THEN 1 ELSE 0 END" for c in S.ALL_FEATURES + [S.TARGET])}
           AS BIGINT) AS columns_with_nulls,
         list_filter([CASE WHEN row_count < 500 THEN printf('Too few rows: %d (minimum 500)', row_count) END,
                      CASE WHEN row_count >= 500 AND len({_FULLY_NULL}) > 0
                           THEN 'Columns are entirely null: [' || array_to_string(list_transform({_FULLY_NULL}, lambda x: '''' || x || ''''), ', ') || ']' END],
                     lambda x: x IS NOT NULL) AS errs,
         list_filter([CASE WHEN row_count >= 500 AND rate < 1.0E-2 THEN printf('Purchase rate is very low: %.1f%% (expected ≥ 1%%)', rate * 100) END,
                      CASE WHEN row_count >= 500 AND rate > 7.0E-1 THEN printf('Purchase rate is unusually high: %.1f%% (expected ≤ 70%%)', rate * 100) END,
                      CASE WHEN row_count >= 500 AND oor_b > 0 THEN printf('BounceRates has %d values outside [0, 1]', oor_b) END,
                      CASE WHEN row_count >= 500 AND oor_e > 0 THEN printf('ExitRates has %d values outside [0, 1]', oor_e) END,
                      CASE WHEN row_count >= 500 AND duplicate_rows > 0 THEN printf('%d duplicate rows detected', duplicate_rows) END],
                     lambda x: x IS NOT NULL) AS warns
  FROM (SELECT count(*) AS row_count, avg(CAST(Revenue AS DOUBLE)) AS rate,
               count(CASE WHEN BounceRates < 0 OR BounceRates > 1 THEN 1 END) AS oor_b,
               count(CASE WHEN ExitRates < 0 OR ExitRates > 1 THEN 1 END) AS oor_e,
               {_NN} FROM sessions),
       (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
        FROM (SELECT count(*) AS n FROM sessions GROUP BY {_BUSINESS}))
)""")


@register("validation_report", _VAL_SQL)
def q_validation_report(spark, sf):
    return quality.report_flat(quality.validation_report(sessions(spark, sf).drop(S.KEY)))


# --- explorer ------------------------------------------------------------------------

@register("kpi_summary", with_sessions(
    """SELECT count(*) AS sessions, count(CASE WHEN Revenue THEN 1 END) AS purchases,
       count(CASE WHEN NOT Revenue THEN 1 END) AS non_purchases,
       CAST(count(CASE WHEN Revenue THEN 1 END) AS DOUBLE) / count(*) AS purchase_rate,
       CAST(count(CASE WHEN NOT Revenue THEN 1 END) AS DOUBLE) / count(*) AS non_purchase_rate
    FROM sessions"""))
def q_kpi_summary(spark, sf):
    return explore.kpi_summary(sessions(spark, sf))


@register("purchase_rate_by_month", with_sessions(
    "SELECT Month, count(CASE WHEN Revenue THEN 1 END) AS purchases, count(*) AS sessions,"
    " CAST(count(CASE WHEN Revenue THEN 1 END) AS DOUBLE) / count(*) AS purchase_rate,"
    " CASE WHEN list_position(['" + "','".join(S.MONTH_ORDER) + "'], Month) > 0 THEN CAST(list_position(['"
    + "','".join(S.MONTH_ORDER) + "'], Month) AS INTEGER) END AS month_order"
    " FROM sessions WHERE Month IS NOT NULL GROUP BY Month ORDER BY month_order NULLS LAST, Month"))
def q_purchase_rate_by_month(spark, sf):
    return explore.purchase_rate_by_month(sessions(spark, sf))


@register("sessions_by_visitor_type", with_sessions(
    """SELECT VisitorType, CASE WHEN Revenue THEN 'Purchase' ELSE 'No Purchase' END AS Purchased, count(*) AS sessions
    FROM sessions WHERE VisitorType IS NOT NULL AND Revenue IS NOT NULL GROUP BY 1, 2"""))
def q_sessions_by_visitor_type(spark, sf):
    return explore.sessions_by_visitor_type(sessions(spark, sf))


@register("sessions_by_weekend", with_sessions(
    """SELECT CASE WHEN Weekend THEN 'Weekend' WHEN NOT Weekend THEN 'Weekday' END AS Weekend,
       CASE WHEN Revenue THEN 'Purchase' ELSE 'No Purchase' END AS Purchased, count(*) AS sessions
    FROM sessions WHERE Revenue IS NOT NULL GROUP BY 1, 2"""))
def q_sessions_by_weekend(spark, sf):
    return explore.sessions_by_weekend(sessions(spark, sf))


@register("page_value_histogram", with_sessions(
    """SELECT bin, lo + (hi - lo) / 50 * bin AS bin_lo, Purchased, count(*) AS sessions
    FROM (SELECT CASE WHEN (hi - lo) / 50 = 0 THEN 0
                      ELSE least(CAST(floor((PageValues - lo) / ((hi - lo) / 50)) AS INTEGER), 49) END AS bin,
                 CASE WHEN Revenue THEN 'Purchase' ELSE 'No Purchase' END AS Purchased, lo, hi
          FROM sessions, (SELECT min(PageValues) AS lo, max(PageValues) AS hi FROM sessions
                          WHERE PageValues IS NOT NULL AND Revenue IS NOT NULL)
          WHERE PageValues IS NOT NULL AND Revenue IS NOT NULL)
    GROUP BY bin, Purchased, lo, hi"""))
def q_page_value_histogram(spark, sf):
    return explore.page_value_histogram(sessions(spark, sf))


@register("batch_profile", with_sessions(
    """SELECT VisitorType, count(*) AS sessions, CAST(count(*) AS DOUBLE) / t.total_sessions AS share,
       t.total_sessions, t.revenue_rate
    FROM sessions, (SELECT count(*) AS total_sessions, avg(CAST(Revenue AS DOUBLE)) AS revenue_rate FROM sessions) t
    WHERE VisitorType IS NOT NULL GROUP BY VisitorType, t.total_sessions, t.revenue_rate"""))
def q_batch_profile(spark, sf):
    return explore.batch_profile(sessions(spark, sf))


@register("head_sample", with_sessions(
    "SELECT session_id, " + ", ".join(S.ALL_FEATURES) + " FROM sessions ORDER BY session_id LIMIT 50"))
def q_head_sample(spark, sf):
    return explore.head_sample(sessions(spark, sf))


@register("random_sample_n", with_sessions(
    f"""SELECT session_id, BounceRates, ExitRates, CASE WHEN Revenue THEN 'Purchase' WHEN NOT Revenue
       THEN 'No Purchase' END AS Purchased FROM sessions ORDER BY {HASH_ORDER} LIMIT 2000"""))
def q_random_sample_n(spark, sf):
    return explore.random_sample_n(sessions(spark, sf))


@register("score_scatter", with_decided(
    """SELECT session_id, PageValues, purchase_probability,
       CASE WHEN intervene THEN 'Intervene' ELSE 'No Intervention' END AS status FROM decided"""))
def q_score_scatter(spark, sf):
    return explore.score_scatter(decided(spark, sf))


@register("drop_duplicates", with_sessions(
    f"SELECT min(session_id) AS session_id, {_BUSINESS} FROM sessions GROUP BY {_BUSINESS}"))
def q_drop_duplicates(spark, sf):
    return prepare.drop_duplicates(sessions(spark, sf))


# --- split and metrics ------------------------------------------------------------------

@register("stratified_split", with_scored("SELECT session_id, label, is_test FROM splitted", SPLIT_SQL))
def q_stratified_split(spark, sf):
    return split_scored(spark, sf).select(S.KEY, "label", "is_test")


@register("stratified_folds", with_scored("SELECT session_id, label, fold FROM splitted WHERE NOT is_test", SPLIT_SQL))
def q_stratified_folds(spark, sf):
    return split_scored(spark, sf).where(~F.col("is_test")).select(S.KEY, "label", "fold")


@register("class_balance_weights", with_sessions(
    """SELECT label, count(*) AS sessions, max(w) AS weight FROM (
         SELECT CAST(Revenue AS INTEGER) AS label,
                CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY Revenue)) AS w FROM sessions)
       GROUP BY label"""))
def q_class_balance_weights(spark, sf):
    s = prepare.project_features(sessions(spark, sf))
    w = split.class_balance_weights(s)
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("sessions"), F.max("weight").alias("weight"))


@register("roc_auc", with_scored(
    "SELECT roc_auc, positives, negatives FROM auc", SPLIT_SQL + "," + auc_sql("(SELECT * FROM splitted WHERE is_test)")))
def q_roc_auc(spark, sf):
    s = split_scored(spark, sf).where(F.col("is_test"))
    return metrics.roc_auc(s, "label", "p")


@register("auc_midrank", with_scored(
    "SELECT fold, roc_auc, positives, negatives FROM auc",
    SPLIT_SQL + "," + auc_sql("(SELECT * FROM splitted WHERE NOT is_test)", "fold")))
def q_auc_midrank(spark, sf):
    s = split_scored(spark, sf).where(~F.col("is_test"))
    return metrics.roc_auc(s, "label", "p", by=["fold"])


_CM_SQL = """SELECT count(CASE WHEN label = 0 AND p <= 5.0E-1 THEN 1 END) AS true_negatives,
       count(CASE WHEN label = 0 AND p > 5.0E-1 THEN 1 END) AS false_positives,
       count(CASE WHEN label = 1 AND p <= 5.0E-1 THEN 1 END) AS false_negatives,
       count(CASE WHEN label = 1 AND p > 5.0E-1 THEN 1 END) AS true_positives
    FROM splitted WHERE is_test"""


def _test_predictions(spark, sf):
    return split_scored(spark, sf).where(F.col("is_test")).withColumn("prediction", C.predicted_class("p"))


@register("confusion_matrix", with_scored(_CM_SQL, SPLIT_SQL))
def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_test_predictions(spark, sf))


@register("classification_metrics", with_scored(
    """SELECT coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0.0E0) AS accuracy,
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0E0) AS precision,
       coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0E0) AS recall,
       coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0E0) AS f1
    FROM cm""", SPLIT_SQL + ", cm AS (SELECT true_negatives AS tn, false_positives AS fp, false_negatives AS fn,"
    " true_positives AS tp FROM (" + _CM_SQL + "))"))
def q_classification_metrics(spark, sf):
    return metrics.classification_metrics(_test_predictions(spark, sf))


_CR_CTE = SPLIT_SQL + ", cm AS (SELECT true_negatives AS tn, false_positives AS fp, false_negatives AS fn," \
    " true_positives AS tp FROM (" + _CM_SQL + ")), per AS (" \
    "SELECT coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0.0E0) AS p0," \
    " coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0E0) AS r0," \
    " coalesce(CAST(2 * tn AS DOUBLE) / nullif(2 * tn + fn + fp, 0), 0.0E0) AS f0," \
    " CAST(tn + fp AS DOUBLE) AS s0," \
    " coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0E0) AS p1," \
    " coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0E0) AS r1," \
    " coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0E0) AS f1," \
    " CAST(tp + fn AS DOUBLE) AS s1, tn + fp + fn + tp AS total, tp + tn AS correct FROM cm)"


@register("classification_report", with_scored(
    """SELECT 'No Purchase' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM per
    UNION ALL SELECT 'Purchase', p1, r1, f1, s1 FROM per
    UNION ALL SELECT 'accuracy', NULL, NULL, coalesce(CAST(correct AS DOUBLE) / nullif(total, 0), 0.0E0),
                     CAST(total AS DOUBLE) FROM per
    UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(total AS DOUBLE) FROM per
    UNION ALL SELECT 'weighted avg', coalesce((p0 * s0 + p1 * s1) / nullif(total, 0), 0.0E0),
                     coalesce((r0 * s0 + r1 * s1) / nullif(total, 0), 0.0E0),
                     coalesce((f0 * s0 + f1 * s1) / nullif(total, 0), 0.0E0), CAST(total AS DOUBLE) FROM per""",
    _CR_CTE))
def q_classification_report(spark, sf):
    return metrics.classification_report(_test_predictions(spark, sf))


@register("cv_summary", with_scored(
    "SELECT round(avg(roc_auc), 12) AS cv_roc_auc_mean, round(stddev_pop(roc_auc), 12) AS cv_roc_auc_std,"
    " count(roc_auc) AS folds FROM auc",
    SPLIT_SQL + "," + auc_sql("(SELECT * FROM splitted WHERE NOT is_test)", "fold")))
def q_cv_summary(spark, sf):
    s = split_scored(spark, sf).where(~F.col("is_test"))
    folds = metrics.roc_auc(s, "label", "p", by=["fold"])
    out = metrics.cv_summary(folds, "roc_auc")  # compared across engines at 12 places
    return out.select(F.round("cv_roc_auc_mean", 12).alias("cv_roc_auc_mean"),
                      F.round("cv_roc_auc_std", 12).alias("cv_roc_auc_std"), "folds")


# --- exact preprocessing (fitted on the training part) ---------------------------------

def _train(spark, sf):
    return split_scored(spark, sf).where(~F.col("is_test"))


def _cat_text_sql(c: str) -> str:
    if c == "Weekend":
        return "CASE WHEN Weekend THEN 'True' WHEN NOT Weekend THEN 'False' ELSE 'nan' END"
    return f"CAST({c} AS VARCHAR)"


_FILLS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (l[(n + 1) // 2] + l[(n + 2) // 2]) / 2 AS fill_value FROM "
    f"(SELECT list_sort(list(CAST({c} AS DOUBLE)) FILTER (WHERE {c} IS NOT NULL)) AS l, count({c}) AS n "
    f"FROM splitted WHERE NOT is_test)"
    for c in S.NUMERIC_FEATURES)


@register("impute_numeric", with_scored("SELECT feature, fill_value FROM fills",
                                        SPLIT_SQL + f", fills AS ({_FILLS_SQL})"))
def q_impute_numeric(spark, sf):
    from ..operators.features import numeric_fill_values
    fills = numeric_fill_values(_train(spark, sf), S.NUMERIC_FEATURES, "median")
    return spark.createDataFrame(list(fills.items()), "feature string, fill_value double")


_MEANS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 OR stddev_pop(x) IS NULL THEN 1.0E0 "
    f"ELSE stddev_pop(x) END AS scale FROM (SELECT coalesce(CAST({c} AS DOUBLE), "
    f"(SELECT fill_value FROM fills WHERE feature = '{c}')) AS x FROM splitted WHERE NOT is_test)"
    for c in S.NUMERIC_FEATURES)


@register("standardise", with_scored(
    "SELECT feature, round(mean, 9) AS mean, round(scale, 9) AS scale FROM stats",
    SPLIT_SQL + f", fills AS ({_FILLS_SQL}), stats AS ({_MEANS_SQL})"))
def q_standardise(spark, sf):
    from ..operators.features import mean_and_scale, numeric_fill_values
    train = _train(spark, sf)
    fills = numeric_fill_values(train, S.NUMERIC_FEATURES, "median")
    means, scales = mean_and_scale(train, S.NUMERIC_FEATURES, fills)
    rows = [(c, means[c], scales[c]) for c in S.NUMERIC_FEATURES]
    df = spark.createDataFrame(rows, "feature string, mean double, scale double")
    return df.select("feature", F.round("mean", 9).alias("mean"), F.round("scale", 9).alias("scale"))


_MODES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT txt FROM (SELECT {_cat_text_sql(c)} AS txt, "
    f"CAST({c if c in S.INTEGER_COLUMNS else 'NULL'} AS DOUBLE) AS num, count(*) AS n FROM splitted "
    f"WHERE NOT is_test AND {_cat_text_sql(c)} IS NOT NULL GROUP BY 1, 2) ORDER BY n DESC, num, txt LIMIT 1) AS mode_value"
    for c in S.CATEGORICAL_FEATURES)


@register("impute_mode", with_scored("SELECT feature, mode_value FROM modes", SPLIT_SQL + f", modes AS ({_MODES_SQL})"))
def q_impute_mode(spark, sf):
    from ..operators.features import mode_values
    modes = mode_values(_train(spark, sf), S.CATEGORICAL_FEATURES)
    return spark.createDataFrame(list(modes.items()), "feature string, mode_value string")


_CATS_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS feature, {_cat_text_sql(c)} AS category FROM splitted WHERE NOT is_test"
    for c in S.CATEGORICAL_FEATURES)
_TEST_LONG_SQL = " UNION ALL ".join(
    f"SELECT session_id, '{c}' AS feature, {_cat_text_sql(c)} AS category FROM splitted WHERE is_test"
    for c in S.CATEGORICAL_FEATURES)


@register("one_hot", with_scored(
    """SELECT t.session_id, t.feature, CAST(v.slot AS INTEGER) AS slot, t.category
    FROM test_long t JOIN vocab v ON t.feature = v.feature AND t.category = v.category""",
    SPLIT_SQL + f", cats AS ({_CATS_SQL}), vocab AS (SELECT feature, category, "
    "row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS slot FROM cats WHERE category IS NOT NULL), "
    f"test_long AS ({_TEST_LONG_SQL})"))
def q_one_hot(spark, sf):
    from ..operators.features import build_preprocessor
    s = split_scored(spark, sf)
    model = build_preprocessor().fit(s.where(~F.col("is_test")))
    idx_model = model.stages[2]
    cats = S.CATEGORICAL_FEATURES
    sizes = [len(lbls) for lbls in idx_model.labelsArray]
    encoded = model.transform(s.where(F.col("is_test")))
    stack = "stack({}, {}) as (feature, slot, category, n_labels)".format(
        len(cats), ", ".join(f"'{c}', CAST(`_idx_{c}` AS INT), `_cat_{c}`, {n}" for c, n in zip(cats, sizes)))
    return encoded.selectExpr(S.KEY, stack).where(F.col("slot") < F.col("n_labels")).drop("n_labels")


# --- run log and ranking (runs derived from evaluations over the sessions) ---------------

from ..oracle import scorecard_sql  # noqa: E402
from ..operators import registry  # noqa: E402

_VLONG_SQL = " UNION ALL ".join(
    f"SELECT session_id, label, fold, '{name}' AS model_type, {scorecard_sql(tuple(ex))} AS p "
    f"FROM splitted WHERE fold IS NOT NULL"
    for name, ex in registry.SCORECARD_VARIANTS.items())

RUNS_SQL = SPLIT_SQL + f""",
vlong AS ({_VLONG_SQL}),
vcm AS (
  SELECT model_type, fold,
         count(CASE WHEN label = 0 AND p <= 5.0E-1 THEN 1 END) AS tn,
         count(CASE WHEN label = 0 AND p > 5.0E-1 THEN 1 END) AS fp,
         count(CASE WHEN label = 1 AND p <= 5.0E-1 THEN 1 END) AS fn,
         count(CASE WHEN label = 1 AND p > 5.0E-1 THEN 1 END) AS tp,
         count(CASE WHEN p < 3.0E-1 THEN 1 END) AS flagged,
         count(CASE WHEN p < 3.0E-1 AND label = 1 THEN 1 END) AS wasted
  FROM vlong GROUP BY model_type, fold
),
{auc_sql("vlong", "model_type, fold")},
runs AS (
  SELECT md5(vcm.model_type || ':' || CAST(vcm.fold AS VARCHAR)) AS run_id, vcm.model_type, vcm.fold, auc.roc_auc,
         coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0.0E0) AS accuracy,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0E0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0E0) AS recall,
         coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0E0) AS f1,
         coalesce(CAST(wasted AS DOUBLE) / nullif(flagged, 0), 0.0E0) AS wasted_discount_rate,
         CAST(flagged AS DOUBLE) AS intervention_count,
         'lower' AS wdr_mode, 3.0E-1 AS wdr_lower, 1.0E0 AS wdr_upper
  FROM vcm JOIN auc ON vcm.model_type = auc.model_type AND vcm.fold = auc.fold
),
versions AS (SELECT CAST(row_number() OVER (ORDER BY fold, model_type) AS INTEGER) AS version, run_id FROM runs),
vaucs AS (SELECT v.version, r.run_id, r.model_type, r.roc_auc FROM versions v JOIN runs r USING (run_id)
          WHERE r.roc_auc IS NOT NULL),
roles AS (
  SELECT CASE WHEN rn = 1 THEN 'champion' ELSE 'challenger' END AS role, version, run_id, model_type, roc_auc
  FROM (SELECT *, row_number() OVER (ORDER BY roc_auc DESC, version) AS rn FROM vaucs) WHERE rn <= 2
)"""

_RUN_COLS = ("run_id, model_type, fold, roc_auc, accuracy, precision, recall, f1, wasted_discount_rate, "
             "intervention_count, wdr_mode, wdr_lower, wdr_upper")


def derived_runs(spark, sf):
    """The evaluation runs, written once (as a run log is): the ranking
    queries then read a table of one row per run instead of re-running the
    grouped evaluation in each branch of their plans."""
    from ..config import materialize
    return materialize(registry.evaluation_runs(split_scored(spark, sf)), "derived-runs")


def _logged_runs(spark, sf, with_validation_run: bool = False):
    from ..config import scratch_path
    path = scratch_path(spark, "run-log")
    flat = derived_runs(spark, sf)
    registry.append_runs(registry.to_run_log(flat), path)
    if with_validation_run:
        rep = quality.report_flat(quality.validation_report(sessions(spark, sf).drop(S.KEY)))
        val = rep.select(
            F.md5(F.lit("data_validation")).alias("run_id"),
            F.lit("data_validation").alias("run_name"),
            F.current_timestamp().alias("started_at"),
            F.create_map(F.lit("model_type"), F.lit(""), F.lit("warnings"), F.col("warning_text")).alias("params"),
            F.create_map(F.lit("row_count"), F.col("row_count").cast("double"),
                         F.lit("duplicate_rows"), F.col("duplicate_rows").cast("double")).alias("metrics"),
        )
        registry.append_runs(val, path)
    return registry.model_runs(registry.read_run_log(spark, path))


@register("run_log_append", with_scored(f"SELECT {_RUN_COLS} FROM runs", RUNS_SQL))
def q_run_log_append(spark, sf):
    return _logged_runs(spark, sf).select(*[c.strip() for c in _RUN_COLS.split(",")])


@register("run_log_scan", with_scored(f"SELECT {_RUN_COLS} FROM runs", RUNS_SQL))
def q_run_log_scan(spark, sf):
    return _logged_runs(spark, sf, with_validation_run=True).select(*[c.strip() for c in _RUN_COLS.split(",")])


def _version_aucs(spark, sf):
    runs = derived_runs(spark, sf)
    versions = registry.number_versions(runs, ["fold", "model_type"])
    return runs, registry.versions_join_runs(versions, runs)


@register("versions_join_runs", with_scored("SELECT version, run_id, model_type, roc_auc FROM vaucs", RUNS_SQL))
def q_versions_join_runs(spark, sf):
    return _version_aucs(spark, sf)[1]


@register("champion_challenger", with_scored("SELECT role, version, run_id, model_type, roc_auc FROM roles", RUNS_SQL))
def q_champion_challenger(spark, sf):
    return registry.champion_challenger(_version_aucs(spark, sf)[1])


@register("run_history", with_scored(
    """SELECT model_type, count(*) AS run_count, max(roc_auc) AS best_roc_auc,
       arg_min(run_id, struct_pack(a := -roc_auc, r := run_id)) AS best_run_id
    FROM runs WHERE model_type <> '' AND roc_auc IS NOT NULL GROUP BY model_type""", RUNS_SQL))
def q_run_history(spark, sf):
    return registry.run_history(derived_runs(spark, sf))


@register("run_leaderboard", with_scored(
    """SELECT r.run_id, r.model_type, r.roc_auc, ro.role FROM runs r LEFT JOIN roles ro USING (run_id)
    WHERE r.fold = (SELECT max(fold) FROM runs)""", RUNS_SQL))
def q_run_leaderboard(spark, sf):
    runs, vaucs = _version_aucs(spark, sf)
    roles = registry.champion_challenger(vaucs)
    latest = runs.join(runs.agg(F.max("fold").alias("fold")), "fold")
    return registry.run_leaderboard(latest, roles)


_THRESH_TEXT_SQL = """CASE WHEN wdr_mode = 'range' AND wdr_lower IS NOT NULL AND wdr_upper IS NOT NULL
              THEN printf('%.0f%%', wdr_lower * 100) || ' – ' || printf('%.0f%%', wdr_upper * 100)
            WHEN wdr_lower IS NOT NULL THEN '< ' || printf('%.0f%%', wdr_lower * 100)
            ELSE '< 30%' END AS threshold_text,
       CASE WHEN wdr_mode = 'range' AND wdr_lower IS NOT NULL AND wdr_upper IS NOT NULL
              THEN 'Wasted Discount (' || printf('%.0f%%', wdr_lower * 100) || '–' || printf('%.0f%%', wdr_upper * 100) || ')'
            WHEN wdr_lower IS NOT NULL THEN 'Wasted Discount (< ' || printf('%.0f%%', wdr_lower * 100) || ')'
            ELSE 'Wasted Discount' END AS wdr_label"""


@register("alias_details", with_scored(
    f"""SELECT ro.role, ro.version, ro.run_id, coalesce(ro.model_type, '—') AS model_name,
       coalesce(ro.roc_auc, 0.0E0) AS roc_auc, r.f1, r.precision, r.wasted_discount_rate, r.intervention_count,
       {_THRESH_TEXT_SQL}
    FROM roles ro LEFT JOIN runs r USING (run_id)""", RUNS_SQL))
def q_alias_details(spark, sf):
    runs, vaucs = _version_aucs(spark, sf)
    return registry.alias_details(registry.champion_challenger(vaucs), runs)


@register("threshold_text", with_scored(f"SELECT run_id, {_THRESH_TEXT_SQL} FROM runs", RUNS_SQL))
def q_threshold_text(spark, sf):
    runs = derived_runs(spark, sf)
    return runs.select(
        "run_id",
        C.threshold_text("wdr_mode", "wdr_lower", "wdr_upper", F.lit("lower"), F.lit(0.30), F.lit(0.70))
        .alias("threshold_text"),
        C.wdr_label("wdr_mode", "wdr_lower", "wdr_upper").alias("wdr_label"),
    )


_ALL_LONG_SQL = " UNION ALL ".join(
    f"SELECT session_id, '{name}' AS model_type, {scorecard_sql(tuple(ex))} AS p FROM splitted"
    for name, ex in registry.SCORECARD_VARIANTS.items())


@register("champion_challenger_compare", with_scored(
    f"""SELECT champion_intervene, challenger_intervene, count(*) AS sessions FROM (
      SELECT a.session_id, max(CASE WHEN ro.role = 'champion' THEN a.p < 3.0E-1 END) AS champion_intervene,
             max(CASE WHEN ro.role = 'challenger' THEN a.p < 3.0E-1 END) AS challenger_intervene
      FROM all_long a JOIN roles ro ON a.model_type = ro.model_type GROUP BY a.session_id)
    GROUP BY 1, 2""", RUNS_SQL + f", all_long AS ({_ALL_LONG_SQL})"))
def q_champion_challenger_compare(spark, sf):
    s = split_scored(spark, sf)
    runs, vaucs = _version_aucs(spark, sf)
    roles = registry.champion_challenger(vaucs)
    return registry.compare_decisions(registry.variant_score_map(s), roles)


# --- models (Spark ML; no SQL equivalent: rows-only checks plus invariant tests) ----------

def _ml_split(spark, sf):
    from ..config import materialize
    labeled = prepare.project_features(sessions(spark, sf))
    return materialize(split.assign_split(labeled, "label"), "ml-split")


def _fit_eval(spark, sf, name: str, overrides: dict | None = None):
    from ..operators import models
    s = _ml_split(spark, sf)
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    params = models.model_params(overrides)[name]
    model = models.build_pipeline(name, params).fit(train)
    return model, models.score(model, test), test


def _written_scores(scored_test):
    """What the hold-out measures read, written once: they pass over it several times."""
    from ..config import materialize
    return materialize(scored_test.select("label", "p", "prediction"), "holdout-scores")


def _holdout_row(spark, sf, name):
    from ..operators import models
    _, scored_test, _ = _fit_eval(spark, sf, name)
    return models.evaluate_holdout(_written_scores(scored_test)).select(F.lit(name).alias("model_type"), "*")


@register("train_logistic")
def q_train_logistic(spark, sf):
    return _holdout_row(spark, sf, "LR_baseline")


@register("train_tree")
def q_train_tree(spark, sf):
    return _holdout_row(spark, sf, "DT_medium")


@register("train_forest")
def q_train_forest(spark, sf):
    return _holdout_row(spark, sf, "RF_baseline")


@register("train_boosted")
def q_train_boosted(spark, sf):
    return _holdout_row(spark, sf, "XGBoost")


@register("preprocess_pipeline")
def q_preprocess_pipeline(spark, sf):
    from pyspark.ml.functions import vector_to_array
    from ..operators.features import build_preprocessor
    s = _ml_split(spark, sf)
    m = build_preprocessor().fit(s.where(~F.col("is_test")))
    return m.transform(s.where(F.col("is_test"))).select(S.KEY, vector_to_array("features").alias("features"))


@register("cross_validate")
def q_cross_validate(spark, sf):
    from ..operators import models
    s = _ml_split(spark, sf)
    train, out = s.where(~F.col("is_test")), None
    prepared = models.PreparedFolds(train)

    def one(item):
        return models.cross_validate(*item, train, prepared=prepared).select(F.lit(item[0]).alias("model_type"), "fold", "auc")
    with ThreadPoolExecutor(max_workers=len(models.MODEL_NAMES)) as pool:
        for folds in pool.map(one, models.model_params().items()):
            out = folds if out is None else out.unionByName(folds)
    return out


# the training complements of the folds; NULL stands for all rows
_COMPLEMENTS_SQL = SPLIT_SQL + """,
left_out AS (SELECT unnest([0, 1, 2, 3, 4, NULL]) AS lf),
kept AS (SELECT lf, s.* FROM splitted s JOIN left_out ON lf IS NULL OR s.fold <> lf WHERE NOT s.is_test)"""
_FOLD_NUMBERS_SQL = " UNION ALL ".join(f"SELECT lf, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM kept" for c in S.NUMERIC_FEATURES)
_FOLD_TEXTS_SQL = " UNION ALL ".join(
    f"SELECT lf, '{c}' AS feature, {_cat_text_sql(c)} AS txt, CAST({c if c in S.INTEGER_COLUMNS else 'NULL'} AS DOUBLE) AS num FROM kept"
    for c in S.CATEGORICAL_FEATURES)


@register("fold_statistics", with_scored(
    """SELECT m.lf AS left_out, m.feature, f.fill, round(m.mean, 6) AS mean, round(m.scale, 6) AS scale, NULL::VARCHAR AS mode,
       NULL::INTEGER AS categories, m.rows FROM moments m JOIN fills f ON f.lf IS NOT DISTINCT FROM m.lf AND f.feature = m.feature
    UNION ALL SELECT lf, feature, NULL, NULL, NULL, first(txt ORDER BY n DESC, num, txt), CAST(count(*) AS INTEGER),
       CAST(any_value(rows) AS BIGINT) FROM texts GROUP BY lf, feature""",
    _COMPLEMENTS_SQL + f""", numbers AS ({_FOLD_NUMBERS_SQL}),
sorted AS (SELECT lf, feature, list_sort(list(x) FILTER (WHERE x IS NOT NULL)) AS l, count(x) AS n FROM numbers GROUP BY lf, feature),
fills AS (SELECT lf, feature, (l[(n + 1) // 2] + l[(n + 2) // 2]) / 2 AS fill FROM sorted),
moments AS (
  SELECT n.lf, n.feature, avg(coalesce(x, fill)) AS mean, count(*) AS rows,
    CASE WHEN stddev_pop(coalesce(x, fill)) = 0 THEN 1.0E0 ELSE stddev_pop(coalesce(x, fill)) END AS scale
  FROM numbers n JOIN fills f ON f.lf IS NOT DISTINCT FROM n.lf AND f.feature = n.feature GROUP BY n.lf, n.feature),
entries AS ({_FOLD_TEXTS_SQL}),
sizes AS (SELECT lf, count(*) AS rows FROM kept GROUP BY lf),
texts AS (
  SELECT e.lf, feature, txt, num, count(*) AS n, any_value(rows) AS rows FROM entries e JOIN sizes z ON z.lf IS NOT DISTINCT FROM e.lf
  WHERE txt IS NOT NULL GROUP BY e.lf, feature, txt, num)"""))
def q_fold_statistics(spark, sf):
    """What preprocessing learns from each fold's complement and from all rows, merged from one cube."""
    from ..operators import foldcube
    table = foldcube.statistics_table(foldcube.measure(_train(spark, sf)), spark)
    return table.withColumns({"mean": F.round("mean", 6), "scale": F.round("scale", 6)})


_TEST_TEXTS_SQL = " UNION ALL ".join(
    f"SELECT session_id, '{c}' AS feature, {_cat_text_sql(c)} AS txt FROM splitted WHERE is_test" for c in S.CATEGORICAL_FEATURES)


@register("train_boosted_second_order", with_scored(
    """SELECT t.session_id, round(1.0E0 / (1.0E0 + exp(-CASE WHEN max(CAST(t.feature = b.feature AND coalesce(t.txt, m.mode_value) = b.txt AS INTEGER)) = 1
       THEN -b.g1 / (b.h1 + 1) ELSE -b.g0 / (b.h0 + 1) END)), 9) AS p
    FROM test_texts t JOIN modes m ON m.feature = t.feature CROSS JOIN best b GROUP BY t.session_id, b.g1, b.h1, b.g0, b.h0""",
    _COMPLEMENTS_SQL + f""", modes AS ({_MODES_SQL}), entries AS ({_FOLD_TEXTS_SQL}), train_texts AS (
  SELECT e.feature, coalesce(txt, mode_value) AS txt, label FROM (
    {" UNION ALL ".join(f"SELECT '{c}' AS feature, {_cat_text_sql(c)} AS txt, label FROM splitted WHERE NOT is_test" for c in S.CATEGORICAL_FEATURES)}
  ) e JOIN modes m ON m.feature = e.feature),
whole AS (SELECT sum(CASE WHEN label = 1 THEN -2.5E0 ELSE 5.0E-1 END) AS g, sum(CASE WHEN label = 1 THEN 1.25E0 ELSE 2.5E-1 END) AS h
  FROM splitted WHERE NOT is_test),
sides AS (SELECT feature, txt, sum(CASE WHEN label = 1 THEN -2.5E0 ELSE 5.0E-1 END) AS g1,
  sum(CASE WHEN label = 1 THEN 1.25E0 ELSE 2.5E-1 END) AS h1 FROM train_texts GROUP BY feature, txt),
gains AS (SELECT *, g - g1 AS g0, h - h1 AS h0, g1 * g1 / (h1 + 1) + (g - g1) * (g - g1) / (h - h1 + 1) - g * g / (h + 1) AS gain FROM sides, whole),
best AS (SELECT * FROM gains WHERE h1 >= 1 AND h0 >= 1 ORDER BY gain DESC, feature, txt LIMIT 1),
test_texts AS ({_TEST_TEXTS_SQL})"""))
def q_train_boosted_second_order(spark, sf):
    """M9: one boosting step on the categories, whose split and leaf weights SQL finds as well; p of the test sessions."""
    from ..operators import boosting, models
    from ..operators.features import build_preprocessor
    s = split_scored(spark, sf).drop("p")
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    prep = build_preprocessor(excluded_features=S.NUMERIC_FEATURES).fit(train)
    weighter = models.ClassWeighterModel(labelCol="label", weightCol="weight", weight0=1.0, weight1=5.0)
    booster = boosting.SecondOrderBooster(rounds=1, rate=1.0, depth=1, rowShare=1.0, columnShare=1.0)
    model = booster.fit(weighter.transform(prep.transform(train)))
    return models.score(model, prep.transform(test)).select(S.KEY, F.round("p", 9).alias("p"))


@register("evaluate_holdout")
def q_evaluate_holdout(spark, sf):
    from ..operators import models
    _, scored_test, _ = _fit_eval(spark, sf, "LR_baseline")
    return models.evaluate_holdout(_written_scores(scored_test), models.threshold_options())


@register("feature_importance")
def q_feature_importance(spark, sf):
    from ..operators import models
    model, scored_test, _ = _fit_eval(spark, sf, "DT_medium")
    return models.feature_importance(model, scored_test)


@register("importance_names")
def q_importance_names(spark, sf):
    from ..operators import models
    from ..operators.features import feature_names
    model, scored_test, _ = _fit_eval(spark, sf, "DT_medium")
    names = feature_names(scored_test)
    imp = models.feature_importance(model, scored_test)
    slots = spark.createDataFrame(list(enumerate(names)), "slot int, feature string")
    return slots.join(imp, "feature").select("slot", "feature", "importance")


@register("score_batch_model")
def q_score_batch_model(spark, sf):
    model, scored_test, _ = _fit_eval(spark, sf, "LR_baseline")
    return decide.with_decisions(scored_test, model_name="LR_baseline")


@register("model_save_load")
def q_model_save_load(spark, sf):
    from pyspark.ml import PipelineModel
    from ..config import scratch_path
    from ..operators import models
    model, scored_test, test = _fit_eval(spark, sf, "DT_medium")
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    again = models.score(PipelineModel.load(path), test)
    a = scored_test.select(S.KEY, F.col("p").alias("p_before"))
    b = again.select(S.KEY, F.col("p").alias("p_after"))
    return a.join(b, S.KEY).withColumn("equal", F.col("p_before") == F.col("p_after"))


@register("champion_challenger_models", with_scored(
    """SELECT c.challenger_there, count(*) AS sessions, count(*) AS agree_or_differ, 2 AS decisions_seen
    FROM splitted, (SELECT unnest([TRUE, FALSE]) AS challenger_there) c WHERE is_test GROUP BY 1""", SPLIT_SQL))
def q_champion_challenger_models(spark, sf):
    """Two fitted pipelines saved, published by role, loaded again and compared on the hold-out, with and without a challenger."""
    from ..config import scratch_path
    from ..operators import models, roles
    s = _ml_split(spark, sf)
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    model_dir, aliases = scratch_path(spark, "models"), scratch_path(spark, "aliases")
    prepared = models.PreparedFolds(train)
    names = {"champion": "DT_medium", "challenger": "LR_baseline"}
    for name in names.values():
        params = models.model_params()[name]
        prepared.pipeline(name, params, prepared.fitted(name, params, [None])[None]).write().overwrite().save(f"{model_dir}/{name}")
    both = spark.createDataFrame([(r, n, n) for r, n in names.items()], "role string, model_type string, run_id string")
    out = None
    for there in (True, False):
        roles.publish(spark, aliases, both if there else both.where("role = 'champion'"), model_dir)
        pairs = roles.compare(test, roles.load(spark, aliases))
        alike = F.col("champion_intervene") == F.col("challenger_intervene")
        counted = pairs.agg(
            F.sum("sessions").alias("sessions"),
            # without a challenger its decision is null in every row
            F.sum(F.when((alike.isNotNull() if there else alike.isNull()), F.col("sessions"))).alias("agree_or_differ"),
            F.count_distinct("champion_intervene").cast("int").alias("decisions_seen"))
        rows = counted.select(F.lit(there).alias("challenger_there"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("train_all", with_scored(
    """SELECT m.model_type, CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS test_rows,
       CAST(count(*) FILTER (WHERE is_test AND Revenue) AS BIGINT) AS test_purchases, CAST(count(*) AS BIGINT) AS data_rows,
       m.model_type <> 'LR_baseline' AS has_importances, TRUE AS auc_in_range, TRUE AS folds_agree, 2 AS roles
    FROM splitted, (SELECT unnest(['LR_baseline', 'DT_medium', 'RF_baseline', 'XGBoost']) AS model_type) m GROUP BY m.model_type""", SPLIT_SQL))
def q_train_all(spark, sf):
    """One row a model of the run log that the job wrote, with what must hold of it whatever the models learn."""
    from ..config import scratch_path
    from .training import train_all
    path = scratch_path(spark, "run-log")
    result = train_all(spark, sessions(spark, sf), path)
    log = registry.read_run_log(spark, path).where("run_name <> 'data_validation'")
    m = {k: F.element_at("metrics", F.lit(k)) for k in ("true_negatives", "false_positives", "false_negatives", "true_positives", "roc_auc", "cv_roc_auc_mean")}
    return log.select(
        F.col("run_name").alias("model_type"),
        (m["true_negatives"] + m["false_positives"] + m["false_negatives"] + m["true_positives"]).cast("long").alias("test_rows"),
        (m["false_negatives"] + m["true_positives"]).cast("long").alias("test_purchases"),
        F.element_at("artifacts", F.lit("data_rows")).cast("long").alias("data_rows"),
        F.map_contains_key("artifacts", "importances").alias("has_importances"),
        m["roc_auc"].between(0.75, 0.99).alias("auc_in_range"),
        # an AUC's standard error is at most 0.5 / sqrt(purchases)
        (F.abs(m["roc_auc"] - m["cv_roc_auc_mean"]) < 1.5 / F.sqrt(m["false_negatives"] + m["true_positives"])).alias("folds_agree"), F.lit(result.roles.count()).alias("roles"))


# --- streaming --------------------------------------------------------------------------

@register("stream_score_sessions", with_decided(
    """SELECT session_id, purchase_probability, no_purchase_probability, prediction, intervene,
       intervention_threshold, model_name, confidence FROM decided"""))
def q_stream_score_sessions(spark, sf):
    from ..config import scratch_path
    from ..streaming.scoring import stream_score_sessions
    src, sink, ckpt = (scratch_path(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    sessions(spark, sf).write.parquet(src)
    stream_score_sessions(spark, src, sink, ckpt).awaitTermination()
    return spark.read.parquet(sink).select(
        S.KEY, "purchase_probability", "no_purchase_probability", "prediction", "intervene",
        "intervention_threshold", "model_name", "confidence")


@register("stream_threshold_reload", with_scored(
    """SELECT session_id, round(p, 4) AS purchase_probability,
       CASE WHEN is_test THEN p < 3.0E-1 ELSE p BETWEEN 3.0E-1 AND 7.0E-1 END AS intervene,
       CASE WHEN is_test THEN 'lower' ELSE 'range' END AS threshold_mode, CASE WHEN is_test THEN 1 ELSE 2 END AS threshold_version
    FROM splitted""", SPLIT_SQL))
def q_stream_threshold_reload(spark, sf):
    """One running query; the hold-out arrives under the first threshold, the training part after the second was appended."""
    from ..config import scratch_path
    from ..streaming.scoring import stream_with_threshold_reload
    src, sink, ckpt, thr = (scratch_path(spark, n) for n in ("t2-src", "t2-sink", "t2-ckpt", "t2-threshold"))
    s = split_scored(spark, sf)
    test, train = (s.where(c).drop("p", "label", "fold", "is_test") for c in ("is_test", "NOT is_test"))
    registry.write_threshold(spark, thr, "lower", 0.30, 0.70)
    test.write.mode("append").parquet(src)
    query = stream_with_threshold_reload(spark, src, sink, ckpt, thr, available_now=False, interval="0 seconds")
    try:
        query.processAllAvailable()
        registry.write_threshold(spark, thr, "range", 0.30, 0.70)
        train.write.mode("append").parquet(src)
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(sink).select(S.KEY, "purchase_probability", "intervene", "threshold_mode", "threshold_version")


# --- intake: the same dirtied sessions by file and by stream -------------------------------

# every tenth kind of session is dirtied in one way; by session_id modulo 10
_DIRTY = {3: ("BounceRates", "1.5"), 5: ("ProductRelated", "abc"), 6: ("Browser", "2.0"), 7: ("Month", None), 9: ("Region", "0")}


def dirty_cells(df: DataFrame) -> DataFrame:
    """Sessions as text cells, some of them unreadable, out of range, missing or in another form."""
    kind = F.col(S.KEY) % 10
    out = {c: F.when(kind == k, F.lit(v)).otherwise(F.col(c).cast("string")) for k, (c, v) in _DIRTY.items()}
    return df.select(F.col(S.KEY).cast("string").alias(S.KEY),
                     *[out.get(c, F.col(c).cast("string")).alias(c) for c in S.ALL_FEATURES])


def _default_sql(c: str) -> str:
    default = S.DOMAINS[c][2]
    literal = f"'{default}'" if isinstance(default, str) else str(default).upper() if isinstance(default, bool) else repr(default)
    value = {"Month": "CASE WHEN session_id % 10 <> 7 THEN Month END", "Browser": "CASE WHEN session_id % 10 = 6 THEN 2 ELSE Browser END"}.get(c, c)
    return f"coalesce({value}, {literal}) AS {c}"


_INTAKE_SQL = f"""
arrived AS (SELECT session_id, {", ".join(_default_sql(c) for c in S.ALL_FEATURES)} FROM sessions),
decided AS (SELECT session_id, {P_EXPR} AS p FROM arrived WHERE session_id % 10 NOT IN (3, 5, 9)),
bad AS (SELECT session_id, CASE session_id % 10 WHEN 3 THEN 'BounceRates' WHEN 5 THEN 'ProductRelated' ELSE 'Region' END AS "column",
  CASE WHEN session_id % 10 = 5 THEN 'not a whole number in range' ELSE 'out of range' END AS reason,
  CASE session_id % 10 WHEN 3 THEN '1.5' WHEN 5 THEN 'abc' ELSE '0' END AS text FROM sessions WHERE session_id % 10 IN (3, 5, 9))"""
_INTAKE_ROWS_SQL = """SELECT session_id, round(p, 4) AS purchase_probability, p < 3.0E-1 AS intervene, NULL::VARCHAR AS "column",
    NULL::VARCHAR AS reason, NULL::VARCHAR AS text FROM decided
  UNION ALL SELECT session_id, NULL, NULL, "column", reason, text FROM bad"""


def _sides(decided: DataFrame, bad: DataFrame) -> DataFrame:
    return decided.select(S.KEY, "purchase_probability", "intervene").unionByName(
        bad.select(S.KEY, "column", "reason", "text"), allowMissingColumns=True)


@register("scan_sessions_quarantine", with_sessions(_INTAKE_ROWS_SQL).replace("\nSELECT", f",{_INTAKE_SQL}\nSELECT", 1))
def q_scan_sessions_quarantine(spark, sf):
    """CSV with unreadable and out-of-range cells; accepted sessions are scored, rejected cells kept."""
    from ..config import scratch_path
    from ..operators import intake
    path, good, bad = (scratch_path(spark, n) for n in ("dirty-csv", "accepted", "rejected"))
    dirty_cells(sessions(spark, sf)).write.option("header", True).csv(path)
    intake.split_csv(spark, path, good, bad)
    scored_ = spark.read.parquet(good).withColumn("p", C.scorecard())
    return _sides(decide.with_decisions(scored_), spark.read.parquet(bad))


@register("stream_score_json", with_sessions(
    _INTAKE_ROWS_SQL + " UNION ALL SELECT NULL, NULL, NULL, '', 'not a session object', '{\"session_id\": ' || session_id FROM sessions WHERE session_id % 10 = 1"
).replace("\nSELECT", f",{_INTAKE_SQL}\nSELECT", 1))
def q_stream_score_json(spark, sf):
    """The same cells as a stream of JSON lines, with lines that are cut off among them."""
    from ..config import scratch_path
    from ..streaming.scoring import stream_score_json
    src, sink, bad, ckpt = (scratch_path(spark, n) for n in ("json-src", "json-sink", "json-rejected", "json-ckpt"))
    rows = dirty_cells(sessions(spark, sf))
    line = F.to_json(F.struct(*rows.columns, F.lit("x").alias("unknown_field")))
    cut = F.concat(F.lit('{"session_id": '), F.col(S.KEY))
    lines = rows.select(F.explode(F.when(F.col(S.KEY).cast("long") % 10 == 1, F.array(line, cut)).otherwise(F.array(line))).alias("value"))
    lines.write.text(src)
    stream_score_json(spark, src, sink, bad, ckpt).awaitTermination()
    return _sides(spark.read.parquet(sink), spark.read.parquet(bad))


# --- fingerprints -----------------------------------------------------------------------

_FP_COLS = [S.KEY, *S.ALL_FEATURES, S.TARGET]
_FP_DOUBLES = {f.name for f in S.SESSION_FIELDS if f.dataType.simpleString() == "double"}


def _fp_text(c: str) -> str:
    x = f"CAST(floor({c} * 1000000 + 5.0E-1) AS BIGINT)" if c in _FP_DOUBLES else c
    return f"coalesce(CAST({x} AS VARCHAR), chr(0))"


@register("dataset_fingerprint", with_sessions(
    "SELECT count(*) AS rows, CAST(CAST(sum(CAST(('0x' || substr(md5(concat_ws(chr(1), "
    + ", ".join(_fp_text(c) for c in _FP_COLS)
    + ")), 1, 15)) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS fingerprint FROM sessions"))
def q_dataset_fingerprint(spark, sf):
    from ..sources.files import table_fingerprint
    fp = table_fingerprint(sessions(spark, sf), _FP_COLS)
    return fp.select("rows", F.col("fingerprint").cast("string").alias("fingerprint"))


# doubles as sign, 53-bit mantissa and exponent; the logarithm's guess is set right by the mantissa's size
_TREE_DOUBLES = [c for c in _FP_COLS if c in _FP_DOUBLES]


def _mantissa_sql(c: str, exponent: str) -> str:
    half = f"floor((52 - {exponent}) / 2.0E0)"
    return f"abs({c}) * pow(2.0E0, {half}) * pow(2.0E0, 52 - {exponent} - {half})"


_EXPONENT_SQL = ", ".join(
    f"g_{c} + CASE WHEN {_mantissa_sql(c, f'g_{c}')} >= 9007199254740992.0E0 THEN 1 "
    f"WHEN {_mantissa_sql(c, f'g_{c}')} < 4503599627370496.0E0 THEN -1 ELSE 0 END AS e_{c}" for c in _TREE_DOUBLES)


def _exact_text_sql(c: str) -> str:
    if c not in _TREE_DOUBLES:
        return f"coalesce(CAST({c} AS VARCHAR), chr(0))"
    return (f"CASE WHEN {c} IS NULL THEN chr(0) WHEN {c} = 0 THEN '0' ELSE CASE WHEN {c} < 0 THEN '-' ELSE '' END || "
            f"CAST(CAST({_mantissa_sql(c, f'e_{c}')} AS BIGINT) AS VARCHAR) || 'e' || CAST(CAST(e_{c} AS BIGINT) AS VARCHAR) END")


_TREE_LEVELS = 5  # more than 2 ** 35 keys are beyond this check
_TREE_SQL = f"""
guessed AS (SELECT *, {", ".join(f"CASE WHEN {c} <> 0 THEN floor(log2(abs({c}))) END AS g_{c}" for c in _TREE_DOUBLES)} FROM sessions),
exact AS (SELECT *, {_EXPONENT_SQL} FROM guessed),
hashed AS (SELECT session_id >> 10 AS leaf, CAST(CAST('0x' || substr(md5(concat_ws(chr(1), {", ".join(map(_exact_text_sql, _FP_COLS))})), 1, 15)
  AS BIGINT) AS DECIMAL(38,0)) AS h FROM exact),
wide AS (SELECT min(leaf) AS least, max(leaf) AS most FROM hashed),
levels AS (SELECT CAST(l AS INTEGER) AS level FROM wide, (SELECT unnest(range({_TREE_LEVELS})) AS l)
  WHERE l = 0 OR (most >> (5 * (l - 1))) - (least >> (5 * (l - 1))) > 1),
nodes AS (SELECT level, leaf >> (5 * level) AS node, count(*) AS rows, sum(h) AS h FROM hashed, levels GROUP BY ALL)"""


@register("dataset_hash_tree", with_sessions(
    f"""SELECT level, node, rows, CAST(CAST(h AS DECIMAL(38,0)) AS VARCHAR) AS hash FROM nodes
    UNION ALL SELECT (SELECT CAST(max(level) + 1 AS INTEGER) FROM levels), 0, count(*), CAST(CAST(sum(h) AS DECIMAL(38,0)) AS VARCHAR) FROM hashed"""
).replace("\nSELECT", f",{_TREE_SQL}\nSELECT", 1))
def q_dataset_hash_tree(spark, sf):
    """Hashes of the sessions by key range, doubles in exact form, summed up to one root."""
    from ..sources.hashtree import hash_tree
    return hash_tree(sessions(spark, sf).select(_FP_COLS), S.KEY).withColumn("hash", F.col("hash").cast("string"))


@register("file_fingerprint")
def q_file_fingerprint(spark, sf):
    from ..sources.files import file_fingerprint
    return file_fingerprint(spark, f"{sf.rstrip('/')}/orders.parquet").select("md5", "size")


# --- configuration applied to the data (S9, M14) ------------------------------------------

@register("threshold_config_rw", with_scored(
    """SELECT session_id, p BETWEEN 3.0E-1 AND 7.0E-1 AS intervene, 'range' AS threshold_mode,
       3.0E-1 AS intervention_threshold FROM scored"""))
def q_threshold_config_rw(spark, sf):
    """Persist a threshold config, restore it, and score every session with it."""
    from ..config import scratch_path
    path = scratch_path(spark, "threshold")
    registry.write_threshold(spark, path, "range", 0.30, 0.70)
    t = registry.read_threshold(spark, path)
    d = decide.with_decisions(scored(spark, sf), threshold=t)
    return d.select(S.KEY, "intervene", F.lit(t["mode"]).alias("threshold_mode"), "intervention_threshold")


OVERRIDES_EXAMPLE = {
    "_threshold": {"mode": "range", "lower": 0.2, "upper": 0.6},
    "_preprocessor": {"drop_duplicates": True},
}


@register("override_params", with_scored(
    f"""SELECT coalesce(CAST(count(CASE WHEN p BETWEEN 2.0E-1 AND 6.0E-1 AND Revenue THEN 1 END) AS DOUBLE)
                       / nullif(count(CASE WHEN p BETWEEN 2.0E-1 AND 6.0E-1 THEN 1 END), 0), 0.0E0)
              AS wasted_discount_rate,
       count(CASE WHEN p BETWEEN 2.0E-1 AND 6.0E-1 THEN 1 END) AS intervention_count
    FROM (SELECT min(session_id) AS session_id, {_BUSINESS}, min(p) AS p FROM scored GROUP BY {_BUSINESS})"""))
def q_override_params(spark, sf):
    """The _threshold and _preprocessor override sections applied to an evaluation."""
    from ..operators import models
    pre = models.preprocessor_options(OVERRIDES_EXAMPLE)
    thr = models.threshold_options(OVERRIDES_EXAMPLE)
    s = sessions(spark, sf)
    if pre["drop_duplicates"]:
        s = prepare.drop_duplicates(s)
    return decide.realised_wasted_rate(s.withColumn("p", C.scorecard()), threshold=thr)
