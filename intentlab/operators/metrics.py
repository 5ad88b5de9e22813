"""Classification measures as single-pass aggregations, and exact ROC AUC.

All take a DataFrame with an integer label column (0/1), a predicted class
and/or a score, and optional ``by`` grouping columns (e.g. run or fold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import prefix_sums

_DEC = "decimal(38,0)"


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction",
                     by: list[str] | None = None) -> DataFrame:
    """TN, FP, FN, TP (four conditional counts in one pass)."""
    y, yh = F.col(label), F.col(pred)
    return df.groupBy(*(by or [])).agg(
        F.count(F.when((y == 0) & (yh == 0), 1)).alias("true_negatives"),
        F.count(F.when((y == 0) & (yh == 1), 1)).alias("false_positives"),
        F.count(F.when((y == 1) & (yh == 0), 1)).alias("false_negatives"),
        F.count(F.when((y == 1) & (yh == 1), 1)).alias("true_positives"),
    )


def _ratio(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                           by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on a zero denominator)."""
    by = by or []
    cm = confusion_matrix(df, label, pred, by)
    tn, fp, fn, tp = (F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    return cm.select(
        *by,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "p", by: list[str] | None = None,
            n_buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC (Mann-Whitney, ties count one half) per group.

    Rows are first counted per distinct score, so the ordered pass runs
    over distinct scores only; the running count of negatives comes from a
    range-partitioned prefix sum (no single-partition window). Integer
    arithmetic in DECIMAL(38,0) keeps the pair count exact. Null when a
    group holds one class only.
    """
    by = by or []
    y = F.col(label).cast("int")
    counted = (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("_s"))
        .agg(F.count(F.when(y == 1, 1)).alias("_pos"), F.count(F.when(y == 0, 1)).alias("_neg"))
    )
    cum = prefix_sums(counted, ["_s"], ["_neg"], by=by, n_buckets=n_buckets)
    pos, neg = F.col("_pos").cast(_DEC), F.col("_neg").cast(_DEC)
    below = (F.col("_neg_cum") - F.col("_neg")).cast(_DEC)
    agg = cum.groupBy(*by).agg(
        F.sum(2 * pos * below + pos * neg).alias("_u2"),
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
    )
    return agg.select(
        *by,
        F.when((F.col("_p") > 0) & (F.col("_n") > 0),
               F.col("_u2").cast("double") / (2 * F.col("_p") * F.col("_n")).cast("double")).alias("roc_auc"),
        F.col("_p").cast("long").alias("positives"),
        F.col("_n").cast("long").alias("negatives"),
    )


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                          names: tuple[str, str] = ("No Purchase", "Purchase")) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages.

    One aggregation over (label, prediction) pairs (4 rows), then derived
    rows; the summary rows are a union of one-row frames.
    """
    cm = confusion_matrix(df, label, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    total = tn + fp + fn + tp

    def cls(name, t_p, f_p, f_n, support):
        prec = _ratio(t_p, t_p + f_p)
        rec = _ratio(t_p, t_p + f_n)
        f1 = _ratio(2 * t_p, 2 * t_p + f_p + f_n)
        return F.struct(F.lit(name).alias("class"), prec.alias("precision"), rec.alias("recall"),
                        f1.alias("f1_score"), support.cast("double").alias("support"))

    c0 = cls(names[0], tn, fn, fp, tn + fp)
    c1 = cls(names[1], tp, fp, fn, tp + fn)
    wide = cm.select(c0.alias("c0"), c1.alias("c1"), total.alias("total"), (tp + tn).alias("correct"))
    acc = _ratio(F.col("correct"), F.col("total"))
    rows = wide.select(F.explode(F.array(
        F.col("c0"),
        F.col("c1"),
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), acc.alias("f1_score"),
                 F.col("total").cast("double").alias("support")),
        F.struct(F.lit("macro avg").alias("class"),
                 ((F.col("c0.precision") + F.col("c1.precision")) / 2).alias("precision"),
                 ((F.col("c0.recall") + F.col("c1.recall")) / 2).alias("recall"),
                 ((F.col("c0.f1_score") + F.col("c1.f1_score")) / 2).alias("f1_score"),
                 F.col("total").cast("double").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"),
                 _ratio(F.col("c0.precision") * F.col("c0.support") + F.col("c1.precision") * F.col("c1.support"),
                        F.col("total")).alias("precision"),
                 _ratio(F.col("c0.recall") * F.col("c0.support") + F.col("c1.recall") * F.col("c1.support"),
                        F.col("total")).alias("recall"),
                 _ratio(F.col("c0.f1_score") * F.col("c0.support") + F.col("c1.f1_score") * F.col("c1.support"),
                        F.col("total")).alias("f1_score"),
                 F.col("total").cast("double").alias("support")),
    )).alias("r"))
    return rows.select("r.*")


def cv_summary(fold_scores: DataFrame, metric: str = "auc", by: list[str] | None = None) -> DataFrame:
    """Mean and population std of the fold scores."""
    return fold_scores.groupBy(*(by or [])).agg(
        F.avg(metric).alias("cv_roc_auc_mean"),
        F.stddev_pop(metric).alias("cv_roc_auc_std"),
        F.count(metric).alias("folds"),
    )
