"""Exact stratified hold-out, stratified folds and class weights.

Rows are ordered by a seeded hash of the key (partition-independent), and
ranked within their class by a range-partitioned row number, so a class
holding most of the table is spread over all tasks. The test part of
class c is its first round(test_size * n_c) rows; the remaining rows get
fold (rank - 1) mod k in the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..config import materialize
from ..functions import columns as C
from .ranking import hash_bucket, row_number_by


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_c"))


def assign_split(df: DataFrame, label: str = "label", test_size: float = S.TEST_SIZE, folds: int = S.CV_FOLDS,
                 seed: int = S.RANDOM_STATE, key: str = S.KEY) -> DataFrame:
    """W1 + W2: adds ``is_test`` and ``fold`` (null for test rows).

    The class sizes come with the ranking (from its small bucket-totals
    table), so no separate counting pass or join is needed. The rows are written
    first, so that ranking and bucket totals do not derive them twice.
    """
    df = materialize(df, "split-rows")
    hashed = df.withColumn("_h", C.hash_order(key, seed)).withColumn("_hb", hash_bucket(F.col("_h")))
    ranked = row_number_by(hashed, [F.col("_h"), F.col(key)], by=[label], out="_rk", bucket="_hb",
                           with_group_size=True)
    j = ranked.withColumn("_k", F.round(F.col("_rk_n") * float(test_size)).cast("long"))
    is_test = F.col("_rk") <= F.col("_k")
    return j.select(
        *df.columns,
        is_test.alias("is_test"),
        F.when(~is_test, ((F.col("_rk") - F.col("_k") - 1) % folds).cast("int")).alias("fold"),
    )


def stratified_split(df: DataFrame, label: str = "label", **kw) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly round(test_size * n_c) test rows per class."""
    s = assign_split(df, label, **kw)
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test", "fold")


def class_balance_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Weight n / (classes * n_c) per row (sklearn's "balanced")."""
    counts = class_counts(df, label)
    totals = counts.agg(F.sum("_n_c").alias("_n"), F.count(F.lit(1)).alias("_classes"))
    w = counts.join(F.broadcast(totals), how="left_outer", on=F.lit(True)).select(
        label, (F.col("_n") / (F.col("_classes") * F.col("_n_c"))).alias(out)
    )
    return df.join(F.broadcast(w), label)


def positive_weight(df: DataFrame, label: str = "label", pos_weight: float = 5.0, out: str = "weight") -> DataFrame:
    """Weight ``pos_weight`` for positives and 1 otherwise (boosting's scale_pos_weight)."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))
