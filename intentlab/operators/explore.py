"""Dataset explorer aggregates (A10-A14, A29) and samples.

Each panel is one aggregation over the session table; group keys drop
nulls first (pandas ``groupby`` does). Only O3/O4 carry a row limit, and
there it is the feature (a fixed-size sample).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from .common import attach_scalars


def kpi_summary(sessions: DataFrame) -> DataFrame:
    """A10: sessions, purchases, non-purchases and both shares."""
    y = F.col(S.TARGET)
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count(F.when(y, 1)).alias("purchases"),
        F.count(F.when(~y, 1)).alias("non_purchases"),
    ).select(
        "sessions",
        "purchases",
        "non_purchases",
        F.try_divide("purchases", "sessions").alias("purchase_rate"),
        F.try_divide("non_purchases", "sessions").alias("non_purchase_rate"),
    )


def purchase_rate_by_month(sessions: DataFrame) -> DataFrame:
    """Purchases, sessions and rate per month, calendar order, unlisted months last."""
    return (
        sessions.where(F.col("Month").isNotNull())
        .groupBy("Month")
        .agg(F.count(F.when(F.col(S.TARGET), 1)).alias("purchases"), F.count(F.lit(1)).alias("sessions"))
        .select(
            "Month",
            "purchases",
            "sessions",
            (F.col("purchases") / F.col("sessions")).alias("purchase_rate"),
            C.month_ordinal("Month").alias("month_order"),
        )
        .orderBy(F.asc_nulls_last("month_order"), "Month")
    )


def sessions_by_visitor_type(sessions: DataFrame) -> DataFrame:
    """Sessions per visitor type and purchase outcome (present pairs only)."""
    return (
        sessions.where(F.col("VisitorType").isNotNull() & F.col(S.TARGET).isNotNull())
        .groupBy("VisitorType", C.purchased_label().alias("Purchased"))
        .agg(F.count(F.lit(1)).alias("sessions"))
    )


def sessions_by_weekend(sessions: DataFrame) -> DataFrame:
    """Sessions per weekend flag and purchase outcome, relabelled."""
    wk = C.weekend_to_text("Weekend")
    return (
        sessions.where(F.col(S.TARGET).isNotNull())
        .groupBy(wk.alias("_wk"), C.purchased_label().alias("Purchased"))
        .agg(F.count(F.lit(1)).alias("sessions"))
        .select(C.weekend_label("_wk").alias("Weekend"), "Purchased", "sessions")
    )


def page_value_histogram(sessions: DataFrame, bins: int = 50, col: str = "PageValues") -> DataFrame:
    """Equal-width bins between min and max of the column, per purchase class.

    The one-row min/max aggregate is attached (bounded broadcast), so the
    whole histogram is two scans and no collect. Last bin closed.
    """
    x = F.col(col)
    base = sessions.where(x.isNotNull() & F.col(S.TARGET).isNotNull())
    rng = base.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.floor((x - F.col("_lo")) / w).cast("int"), F.lit(bins - 1)))
    return (
        attach_scalars(base, rng)
        .groupBy(b.alias("bin"), C.purchased_label().alias("Purchased"))
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.min("_lo").alias("_lo"),
            F.min("_hi").alias("_hi"),
        )
        .select(
            "bin",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) / bins * F.col("bin")).alias("bin_lo"),
            "Purchased",
            "sessions",
        )
    )


def batch_profile(sessions: DataFrame) -> DataFrame:
    """Per visitor type the count and share, with batch size and revenue rate."""
    totals = sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg(F.col(S.TARGET).cast("double")).alias("revenue_rate"),
    )
    per = sessions.where(F.col("VisitorType").isNotNull()).groupBy("VisitorType").agg(
        F.count(F.lit(1)).alias("sessions")
    )
    return attach_scalars(per, totals).select(
        "VisitorType",
        "sessions",
        (F.col("sessions") / F.col("total_sessions")).alias("share"),
        "total_sessions",
        "revenue_rate",
    )


def head_sample(sessions: DataFrame, n: int = 50) -> DataFrame:
    """O3: the first n sessions by key, feature columns (a top-n: TakeOrderedAndProject)."""
    return sessions.orderBy(S.KEY).limit(n).select(S.KEY, *S.ALL_FEATURES)


def random_sample_n(sessions: DataFrame, n: int = 2000, seed: int = S.RANDOM_STATE) -> DataFrame:
    """Exactly min(n, rows) sessions without replacement, fixed seed.

    Seeded hash order + limit, planned as a distributed top-n (each task
    keeps n rows), unlike ``sample`` which is not exact in size.
    """
    return (
        sessions.orderBy(C.hash_order(S.KEY, seed), S.KEY)
        .limit(n)
        .select(S.KEY, "BounceRates", "ExitRates", C.purchased_label().alias("Purchased"))
    )


def score_scatter(decided_with_features: DataFrame) -> DataFrame:
    """PageValues against rounded p with status, for every scored row."""
    return decided_with_features.select(
        S.KEY, "PageValues", "purchase_probability", C.status_label("intervene").alias("status")
    )
