"""Ordered operations without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task,
and ``partitionBy(label)`` moves half the table into one task. Here the
order key is first cut into buckets that are monotone in the order:

* a uniform hash digest (md5) is bucketed by its leading hex digits, or
* a numeric key by quantile bounds (one ``approxQuantile`` pass) through
  ``Bucketizer`` (a binary search, JVM-side).

Running counts/sums are then taken inside (group, bucket) window
partitions and shifted by the totals of the earlier buckets of the same
group. The bucket-totals table has at most groups x buckets rows. Every
step is deterministic, so re-executed tasks (lost executors) give the
same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import shuffle_partitions


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def hash_bucket(hex_digest: Column, digits: int = 4) -> Column:
    """Bucket id from the leading hex digits of a uniform digest (monotone in it).

    4 digits = 65,536 buckets: about a million rows per window partition at
    6 * 10^10 rows, and a bucket-totals table of at most 2^16 rows per group,
    which one task a group sums and the join can broadcast.
    """
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("long")


def default_buckets(df: DataFrame) -> int:
    return max(16, min(4096, 4 * shuffle_partitions(df.sparkSession)))


def quantile_splits(df: DataFrame, cols: list[str], n: int) -> list[list[float]]:
    """Bucketizer splits per column from approximate quantiles (one pass, small result)."""
    probs = [i / n for i in range(1, n)]
    res = df.approxQuantile(cols, probs, 1.0 / (4 * n))
    out = []
    for b in res:
        inner = sorted({float(x) for x in b if x is not None and not math.isnan(x) and not math.isinf(x)})
        out.append([-math.inf] + inner + [math.inf])
    return out


def with_quantile_buckets(df: DataFrame, cols: list[str], outs: list[str], n: int | None = None) -> DataFrame:
    """Adds a bucket column per numeric column, monotone in that column."""
    n = n or default_buckets(df)
    tmp = [f"_qb_in_{i}" for i in range(len(cols))]
    staged = df.select("*", *[F.col(c).cast("double").alias(t) for c, t in zip(cols, tmp)])
    splits = quantile_splits(staged, tmp, n)
    b = Bucketizer(splitsArray=splits, inputCols=tmp, outputCols=outs, handleInvalid="keep")
    out = b.transform(staged).drop(*tmp)
    return out.select(*[F.col(c) for c in df.columns], *[F.col(o).cast("int").alias(o) for o in outs])


def prefix_sums(df: DataFrame, order: Sequence, values: Sequence[str], by: Sequence[str] = (),
                bucket: str | None = None, suffix: str = "_cum", n_buckets: int | None = None,
                with_totals: bool = False) -> DataFrame:
    """Inclusive running sums of ``values`` within ``by`` groups following ``order``.

    ``order`` must be total within a group (pre-aggregate equal keys first).
    ``bucket`` names a column monotone in ``order``; if absent, quantile
    buckets of the first order column are computed. Adds ``<v><suffix>``,
    and with ``with_totals`` the group total ``<v>_total`` (taken from the
    small bucket-totals table, not from another pass over the input).
    """
    by = list(by)
    if bucket is None:
        first = order[0] if isinstance(order[0], str) else None
        if first is None:
            raise ValueError("give a bucket column or a named numeric first order column")
        df = with_quantile_buckets(df, [first], ["_bk"], n_buckets)
        bucket = "_bk"
    w_in = Window.partitionBy(*by, bucket).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(v).over(w_in).alias(f"_{v}_loc") for v in values])
    totals = df.groupBy(*by, bucket).agg(*[F.sum(v).alias(f"_{v}_tot") for v in values])
    w_off = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*by)
    offsets = totals.select(
        *by, bucket, *[F.coalesce(F.sum(f"_{v}_tot").over(w_off), F.lit(0)).alias(f"_{v}_off") for v in values],
        *([F.sum(f"_{v}_tot").over(w_all).alias(f"{v}_total") for v in values] if with_totals else []),
    )
    out = local.join(offsets, [*by, bucket])
    for v in values:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_{v}_loc") + F.col(f"_{v}_off"))
    drop = [f"_{v}_loc" for v in values] + [f"_{v}_off" for v in values] + (["_bk"] if bucket == "_bk" else [])
    return out.drop(*drop)


def row_number_by(df: DataFrame, order: Sequence, by: Sequence[str] = (), out: str = "rn",
                  bucket: str | None = None, n_buckets: int | None = None,
                  with_group_size: bool = False) -> DataFrame:
    """1-based row number within ``by`` groups following ``order`` (a total order).

    ``with_group_size`` also adds ``<out>_n``, the size of the row's group.
    """
    one = "_one_rn"
    res = prefix_sums(df.withColumn(one, F.lit(1)), order, [one], by=by, bucket=bucket, n_buckets=n_buckets,
                      with_totals=with_group_size)
    res = res.withColumnRenamed(f"{one}_cum", out)
    if with_group_size:
        res = res.withColumnRenamed(f"{one}_total", f"{out}_n")
    return res.drop(one)


def exact_quantile_ranks(n: Column, q: float = 0.5):
    """Ranks (1-based) around the q-quantile and the interpolation fraction
    (linear between the two closest ranks, numpy's default)."""
    pos = (n - 1) * F.lit(q) + 1
    return F.floor(pos).cast("long"), F.ceil(pos).cast("long"), pos - F.floor(pos)


def exact_quantiles(long_df: DataFrame, key: str, value: str, qs: Sequence[float] = (0.5,),
                    midpoint: str = "mean", n_buckets: int | None = None,
                    bucket: Column | None = None) -> DataFrame:
    """Exact quantiles of ``value`` per ``key`` (long form), nulls ignored.

    Equal values are first counted (a value that holds a third of the rows
    becomes one row), then the running count finds the value at each rank.
    Linear interpolation between neighbouring ranks, as numpy/sklearn and
    ``percentile_cont``. ``midpoint="mean"`` takes the median of an even
    count as (a + b) / 2 like numpy; "interpolate" as a + (b - a) / 2.
    ``bucket`` may give a bucket expression monotone in ``value`` (e.g.
    fixed-width bins of a bounded score), which saves the quantile pass.
    Returns one row per key: key, n, q_<i> columns.
    """
    return quantiles_from_counts(value_counts(long_df, key, value), key, value, qs, midpoint, n_buckets, bucket)


def value_counts(long_df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, _c): how often each non-null value occurs per key."""
    return long_df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))


def quantiles_from_counts(v: DataFrame, key: str, value: str, qs: Sequence[float] = (0.5,),
                          midpoint: str = "mean", n_buckets: int | None = None,
                          bucket: Column | None = None) -> DataFrame:
    """``exact_quantiles`` over a ``value_counts`` table (which callers may cache)."""
    if bucket is not None:
        cum = prefix_sums(v.withColumn("_fb", bucket), [value], ["_c"], by=[key], bucket="_fb",
                          with_totals=True).drop("_fb")
    else:
        cum = prefix_sums(v, [value], ["_c"], by=[key], n_buckets=n_buckets, with_totals=True)
    cum = cum.withColumnRenamed("_c_total", "_n").withColumn("_lo_rank", F.col("_c_cum") - F.col("_c") + 1)
    aggs = []
    for i, q in enumerate(qs):
        r_lo, r_hi, frac = exact_quantile_ranks(F.col("_n"), q)
        at_lo = (F.col("_lo_rank") <= r_lo) & (F.col("_c_cum") >= r_lo)
        at_hi = (F.col("_lo_rank") <= r_hi) & (F.col("_c_cum") >= r_hi)
        aggs.append(F.max(F.when(at_lo, F.col(value))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(at_hi, F.col(value))).alias(f"_hi{i}"))
        aggs.append(F.first(frac).alias(f"_f{i}"))
    picked = cum.groupBy(key).agg(F.first("_n").alias("n"), F.min(value).alias("v_min"),
                                  F.max(value).alias("v_max"), *aggs)
    sel = [F.col(key), F.col("n"), F.col("v_min"), F.col("v_max")]
    for i, q in enumerate(qs):
        lo, hi, fr = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        if q == 0.5 and midpoint == "mean":  # the mean of the two middle values, as numpy's median
            sel.append(((lo + hi) / 2).alias(f"q_{i}"))
        else:
            sel.append(F.when(fr == 0, lo).otherwise(lo + (hi - lo) * fr).alias(f"q_{i}"))
    return picked.select(*sel)
