"""Projections, request-domain checks and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C


def active_features(excluded: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical features left after exclusions.

    ``excluded`` may name features or groups (``Technical``, ``Engagement``).
    """
    names: set[str] = set()
    for e in excluded or []:
        names.update(S.FEATURE_GROUPS.get(e, [e]))
    return ([c for c in S.NUMERIC_FEATURES if c not in names],
            [c for c in S.CATEGORICAL_FEATURES if c not in names])


def project_features(df: DataFrame, excluded: list[str] | None = None, keep_key: bool = True,
                     keep_target: bool = True) -> DataFrame:
    """Key, active features, target as 1/0 (``label``)."""
    num, cat = active_features(excluded)
    cols = ([S.KEY] if keep_key and S.KEY in df.columns else []) + num + cat
    out = [F.col(c) for c in cols]
    if keep_target and S.TARGET in df.columns:
        out.append(C.target_int(S.TARGET).alias("label"))
    return df.select(*out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is not null in Spark (and NaN > 1 is true); make it null first."""
    sel = [C.nan_to_null(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*sel)


def normalise_request(df: DataFrame) -> DataFrame:
    """Weekend from text and integer truncation of count/code columns."""
    sel = []
    for c, t in df.dtypes:
        if c == "Weekend":
            sel.append(C.weekend_from_text(c).alias(c))
        elif c in S.INTEGER_COLUMNS:
            sel.append(C.integer_normalise(c).alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


def domain_validate_rows(df: DataFrame) -> DataFrame:
    """Defaults for missing values, then the list of range violations per row.

    Adds ``violations`` (array of column names out of their declared range);
    ``accepted = size(violations) = 0``. Split with ``where``.
    """
    sel, checks = [], []
    for c in df.columns:
        if c not in S.DOMAINS:
            sel.append(F.col(c))
            continue
        lo, hi, default = S.DOMAINS[c]
        v = F.coalesce(F.col(c), F.lit(default)).alias(c)
        sel.append(v)
        cond = None
        if lo is not None:
            cond = F.coalesce(F.col(c), F.lit(default)) < F.lit(lo)
        if hi is not None:
            up = F.coalesce(F.col(c), F.lit(default)) > F.lit(hi)
            cond = up if cond is None else (cond | up)
        if cond is not None:
            checks.append(F.when(cond, F.lit(c)))
    viol = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast("array<string>")
    return df.select(*sel, viol.alias("violations")).withColumn("accepted", F.size("violations") == 0)


def clip_round_domain(df: DataFrame) -> DataFrame:
    """Clip each listed column to its bounds and round to its places."""
    return df.select(*[C.clip_round(c).alias(c) if c in S.CLIP_ROUND else F.col(c) for c in df.columns])


def flag_outliers(df: DataFrame, bounds: dict | None = None) -> DataFrame:
    """Adds ``outlier`` for extreme-engagement sessions."""
    return df.withColumn("outlier", F.coalesce(C.outlier_flag(bounds), F.lit(False)))


def drop_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Remove exact duplicates over the business columns, keep the first (smallest key).

    One aggregation keyed by all business columns: copies combine map-side,
    so a group of copies holding a third of the table never lands whole in
    one task.
    """
    cols = columns or [c for c in df.columns if c != S.KEY]
    return df.groupBy(*cols).agg(F.min(S.KEY).alias(S.KEY)).select(*df.columns)
