"""Column expressions (all JVM-side, inside whole-stage codegen).

Each function returns a ``Column``; nothing here starts a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from . import text


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- casts and text forms --------------------------------------------------

def target_int(col="Revenue") -> Column:
    """Boolean target as 1/0."""
    return _c(col).cast("int")


def weekend_to_text(col="Weekend") -> Column:
    """Boolean as "True"/"False"; null as the text "nan"."""
    return F.coalesce(F.initcap(_c(col).cast("string")), F.lit("nan"))


def weekend_from_text(col) -> Column:
    """P5: true iff the text is one of WEEKEND_TRUE_TEXTS; null is false."""
    return F.coalesce(_c(col).cast("string").isin(*S.WEEKEND_TRUE_TEXTS), F.lit(False))


def integer_normalise(col) -> Column:
    """Truncate toward zero to int (like Python ``int``); NaN and out-of-range values are null."""
    return _c(col).try_cast("int")


def nan_to_null(col) -> Column:
    c = _c(col)
    return F.when(~F.isnan(c), c)


# the label texts below are fixed values

def purchased_label(col="Revenue") -> Column:
    """Revenue -> Purchase / No Purchase (null stays null)."""
    c = _c(col)
    return F.when(c, F.lit("Purchase")).when(~c, F.lit("No Purchase"))


def weekend_label(col) -> Column:
    """P7: "True"/"False" text -> Weekend / Weekday; anything else null."""
    c = _c(col)
    return F.when(c == "True", F.lit("Weekend")).when(c == "False", F.lit("Weekday"))


def prediction_label(col="prediction") -> Column:
    c = _c(col)
    return F.when(c == 1, F.lit("Purchase")).otherwise(F.lit("No Purchase"))


def status_label(col="intervene") -> Column:
    c = _c(col)
    return F.when(c, F.lit("Intervene")).otherwise(F.lit("No Intervention"))


# --- probabilities and decisions --------------------------------------------

def complement_round(p="p"):
    """(round(p, 4), round(1 - p, 4))."""
    pc = _c(p)
    return F.round(pc, 4), F.round(F.lit(1.0) - pc, 4)


def intervene_lower(p="p", lower: float = S.INTERVENTION_THRESHOLD) -> Column:
    """P10: flag iff p < lower (strict), on the unrounded p."""
    return _c(p) < F.lit(float(lower))


def intervene_range(p="p", lower: float = 0.30, upper: float = 0.70) -> Column:
    """Flag iff lower <= p <= upper."""
    return _c(p).between(F.lit(float(lower)), F.lit(float(upper)))


def intervene(p="p", mode: str = "lower", lower: float = 0.30, upper: float = 0.70) -> Column:
    """Any mode other than "range" acts as "lower"."""
    if mode == "range":
        return intervene_range(p, lower, upper)
    return intervene_lower(p, lower)


def intervene_by_config(p, mode: Column, lower: Column, upper: Column) -> Column:
    """Decision with the threshold given as columns (e.g. a one-row config table)."""
    pc = _c(p)
    return F.when(mode == "range", pc.between(lower, upper)).otherwise(pc < lower)


def confidence_bucket(p="p") -> Column:
    """|p - 0.5| > 0.35 High, > 0.15 Medium, else Low."""
    gap = F.abs(_c(p) - F.lit(0.5))
    return (
        F.when(gap > F.lit(S.CONFIDENCE_HIGH_GAP), F.lit("High"))
        .when(gap > F.lit(S.CONFIDENCE_MEDIUM_GAP), F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def predicted_class(p="p") -> Column:
    """Class at 0.5, a tie goes to 0."""
    return (_c(p) > F.lit(0.5)).cast("int")


def month_ordinal(col="Month") -> Column:
    """1-based position in MONTH_ORDER; null when off the list."""
    pos = F.array_position(F.array(*[F.lit(m) for m in S.MONTH_ORDER]), _c(col))
    return F.when(pos > 0, pos.cast("int"))


def percent_text(col, decimals: int = 1) -> Column:
    """P15: "xx.x%" with Python's rounding (null -> em dash)."""
    return text.percent(_c(col), decimals)


def decimal_text(col, decimals: int = 4) -> Column:
    """Fixed decimals with Python's rounding (null -> em dash)."""
    return text.fixed(_c(col), decimals)


def _pct0(c: Column) -> Column:
    return text.py_format(c, ".0%", null_text=None)


def threshold_text(mode, lower, upper, live_mode, live_lower, live_upper) -> Column:
    """P16: "a% – b%" in range mode, "< a%" otherwise; live config as fallback."""
    mode, lower, upper = _c(mode), _c(lower), _c(upper)
    live_mode, live_lower, live_upper = _c(live_mode), _c(live_lower), _c(live_upper)
    dash = F.lit(" – ")
    return (
        F.when((mode == "range") & lower.isNotNull() & upper.isNotNull(), F.concat(_pct0(lower), dash, _pct0(upper)))
        .when(lower.isNotNull(), F.concat(F.lit("< "), _pct0(lower)))
        .when(live_mode == "range", F.concat(_pct0(live_lower), dash, _pct0(live_upper)))
        .otherwise(F.concat(F.lit("< "), _pct0(live_lower)))
    )


def wdr_label(mode, lower, upper) -> Column:
    """Label of the wasted-discount measure matching the threshold."""
    mode, lower, upper = _c(mode), _c(lower), _c(upper)
    return (
        F.when((mode == "range") & lower.isNotNull() & upper.isNotNull(),
               F.concat(F.lit("Wasted Discount ("), _pct0(lower), F.lit("–"), _pct0(upper), F.lit(")")))
        .when(lower.isNotNull(), F.concat(F.lit("Wasted Discount (< "), _pct0(lower), F.lit(")")))
        .otherwise(F.lit("Wasted Discount"))
    )


# --- re-aimed generator rules ------------------------------------------------

def clip_round(col: str) -> Column:
    """Clip to the declared bounds, then round to the column's places."""
    lo, hi, places = S.CLIP_ROUND[col]
    c = F.col(col)
    if hi is not None:
        c = F.least(F.lit(hi), c)
    if lo is not None:
        c = F.greatest(F.lit(lo), c)
    if places is not None:
        c = F.round(c, places)
    return c


def scorecard(prefix: str = "", excluded: tuple[str, ...] = ()) -> Column:
    """Additive purchase-propensity rule, clipped to [0.01, 0.95].

    A null PageValues makes the sum null; such a session scores 0.01.
    ``excluded`` drops the terms of excluded features (null-safe: an
    excluded feature contributes nothing).
    """
    sc = S.SCORECARD
    col = lambda n: F.col(prefix + n)
    lo_b, mid_b = sc["tier_bounds"]
    b_low, b_mid, b_high = sc["tier_base"]
    zero = F.lit(0.0)
    if "ProductRelated" in excluded:
        raw = F.lit(b_low)
    else:
        pr = col("ProductRelated")
        raw = F.when(pr < lo_b, F.lit(b_low)).when(pr < mid_b, F.lit(b_mid)).otherwise(F.lit(b_high))
    if "VisitorType" not in excluded:
        vt = col("VisitorType")
        raw = raw + F.when(vt == "Returning_Visitor", F.lit(sc["returning"])).otherwise(zero)
        raw = raw + F.when(vt == "New_Visitor", F.lit(sc["new"])).otherwise(zero)
    if "PageValues" not in excluded:
        raw = raw + col("PageValues") / sc["page_value_scale"] * sc["page_value_weight"]
    if "BounceRates" not in excluded:
        raw = raw - F.coalesce(col("BounceRates"), zero) * sc["bounce_weight"]
    if "Weekend" not in excluded:
        raw = raw + F.when(col("Weekend"), F.lit(sc["weekend"])).otherwise(zero)
    if "SpecialDay" not in excluded:
        raw = raw + col("SpecialDay") * sc["special_day_weight"]
    if "Month" not in excluded:
        raw = raw + F.when(col("Month").isin(*sc["holiday_months"]), F.lit(sc["holiday"])).otherwise(zero)
    lo, hi = sc["clip"]
    # a session without PageValues has no score: it takes the lower bound
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(raw, F.lit(lo))))


def outlier_flag(bounds: dict | None = None) -> Column:
    """Extreme-engagement session (all bounds inclusive)."""
    b = bounds or S.OUTLIER_BOUNDS
    return (
        (F.col("ProductRelated") >= b["ProductRelated"])
        & (F.col("ProductRelated_Duration") >= b["ProductRelated_Duration"])
        & (F.col("PageValues") >= b["PageValues"])
    )


def hash_order(key: str = S.KEY, seed: int = S.RANDOM_STATE) -> Column:
    """Seeded, partition-independent order key: md5(id || ':' || seed)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
