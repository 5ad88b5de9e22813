"""Exact order statistics by bracketing.

One pass sketches the values (KLL, mergeable, JVM-side) of every column and
group. The sketches of any union of groups merge, so one pass serves
overlapping sets such as the complements of folds. The merged sketch gives a
bracket of values around the wanted rank. A second pass counts what lies below the
bracket and how often each value inside it occurs: values above it are dropped and
those below it become one row a task, so only the inside (``MARGIN`` on either side of the rank) is
shuffled. The value at the rank is then found by running counts over
equally wide bins of the bracket. Counts are exact, so they show whether the rank
lies inside; if the sketch missed it, the bracket grows on that side. The
sketch decides only how much is shuffled, never the result.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .ranking import prefix_sums

SKETCH_K = 2048
MARGIN = 0.006  # of the rows, on either side; above twice the sketch's 99 % error of 0.0024
BINS = 1024


@dataclass(frozen=True)
class Slot:
    """One order statistic: a column over the rows of some groups."""

    column: str
    groups: tuple | None  # None: all rows


def number(column: str) -> Column:
    return C.nan_to_null(F.col(column).cast("double"))


def sketch_aggregates(cols: list[str]) -> list[Column]:
    """Count and sketch of every column, to be used in any grouped aggregation."""
    out = []
    for c in cols:
        out.append(F.count(number(c)).alias(f"n_{c}"))
        out.append(F.kll_sketch_agg_double(number(c), SKETCH_K).alias(f"kll_{c}"))
    return out


def _brackets(sketches: DataFrame, group: str | None, slots: list[Slot], q: float) -> dict[int, tuple]:
    """Per slot the number of values, the bracket of its rank, least and greatest value; slots without values are left out.

    ``sketches`` has one row a group. Merging happens in Spark; one row a slot comes back.
    """
    # a group's row is handed to every slot that it belongs to
    entries = [F.struct(F.lit(i).alias("slot"), F.col(f"n_{s.column}").alias("n"), F.col(f"kll_{s.column}").alias("kll"))
               for i, s in enumerate(slots)]
    entries = [e if s.groups is None else F.when(F.col(group).isin(list(s.groups)), e) for e, s in zip(entries, slots)]
    table = sketches.select(F.inline(F.array_compact(F.array(*entries))))
    merged = table.where("n > 0").groupBy("slot").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("kll", SKETCH_K).alias("kll"))
    lo, hi = max(0.0, q - MARGIN), min(1.0, q + MARGIN)
    points = [F.kll_sketch_get_quantile_double("kll", F.lit(p)) for p in (lo, hi, 0.0, 1.0)]
    return {r[0]: tuple(r)[1:] for r in merged.select("slot", "n", *points).collect()}  # one row a slot


def _ranks(n: int, q: float) -> tuple[int, int, float]:
    at = (n - 1) * q + 1
    return math.floor(at), math.ceil(at), at - math.floor(at)


def _inside(df: DataFrame, group: str | None, slots: list[Slot], bounds: dict[int, tuple[float, float]]) -> DataFrame:
    """(slot, value, c): how often each value inside its slot's bracket occurs; null counts what lies below.

    A row has one entry a column, whatever the number of slots: values are counted by group inside the hull of the brackets
    that the group takes part in, and the counts are then handed to every slot.
    """
    named = sorted({g for i in bounds for g in slots[i].groups or ()}, key=repr)
    columns = sorted({slots[i].column for i in bounds})
    # the last place is that of rows of other groups, which only slots of all rows take
    place = F.coalesce(*[F.when(F.col(group) == g, F.lit(k)) for k, g in enumerate(named)], F.lit(len(named)))
    takes = [[[i for i in sorted(bounds) if slots[i].column == c and (slots[i].groups is None or (k < len(named) and named[k] in slots[i].groups))]
              for k in range(len(named) + 1)] for c in columns]

    def constant(values: list, of: str) -> Column:
        return F.from_json(F.lit(json.dumps(values)), of)
    entries = []
    for j, c in enumerate(columns):
        hull = [(min(bounds[i][0] for i in at), max(bounds[i][1] for i in at)) if at else (None, None) for at in takes[j]]
        lo, hi = (F.element_at(constant([h[side] for h in hull], "array<double>"), F.col("_place") + 1) for side in (0, 1))
        x = number(c)
        entries.append(F.when(x <= hi, F.struct(F.lit(j).alias("column"), F.when(x >= lo, x).alias("value"))))
    rows = df.withColumn("_place", place).select("_place", F.explode(F.array(*entries)).alias("e")).where("e.column is not null")
    counts = rows.groupBy("_place", F.col("e.column").alias("column"), F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    of_entry = F.element_at(F.element_at(constant(takes, "array<array<array<int>>>"), F.col("column") + 1), F.col("_place") + 1)
    lo, hi = (F.element_at(constant([bounds.get(i, (None, None))[side] for i in range(len(slots))], "array<double>"), F.col("slot") + 1)
              for side in (0, 1))
    each = counts.select(F.explode(of_entry).alias("slot"), "value", "c").where(F.col("value").isNull() | (F.col("value") <= hi))
    return each.groupBy("slot", F.when(F.col("value") >= lo, F.col("value")).alias("value")).agg(F.sum("c").alias("c"))


def exact_quantiles(df: DataFrame, slots: list[Slot], q: float = 0.5, group: str | None = None,
                    sketches: DataFrame | None = None, midpoint: bool = True) -> list[float | None]:
    """The exact q-quantile of every slot (null without values; NaN counts as null).

    ``sketches`` may hold one row a group with the columns of ``sketch_aggregates``,
    if another pass has taken them already. ``midpoint``: between two ranks the mean of the two values,
    as numpy's median; else linear interpolation.
    """
    cols = sorted({s.column for s in slots})
    if sketches is None:
        keys = [group] if group else []
        sketches = df.groupBy(*keys).agg(*sketch_aggregates(cols))
    sized = _brackets(sketches, group, slots, q)
    open_, out = {i: found[1:3] for i, found in sized.items()}, [None] * len(slots)
    while open_:
        span = F.create_map(*[F.lit(x) for i, (lo, hi) in open_.items() for x in (i, float(lo))])
        wide = F.create_map(*[F.lit(x) for i, (lo, hi) in open_.items()
                              for x in (i, float(hi - lo) if math.isfinite(hi - lo) and hi > lo else 1.0)])
        counts = _inside(df, group, slots, open_)
        at = (F.col("value") - F.element_at(span, F.col("slot"))) / F.element_at(wide, F.col("slot"))
        # what lies below comes first
        binned = counts.withColumn("bin", F.when(F.col("value").isNull(), -1).otherwise(
            F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(at * BINS))).cast("int")))
        running = prefix_sums(binned, [F.col("value").asc_nulls_first()], ["c"], by=["slot"], bucket="bin")
        wanted = {i: _ranks(sized[i][0], q)[:2] for i in open_}
        rank = [F.element_at(F.create_map(*[F.lit(x) for i, w in wanted.items() for x in (i, w[j])]), F.col("slot")) for j in (0, 1)]
        holds = [(F.col("c_cum") >= r) & (F.col("c_cum") - F.col("c") < r) & F.col("value").isNotNull() for r in rank]
        found = running.groupBy("slot").agg(
            *[F.max(F.when(h, F.col("value"))).alias(f"v{j}") for j, h in enumerate(holds)],
            F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("below"))
        got = {r["slot"]: r for r in found.collect()}  # one row a slot
        again = {}
        for i, (lo, hi) in open_.items():
            row, (low_rank, _, part) = got.get(i), _ranks(sized[i][0], q)
            a, b = (row["v0"], row["v1"]) if row else (None, None)
            if a is not None and b is not None:
                out[i] = a if part == 0 else ((a + b) / 2 if midpoint and q == 0.5 else a + (b - a) * part)
            else:  # the sketch missed a rank: the bracket grows on that side
                again[i] = (sized[i][3], hi) if row and row["below"] >= low_rank else (lo, sized[i][4])
        open_ = again
    return out


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """The exact median of every column."""
    return dict(zip(cols, exact_quantiles(df, [Slot(c, None) for c in cols]))) if cols else {}
