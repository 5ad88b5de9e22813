"""Mixing sources to target weights by Pareto order sampling.

1. Sources in code-point order (null last) get the repeating weights, and
   share ``share`` times all sizes. A target stops at ``max_copies`` times
   its source's size; the excess goes to the others by weight until none is
   above (closed form: sources in ascending order of cap / weight, the
   first that need not be capped fixes the common level).
2. A document's expected copies are target / source size, times its own
   weight over the source's mean weight if ``doc_weight`` is given, at most
   ``max_copies``. The whole part is taken with certainty.
3. The fractional part p is an inclusion probability. With U in (0, 1) from
   the md5 of seed, id and size, the Pareto rank is
   (U / (1 - U)) / (p / (1 - p)). Per source the documents of smallest rank
   get one more copy, as long as the words so far plus half the document
   stay within what the whole copies leave of the target: a sample of fixed
   size in words, within half a document of its target.

The cut of step 3 is found without sorting a source: ranks fall into
cells of a 24-bit grid, and three levels of 8 bits of sums (source, digit)
narrow the cut to one cell of the 2**24, the only rows that a window sorts.
A source that holds a third of all rows is summed before each shuffle.

Defined results: null or wordless texts have size 0 and are taken as 0
words; a source without words has target 0; a null id is an id of its own;
repeated rows are separate documents; rows of equal id and size are taken in
the order of their position. Equal input and seed give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
SEED = "mix"
LEVELS, DIGIT = 3, 8
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of the keys."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def source_targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, weight, target and ``_mean``, if there. ``sizes``: (source, size). Works on one row per source."""
    kept = [c for c in ("_mean",) if c in sizes.columns]
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), *[F.first(c).alias(c) for c in kept])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_k", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                                (F.col("_k") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_copies
    order = Window.orderBy(cap / F.col("weight"), "_k")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select("*", F.sum("source_size").over(every).alias("_all"),
                     F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("_capped"),
                     F.sum("weight").over(onward).alias("_open"), cap.alias("_cap"))
    level = (F.col("_all") * share - F.col("_capped")) / F.col("_open")
    per = per.withColumn("_level", level).withColumn("_free", F.col("weight") * F.col("_level") < F.col("_cap"))
    # the level of the first free source: behind it the levels, reckoned with caps that do not bind, only fall
    per = per.withColumn("_common", F.max(F.when(F.col("_free"), F.col("_level"))).over(every))
    target = F.when(F.col("_free"), F.col("weight") * F.col("_common")).otherwise(F.col("_cap").cast("double"))
    return per.select("source", "source_size", "weight", target.cast("double").alias("target"), *kept)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None,
        text: str = "text", share: float = SHARE, weights=WEIGHTS, max_copies: int = MAX_COPIES,
        doc_weight: str | None = None, seed: str = SEED, keep: tuple = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and the ``keep`` columns, one row per input row."""
    size = n_words(F.col(text)) if size is None else size.cast("long")
    w = F.lit(1.0) if doc_weight is None else F.greatest(F.coalesce(F.col(doc_weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"),
                       w.alias("_w"), *keep).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, "mix-sizes")  # the texts are read once; every later pass reads sizes
    sums = rows.groupBy("source").agg((F.sum(F.col("_w") * F.col("size")) / F.sum("size")).alias("_mean"), F.sum("size").alias("size"))
    targets = source_targets(sums, share, weights, max_copies)
    # one row a source; written, so that the plans of the passes below do not hold its windows again and again
    targets = materialize(targets, "mix-targets")

    rate = F.col("target") / F.col("source_size")
    relative = F.when(F.col("_mean") > 0, F.col("_w") / F.col("_mean")).otherwise(F.lit(1.0))
    expected = F.when(F.col("source_size") > 0, F.least(rate * relative, F.lit(float(max_copies)))).otherwise(F.lit(0.0))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target", "_mean")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_expected", expected).withColumn("_whole", F.floor("_expected"))
    rows = rows.withColumn("_p", F.col("_expected") - F.col("_whole"))
    u = uniform(seed, F.col("doc_id"), F.col("size"))
    rows = rows.withColumn("_u", u).withColumn("_rank", F.when(
        F.col("_p") > 0, (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))))
    # Q / (1 + Q) maps ranks to (0, 1) and keeps their order
    top = 2 ** (LEVELS * DIGIT) - 1
    rows = rows.withColumn("_cell", F.least(F.floor(F.col("_rank") / (1 + F.col("_rank")) * (top + 1)), F.lit(top)).cast("long"))
    return _take(materialize(rows.drop("_w", "_mean", "_expected", "_p", "_u"), "mix-ranked"), keep)


def _take(rows: DataFrame, keep: tuple) -> DataFrame:
    whole = rows.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_sure"), F.first("target").alias("_t"))
    cut = whole.select(F.col("source").alias("_s"), (F.col("_t") - F.col("_sure")).alias("_left"),
                       F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"))
    drawn = rows.where("_rank is not null")
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        here = drawn.join(cut, F.col("source").eqNullSafe(F.col("_s")) &
                          (F.shiftright("_cell", shift + DIGIT) == F.col("_prefix")))
        # what the cut says of a source goes along: a second join would be one more broadcast in the driver's memory
        sums = here.groupBy("_s", F.shiftright("_cell", shift).alias("_digit")).agg(
            F.sum("size").alias("_n"), F.first("_left").alias("_left"), F.first("_before").alias("_before"))
        w = Window.partitionBy("_s").orderBy("_digit")
        # at most 256 digits a source; the cut is in the last one that begins within what is left
        sums = sums.withColumn("_begin", F.col("_before") + F.sum("_n").over(w) - F.col("_n"))
        sums = sums.where("_begin <= _left").withColumn("_last", F.max("_digit").over(Window.partitionBy("_s")))
        found = sums.where("_digit = _last").select("_s", "_left", F.col("_digit").alias("_prefix"), F.col("_begin").alias("_before"))
        cut = materialize(found, "mix-cut")
    edge = drawn.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_prefix")))
    w = Window.partitionBy("_s").orderBy("_rank", F.col("doc_id").asc_nulls_last(), "size", "_at")
    begin = F.col("_before") + F.sum("size").over(w) - F.col("size")
    edge = edge.withColumn("_begin", begin).where(F.col("_begin") + F.col("size") / 2 <= F.col("_left")).select(
        F.col("_at").alias("_edge"))
    limit = cut.select("_s", "_prefix")
    out = (rows.join(limit, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
           .join(edge, F.col("_at") == F.col("_edge"), "left"))
    more = ((F.col("_cell") < F.col("_prefix")) | F.col("_edge").isNotNull()) & F.col("_rank").isNotNull()
    copies = (F.col("_whole") + F.when(more, 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"), *keep)


#: DuckDB SQL of op5: the same sizes, targets and Pareto ranks with plain windows.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM per),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM named),
filled AS (
  SELECT *, (SELECT sum(source_size) FROM per)::DOUBLE * 1.5::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open FROM weighed),
levels AS (SELECT *, (total - capped) / open AS level, w * ((total - capped) / open) < cap AS free FROM filled),
targets AS (
  SELECT source, source_size,
    CASE WHEN free THEN w * (SELECT max(level) FROM levels WHERE free) ELSE cap::DOUBLE END::DOUBLE AS target FROM levels),
drawn AS (
  SELECT s.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS expected,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, floor(expected)::BIGINT AS whole,
    CASE WHEN expected - floor(expected) > 0
      THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS q FROM drawn),
summed AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS left_over,
    sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (
      PARTITION BY source ORDER BY q ASC NULLS LAST, doc_id ASC NULLS LAST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS begin FROM ranked)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN q IS NOT NULL AND begin + size / 2 <= left_over THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""
