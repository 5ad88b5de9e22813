"""Successors in the order of an integer key, without a global window.

The key's range is cut into cells of ``2**CELL_BITS`` consecutive values,
so a cell holds at most that many different keys however the keys are
spread. Inside a cell a window gives the next row; the last row of a cell
takes the first row of the next cell that has rows, which the same
procedure finds one level up, over the far smaller table of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import materialize

CELL_BITS = 10


def successors(keys: DataFrame, key: str) -> DataFrame:
    """(key, next_key) of every distinct non-null ``key``; the last one's next is null."""
    keys = materialize(keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct(), "order-keys")
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    return _successors(keys, lo, hi).select(F.col("key").alias(key), F.col("next_key").alias(f"next_{key}"))


def _successors(keys: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    one = lo is None or hi - lo < 1 << CELL_BITS  # all keys fit one cell
    cells = keys.withColumn("cell", F.lit(0) if one else F.shiftright("key", CELL_BITS))
    inside = cells.withColumn("next_in", F.lead("key").over(Window.partitionBy("cell").orderBy("key")))
    if one:
        return inside.select("key", F.col("next_in").alias("next_key"))
    firsts = materialize(cells.groupBy("cell").agg(F.min("key").alias("first_key")), "order-cells")
    up = _successors(firsts.select(F.col("cell").alias("key")), lo >> CELL_BITS, hi >> CELL_BITS)
    across = (up.where("next_key is not null").select(F.col("key").alias("cell"), F.col("next_key").alias("to"))
              .join(firsts.select(F.col("cell").alias("to"), "first_key"), "to").select("cell", "first_key"))
    return (inside.join(across, "cell", "left")
            .select("key", F.coalesce("next_in", "first_key").alias("next_key")))


def with_next_row(df: DataFrame, key: str, carry: dict, ties: list | None = None, then=lambda x: x) -> DataFrame:
    """Adds a struct column ``next_row`` holding ``carry`` of the following row by ``key``.

    ``carry`` maps field names to column names of ``df``. The last row gets
    the first one's (a table of one row: its own). Rows of equal ``key``
    follow each other in the order of ``ties``. Rows without a key have no
    place in the order and must be taken out before. ``then`` adds columns
    after the rows have moved (so they need not move with them).
    The rows move once, to their cell; beside them only one row per cell moves.
    """
    order = [F.col(key), *(ties or [])]
    placed = df.withColumn("_cell", F.shiftright(F.col(key).cast("long"), CELL_BITS)).where("_cell is not null").repartition("_cell")
    w = Window.partitionBy("_cell").orderBy(*order)
    row = F.struct(*[F.col(c).alias(n) for n, c in carry.items()])
    rows = then(placed).withColumn("_next_in", F.lead(row).over(w))

    cells = df.select(F.shiftright(F.col(key).cast("long"), CELL_BITS).alias("_cell"))
    lo = df.agg(F.min(F.col(key).cast("long"))).first()[0]
    first = None if lo is None else lo >> CELL_BITS
    after = successors(cells, "_cell").select(  # the first cell follows the last
        F.col("_cell").alias("_before"), F.coalesce("next__cell", F.lit(first).cast("long")).alias("_cell"))
    firsts = then(placed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")).select("_cell", row.alias("_first_row"))
    firsts = firsts.join(after, "_cell").select(F.col("_before").alias("_cell"), "_first_row")
    return (rows.join(firsts, "_cell", "left")
            .withColumn("next_row", F.coalesce("_next_in", "_first_row")).drop("_cell", "_next_in", "_first_row"))
