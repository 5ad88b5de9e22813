"""Small shared DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row frame (a global aggregate) beside every row.

    ``one_row`` must be an aggregate without grouping: exactly one row, so
    broadcasting it is bounded whatever the data size.
    """
    return df.join(F.broadcast(one_row), how="left_outer", on=F.lit(True))
