"""Display texts with Python's number formatting.

Java's formatter (``format_string``) rounds the shortest decimal form half
up (14.95 -> "15.0"), while Python rounds the exact binary value
(14.949999... -> "14.9"). The displayed texts must equal Python's, so the
formatting itself runs as an Arrow-batched pandas UDF; it is a display
step over result rows, not part of any aggregation.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DASH = "—"


@lru_cache(maxsize=None)
def _formatter(spec: str, scale: float, suffix: str):
    @pandas_udf("string")
    def fmt(v: pd.Series) -> pd.Series:
        out = [None if x is None or pd.isna(x) else format(float(x) * scale, spec) + suffix for x in v]
        return pd.Series(out, dtype="object")
    return fmt


def py_format(col, spec: str, scale: float = 1.0, suffix: str = "", null_text: str | None = DASH) -> Column:
    """``format(x * scale, spec) + suffix`` as Python does it; null -> ``null_text``."""
    c = F.col(col) if isinstance(col, str) else col
    out = _formatter(spec, float(scale), suffix)(c.cast("double"))
    return F.coalesce(out, F.lit(null_text)) if null_text is not None else out


def percent(col, decimals: int = 1) -> Column:
    """"xx.x%" from a share (P15); null -> em dash."""
    return py_format(col, f".{decimals}f", 100.0, "%")


def fixed(col, decimals: int = 4) -> Column:
    """Fixed decimals (P15); null -> em dash."""
    return py_format(col, f".{decimals}f")
