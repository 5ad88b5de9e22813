"""One intake for sessions that arrive as text: CSV files, JSON lines, requests and streams.

Every cell is read as text and cast cell by cell. A cell that cannot be read, or a value outside
its declared range, becomes a problem (column, reason, text) of its row; a row with problems is
rejected with all of them, never changed to nulls in silence. Missing cells take the declared defaults; unknown fields
are dropped. File, stream and request share these expressions, so equal sessions give equal records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C
from .prepare import domain_validate_rows

#: Cell texts that stand for a missing value. A parameter.
MISSING_TEXTS = ("", "NaN", "nan", "NA", "N/A", "null", "NULL", "None")
CORRUPT = "_corrupt"
TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in [S.KEY, *S.ALL_FEATURES]])
PROBLEMS = "array<struct<column:string,reason:string,text:string>>"


def cells_from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Text cells of JSON session objects, one in each row; text that is no object is kept in ``_corrupt``."""
    schema = T.StructType([*TEXT_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(value), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    is_object = F.coalesce(F.ltrim(F.col(value)).startswith("{"), F.lit(False))
    broken = F.when(~is_object, F.coalesce(F.col(value), F.lit(""))).otherwise(F.col("_cells")[CORRUPT])
    return df.withColumn("_cells", parsed).withColumn("_broken", broken).select(
        *[c for c in df.columns if c != value and c not in TEXT_SCHEMA.fieldNames()],
        *[F.col("_cells")[c].alias(c) for c in TEXT_SCHEMA.fieldNames()], F.col("_broken").alias(CORRUPT))


def cells_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text cells of header CSV files; columns of other names stay as they are."""
    return spark.read.option("header", True).csv(path)


def _present(c: str) -> Column:
    text = F.trim(F.col(c))
    return F.when(~text.isin(*MISSING_TEXTS), text)


def typed(cells: DataFrame) -> DataFrame:
    """Typed sessions with defaults, ``problems`` and ``accepted``; the key, if there is one, stays null where it is missing.

    Write or persist the result before its rows are filtered: a filter pushed below the casts would repeat them many times.
    """
    values, problems = [], []

    def cast(c: str, kind: str, value: Column, reason: str) -> None:
        values.append(value.alias(c))
        problems.append(F.when(_present(c).isNotNull() & value.isNull(), F.struct(
            F.lit(c).alias("column"), F.lit(reason).alias("reason"), F.col(c).alias("text"))))

    if S.KEY in cells.columns:
        cast(S.KEY, "long", _present(S.KEY).try_cast("long"), "not a key")
    for c in S.ALL_FEATURES:
        number = C.nan_to_null(_present(c).try_cast("double"))
        if c == "Weekend":
            values.append(F.when(_present(c).isNotNull(), C.weekend_from_text(_present(c))).alias(c))
        elif c in S.INTEGER_COLUMNS:
            cast(c, "int", C.integer_normalise(number), "not a whole number in range")
        elif c in S.NUMERIC_FEATURES:
            cast(c, "double", number, "not a number")
        else:
            values.append(_present(c).alias(c))
    if CORRUPT in cells.columns:
        problems.append(F.when(F.col(CORRUPT).isNotNull(), F.struct(
            F.lit("").alias("column"), F.lit("not a session object").alias("reason"), F.col(CORRUPT).alias("text"))))
    kept = [c for c in cells.columns if c not in (S.KEY, CORRUPT, *S.ALL_FEATURES)]
    rows = domain_validate_rows(cells.select(*kept, *values, F.array_compact(F.array(*problems)).alias("_unread")))
    outside = F.transform("violations", lambda c: F.struct(
        c.alias("column"), F.lit("out of range").alias("reason"),
        F.element_at(F.create_map(*[x for d in S.DOMAINS for x in (F.lit(d), F.col(d).cast("string"))]), c).alias("text")))
    # a cell that could not be read took its default, which is in range: a column has one problem at most
    found = F.concat("_unread", outside).cast(PROBLEMS)
    return rows.withColumn("problems", found).withColumn("accepted", F.size("problems") == 0).drop("_unread", "violations")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("accepted").drop("problems", "accepted")


def rejected(checked: DataFrame) -> DataFrame:
    """One row a problem: what identifies the row, then column, reason and text."""
    keys = [c for c in checked.columns if c not in ("problems", "accepted", *S.ALL_FEATURES)]
    return checked.where("NOT accepted").select(*keys, F.inline("problems"))


def counted(checked: DataFrame, name: str = "intake") -> tuple[DataFrame, Observation]:
    """The same rows, with an observation of their number and the rejected ones, taken in whatever pass reads them."""
    seen = Observation(name)
    return checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col("accepted"), 1)).alias("rejected")), seen


def split_csv(spark: SparkSession, path: str, accepted_path: str, rejected_path: str) -> dict:
    """S1 with quarantine: accepted sessions and rejected cells as two tables; returns the counts of rows.

    The checked rows are written once, and counted in that pass; both tables are read off them.
    """
    from ..config import materialize
    checked, seen = counted(typed(cells_from_csv(spark, path)))
    checked = materialize(checked, "intake")
    accepted(checked).write.mode("overwrite").parquet(accepted_path)
    rejected(checked).write.mode("overwrite").parquet(rejected_path)
    return dict(seen.get)
