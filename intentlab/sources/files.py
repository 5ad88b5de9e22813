"""File sources and sinks for sessions and scored output.

Reads always pass an explicit schema (no inference pass over the data).
Writes go to a folder of part files, one per task; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, required: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """S3: fail when any required column is absent, then project to them.

    Uses only the schema (no job).
    """
    req = required or S.ALL_FEATURES
    present = set(df.columns)
    missing = [c for c in req if c not in present]
    if missing:
        raise MissingColumnsError(f"Missing columns: {missing}")
    return df.select(*(keep or []), *req)


def write_sessions_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_sessions_csv(spark: SparkSession, path: str, keyed: bool = True) -> DataFrame:
    """Header CSV with the session schema; NaN text becomes null."""
    schema = S.KEYED_SESSION_SCHEMA if keyed else S.SESSION_SCHEMA
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*[C.nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in schema.fields])


def write_sessions_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_sessions_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one session object per line; missing keys -> null, unknown keys dropped."""
    return spark.read.schema(S.REQUEST_SCHEMA).json(path)


def parse_session_json(value: Column) -> Column:
    """S2 for a text column holding one JSON session object (e.g. a stream)."""
    return F.from_json(value, S.REQUEST_SCHEMA)


def scored_output(decided: DataFrame) -> DataFrame:
    """S4 layout of decided sessions that kept their features: features + purchase_probability, intervene, prediction label."""
    return decided.select(S.KEY, *S.ALL_FEATURES, "purchase_probability", "intervene", C.prediction_label().alias("prediction"))


SCORED_SCHEMA = T.StructType(
    [T.StructField(S.KEY, T.LongType())] + S.SESSION_FIELDS + [
        T.StructField("purchase_probability", T.DoubleType()),
        T.StructField("intervene", T.BooleanType()),
        T.StructField("prediction", T.StringType()),
    ]
)


def write_scored_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(*[f.name for f in SCORED_SCHEMA.fields]).write.mode(mode).option("header", True).csv(path)


def read_scored_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORED_SCHEMA).option("header", True).csv(path)


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """md5 and size of each file's bytes (``binaryFile``), one row per file."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.md5("content").alias("md5"), F.col("length").alias("size")
    )


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """S8 for tables: order-free fingerprint (row count + sum of a per-row 60-bit hash).

    The per-row hash is the first 15 hex digits of md5 over the row's
    columns (nulls marked), summed as DECIMAL(38,0): no order, no collect.
    Doubles enter as whole millionths, a text that every engine writes alike.
    """
    cols = columns or df.columns
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        x = F.floor(F.col(c) * 1000000 + 0.5).cast("bigint") if kinds[c] == "double" else F.col(c)
        return F.coalesce(x.cast("string"), F.lit("\u0000"))

    row_text = F.concat_ws("\u0001", *[text(c) for c in cols])
    h = F.conv(F.substring(F.md5(row_text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("decimal(38,0)").alias("fingerprint"))
