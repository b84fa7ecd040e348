"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, fail_fast: bool = True) -> DataFrame:
    """Read with a given schema. Without ``fail_fast`` broken lines stay, in ``_corrupt_record``."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("mode", "FAILFAST" if fail_fast else "PERMISSIVE")
    if not fail_fast:
        fields = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(fields).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def first_in_source_order(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """First ``limit`` rows in an explicit source order (a per-partition top-n, then a merge)."""
    return df.orderBy(*[F.col(c) for c in order]).limit(limit)
