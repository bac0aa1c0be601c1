"""Small tables: how large they are, and how to make them from values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.constants import BROADCAST_BYTES

# Room for pointers and headers of a row in a hash table.
_ROW_BYTES = 48


def _width(field: T.StructField) -> Column:
    column = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(column), F.lit(0)) * 8
    return F.lit(8)


def row_bytes(df: DataFrame) -> Column:
    """What a row of plain columns and number arrays takes in memory."""
    return sum((_width(field) for field in df.schema.fields), F.lit(_ROW_BYTES)).cast("bigint")


def is_bounded(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table of plain columns and number arrays fits into so many bytes.

    Runs one job that adds up the actual sizes; only a table measured like this, or
    one with a limit by construction, may be broadcast.
    """
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType) -> DataFrame:
    """A handful of rows as a table that is part of the plan."""
    entries = [
        F.struct(*[
            F.lit(value).cast(field.dataType).alias(field.name)
            for value, field in zip(row, schema.fields, strict=True)
        ])
        for row in rows
    ]
    listed = F.array(*entries) if entries else F.array().cast(T.ArrayType(schema))
    return spark.range(1).select(F.inline(listed))
