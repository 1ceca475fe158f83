"""Label codes: position of a value among the sorted distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.places import numbered
from shelfwise.operators.sizing import lookup_side

UNKNOWN = "inconnu"


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """Table ``(value, code)`` with codes from 0 in sorted order, nulls as ``inconnu``."""
    values = df.select(F.coalesce(F.col(column), F.lit(UNKNOWN)).alias("value")).distinct()
    return numbered(values, ["value"], "code").withColumn("code", F.col("code").cast("int"))


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Attach the code of ``column`` as ``out``."""
    codes = lookup_side(ordinal_codes(df, column)).select(
        F.col("value").alias("_value"), F.col("code").alias(out)
    )
    keyed = df.withColumn("_value", F.coalesce(F.col(column), F.lit(UNKNOWN)))
    return keyed.join(codes, "_value", "left").drop("_value")
