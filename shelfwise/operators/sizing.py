"""Size checks in front of broadcasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from shelfwise.session import work_dir

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
PARTITION_ROWS = 1_000_000


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage, survives lost executors."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as Spark holds it: eight a column and for the null bits, and the content of texts and nested values."""
    sizes = [F.lit(8 * (1 + len(df.columns)))]
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            sizes.append(F.coalesce(F.octet_length(value), F.lit(0)))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            sizes.append(F.coalesce(F.octet_length(value.cast("string")), F.lit(0)))
    return reduce(lambda a, b: a + b, sizes).cast("long")


def lookup_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join side that is broadcast only after its rows and bytes were counted.

    The table is computed once into the shared folder. Above ``max_rows`` or
    ``max_bytes`` it is returned without a hint, so Spark shuffles the join and AQE
    splits skewed keys.
    """
    stored = materialise(df)
    size = stored.agg(F.count("*").alias("rows"), F.sum(row_bytes(stored)).alias("bytes")).first()
    return F.broadcast(stored) if size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes else stored


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of short rows whose counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def width(df: DataFrame) -> int:
    """Partitions for a table that is worked on repeatedly or opens into many rows."""
    spark = df.sparkSession
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )


def balanced(df: DataFrame, key: str | None = None) -> DataFrame:
    """Even partitions for repeated passes, in a number that fits the counted rows.

    Every core gets work, a partition stays under a million short rows. Rows are placed
    by a unique key where there is one, else in turn.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-df.count() // PARTITION_ROWS))
    return df.repartition(parts, key) if key in df.columns else df.repartition(parts)
