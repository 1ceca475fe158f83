"""Staged tables, row tags, running totals over a global order, and Arrow batch maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from shelfwise.session import work_dir
from shelfwise.sources.landing import file_system

#: Own columns start with this, so that columns of the input can't clash with them.
OWN = "__sw_"
TAG = f"{OWN}tag"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """New folder below the shared one that the cluster names in ``spark.checkpoint.dir``."""
    return f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, outlives executors.

    Nothing reads the shuffle files of the write again, so Spark deletes them at its end and
    does not keep those of all steps until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._staged_path = path
    return stored


def release(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_staged_path", None)
    if path:
        system, location = file_system(df.sparkSession, path)
        system.delete(location, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tagged(df: DataFrame) -> DataFrame:
    """Adds a number unique to each row. Stage the result before using it twice."""
    return df.withColumn(TAG, F.monotonically_increasing_id())


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def arrow_type(kind: DataType) -> pa.DataType:
    """Arrow type of the few types that operators compute."""
    if isinstance(kind, ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    simple = {LongType: pa.int64(), IntegerType: pa.int32(), DoubleType: pa.float64(), StringType: pa.string(), BinaryType: pa.binary()}
    return simple[type(kind)]


def map_batches(
    df: DataFrame, keep: Sequence[str], fields: Sequence[StructField], work: Callable[[pa.RecordBatch], Sequence]
) -> DataFrame:
    """``keep`` unchanged and ``fields`` computed by ``work`` from each Arrow batch, row by row in order."""
    schema = StructType([df.schema[k] for k in keep] + list(fields))
    kept = list(keep)
    made_types = [(f.name, arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in kept]
            arrays += [pa.array(m, type=t) for m, (_, t) in zip(work(batch), made_types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(n for n, _ in made_types)])

    return df.mapInArrow(run, schema)


def running_total(df: DataFrame, order: Sequence[Column | str], values: Sequence[str], name: str = "running") -> DataFrame:
    """For each long column in ``values``: the sum over all earlier rows of the global order, as ``before_<value>``.

    Rows are range-partitioned and sorted by ``order``; totals run inside each partition and
    the partitions' sums, one row each, are added up and sent back. No group is gathered:
    a hot group spreads over as many ranges as its rows need, given an order that ends in a
    unique key. The result is staged, in the order asked for.
    """
    spark = df.sparkSession
    names = list(values)
    sorted_df = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    part = f"{OWN}part"
    schema = StructType(
        list(df.schema.fields)
        + [StructField(part, IntegerType(), False)]
        + [StructField(f"before_{n}", LongType(), False) for n in names]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        so_far = [0] * len(names)
        for batch in batches:
            extra = [pa.array(np.full(batch.num_rows, here, np.int32))]
            for i, n in enumerate(names):
                v = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64)
                up_to = np.cumsum(v)
                extra.append(pa.array(so_far[i] + up_to - v))
                so_far[i] += int(up_to[-1]) if len(up_to) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    local = stage(sorted_df.mapInArrow(run, schema), name)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = local.groupBy(part).agg(*[F.sum(n).alias(f"{OWN}sum_{n}") for n in names])
    # One row for each partition of the exchange: bounded by the session's partition count.
    bases = sums.select(part, *[F.coalesce(F.sum(f"{OWN}sum_{n}").over(earlier), F.lit(0)).alias(f"{OWN}base_{n}") for n in names])
    out = local.join(F.broadcast(bases), part)
    out = out.select(
        *df.columns, *[(F.col(f"before_{n}") + F.col(f"{OWN}base_{n}")).cast("long").alias(f"before_{n}") for n in names]
    )
    out._staged_path = local._staged_path
    return out
