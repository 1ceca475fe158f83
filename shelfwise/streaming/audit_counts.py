"""Audit counts kept up to date from an append-only folder of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.sources.landing import file_system

#: Batches that may lie beside the base table before they are added to it.
MOST_BATCHES = 50
STATE = "window_start timestamp, status string, n long, duration_cents long"


def windowed_counts(log: DataFrame, window: str = "1 day") -> DataFrame:
    """Entries per tumbling window and status, and their total duration in hundredths."""
    return (
        log.groupBy(F.window("timestamp", window).alias("w"), "status")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.round(F.col("duration_ms") * 100).cast("long")).alias("duration_cents"),
        )
        .select(F.col("w.start").alias("window_start"), "status", "n", "duration_cents")
    )


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished sub-folders ``<prefix>=<number>``."""
    system, location = file_system(spark, folder)
    if not system.exists(location):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in system.listStatus(location)]
    found = [(int(n.split("=")[1]), path) for n, path in names if n.startswith(f"{prefix}=")]
    return sorted(k for k, path in found if system.exists(file_system(spark, f"{path}/_SUCCESS")[1]))


def run_audit_counts(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    shape,
    target: str,
    pattern: str | None = None,
    fmt: str = "parquet",
    window: str = "1 day",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Read what is new, add it to the counts, stop; returns the current state.

    Nothing is ever too late: each batch is counted on its own, without state and without a
    watermark, and its partial counts go to the batch's own folder, written again whole if
    the batch is retried. Readers add the partial counts up. ``target`` holds progress and
    counts, so a later application that is given the same folder goes on from there.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def store(batch: DataFrame, batch_id: int) -> None:
        windowed_counts(batch, window).write.mode("overwrite").parquet(f"{target}/state/batch={batch_id}")

    query = (
        shape(reader.load(folder))
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{target}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    compact(spark, target)
    return current_state(spark, target)


def _parts(spark: SparkSession, target: str) -> tuple[int, list[int]]:
    """Last batch that the newest base table holds, -1 without one, and the batches after it."""
    base = max(_numbers(spark, f"{target}/base", "upto"), default=-1)
    return base, [k for k in _numbers(spark, f"{target}/state", "batch") if k > base]


def compact(spark: SparkSession, target: str, most: int = MOST_BATCHES) -> None:
    """Add finished batches to a new base table once there are more than ``most`` of them.

    The new base counts from the moment it is complete; what it replaces goes after that.
    """
    base, batches = _parts(spark, target)
    if len(batches) <= most:
        return
    current_state(spark, target).write.mode("overwrite").parquet(f"{target}/base/upto={batches[-1]}")
    old = [f"{target}/state/batch={k}" for k in batches] + ([f"{target}/base/upto={base}"] if base >= 0 else [])
    for path in old:
        system, location = file_system(spark, path)
        system.delete(location, True)


def current_state(spark: SparkSession, target: str) -> DataFrame:
    """Counts per window and status over all batches."""
    base, batches = _parts(spark, target)
    paths = [f"{target}/state/batch={k}" for k in batches] + ([f"{target}/base/upto={base}"] if base >= 0 else [])
    if not paths:
        return spark.createDataFrame([], STATE)
    stored = spark.read.schema(STATE).parquet(*paths)
    return stored.groupBy("window_start", "status").agg(
        F.sum("n").alias("n"), F.sum("duration_cents").alias("duration_cents")
    )
