"""Ranks, top-k and first-per-key."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.sizing import BROADCAST_ROWS, lookup_side, materialise

# Distinct scores one task ranks, and the most ranges they are split into.
PART_VALUES, MOST_PARTS = 200_000, 5_000


def rank_descending(
    df: DataFrame, score: str, out: str = "rang", distinct_bound: int | None = None
) -> DataFrame:
    """Rank 1 for the highest score; ties share the smallest rank.

    Ranks come from the counts per distinct score; the rows are never sorted.
    ``distinct_bound`` is a proven limit on distinct scores (two decimals between 0
    and 100 give 10,001): one running total over that short table, then broadcast.
    Without it the distinct scores are split into even value ranges, the ranges get
    running totals, a window ranks each range, and the size is counted before a
    broadcast.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"))
    if distinct_bound is not None and distinct_bound <= BROADCAST_ROWS:
        ahead = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
        place = F.coalesce(F.sum("_n").over(ahead), F.lit(0)) + 1
        ranks = F.broadcast(counts.select(score, place.cast("int").alias(out)))
        return df.join(ranks, score, "left")

    counts = materialise(counts.withColumn(score, F.col(score).cast("double")))
    parts = max(1, min(MOST_PARTS, -(-counts.count() // PART_VALUES)))
    placed = _in_even_parts(counts, score, parts)
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    groups = placed.groupBy("_part").agg(F.sum("_n").alias("_m")).select(
        "_part", F.coalesce(F.sum("_m").over(above), F.lit(0)).alias("_before")
    )
    within = (
        Window.partitionBy("_part")
        .orderBy(F.desc(score))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    place = F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + 1
    ranks = placed.join(F.broadcast(groups), "_part").select(score, place.cast("long").alias(out))
    return df.join(lookup_side(ranks), score, "left")


def _in_even_parts(counts: DataFrame, score: str, parts: int) -> DataFrame:
    """Value ranges holding about as many distinct scores each, as ``_part``."""
    if parts == 1:
        return counts.withColumn("_part", F.lit(0.0))
    shares = [i / parts for i in range(1, parts)]
    cuts = counts.agg(F.percentile_approx(score, shares, 10 * parts)).first()[0]
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    return Bucketizer(splits=splits, inputCol=score, outputCol="_part").transform(counts)


def top_k(df: DataFrame, k: int, by: str, tie: str = "uid", ascending: bool = False) -> DataFrame:
    """The k best rows, ties decided by ``tie``; each task keeps k rows only."""
    first = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.orderBy(first, F.asc(tie)).limit(k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order.

    A smallest-struct aggregate, not a window: a hot key shrinks to one row per map
    task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    smallest = F.min(F.struct(*order, *rest)).alias("_first")
    picked = df.groupBy(*keys).agg(smallest)
    return picked.select(
        *[F.col(c) if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns]
    )


def top_per_group(df: DataFrame, group: str, k: int, order: list[Column], rank: str) -> DataFrame:
    """At most k rows per group with their position; Spark limits each group map-side."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
