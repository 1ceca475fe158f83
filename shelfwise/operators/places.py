"""Places and running sums along a global order, in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.sizing import materialise, width

_PLACE, _PART, _BASE = "_sw_place", "_sw_part", "_sw_base"
#: Bits of a row's place inside its partition.
_BITS = 33


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned by sampled cuts and sorted, with their range and their place in it, written once."""
    spread = df.repartitionByRange(width(df), *order).sortWithinPartitions(*order)
    # The generated id holds the partition above the row's place in it.
    placed = materialise(spread.withColumn(_PLACE, F.monotonically_increasing_id()))
    return placed.withColumn(_PART, F.shiftright(_PLACE, _BITS))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows with their place from 0 in the order of ``order``, whose values should be unique.

    The ranges' counts, one row each, are added up before them; no task sees more than its range.
    """
    placed = _ranged(df, order)
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(_PART).agg(F.count("*").alias("n")).select(_PART, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(_BASE))
    within = F.col(_PLACE).bitwiseAND(F.lit((1 << _BITS) - 1))
    return placed.join(F.broadcast(bases), _PART).select(*df.columns, (F.col(_BASE) + within).cast("long").alias(out))


def earlier_sums(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Rows with the sum of ``amount`` over all rows before them in the order of ``order``, whose values should be unique."""
    placed = _ranged(df, order)
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(_PART).agg(F.sum(amount).alias("n")).select(_PART, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(_BASE))
    inside = Window.partitionBy(_PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return placed.join(F.broadcast(bases), _PART).select(*df.columns, (F.col(_BASE) + within).cast("long").alias(out))
