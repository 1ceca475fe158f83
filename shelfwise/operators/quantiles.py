"""Exact quantiles without gathering the column.

The built-in exact ``percentile`` keeps every distinct value in one task. Here a
bounded sketch gives a bracket around each wanted order statistic, one counting pass
places the statistic inside the bracket, and the bracket is narrowed until it holds
few enough values to sort. Every pass is a one-row aggregate with map-side partials.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.places import earlier_sums
from shelfwise.operators.sizing import materialise

SMALL = 100_000
ACCURACY = 10_000


@dataclass(frozen=True)
class Span:
    """Values strictly between two ends, how many lie below and inside, and the wanted positions among them."""

    name: str
    low: object
    high: object
    below: int
    count: int
    positions: tuple

    def inside(self) -> Column:
        c = F.col(self.name)
        kept = c.isNotNull()
        if self.low is not None:
            kept = kept & (c > F.lit(self.low))
        return kept if self.high is None else kept & (c < F.lit(self.high))


def _read(df: DataFrame, spans: list[Span]) -> list[dict[int, float]]:
    """The wanted values of spans that hold few rows, all in one aggregate."""
    aggs = []
    for i, s in enumerate(spans):
        ordered = F.sort_array(F.collect_list(F.when(s.inside(), F.col(s.name))))
        aggs.append(F.array(*[F.element_at(ordered, p - s.below + 1) for p in s.positions]).alias(f"s_{i}"))
    row = df.agg(*aggs).first()
    return [dict(zip(s.positions, row[f"s_{i}"])) for i, s in enumerate(spans)]


def _sketch(c: Column, positions: list[int], below: int, count: int) -> Column:
    """Approximate values around each position, by its share of the rows."""
    margin, edges = 2.0 / ACCURACY, []
    for p in positions:
        q = (p - below) / max(count - 1, 1)
        edges += [max(q - margin, 0.0), min(q + margin, 1.0)]
    return F.percentile_approx(c, [float(e) for e in edges], ACCURACY)


def _cut(df: DataFrame, spans: list[Span], ends: list[list], found: dict) -> list[Span]:
    """Count below, at and between the ends of all spans in one aggregate; what is still open comes back, shorter."""
    aggs, cuts = [], []
    for i, s in enumerate(spans):
        c = F.col(s.name)
        for low, high, positions in _brackets(s.positions, ends[i]):
            k = len(cuts)
            cuts.append((s, low, high, positions))
            tests = {"under": c < F.lit(low), "upto": c <= F.lit(low), "before": c < F.lit(high), "through": c <= F.lit(high)}
            aggs += [F.count_if(t).alias(f"{n}_{k}") for n, t in tests.items()]
    row, left = df.agg(*aggs).first(), {}
    for k, (s, low, high, positions) in enumerate(cuts):
        under, upto, before, through = (row[f"{n}_{k}"] for n in ("under", "upto", "before", "through"))
        for p in positions:
            if under <= p < upto:
                found[s.name][p] = low
            elif before <= p < through:
                found[s.name][p] = high
            else:  # between the ends, or on a side where the sketch was too far off
                if p < under:
                    part = (s.name, s.low, low, s.below, under - s.below)
                elif p >= through:
                    part = (s.name, high, s.high, through, s.below + s.count - through)
                else:
                    part = (s.name, low, high, upto, before - upto)
                left.setdefault(part, set()).add(p)
    return [Span(*part, tuple(sorted(ps))) for part, ps in left.items()]


def _brackets(positions: tuple, ends: list) -> list[tuple]:
    """Equal ends are counted once for all positions they were found for."""
    grouped: dict[tuple, list[int]] = {}
    for i, p in enumerate(positions):
        grouped.setdefault((ends[2 * i], ends[2 * i + 1]), []).append(p)
    return [(low, high, ps) for (low, high), ps in grouped.items()]


def order_statistics(
    df: DataFrame, wanted: dict[str, list[float]], small: int = SMALL
) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column, its non-null count and the order statistics around each fraction.

    All open positions of all columns are narrowed together: a level is one aggregate that
    sketches values around each and one that counts below them. A span shrinks to some ten
    thousandths of itself at each level, so the passes don't grow with the positions.
    """
    df = df.select(*wanted)
    margin = 2.0 / ACCURACY
    aggs = []
    for name, fractions in wanted.items():
        edges = [float(e) for q in fractions for e in (max(q - margin, 0.0), min(q + margin, 1.0))]
        aggs += [F.count(name).alias(f"n_{name}"), F.percentile_approx(name, edges, ACCURACY).alias(f"b_{name}")]
    row = df.agg(*aggs).first()
    counts = {name: row[f"n_{name}"] for name in wanted}
    found: dict[str, dict[int, float]] = {name: {} for name in wanted}
    spans, ends = [], []
    for name, fractions in wanted.items():
        n, around = counts[name], {}
        for i, q in enumerate(fractions if n else ()):
            for p in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))}:
                around.setdefault(p, row[f"b_{name}"][2 * i : 2 * i + 2])
        if around:
            spans.append(Span(name, None, None, 0, n, tuple(sorted(around))))
            ends.append([e for p in sorted(around) for e in around[p]])
    while spans:
        few = [s for s in spans if s.count <= small]
        for s, values in zip(few, _read(df, few) if few else ()):
            found[s.name].update(values)
        keep = [i for i, s in enumerate(spans) if s.count > small]
        spans, ends = [spans[i] for i in keep], [ends[i] for i in keep]
        if not spans:
            break
        spans = _cut(df, spans, ends, found)
        many = [s for s in spans if s.count > small]
        if many:
            looks = [_sketch(F.when(s.inside(), F.col(s.name)), list(s.positions), s.below, s.count).alias(f"e_{i}") for i, s in enumerate(many)]
            row = df.agg(*looks).first()
            by_span = {s: row[f"e_{i}"] for i, s in enumerate(many)}
            ends = [by_span.get(s, []) for s in spans]
        else:
            ends = [[] for _ in spans]
    return {name: (counts[name], found[name]) for name in wanted}


def quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    interpolation: str = "linear",
    small: int = SMALL,
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles per column, nulls ignored; ``linear`` or ``lower`` between values."""
    found = order_statistics(df, wanted, small)
    result: dict[str, dict[float, float | None]] = {}
    for name, fractions in wanted.items():
        n, stats = found[name]
        result[name] = {}
        for q in fractions:
            if n == 0:
                result[name][q] = None
                continue
            at = q * (n - 1)
            low, high = stats[math.floor(at)], stats[math.ceil(at)]
            share = at - math.floor(at)
            exact = interpolation == "lower" or share == 0.0 or low == high
            result[name][q] = low if exact else low + (high - low) * share
    return result


def scalars(df: DataFrame, **aggregates: Column) -> dict:
    """Named one-row aggregates of a table."""
    return df.agg(*[a.alias(name) for name, a in aggregates.items()]).first().asDict()


def grouped_quantiles(df: DataFrame, key: str, value: str, fractions: list[float]) -> DataFrame:
    """Exact quantiles per group: ``(key, n, minimum, maximum, q)``, ``q`` an array in the order of ``fractions``.

    Values are counted per group, the counts are added up along one range-partitioned order
    of (group, value), and each wanted position is the value whose counts cover it. A group
    spreads over as many ranges as its distinct values need; null values are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    placed = materialise(earlier_sums(counts, ["_key", "_value"], "_n", "_before"))
    groups = placed.groupBy("_key").agg(
        F.min("_before").alias("_start"), F.sum("_n").alias("n"), F.min("_value").alias("minimum"), F.max("_value").alias("maximum")
    )
    wanted = []
    for i, q in enumerate(fractions):
        at = F.lit(float(q)) * (F.col("n") - 1)
        wanted += [F.struct(F.lit(i).alias("i"), side(at).cast("long").alias("p")) for side in (F.floor, F.ceil)]
    asked = groups.select(F.col("_key").alias("_group"), "_start", F.explode(F.array(*wanted)).alias("w")).distinct()
    place = F.col("_before") - F.col("_start")
    covered = F.col("_key").eqNullSafe(F.col("_group")) & (F.col("w.p") >= place) & (F.col("w.p") < place + F.col("_n"))
    ends = placed.join(asked, covered).groupBy("_group", F.col("w.i").alias("i")).agg(F.min("_value").alias("low"), F.max("_value").alias("high"))
    share = F.element_at(F.array(*[F.lit(float(q)) for q in fractions]), F.col("i") + 1) * (F.col("n") - 1)
    share = share - F.floor(share)
    value_at = F.when((share == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * share)
    joined = groups.join(ends, F.col("_key").eqNullSafe(F.col("_group")))
    listed = F.sort_array(F.collect_list(F.struct("i", value_at.cast("double").alias("v"))))
    return joined.groupBy(F.col("_key").alias(key), "n", "minimum", "maximum").agg(F.transform(listed, lambda e: e["v"]).alias("q"))
