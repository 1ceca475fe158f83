"""Density clusters and outliers (DBSCAN) on a grid.

A pair of rows is never formed unless cells leave it open. The grid is fine enough that
two rows of one cell are always neighbours, so a cell with enough rows is core as a
whole. What is left works on cells, whose number is bounded by the grid and not by
the rows: tight boxes decide most distances from their nearest and farthest corners,
undecided boxes are split further, and single rows are only compared when few enough
comparisons remain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.components import components
from shelfwise.operators.places import numbered
from shelfwise.operators.quantiles import scalars
from shelfwise.operators.sizing import lookup_side, materialise, sized, width

# Neighbourhood radius and the rows that make a core, the row itself counted.
EPS, MIN_ROWS = 0.15, 5
# Row comparisons allowed before boxes are split once more.
OPEN_LIMIT = 20_000_000
LEVEL_STEP, LAST_LEVEL = 2, 8


@dataclass(frozen=True)
class Grid:
    """Cells of side eps/m; m is chosen so that a cell's diagonal stays below eps."""

    features: tuple
    lows: tuple
    eps: float

    @property
    def dims(self) -> int:
        return len(self.features)

    @property
    def parts(self) -> int:
        return math.isqrt(self.dims) + 1

    @property
    def side(self) -> float:
        return self.eps / self.parts

    @property
    def bits(self) -> int:
        return 62 // self.dims

    def axis(self, i: int, level: int = 0) -> Column:
        scaled = (F.col(self.features[i]) - F.lit(self.lows[i])) / F.lit(self.side / 2**level)
        return F.floor(scaled)

    def cell(self) -> Column:
        return sum((self.axis(i) * F.lit(1 << (self.bits * i)) for i in range(1, self.dims)), self.axis(0))

    def sub(self, level: int) -> Column:
        """Position inside the cell after ``level`` halvings of its side."""
        top = (1 << level) - 1
        code = F.lit(0).cast("long")
        for i in range(self.dims):
            inner = self.axis(i, level) - self.axis(i) * F.lit(1 << level)
            inner = F.least(F.greatest(inner, F.lit(0)), F.lit(top)).cast("long")
            code = code + inner * F.lit(1 << (level * i))
        return code

    def index(self, cell: Column, i: int) -> Column:
        shifted = F.shiftright(cell, self.bits * i)
        return shifted.bitwiseAND(F.lit((1 << self.bits) - 1))

    def coarse(self, cell: Column, i: int) -> Column:
        return F.floor(self.index(cell, i) / self.parts)

    def boxes(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Row count (``w`` rows per vector) and tight box per key; partial aggregates absorb hot cells."""
        aggs = [F.sum("w").alias("n")]
        for i, f in enumerate(self.features):
            aggs += [F.min(f).alias(f"lo{i}"), F.max(f).alias(f"hi{i}")]
        return rows.groupBy(*keys).agg(*aggs)

    def points(self, rows: DataFrame) -> DataFrame:
        """Vectors as boxes without extent."""
        columns = {"n": F.col("w")}
        for i, f in enumerate(self.features):
            columns |= {f"lo{i}": F.col(f), f"hi{i}": F.col(f)}
        return rows.withColumns(columns).drop("w", *self.features)

    def box_columns(self, prefix: str = "") -> list[str]:
        return [f"{prefix}{end}{i}" for i in range(self.dims) for end in ("lo", "hi")]

    def nearest(self, a: str, b: str) -> Column:
        """Squared distance of the nearest corners of two boxes."""
        total = F.lit(0.0)
        for i in range(self.dims):
            gap = F.greatest(
                F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.lit(0.0)
            )
            total = total + gap * gap
        return total

    def farthest(self, a: str, b: str) -> Column:
        """Squared distance of the farthest corners of two boxes."""
        total = F.lit(0.0)
        for i in range(self.dims):
            gap = F.greatest(
                F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}"), F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}")
            )
            total = total + gap * gap
        return total

    @property
    def limit(self) -> Column:
        return F.lit(self.eps * self.eps)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _neighbours(grid: Grid, cells: DataFrame, n_cells: int, axes: list[int]) -> DataFrame:
    """Pairs ``(a_cell < b_cell, sure)`` whose boxes come within eps; ``sure`` when wholly so.

    Cells meet through coarse cells of side eps: these pair on three axes by key and
    are compared on the others. A coarse cell holds a number of fine cells that
    depends on the dimensions only. Whole grid steps are compared before the boxes
    are brought along.
    """
    code = sum(
        (grid.coarse(F.col("cell"), i) * F.lit(1 << (grid.bits * i)) for i in range(1, grid.dims)),
        grid.coarse(F.col("cell"), 0),
    )
    placed = cells.select("cell", code.alias("big"))
    coarse = placed.select("big").distinct()

    key_axes, other = axes[:3], axes[3:]
    wide = coarse
    for i in key_axes:
        steps = [grid.index(F.col("big"), i) + F.lit(step) for step in (-1, 0, 1)]
        wide = wide.withColumn(f"k{i}", F.explode(F.array(*steps)))
    keyed = coarse.withColumnRenamed("big", "big2")
    for i in key_axes:
        keyed = keyed.withColumn(f"k{i}", grid.index(F.col("big2"), i))
    near = wide.join(keyed, [f"k{i}" for i in key_axes])
    for i in other:
        near = near.where(F.abs(grid.index(F.col("big"), i) - grid.index(F.col("big2"), i)) <= 1)
    # Few and short rows that open into many: keep them spread over all cores.
    near = near.select(F.col("big").alias("a_big"), F.col("big2").alias("b_big"))
    near = near.repartition(width(cells))
    a = placed.select(F.col("big").alias("a_big"), F.col("cell").alias("a_cell"))
    b = placed.select(F.col("big").alias("b_big"), F.col("cell").alias("b_cell"))
    pairs = near.join(sized(a, n_cells), "a_big").join(sized(b, n_cells), "b_big")
    apart = F.lit(0)
    for i in range(grid.dims):
        steps = F.abs(grid.index(F.col("a_cell"), i) - grid.index(F.col("b_cell"), i)) - 1
        apart = apart + F.greatest(steps, F.lit(0)) * F.greatest(steps, F.lit(0))
    pairs = pairs.where((F.col("a_cell") < F.col("b_cell")) & (apart <= grid.parts**2))
    return _judged(grid, pairs.select("a_cell", "b_cell"), cells, n_cells)


def _judged(grid: Grid, pairs: DataFrame, boxes: DataFrame, n_boxes: int) -> DataFrame:
    """Pairs kept by their boxes' nearest corners, ``sure`` by their farthest."""
    boxes = boxes.select("cell", *grid.box_columns())
    a = _prefixed(boxes, "a_")
    b = _prefixed(boxes, "b_")
    both = pairs.join(sized(a, n_boxes), "a_cell").join(sized(b, n_boxes), "b_cell")
    both = both.where(grid.nearest("a_", "b_") <= grid.limit)
    sure = grid.farthest("a_", "b_") <= grid.limit
    return both.select("a_cell", "b_cell", sure.alias("sure"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair seen from either end: ``(a_cell, cell, ...)``."""
    rest = [c for c in pairs.columns if c not in ("a_cell", "b_cell")]
    ends = F.array(
        F.struct(F.col("a_cell").alias("f"), F.col("b_cell").alias("t")),
        F.struct(F.col("b_cell").alias("f"), F.col("a_cell").alias("t")),
    )
    seen = pairs.select(F.explode(ends).alias("e"), *rest)
    return seen.select(F.col("e.f").alias("a_cell"), F.col("e.t").alias("cell"), *rest)


def _rows_of(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows that lie in the named cells; a cell list is bounded by the grid."""
    return rows.join(lookup_side(cells.select("cell").distinct()), "cell", "left_semi")


def _vectors(grid: Grid, rows: DataFrame) -> DataFrame:
    """Equal rows as one vector with their weight: ``(id, cell, w, features)``.

    Only the rows of the cells that need it are made so; a copy of all of them would be as large as the table.
    """
    counted = rows.groupBy("cell", *grid.features).agg(F.sum("w").alias("w"))
    return counted.select(_vector(grid.features).alias("id"), "cell", "w", *grid.features)


def _vector(features: tuple) -> Column:
    return F.concat_ws(",", *[F.col(f).cast("double").cast("string") for f in features])


def _count_within(
    grid: Grid, asked: DataFrame, boxes: DataFrame, rows: DataFrame, enough: int, open_limit: int
) -> DataFrame:
    """Rows of each asked cell within eps of each asking point: ``(id, cell, hits)``.

    ``asked`` is ``(id, cell, q_lo*, q_hi*)``, ``boxes`` the asked cells' boxes,
    ``rows`` all rows an answer may count. Counting of a point stops at ``enough``.
    """
    parts = []
    asked = asked.repartition(width(asked))
    open_ = asked.join(sized(_prefixed(boxes, "t_").withColumnRenamed("t_cell", "cell"), boxes.count()), "cell")
    keys = ["id", "cell"]
    level = 0
    while True:
        open_ = open_.withColumns(
            {"_in": grid.farthest("q_", "t_") <= grid.limit, "_near": grid.nearest("q_", "t_") <= grid.limit}
        )
        open_ = materialise(open_.where("_near"))
        inside = materialise(open_.where("_in").groupBy(*keys).agg(F.sum("t_n").alias("hits")))
        parts.append(inside)
        met = inside.groupBy("id").agg(F.sum("hits").alias("h")).where(F.col("h") >= enough).select("id")
        open_ = materialise(open_.where("NOT _in").join(met, "id", "left_anti"))
        stats = scalars(open_, work=F.sum("t_n"))
        if not stats["work"]:
            return _summed(parts, keys)
        if stats["work"] <= open_limit or level >= LAST_LEVEL:
            break
        level += LEVEL_STEP
        wanted = open_.select("cell").distinct()
        finer = _rows_of(rows, wanted).withColumn("sub", grid.sub(level))
        finer = _prefixed(grid.boxes(finer, "cell", "sub"), "t_").withColumnRenamed("t_cell", "cell")
        parts.pop()  # a finer split counts the whole cell again
        again = open_.select(*keys, *grid.box_columns("q_")).distinct()
        parts.append(inside.join(again.select(*keys), keys, "left_anti"))
        open_ = again.join(finer, "cell")
    last = _vectors(grid, _rows_of(rows, open_.select("cell")))
    on = ["cell"]
    if level:
        last, on = last.withColumn("t_sub", grid.sub(level)), ["cell", "t_sub"]
    singles = _prefixed(grid.points(last.select(*on, "w", *grid.features)), "p_")
    for c in on:
        singles = singles.withColumnRenamed(f"p_{c}", c)
    met = open_.select(*on, "id", *grid.box_columns("q_")).join(singles, on)
    hits = met.where(grid.nearest("q_", "p_") <= grid.limit).groupBy(*keys).agg(F.sum("p_n").alias("hits"))
    return _summed(parts + [hits], keys)


def _summed(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy(*keys).agg(F.sum("hits").alias("hits"))


def _linked(
    grid: Grid, pairs: DataFrame, nodes: DataFrame, rows: DataFrame, open_limit: int
) -> DataFrame:
    """Component label of every core cell, from candidate pairs of core cells.

    Only pairs that still join two components are looked at more closely.
    """
    edges = pairs.where("sure").select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"))
    labels = components(nodes, edges)
    size = nodes.select("cell", "n")
    a = size.select(F.col("cell").alias("a_cell"), F.col("n").alias("a_n"))
    b = size.select(F.col("cell").alias("b_cell"), F.col("n").alias("b_n"))
    n = nodes.count()
    open_ = _across(pairs.where("NOT sure").select("a_cell", "b_cell"), labels, n)
    open_ = open_.join(sized(a, n), "a_cell").join(sized(b, n), "b_cell").select(
        "a_cell", "b_cell", (F.col("a_n") * F.col("b_n")).alias("work")
    )
    level = 0
    while True:
        open_ = materialise(_across(open_, labels, n))
        work = scalars(open_, w=F.sum("work"))["w"]
        if not work:
            return labels
        exact = work <= open_limit or level >= LAST_LEVEL
        level += LEVEL_STEP
        cells = open_.select(F.explode(F.array("a_cell", "b_cell")).alias("cell"))
        near_rows = _rows_of(rows, cells)
        if exact:
            pieces = grid.points(_vectors(grid, near_rows).select("cell", "w", *grid.features))
        else:
            pieces = grid.boxes(near_rows.withColumn("sub", grid.sub(level)), "cell", "sub").drop("sub")
        pieces = materialise(pieces)
        met = (
            open_.select("a_cell", "b_cell")
            .join(_prefixed(pieces, "a_"), "a_cell")
            .join(_prefixed(pieces, "b_"), "b_cell")
            .where(grid.nearest("a_", "b_") <= grid.limit)
        )
        judged = materialise(
            met.groupBy("a_cell", "b_cell").agg(
                F.max(grid.farthest("a_", "b_") <= grid.limit).alias("yes"),
                F.sum(F.col("a_n") * F.col("b_n")).alias("work"),
            )
        )
        found = judged.where("yes").select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"))
        labels = _merge(labels, found, n)
        if exact:
            return labels
        open_ = judged.where("NOT yes").select("a_cell", "b_cell", "work")


def _across(pairs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Pairs whose cells carry different labels."""
    la = labels.select(F.col("cell").alias("a_cell"), F.col("label").alias("la"))
    lb = labels.select(F.col("cell").alias("b_cell"), F.col("label").alias("lb"))
    return pairs.join(sized(la, n), "a_cell").join(sized(lb, n), "b_cell").where("la <> lb").drop("la", "lb")


def _merge(labels: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Join components linked by new edges: components of the labels themselves."""
    la = labels.select(F.col("cell").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("cell").alias("b"), F.col("label").alias("lb"))
    between = edges.join(sized(la, n), "a").join(sized(lb, n), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    groups = components(labels.select(F.col("label").alias("cell")).distinct(), between.distinct())
    renamed = groups.select(F.col("cell").alias("label"), F.col("label").alias("joined"))
    return materialise(labels.join(renamed, "label").select("cell", F.col("joined").alias("label")))


def dbscan(
    df: DataFrame,
    features: tuple,
    eps: float = EPS,
    min_rows: int = MIN_ROWS,
    open_limit: int = OPEN_LIMIT,
) -> DataFrame:
    """Add ``cluster_dbscan`` (-1 for outliers) and ``is_anomalie``.

    ``df`` is read several times and should be a stored table. Core rows and outliers do not depend on any order. A border row takes the smallest
    of the clusters it touches; clusters are numbered by their smallest cell.
    """
    ends = scalars(
        df, **{f"lo{i}": F.min(f).cast("double") for i, f in enumerate(features)},
        **{f"hi{i}": F.max(f).cast("double") for i, f in enumerate(features)},
    )
    if ends["lo0"] is None:
        return df.withColumns({"cluster_dbscan": F.lit(-1), "is_anomalie": F.lit(1)})
    grid = Grid(tuple(features), tuple(ends[f"lo{i}"] for i in range(len(features))), float(eps))
    span = max(ends[f"hi{i}"] - ends[f"lo{i}"] for i in range(len(features)))
    if span / grid.side >= (1 << grid.bits) - 1:
        raise ValueError("eps is too small for the range of the features")

    # Equal vectors become one point with a weight before they are compared, so a common vector is never compared row by row.
    vector = _vector(features)
    rows = df.select(grid.cell().alias("cell"), F.lit(1).cast("long").alias("w"), *features)
    cells = materialise(grid.boxes(rows, "cell"))
    spread = scalars(cells, **{f"s{i}": F.stddev_pop(grid.index(F.col("cell"), i)) for i in range(grid.dims)})
    axes = sorted(range(grid.dims), key=lambda i: -(spread[f"s{i}"] or 0.0))

    n_cells = cells.count()

    dense = cells.where(F.col("n") >= min_rows)
    sparse = cells.where(F.col("n") < min_rows)
    pairs = materialise(_neighbours(grid, cells, n_cells, axes))

    # A sparse cell is core as a whole when cells wholly within eps bring enough rows.
    weight = cells.select("cell", "n")
    certain = _both_ways(pairs.where("sure")).join(sized(weight, n_cells), "cell")
    certain = certain.groupBy(F.col("a_cell").alias("cell")).agg(F.sum("n").alias("more"))
    weighed = sparse.select("cell", "n").join(certain, "cell", "left").select(
        "cell", (F.col("n") + F.coalesce("more", F.lit(0))).alias("sum")
    )
    weighed = materialise(weighed)
    loose = materialise(_vectors(grid, _rows_of(rows, sparse)).join(weighed, "cell"))

    # The other rows of sparse cells ask the cells that are only partly within eps.
    unsure = loose.where(F.col("sum") < min_rows)
    points = _prefixed(grid.points(unsure), "q_").withColumnsRenamed({"q_id": "id", "q_cell": "a_cell"})
    doubtful = _both_ways(pairs.where("NOT sure").select("a_cell", "b_cell"))
    asked = doubtful.join(lookup_side(points), "a_cell").select("id", "cell", *grid.box_columns("q_"))
    hits = _count_within(grid, asked, cells, rows, min_rows, open_limit)
    hits = hits.groupBy("id").agg(F.sum("hits").alias("h"))
    core = F.col("sum") + F.coalesce("h", F.lit(0)) >= min_rows
    loose = materialise(loose.join(hits, "id", "left").withColumn("core", core).drop("sum", "h"))

    core_loose = loose.where("core")
    core_cells = materialise(dense.unionByName(grid.boxes(core_loose, "cell")))
    n_core = core_cells.count()
    core_rows = _rows_of(rows, dense).unionByName(core_loose.select("cell", "w", *grid.features))
    # Fewer rows can only tighten a box: sure pairs stay sure, the rest are judged again.
    kept = _judged(grid, pairs.where("NOT sure").select("a_cell", "b_cell"), core_cells, n_core)
    firm = pairs.where("sure")
    for end in ("a_cell", "b_cell"):
        firm = firm.join(sized(core_cells.select(F.col("cell").alias(end)), n_core), end, "left_semi")
    linked = materialise(kept.unionByName(firm.select("a_cell", "b_cell", "sure")))
    labels = _linked(grid, linked, core_cells, core_rows, open_limit)
    numbers = numbered(labels.select("label").distinct(), ["label"], "number").withColumn("number", F.col("number").cast("int"))
    by_cell = materialise(labels.join(numbers, "label").select("cell", "number"))

    # Border rows: not core, within eps of a core row; their own cell's core rows are.
    rest = loose.where("NOT core").drop("core")
    edge = _prefixed(grid.points(rest), "q_").withColumnsRenamed({"q_id": "id", "q_cell": "a_cell"})
    reach = _both_ways(pairs.select("a_cell", "b_cell"))
    touch = reach.join(lookup_side(edge), "a_cell").join(sized(by_cell.select("cell"), n_core), "cell", "left_semi")
    touch = touch.select("id", "cell", *grid.box_columns("q_"))
    touched = _count_within(grid, touch, core_cells, core_rows, 1 << 62, open_limit)
    inside = rest.join(by_cell, "cell").select("id", "number")
    border = touched.join(by_cell, "cell").select("id", "number").unionByName(inside)
    border = border.groupBy("id").agg(F.min("number").alias("number"))

    loose_labels = (
        core_loose.join(by_cell, "cell").select("cell", "id", "number")
        .unionByName(rest.join(border, "id").select("cell", "id", "number"))
    )
    entries = F.map_from_entries(F.collect_list(F.struct("id", "number")))
    few = loose_labels.groupBy("cell").agg(entries.alias("members"))  # under min_rows each
    lookup = (
        by_cell.join(dense.select("cell"), "cell", "left_semi")
        .select("cell", "number", F.lit(None).cast("map<string,int>").alias("members"))
        .unionByName(few.select("cell", F.lit(None).cast("int").alias("number"), F.col("members").cast("map<string,int>").alias("members")))
    )
    found = F.coalesce("number", F.element_at("members", vector), F.lit(-1))
    placed = df.withColumn("cell", grid.cell()).join(lookup_side(lookup), "cell", "left")
    return placed.withColumns(
        {"cluster_dbscan": found, "is_anomalie": (found == -1).cast("int")}
    ).drop("cell", "number", "members")


def outlier_counts(df: DataFrame) -> DataFrame:
    """Number of clusters and of outliers."""
    label = F.col("cluster_dbscan")
    return df.agg(
        F.countDistinct(F.when(label >= 0, label)).alias("n_clusters"),
        F.count_if(label == -1).alias("n_outliers"),
    )
