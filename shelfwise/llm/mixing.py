"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import OWN, TAG, release, running_total, stage, tagged, text_or_empty

#: Bytes up to which a table with a row per source is sent to all tasks.
BROADCAST_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"
RESULT = {f"{OWN}size": "size", f"{OWN}source_size": "source_size", f"{OWN}target": "target", f"{OWN}taken": "taken"}


def word_count(text: Column) -> Column:
    """Runs of anything but blank and the ASCII controls from tab to carriage return."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Target of each source, from ``(source, source_size)`` with one row per source.

    Sources sorted by code point, null last, take the weights in turn. All of them together
    get ``share`` of all words by weight, none more than ``cap`` times its own size; what a
    stopped source leaves goes to the others by weight. In the order of size over weight the
    stopped sources come first, so the level of the others follows from running totals.
    """
    ordered = running_total(
        sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], ["one"], "mix-sources"
    )
    turn = F.array(*[F.lit(w) for w in weights])
    weighed = ordered.withColumn("weight", F.get(turn, (F.col("before_one") % len(weights)).cast("int")).cast("long"))
    weighed = weighed.withColumn("most", F.col("source_size") * cap).select("source", "source_size", "weight", "most", F.col("before_one").alias("turn"))
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight = (whole["words"] or 0) * share, whole["weight"] or 1
    by_ratio = running_total(weighed, [F.col("most") / F.col("weight"), "turn"], ["most", "weight"], "mix-levels")
    level = (F.lit(float(words)) - F.col("before_most")) / (F.lit(float(weight)) - F.col("before_weight"))
    top = by_ratio.agg(F.max(level).alias("level")).first()["level"] or 0.0
    target = F.least(F.col("most").cast("double"), F.lit(float(top)) * F.col("weight"))
    return by_ratio.select("source", "source_size", "turn", target.alias("target"))


def small_side(df: DataFrame, text: str | None = None) -> DataFrame:
    """A table of one row per source as a broadcast side, if its counted rows and bytes allow it.

    Otherwise it is joined by shuffle, and Spark splits skewed keys.
    """
    found = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(text) if text else F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] * 64 + (found["bytes"] or 0) <= BROADCAST_BYTES else df


def schedule(rows: DataFrame, targets: DataFrame, budget: int, seed: int) -> DataFrame:
    """What the mix takes, in its order: ``(tag, epoch, finish, words, before_words)``.

    A source is gone through as often as its target asks for, each time in another shuffled
    order. A document's finish time is the words of its source up to its own end over the source's
    target. The document in service at virtual time 1 is two pieces, before and after the last whole
    word that its source's target holds. All pieces of all sources are sorted by finish time over the whole
    cluster and taken in that order until the ``budget`` of words is spent.
    """
    times = F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    wanted = small_side(targets.where("target > 0"), "source")
    runs = rows.where(f"{OWN}size > 0").join(wanted, F.col(f"{OWN}source").eqNullSafe(F.col("source")))
    runs = runs.select(
        TAG, f"{OWN}id", f"{OWN}size", "turn", "target",
        F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"),
    )
    runs = runs.withColumn("place", F.md5(F.concat_ws("|", F.lit(seed), "epoch", F.coalesce(F.col(f"{OWN}id").cast("string"), F.lit(""))).cast("binary")))
    laid = running_total(runs, ["turn", "epoch", "place", f"{OWN}id", f"{OWN}size", TAG], [f"{OWN}size"], "mix-queues")
    bases = laid.groupBy("turn").agg(F.min(f"before_{OWN}size").alias("base"))
    edge = F.floor("target")
    queued = laid.join(small_side(bases), "turn").withColumn("start", F.col(f"before_{OWN}size") - F.col("base"))
    queued = queued.withColumn("end", F.col("start") + F.col(f"{OWN}size"))
    piece = lambda a, b: F.struct(b.cast("long").alias("end"), (b - a).cast("long").alias("words"))
    start, end = F.col("start"), F.col("end")
    pieces = F.when((start < edge) & (edge < end), F.array(piece(start, edge), piece(edge, end))).otherwise(F.array(piece(start, end)))
    queued = queued.select(TAG, f"{OWN}id", "turn", "epoch", "target", F.explode(pieces).alias("p")).select(
        TAG, f"{OWN}id", "turn", "epoch", (F.col("p.end") / F.col("target")).alias("finish"), F.col("p.words").alias("words")
    )
    ordered = running_total(queued, ["finish", "turn", "epoch", f"{OWN}id", TAG], ["words"], "mix-order")
    release(laid)
    left = F.lit(budget).cast("long") - F.col("before_words")
    return ordered.where(left > 0).withColumn("words", F.least("words", left))


def mix(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    cap: int = 3,
    seed: int = 7,
    keep: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Every row with its size, its source's size and target and the words taken; and the schedule.

    The first table has ``keep`` and columns with the own prefix. Null text has size 0; a
    null source is a source of its own and comes last. A text without words is never taken.
    Rows that repeat an id are rows of their own and change places only with each other.
    Empty tables give empty results. The order depends on ids and the seed alone, so reruns
    agree. Hot sources are ranges of one global order, never one task. The
    budget is the whole words of all targets.
    """
    keep = list(docs.columns if keep is None else keep)
    own = docs.select(
        *keep,
        F.col(doc_id).cast("long").alias(f"{OWN}id"),
        F.col(source).cast("string").alias(f"{OWN}source"),
        word_count(text_or_empty(text)).alias(f"{OWN}size"),
    )
    rows = stage(tagged(own), "mix-rows")
    sizes = rows.groupBy(F.col(f"{OWN}source").alias("source")).agg(F.sum(f"{OWN}size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, share, cap), "mix-targets")
    budget = targets.agg(F.sum(F.floor("target"))).first()[0] or 0
    order = schedule(rows.select(TAG, f"{OWN}id", f"{OWN}source", f"{OWN}size"), targets, budget, seed)
    taken = order.groupBy(TAG).agg(F.sum("words").alias(f"{OWN}taken"))
    own_targets = targets.select(
        F.col("source").alias(f"{OWN}mixed"), F.col("source_size").alias(f"{OWN}source_size"), F.col("target").alias(f"{OWN}target")
    )
    placed = (
        rows.join(small_side(own_targets, f"{OWN}mixed"), F.col(f"{OWN}source").eqNullSafe(F.col(f"{OWN}mixed")))
        .join(taken, TAG, "left")
        .withColumn(f"{OWN}taken", F.coalesce(f"{OWN}taken", F.lit(0)).cast("long"))
    )
    return placed, order


def mixture(docs: DataFrame, *, keep: list[str] | None = None, **how) -> DataFrame:
    """``keep`` and ``size``, ``source_size``, ``target``, ``taken`` of every row; see ``mix``.

    An input column with the name of a result column gives way to it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.values()]
    placed, _ = mix(docs, keep=names, **how)
    return placed.select(*names, *[F.col(a).alias(b) for a, b in RESULT.items()])


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each whole document as often as it is taken, with exactly the columns of ``docs``.

    A document that is cut off by the budget is in the mix if at least half of it was taken.
    """
    placed, _ = mix(docs, **how)
    times = F.floor(F.col(f"{OWN}taken") / F.col(f"{OWN}size") + 0.5).cast("int")
    return (
        placed.where((F.col(f"{OWN}size") > 0) & (times > 0))
        .withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(1), times)))
        .select(*docs.columns)
    )
