"""Shards of even size that keep linked documents together: balanced label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import OWN, TAG, release, running_total, stage, tagged, text_or_empty

RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _ranges(position: Column, counts: list[int]) -> Column:
    """Number of the consecutive range, of the lengths in ``counts``, that holds a position."""
    out, upper = F.lit(len(counts) - 1), sum(counts)
    for i in range(len(counts) - 2, -1, -1):
        upper -= counts[i + 1]
        out = F.when(position < upper, i).otherwise(out)
    return out


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _permits(asked: dict[tuple[int, int], int], loads: list[int], quota: int) -> list[int]:
    """How many rows may move from shard to shard: as many as come back, and what the quota leaves."""
    shards = len(loads)
    out = {pair: min(n, asked.get(pair[::-1], 0)) for pair, n in asked.items()}
    left = [max(0, quota - n) for n in loads]
    for pair in sorted(asked, key=lambda p: (-asked[p], p)):
        more = min(asked[pair] - out[pair], left[pair[1]])
        out[pair] += more
        left[pair[1]] -= more
    return [out.get((a, b), 0) for a in range(shards) for b in range(shards)]


def _moved(cells: DataFrame, moves: DataFrame) -> DataFrame:
    changed = (
        cells.union(moves.select("link", "shard", (-F.col("moved")).alias("n")))
        .union(moves.select("link", F.col("to").alias("shard"), F.col("moved").alias("n")))
        .groupBy("link", "shard")
        .agg(F.sum("n").alias("n"))
        .where("n > 0")
    )
    return stage(changed, "shard-cells")


def _whole_links(links: DataFrame, room: list[tuple[int, int, int]], shards: int) -> DataFrame:
    """Deals links ``(link, shard, n)`` whole to the rooms ``(shard, to, n)`` of their shard, the smallest first: ``(link, shard, to, n)``."""
    spans, ends = [], [0] * (shards + 1)
    for shard, to, n in sorted(room):
        spans.append((shard, to, ends[shard], ends[shard] + n))
        ends[shard] += n
    rooms = F.broadcast(links.sparkSession.createDataFrame(spans, "shard int, to int, low long, high long"))
    largest = rooms.groupBy("shard").agg(F.max(F.col("high") - F.col("low")).alias("largest"))
    fitting = links.join(F.broadcast(largest), "shard").where("n <= largest").select("link", "shard", "n")
    queued = running_total(fitting, ["shard", "n", "link"], ["n"], "shard-whole")
    bases = queued.groupBy("shard").agg(F.min("before_n").alias("base"))
    queued_at = queued.join(bases, "shard").withColumn("at", F.col("before_n") - F.col("base"))
    dealt = queued_at.join(rooms, "shard").where((F.col("at") >= F.col("low")) & (F.col("at") + F.col("n") <= F.col("high")))
    dealt = stage(dealt.select("link", "shard", "to", "n"), "shard-dealt")
    release(queued)
    return dealt


def _links(cells: DataFrame) -> DataFrame:
    return cells.groupBy("link").agg(F.max("shard").alias("shard"), F.sum("n").alias("n"), F.count("*").alias("parts"))


def _step(cells: DataFrame, shards: int, quota: int, targets: list[int]) -> tuple[DataFrame, bool, set[int]]:
    """Moves cells to their link's fullest open cell in ``targets``; whether any moved, and shards that can't take all who ask."""
    loads = _loads(cells, shards)
    open_cells = cells.where(F.col("n") < quota)
    best = open_cells.where(F.col("shard").isin(targets)).groupBy("link").agg(
        F.max(F.struct("n", F.pmod(F.xxhash64("link", "shard"), F.lit(1 << 20)).alias("tie"), "shard")).alias("best")
    )
    wishes = open_cells.join(best.select("link", F.col("best.shard").alias("to"), F.col("best.n").alias("there")), "link")
    wishes = stage(wishes.where("shard <> to and n <= there").select("link", "shard", "to", "there", "n"), "shard-wishes")
    asked = {(r["shard"], r["to"]): r["n"] for r in wishes.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
    permits = _permits(asked, loads, quota)
    unmet = {(a, to): n - permits[a * shards + to] for (a, to), n in asked.items() if n > permits[a * shards + to]}
    yields = None
    if unmet:
        whole = _links(cells).where((F.col("parts") == 1) & (F.col("n") < quota))
        yields = _whole_links(whole, [(to, a, n) for (a, to), n in unmet.items()], shards)
        for r in yields.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():
            permits[r["to"] * shards + r["shard"]] += r["n"]
            unmet[r["to"], r["shard"]] -= r["n"]
    full = {to for (_, to), n in unmet.items() if n > 0}
    if any(permits):
        permit = F.get(F.array(*[F.lit(n) for n in permits]), F.col("shard") * shards + F.col("to"))
        queued = running_total(wishes, ["shard", "to", F.desc("there"), "link"], ["n"], "shard-queues")
        bases = queued.groupBy("shard", "to").agg(F.min("before_n").alias("base"))
        fits = permit - (F.col("before_n") - F.col("base"))
        moves = queued.join(bases, ["shard", "to"]).withColumn("moved", F.greatest(F.lit(0), F.least("n", fits)).cast("long"))
        moves = moves.where("moved > 0").select("link", "shard", "to", "moved")
        after = _moved(cells, moves if yields is None else moves.union(yields))
        release(queued)
        release(cells)
    else:
        after = cells
    release(wishes)
    release(yields)
    return after, any(permits), full


def _together(cells: DataFrame, shards: int, quota: int) -> tuple[DataFrame, bool]:
    """Moves links that are still apart whole to a shard that has room for all of their rows."""
    room = [(0, s, quota - n) for s, n in enumerate(_loads(cells, shards)) if n < quota]
    apart = _links(cells).where("parts > 1").select("link", F.lit(0).alias("shard"), "n")
    if not room or apart.where(F.col("n") <= max(n for _, _, n in room)).isEmpty():
        return cells, False
    dealt = _whole_links(apart, room, shards)
    moves = cells.withColumnRenamed("n", "moved").join(dealt.select("link", "to"), "link").where("shard <> to")
    any_dealt = not dealt.isEmpty()
    after = _moved(cells, moves.select("link", "shard", "to", "moved")) if any_dealt else cells
    release(dealt)
    if any_dealt:
        release(cells)
    return after, any_dealt


def propagate(cells: DataFrame, shards: int, quota: int) -> DataFrame:
    """Moves linked documents towards the shard where most of their neighbours are.

    ``cells`` holds ``(link, shard, n)``: how many documents of a link lie in a shard, which
    is each of its documents' whole neighbourhood. In every round each cell joins its link's
    histogram and asks to move to the fullest shard that the link does not fill alone. From
    one shard to another as many rows may move as move back, and beyond that what the
    other's quota leaves; requests with most neighbours waiting go first and the last one
    may be cut. For requests still unmet, links that lie whole in the wanted shard give way:
    they change places, whole, with as many of the rows that ask. A shard that can't take all
    who ask is no choice for the rest of the round, and cells ask for their link's fullest
    shard among the others. At last links still apart go together where a shard has room for
    all their rows.

    Rounds end when no choice of any link is permitted, and they do end: in a step the cells
    of a link move to one cell at least as full, so the sum of the squares of ``n`` grows with
    every step that moves anything; links that give way stay whole and leave it as it is; and
    it can't pass the squares of the links' sizes.
    """
    while True:
        moved, targets = False, set(range(shards))
        while targets:
            cells, more, full = _step(cells, shards, quota, sorted(targets))
            moved |= more
            if not full:
                break
            targets -= full
        cells, more = _together(cells, shards, quota)
        if not (moved or more):
            return cells


def _shares(loads: list[int], total: int) -> list[int]:
    """Rows of each shard, at most one apart: the fullest shards take one more."""
    quota, more = divmod(total, len(loads))
    share = [quota] * len(loads)
    for s in sorted(range(len(loads)), key=lambda s: (-loads[s], s))[:more]:
        share[s] += 1
    return share


def _neighbours(cells: DataFrame) -> int:
    """Pairs of linked documents in one shard, each counted from both ends, and each document with itself."""
    n = F.col("n").cast("decimal(19,0)")
    return int(cells.agg(F.sum(n * n)).first()[0] or 0)


def _best_places(links: list[tuple[bytes, int]], room: list[int]) -> list[tuple[bytes, int, int]]:
    """Largest first: a link goes whole to the least room that holds it, or else fills the largest rooms."""
    room, out = list(room), []
    for link, n in sorted(links, key=lambda k: (-k[1], k[0])):
        holds = [s for s in range(len(room)) if room[s] >= n]
        order = [min(holds, key=lambda s: (room[s], s))] if holds else sorted(range(len(room)), key=lambda s: (-room[s], s))
        for s in order:
            part = min(n, room[s])
            if part:
                out.append((link, s, part))
                room[s] -= part
                n -= part
    return out


def laid_out(cells: DataFrame, shards: int, total: int) -> DataFrame:
    """Lays links that propagation left apart end to end into the room beside the whole ones.

    The largest links and the largest rooms come first. A border between two rooms cuts one
    link at most; those few, fewer than shards, are placed again by best fit. Whole links that
    a shard's share has no room for are laid with them. Where no shard is above its share, the
    layout is taken only if it keeps more neighbours together. Shares afterwards hold all cells.
    """
    links = stage(_links(cells), "shard-links")
    whole, apart = links.where("parts = 1").select("link", "shard", "n"), links.where("parts > 1").select("link", "n")
    loads = _loads(whole, shards)
    share = _shares(loads, total)
    held = None
    if any(n > q for n, q in zip(loads, share)):
        held = running_total(whole, ["shard", F.desc("n"), "link"], ["n"], "shard-held")
        bases = held.groupBy("shard").agg(F.min("before_n").alias("base"))
        most = F.get(F.array(*[F.lit(n) for n in share]), F.col("shard"))
        judged = held.join(bases, "shard").withColumn("fits", F.col("before_n") - F.col("base") + F.col("n") <= most)
        whole, apart = judged.where("fits").select("link", "shard", "n"), apart.union(judged.where("not fits").select("link", "n"))
        loads = _loads(whole, shards)
    above = held is not None or any(n > q for n, q in zip(_loads(cells, shards), _shares(_loads(cells, shards), total)))
    if apart.isEmpty():
        release(links)
        return cells
    spans, end = [], 0
    for room, s in sorted(((share[s] - loads[s], s) for s in range(shards)), key=lambda r: (-r[0], r[1])):
        spans.append((s, end, end + room))
        end += room
    queued = running_total(apart, [F.desc("n"), "link"], ["n"], "shard-laid")
    rooms = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for s, a, b in spans])
    met = F.filter(rooms, lambda r: (r["high"] > F.col("before_n")) & (r["low"] < F.col("before_n") + F.col("n")))
    queued_at = queued.select("link", "n", F.transform(met, lambda r: r["shard"]).alias("to"))
    fitting = stage(whole.union(queued_at.where("size(to) = 1").select("link", F.col("to")[0].alias("shard"), "n")), "shard-fitting")
    # Borders lie between two rooms, so at most ``shards - 1`` links are cut.
    cut = [(bytes(r["link"]), r["n"]) for r in queued_at.where("size(to) > 1").collect()]
    room = [q - n for q, n in zip(share, _loads(fitting, shards))]
    laid = stage(fitting.union(cells.sparkSession.createDataFrame(_best_places(cut, room), cells.schema)), "shard-cells")
    release(fitting)
    for used in (links, held, queued):
        release(used)
    if not above and _neighbours(laid) <= _neighbours(cells):
        release(laid)
        return cells
    release(cells)
    return laid


def even_shards(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    shards: int = 8,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of every row.

    The law is ``rows``: counts of any two shards differ by at most one. Documents with equal
    text are linked. Every document starts in the shard of its hash; linked ones then move by
    label propagation under a quota of a shard's share of all rows, until no move is left that
    the quotas permit; links that are still apart are then laid end to end where that keeps
    more neighbours together. Documents without a link fill what is left, so they cost no cut
    edge. A link with more documents than a shard may hold is spread over several.

    Null text counts as empty, its size is 1; empty texts are linked like others. Repeated
    rows are rows of their own. ``slot`` numbers a shard's rows by id without gaps.
    ``grown_shard`` is null under this law. An empty table gives an empty result. An input
    column with the name of a result column gives way to it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    plain = text_or_empty(text)
    own = docs.select(
        *names,
        F.col(doc_id).cast("long").alias(f"{OWN}id"),
        (F.octet_length(plain) + 1).cast("long").alias(f"{OWN}size"),
        F.crc32(plain.cast("binary")).alias(f"{OWN}crc"),
        F.unhex(F.sha2(plain.cast("binary"), 256)).alias(f"{OWN}link"),
    )
    rows = stage(tagged(own), "shard-rows")
    total = rows.count()
    start = F.pmod(F.xxhash64(f"{OWN}id", TAG), F.lit(shards)).cast("int")
    counted = rows.groupBy(F.col(f"{OWN}link").alias("link"), start.alias("shard")).agg(F.count("*").alias("n"))
    sizes = counted.groupBy("link").agg(F.sum("n").alias("all"))
    cells = stage(counted.join(sizes.where("all > 1").select("link"), "link").select("link", "shard", "n"), "shard-cells")
    quota = total // shards
    cells = laid_out(propagate(cells, shards, quota), shards, total)
    loads = _loads(cells, shards)
    share = _shares(loads, total)

    # Rows of a link are equal in all their edges: its first rows by id go to its first cell, and so on.
    linked = cells.groupBy("link").agg(F.sum("n").alias("placed"))
    by_link = rows.select(TAG, f"{OWN}id", F.col(f"{OWN}link").alias("link"), F.lit(1).cast("long").alias("one")).join(linked, "link", "left")
    numbered = running_total(
        by_link.where("placed is not null").select("link", f"{OWN}id", TAG, "one"), ["link", f"{OWN}id", TAG], ["one"], "shard-linked"
    )
    firsts = numbered.groupBy("link").agg(F.min("before_one").alias("base"))
    in_order = Window.partitionBy("link").orderBy("shard")
    spans = cells.select("link", "shard", (F.sum("n").over(in_order) - F.col("n")).alias("low"), F.sum("n").over(in_order).alias("high"))
    spans = spans.join(firsts, "link").select("link", "shard", (F.col("low") + F.col("base")).alias("low"), (F.col("high") + F.col("base")).alias("high"))
    spans = stage(spans, "shard-spans")
    placed = numbered.join(spans, "link").where("before_one >= low and before_one < high").select(TAG, "shard")
    placed = stage(placed, "shard-placed")
    free = rows.select(TAG, f"{OWN}id").join(placed.select(TAG), TAG, "left_anti")
    spread = F.xxhash64(f"{OWN}id", F.lit("free"))
    free = running_total(
        free.withColumn("one", F.lit(1).cast("long")).withColumn("spread", spread), ["spread", f"{OWN}id", TAG], ["one"], "shard-free"
    )
    rest = [q - n for q, n in zip(share, loads)]
    all_placed = placed.union(free.select(TAG, _ranges(F.col("before_one"), rest).cast("int").alias("shard")))
    whole = rows.drop(f"{OWN}link").join(all_placed.withColumnRenamed("shard", f"{OWN}shard"), TAG).withColumn(f"{OWN}one", F.lit(1).cast("long"))
    slots = running_total(whole, [f"{OWN}shard", f"{OWN}id", TAG], [f"{OWN}one"], "shard-slots")
    firsts_of = F.array(*[F.lit(sum(share[:s])) for s in range(shards)])
    return slots.select(
        *names,
        F.col(f"{OWN}size").alias("size"),
        F.col(f"{OWN}crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(f"{OWN}shard").alias("shard"),
        (F.col(f"before_{OWN}one") - F.get(firsts_of, F.col(f"{OWN}shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
