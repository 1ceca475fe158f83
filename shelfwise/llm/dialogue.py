"""Conversation structure repair by Wagner-Fischer alignment with the strings of a role grammar."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from shelfwise.llm.common import OWN, TAG, arrow_type, map_batches, release, shuffle_width, stage, tagged

#: What an edit costs; an insert makes a turn without text.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns that are aligned at once; longer conversations are aligned in runs of this many.
BLOCK = 16
#: Text of one conversation that a task holds; beyond it the text is hashed as a stream.
HELD = 1 << 24

# States between turns: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: A state whose cost lies further above the least can't be on a best path: two inserts and a
#: deletion lead from any state to where every future of any other can be followed.
SLACK = 2 * INSERT + DELETE

_BLANK = r"\x20\x09-\x0D"


# ---- alignment of one run of turns ------------------------------------------------------
#
# A turn is a letter: s, u, a by the initial of its role, x for any other, upper case if its
# text is truncated, d if it must be deleted. A target is a string over s, u and a.


def target_of(entry: int, system: bool, length: int) -> str:
    """The grammar's string of ``length`` turns that follows the state ``entry``."""
    first = "a" if entry == USER else "u"
    other = "u" if first == "a" else "a"
    rest = length - system
    return ("s" if system else "") + (first + other) * (rest // 2) + first * (rest % 2)


def state_after(entry: int, target: str) -> int:
    return "sua".index(target[-1]) + 1 if target else entry


def _place(code: str, wanted: str) -> int | None:
    """Cost of putting a turn in a wanted place, ``None`` if no edit can."""
    if code == "d":
        return None
    late = TRUNCATED if code.isupper() else 0
    if code.lower() == wanted:
        return late
    return None if wanted == "s" else REROLE + late


def wagner_fischer(codes: str, target: str, budget: int) -> tuple[int, str] | None:
    """Least cost of turning ``codes`` into ``target`` and its least audit, or ``None`` above ``budget``.

    Costs of what is left are filled from the end, only in Ukkonen's band: with a deletions
    and b inserts, b - a is the difference of the lengths and 3a + 2b at most the budget, so
    no path of that cost leaves the diagonals -a to b. The audit is read from the front and
    takes the least letter on a best path at each step.
    """
    m, n = len(codes), len(target)
    deletions = (budget - INSERT * (n - m)) // (DELETE + INSERT)
    inserts = deletions + n - m
    if deletions < 0 or inserts < 0:
        return None
    far = budget + 1
    table: list[dict[int, int]] = [{} for _ in range(m + 1)]
    for i in range(m, -1, -1):
        here, below = table[i], table[i + 1] if i < m else {}
        for j in range(min(n, i + inserts), max(0, i - deletions) - 1, -1):
            if i == m and j == n:
                here[j] = 0
                continue
            best = far
            if i < m:
                best = DELETE + below.get(j, far)
                if j < n and (cost := _place(codes[i], target[j])) is not None:
                    best = min(best, cost + below.get(j + 1, far))
            if j < n and target[j] != "s":
                best = min(best, INSERT + here.get(j + 1, far))
            here[j] = min(best, far)
    total = table[0].get(0, far)
    if total > budget:
        return None
    audit, i, j = [], 0, 0
    while i < m or j < n:
        left = table[i][j]
        if i < m and left == DELETE + table[i + 1].get(j, far):
            audit.append("D")
            i += 1
        elif j < n and target[j] != "s" and left == INSERT + table[i].get(j + 1, far):
            audit.append("I")
            j += 1
        else:
            audit.append("K" if codes[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


@lru_cache(maxsize=1 << 16)
def align(codes: str, entry: int, leave: int) -> tuple[int, str] | None:
    """Least ``(cost, audit)`` that leads from one state to another over a run of turns.

    All lengths of the grammar's string whose difference alone doesn't cost more than the
    best so far are aligned, nearest first. The budget starts low and doubles, so bands stay
    narrow.
    """
    m, budget = len(codes), 4
    most = DELETE * m + SLACK
    systems = (False, True) if entry == START and any(c in "sS" for c in codes) else (False,)
    while True:
        best: tuple[int, str] | None = None
        limit = min(budget, most)
        lengths = range(max(0, m - limit // DELETE), m + limit // INSERT + 1)
        for n in sorted(lengths, key=lambda n: abs(n - m)):
            for system in systems:
                if n < system:
                    continue
                target = target_of(entry, system, n)
                if state_after(entry, target) != leave:
                    continue
                found = wagner_fischer(codes, target, best[0] if best else limit)
                if found and (best is None or found < best):
                    best = found
        if best or budget >= most:
            return best
        budget *= 2


def transfer(codes: str, entry: int) -> dict[int, tuple[int, str]]:
    """For every state after a whole run of any length: least ``(cost, audit)`` from ``entry``.

    Runs are aligned in blocks and joined at the state between them. Of two audits of equal
    cost over the same turns neither begins the other, so their order decides that of the
    joined ones. What all open audits share is put aside, so the work grows with the turns.
    """
    settled: list[str] = []
    now = {entry: (0, "")}
    for at in range(0, len(codes), BLOCK):
        block = codes[at : at + BLOCK]
        now = step(now, {(s, t): align(block, s, t) for s in now for t in STATES})
        shared = os.path.commonprefix([a for _, a in now.values()])
        settled.append(shared)
        now = {s: (cost, audit[len(shared) :]) for s, (cost, audit) in now.items()}
    before = "".join(settled)
    return {s: (cost, before + audit) for s, (cost, audit) in now.items()}


def step(now: dict[int, tuple[int, str]], moves: dict[tuple[int, int], tuple[int, str] | None]) -> dict[int, tuple[int, str]]:
    after: dict[int, tuple[int, str]] = {}
    for (s, t), move in moves.items():
        if move is None or s not in now:
            continue
        found = (now[s][0] + move[0], now[s][1] + move[1])
        if t not in after or found < after[t]:
            after[t] = found
    least = min(cost for cost, _ in after.values())
    return {t: v for t, v in after.items() if v[0] <= least + SLACK}


def finish(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The best of the ends at which a conversation may stop."""
    return min(ends[s] for s in (START, ASSISTANT) if s in ends)


class Writer:
    """SHA-256 of the repaired ``role:text`` lines, fed turn by turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.lines = audit, 0, 0
        kept = sum(1 for c in audit if c != "D")
        self.turn = 1 if kept % 2 else 0  # an odd number of turns starts with the system's
        self.sum = hashlib.sha256()

    def _line(self, role: str | None, text: str) -> None:
        place = self.lines - self.turn
        wanted = ("user", "assistant")[place % 2] if place >= 0 else "system"
        self.sum.update(f"{chr(10) if self.lines else ''}{wanted if role is None else role}:{text}".encode())
        self.lines += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(None, "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else None, text)

    def end(self) -> str:
        self._inserts()
        return self.sum.hexdigest()


# ---- Spark job --------------------------------------------------------------------------

_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_MOVES = StructType([StructField(n, t, False) for n, t in (("s", IntegerType()), ("t", IntegerType()), ("cost", LongType()), ("audit", StringType()))])


def _run_fields(conv: StructField) -> list[StructField]:
    """Of one run of a conversation's turns: counts, edges, and either the result or its transfers."""
    return [
        conv,
        StructField("part", LongType(), False),
        *[StructField(n, LongType(), False) for n in _COUNTS],
        StructField("first_turn", LongType()), StructField("last_turn", LongType()),
        StructField("first_class", StringType()), StructField("last_class", StringType()),
        StructField("cost", LongType()), StructField("audit", StringType()), StructField("sha", StringType()),
        StructField("moves", ArrayType(_MOVES, False)),
    ]


class _Run:
    """Turns of one conversation that follow each other in a task."""

    def __init__(self, conv, part: int, after_border: bool, most: int):
        self.conv, self.part, self.border, self.most = conv, part, after_border, most
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first_turn = self.last_turn = self.first = self.last = None
        self.codes: list[str] = []
        self.held: list[tuple[str, str]] = []
        self.bytes = 0

    def add(self, turn: int | None, kind: str, code: str, fault: str | None, role: str, text: str) -> None:
        c = self.counts
        c["rows"] += 1
        if fault:
            c[fault] += 1
        if self.last is not None and self.last + kind not in ("su", "ua", "au"):
            c["illegal"] += 1
        if turn is not None and turn != self.last_turn:
            c["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.first = self.first or kind
        self.last = kind
        self.codes.append(code)
        if not self.border:
            self.held.append((role, text))
            self.bytes += len(text)
            if self.bytes > self.most:
                self.border, self.held = True, []

    def row(self, border: bool) -> tuple:
        codes = "".join(self.codes)
        cost = audit = sha = moves = None
        if border or self.border:
            moves = [
                {"s": s, "t": t, "cost": c, "audit": a} for s in STATES for t, (c, a) in transfer(codes, s).items()
            ]
        else:
            cost, audit = finish(transfer(codes, START))
            writer = Writer(audit)
            for role, text in self.held:
                writer.add(role, text)
            sha = writer.end()
        counts = [self.counts[n] for n in _COUNTS]
        return (self.conv, self.part, *counts, self.first_turn, self.last_turn, self.first, self.last, cost, audit, sha, moves)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _batches(rows: Iterator[tuple], fields: list[StructField], size: int = 2_000) -> Iterator[pa.RecordBatch]:
    def made(some: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, type=k) for c, k in zip(zip(*some), kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    kinds = [arrow_type(f.dataType) for f in fields]
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield made(some)
            some = []
    if some:
        yield made(some)


def _find_runs(fields: list[StructField], names: list[str], held: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, run, first = TaskContext.get().partitionId(), None, True
        for conv, turn, kind, code, fault, role, text in _rows(batches, names):
            if run is None or conv != run.conv:
                if run is not None:
                    yield run.row(border=False)
                run, first = _Run(conv, part, first, held), False
            run.add(turn, kind, code, fault, role, text)
        if run is not None:
            yield run.row(border=True)

    return lambda batches: _batches(runs(batches), fields)


def _joined(parts: list[dict]) -> tuple:
    """Counts, cost and audit of a conversation from its runs in order."""
    now, totals, before = {START: (0, "")}, dict.fromkeys(_COUNTS, 0), None
    first_turn = last_turn = None
    for p in parts:
        now = step(now, {(m["s"], m["t"]): (m["cost"], m["audit"]) for m in p["moves"]})
        for n in _COUNTS:
            totals[n] += p[n]
        if before is not None and before + p["first_class"] not in ("su", "ua", "au"):
            totals["illegal"] += 1
        before = p["last_class"]
        if p["first_turn"] is not None:
            totals["turns"] -= p["first_turn"] == last_turn
            first_turn = p["first_turn"] if first_turn is None else first_turn
            last_turn = p["last_turn"]
    return (*(totals[n] for n in _COUNTS), first_turn, last_turn, *finish(now))


def _stream_hash(fields: list[StructField], names: list[str]):
    """Rows come as the audit of a conversation, then its turns in order."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, writer = None, None
        for c, audit, role, text in _rows(batches, names):
            if audit is not None:
                if writer is not None:
                    yield conv, writer.end()
                conv, writer = c, Writer(audit)
            else:
                writer.add(role, text)
        if writer is not None:
            yield conv, writer.end()

    return lambda batches: _batches(hashed(batches), fields)


def marked_turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All turns, staged, and those with their fault (``blank``, ``duplicate``, ``truncated`` or null), class and code letter.

    A duplicate has role and text of an earlier turn of its conversation. Only keys that
    occur more than once are joined back, so a common turn is a skewed join side at most.
    """
    blank, ends = ~F.col(f"{OWN}text").rlike(f"[^{_BLANK}]"), F.col(f"{OWN}text").rlike(rf"[.!?][{_BLANK}]*\z")
    initial = F.substring(f"{OWN}role", 1, 1)
    own = turns.select(
        F.col(conv_id).alias(f"{OWN}conv"), F.col(turn).cast("long").alias(f"{OWN}turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias(f"{OWN}role"), F.coalesce(F.col(text), F.lit(" ")).alias(f"{OWN}text"),
    )
    own = own.select(
        "*", F.when(blank, "blank").when(~ends, "truncated").alias(f"{OWN}fault"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias(f"{OWN}class"),
        F.sha2(F.concat(F.length(f"{OWN}role").cast("string"), F.lit(":"), f"{OWN}role", f"{OWN}text"), 256).alias(f"{OWN}digest"),
    )
    base = stage(tagged(own), "dialogue-turns")
    full = base.where(~F.col(f"{OWN}fault").eqNullSafe("blank"))
    firsts = (
        full.groupBy(f"{OWN}conv", f"{OWN}digest")
        .agg(F.count("*").alias("n"), F.min(F.struct(f"{OWN}turn", TAG)).alias("first"))
        .where("n > 1")
        .select(F.col(f"{OWN}conv").alias("c"), F.col(f"{OWN}digest").alias("d"), F.col(f"first.{TAG}").alias("first"))
    )
    same = F.col(f"{OWN}conv").eqNullSafe(F.col("c")) & (F.col(f"{OWN}digest") == F.col("d"))
    repeated = ~F.col(f"{OWN}fault").eqNullSafe("blank") & (F.col("first") != F.col(TAG))
    fault = F.when(repeated, "duplicate").otherwise(F.col(f"{OWN}fault"))
    kind = F.col(f"{OWN}class")
    code = F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(kind)).otherwise(kind)
    marked = base.join(firsts, same, "left").select(
        f"{OWN}conv", f"{OWN}turn", f"{OWN}digest", TAG, f"{OWN}role", f"{OWN}text",
        f"{OWN}class", code.alias(f"{OWN}code"), fault.alias(f"{OWN}fault"),
    )
    return base, marked


def repair(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    every: DataFrame | None = None, held: int = HELD,
) -> DataFrame:
    """Audit and repaired hash of each conversation.

    Turns stand by ``turn``, nulls first; equal ones by the digest of role and text. Blank and
    duplicate turns are deleted, the others kept, given the role user or assistant, or
    deleted, and empty turns are inserted so that the roles read ``(s?(ua)+)?``, at the
    least cost and then with the least audit. Every length of that string which the best
    cost so far allows is aligned by Wagner-Fischer.

    Turns are range-partitioned and sorted by conversation and turn, so a conversation of any
    size spreads over tasks. One that lies inside a task is finished there. Of one that
    crosses a border, or is too long to hold, each run gives its costs between all states;
    the runs are joined in order, and the text is hashed as a stream, which the hash needs in
    one order: memory stays bounded, and that conversation's text passes one task.

    Nulls in role and text are one space. A null id is a conversation of its own. Columns
    beside the four named are left out. ``every`` has ids of conversations that may lack
    turns: they get zeros, an empty audit and the hash of the empty string.
    """
    base, marked = marked_turns(turns, conv_id, turn, role, text)
    spark = turns.sparkSession
    conv = StructField(f"{OWN}conv", turns.schema[conv_id].dataType)
    order = [F.col(f"{OWN}conv"), F.col(f"{OWN}turn").asc_nulls_first(), F.col(f"{OWN}digest"), F.col(TAG)]
    names = [f"{OWN}{n}" for n in ("conv", "turn", "class", "code", "fault", "role", "text")]
    fields = _run_fields(conv)
    ordered = marked.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select(*names)
    runs = stage(ordered.mapInArrow(_find_runs(fields, names, held), StructType(fields)), "dialogue-runs")

    columns = [f"{OWN}conv", *_COUNTS, "first_turn", "last_turn", "cost", "audit"]
    done = runs.where("moves IS NULL").select(*columns, "sha")
    # Runs of a conversation: one a task, or one for each text beyond what a task holds.
    crossing = runs.where("moves IS NOT NULL").groupBy(f"{OWN}conv").agg(
        F.sort_array(F.collect_list(F.struct("part", *[f.name for f in fields[2:] if f.name not in ("cost", "audit", "sha")]))).alias("parts")
    )
    joined_fields = [StructField(n, LongType()) for n in (*_COUNTS, "first_turn", "last_turn", "cost")] + [StructField("audit", StringType())]
    joined = map_batches(
        crossing, [f"{OWN}conv"], joined_fields,
        lambda batch: list(zip(*(_joined(p) for p in batch.column(batch.schema.get_field_index("parts")).to_pylist())))
        if batch.num_rows else [[] for _ in joined_fields],
    )
    joined = stage(joined, "dialogue-joined")
    ids = joined.select(F.col(f"{OWN}conv").alias("c"))
    texts = base.join(ids, F.col(f"{OWN}conv").eqNullSafe(F.col("c")), "left_semi")
    nothing = F.lit(None).cast("string")
    lines = joined.select(
        f"{OWN}conv", "audit", nothing.alias(f"{OWN}role"), nothing.alias(f"{OWN}text"),
        F.lit(None).cast("long").alias(f"{OWN}turn"), F.lit("").alias(f"{OWN}digest"), F.lit(-1).cast("long").alias(TAG),
    ).unionByName(
        texts.select(f"{OWN}conv", nothing.alias("audit"), f"{OWN}role", f"{OWN}text", f"{OWN}turn", f"{OWN}digest", TAG)
    )
    hash_fields = [conv, StructField("sha", StringType(), False)]
    line_names = [f"{OWN}conv", "audit", f"{OWN}role", f"{OWN}text"]
    streamed = lines.repartition(shuffle_width(spark), f"{OWN}conv").sortWithinPartitions(
        F.col(f"{OWN}conv"), F.col("audit").isNull(), *order[1:]
    )
    sums = streamed.select(*line_names).mapInArrow(_stream_hash(hash_fields, line_names), StructType(hash_fields))
    sums = sums.select(F.col(f"{OWN}conv").alias("c"), "sha")
    whole = joined.join(sums, F.col(f"{OWN}conv").eqNullSafe(F.col("c"))).select(*columns, "sha")
    found = done.unionByName(whole)
    if every is not None:
        ids = every.select(F.col(conv_id).alias("c")).distinct()
        found = ids.join(found, F.col("c").eqNullSafe(F.col(f"{OWN}conv")), "left").withColumn(f"{OWN}conv", F.col("c"))
    out = stage(_report(found, conv_id), "dialogue-result")
    for t in (base, runs, joined):
        release(t)
    return out


def _report(found: DataFrame, conv_id: str) -> DataFrame:
    def long(value: Column, name: str) -> Column:
        return F.coalesce(value, F.lit(0)).cast("long").alias(name)

    return found.select(
        F.col(f"{OWN}conv").alias(conv_id),
        long(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), "gaps"),
        *[long(F.col(n), n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults: by CRC-32 of ``conv_id:turn`` modulo 20, a turn is dropped (0), emptied (1),
    stripped of ``.!?`` (2), repeated (3) or given to the user (4). Nulls are one space."""
    id_of = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    turns = turns.select(
        "conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.crc32(F.concat(id_of[0], F.lit(":"), id_of[1])) % 20).alias(f"{OWN}fate"),
    )
    fate = F.col(f"{OWN}fate")
    turns = turns.where(fate != 0).select(
        "conv_id", "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias(f"{OWN}copy"),
    )
    return turns.drop(f"{OWN}copy")
