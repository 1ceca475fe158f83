"""Suffix-array deduplication: long byte strings that start more than once, by sampled digests in place of prefix doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from shelfwise.llm.common import OWN, TAG, map_batches, release, running_total, stage, tagged, text_or_empty

#: Bytes of a text that are sampled at once; longer texts are sampled in overlapping pieces.
SEGMENT = 1 << 20
#: Rows of an Arrow batch that are opened at once, as one can stand for some 300 strings, and
#: anchors after which a task hands on what it has.
IN_ROWS, OUT_ROWS = 128, 65_536
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sliding(reduce: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Least or largest of every window of ``width`` neighbours, from windows of doubled width."""
    reach, whole = 1, len(x) - width + 1
    while 2 * reach <= width:
        x = reduce(x[:-reach], x[reach:])
        reach *= 2
    return reduce(x[:whole], x[width - reach : width - reach + whole])


class Sampler:
    """Anchors of a text: in every window of ``length`` bytes the gram with the least hash.

    Which gram that is depends on the window's bytes alone, so equal windows have their
    anchor at the same place and with equal bytes around it.
    """

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.up, self.down = _powers(_ODD, SEGMENT + length), _powers(_INVERSE, SEGMENT + length)

    def anchors(self, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First and last window start of each anchor, its place and its gram's hash."""
        whole = np.frombuffer(raw, np.uint8)
        for at in range(0, max(0, len(raw) - self.length + 1), SEGMENT):
            first, last, place, grams = self._segment(whole[at : at + SEGMENT + self.length - 1])
            yield first + at, last + at, place + at, grams

    def _segment(self, part: np.ndarray):
        n, gram = len(part), self.gram
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        hashes = (sums[gram:] - sums[:-gram]) * self.down[: n - gram + 1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        width = self.length - gram + 1
        least = _sliding(np.minimum, hashes, width)
        edge = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(hashes == _sliding(np.maximum, np.concatenate([edge, least, edge]), width))
        owner = np.searchsorted(chosen, np.arange(len(least)))
        values = hashes[chosen]
        while True:
            wrong = values[owner] != least
            if not wrong.any():
                break
            owner[wrong] += 1
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        place = chosen[owner[first]]
        return first, last, place, hashes[place].view(np.int64)


def _two_longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _anchor_rows(length: int, gram: int):
    names = [TAG, "lo", "hi", "at", "gram", "c1", "c2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(length, gram)
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            columns, held = [[] for _ in names], 0
            for tag, text in zip(batch[TAG], batch[f"{OWN}text"]):
                raw = text.encode("utf-8", "replace")
                for first, last, place, grams in sampler.anchors(raw):
                    around = b"".join(
                        digest(raw[a : b + length], c - a) for a, b, c in zip(first.tolist(), last.tolist(), place.tolist())
                    )
                    pairs = np.frombuffer(around, np.int64).reshape(-1, 2)
                    for column, values in zip(
                        columns, (np.full(len(first), tag), first, last, place, grams, pairs[:, 0], pairs[:, 1])
                    ):
                        column.append(values)
                    held += len(first)
                    if held >= OUT_ROWS:
                        yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, columns)})
                        columns, held = [[] for _ in names], 0
            if held:
                yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, columns)})

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Few rows of a batch at a time as Python values; what a row opens into is never held for a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, IN_ROWS):
            yield batch.slice(at, IN_ROWS).to_pydict()


def _context_rows(length: int):
    """Cuts the bytes around the chosen anchors out of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = {n: [] for n in ("xid", "gram", "at", "windows", "weight", "bytes")}
            for text, spots in zip(batch[f"{OWN}text"], batch["spots"]):
                raw = text.encode("utf-8", "replace")
                for s in spots:
                    out["xid"].append(s["aid"])
                    out["gram"].append(s["gram"])
                    out["at"].append(s["at"] - s["lo"])
                    out["windows"].append(s["hi"] - s["lo"] + 1)
                    out["weight"].append(s["weight"])
                    out["bytes"].append(raw[s["lo"] : s["hi"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if n == "bytes" else pa.int64()) for n, v in out.items()], names=list(out))

    return run


def _node_rows(length: int, gram: int, step: int, before: int | None):
    """The strings of this round: for each node of ``step`` windows what all of them share, and all they cover."""
    top = length - gram
    names = ("xid", "node", "rank", "weight", "open", "k1", "k2", "u1", "u2", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in _pieces(batches):
            out = {n: [] for n in names}
            for xid, first_rank, at, windows, weight, raw, alive in zip(
                batch["xid"], batch["gram"], batch["at"], batch["windows"], batch["weight"], batch["bytes"], batch["alive"]
            ):
                least, most = at - windows + 1, at  # how far before the anchor windows start
                if before is None:
                    nodes = [(n, first_rank, weight == 1) for n in range(least // step, most // step + 1)]
                else:
                    nodes = [
                        (n, p["rank"], p["open"])
                        for p in alive
                        for n in range(p["node"] * before // step, (p["node"] + 1) * before // step)
                        if n * step <= most and n * step + step - 1 >= least
                    ]
                for n, rank, is_open in nodes:
                    low, high = n * step, min(n * step + step - 1, top)
                    own_low, own_high = max(low, least), min(high, most)
                    k1, k2 = _two_longs(digest(raw[at - low : at - high + length], low))
                    u1 = u2 = 0
                    if step > 1:
                        u1, u2 = _two_longs(digest(raw[at - own_high : at - own_low + length], own_low * length + own_high))
                    for name, value in zip(names, (xid, n, rank, weight, is_open, k1, k2, u1, u2, own_low, own_high)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.bool_() if n == "open" else pa.int64()) for n, v in out.items()], names=list(out))

    return run


_NODES = "xid long, node long, rank long, weight long, open boolean, k1 long, k2 long, u1 long, u2 long, low long, high long"


def repeated_starts(contexts: DataFrame, length: int, gram: int, steps: tuple[int, ...]) -> DataFrame:
    """Runs of window starts whose string occurs elsewhere: ``(xid, low, high)`` before the anchor.

    A run's rank stands for the string that all its windows share. Each round cuts the
    surviving runs and ranks them anew by the digest of the longer string now shared, sorted
    over the cluster; no rank at another offset is joined, so nothing doubles. Runs
    whose pair is unique hold no repeated window and are dropped; runs whose whole extent
    occurs twice are done. The last round's strings are the windows themselves.
    """
    found, alive, before = None, None, None
    for step in steps:
        given = contexts.withColumn("alive", F.lit(None).cast("array<struct<node:long,rank:long,open:boolean>>")) if alive is None else contexts.join(alive, "xid")
        rows = stage(given.mapInArrow(_node_rows(length, gram, step, before), _NODES), "repeats-nodes")
        pairs = rows.groupBy("rank", "node", "k1", "k2").agg(F.sum("weight").alias("all"), F.max("open").alias("open"))
        pairs = pairs.where("all > 1 and open").select("rank", "node", "k1", "k2", F.lit(1).cast("long").alias("one"))
        ranked = running_total(pairs, ["rank", "node", "k1", "k2"], ["one"], "repeats-ranks")
        ranked = ranked.select("rank", "node", "k1", "k2", F.col("before_one").alias("new_rank"))
        left = rows.join(ranked, ["rank", "node", "k1", "k2"]).select("xid", "node", F.col("new_rank").alias("rank"), "weight", "open", "u1", "u2", "low", "high")
        if step == 1:
            done = left.where("open").select("xid", "low", "high")
            return done if found is None else found.union(done)
        left = stage(left, "repeats-left")
        twice = left.groupBy("u1", "u2").agg(F.sum("weight").alias("all")).where("all > 1").select("u1", "u2", F.lit(True).alias("twice"))
        judged = left.join(twice, ["u1", "u2"], "left").withColumn("twice", F.coalesce("twice", F.lit(False)))
        judged = stage(judged, "repeats-judged")
        release(rows)
        release(left)
        done = judged.where("open and twice").select("xid", "low", "high")
        found = done if found is None else found.union(done)
        alive = judged.groupBy("xid").agg(
            F.collect_list(F.struct("node", "rank", (F.col("open") & ~F.col("twice")).alias("open"))).alias("alive")
        )
        before = step
    raise ValueError("the last step must be 1")


def merged_spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open intervals."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return low[first], np.append(high[first[1:] - 1], high[-1])


def _cut(with_text: bool):
    def work(batch: pa.RecordBatch) -> list[list]:
        rows = []
        texts, spans_of = (batch.column(batch.schema.get_field_index(n)) for n in (f"{OWN}text", "spans"))
        for text, pairs in zip(texts, spans_of):
            raw, pairs = text.as_py().encode("utf-8", "replace"), pairs.as_py()
            spans, left = [], raw
            if pairs:
                low, high = merged_spans(
                    np.array([p["low"] for p in pairs], np.int64), np.array([p["high"] for p in pairs], np.int64)
                )
                edges = [0, *np.column_stack([low, high]).ravel().tolist(), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                spans = [{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())]
            made = (len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest())
            rows.append((*made, spans, left) if with_text else made)
        return [[r[i] for r in rows] for i in range(6 if with_text else 4)]

    return work


def without_repeats(
    docs: DataFrame,
    *,
    text: str = "text",
    length: int = 400,
    gram: int = 64,
    steps: tuple[int, ...] = (64, 8, 1),
    keep: list[str] | None = None,
    with_text: bool = False,
) -> DataFrame:
    """Removes each byte that lies in a ``length``-byte string that also starts anywhere else.

    Returns ``keep``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row and,
    with ``with_text``, the removed ``spans`` (bytes, half open) and the remaining bytes.

    Positions are sampled first: every window has one anchor, chosen by its bytes, so only
    windows whose anchor's gram occurs twice can repeat. Anchors whose whole surroundings
    (all windows they stand for) occur twice are decided at once; what differs on one side
    goes through rounds of digests over runs of starts (``repeated_starts``). Equal
    surroundings are one row there, so a passage shared by many documents costs its edges.

    Null text counts as empty. Texts shorter than ``length`` lose nothing; strings never
    cross documents; repeated rows are documents of their own. An empty table gives an
    empty result. A column with the name of a result column gives way to it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    texts = docs.select(*names, text_or_empty(text).alias(f"{OWN}text"))
    rows = stage(tagged(texts), "repeats-rows")
    only = rows.select(TAG, f"{OWN}text")
    anchors = only.where(F.octet_length(f"{OWN}text") >= length).mapInPandas(
        _anchor_rows(length, gram), f"{TAG} long, lo long, hi long, at long, gram long, c1 long, c2 long"
    )
    anchors = stage(anchors.withColumn("aid", F.monotonically_increasing_id()), "repeats-anchors")
    classes = stage(anchors.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min("aid").alias("rep")), "repeats-classes")
    grams = classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    known = classes.join(grams.select("gram", "kinds"), "gram")
    placed = stage(anchors.join(known, ["gram", "c1", "c2"]), "repeats-placed")
    release(anchors)
    release(classes)
    spots = placed.where("kinds > 1 and aid = rep").groupBy(TAG).agg(
        F.collect_list(F.struct("aid", "gram", "at", "lo", "hi", F.least("n", F.lit(2)).cast("long").alias("weight"))).alias("spots")
    )
    contexts = stage(
        only.join(spots, TAG).mapInArrow(_context_rows(length), "xid long, gram long, at long, windows long, weight long, bytes binary"),
        "repeats-contexts",
    )
    starts = repeated_starts(contexts, length, gram, steps)
    partly = placed.where("n = 1").join(starts, F.col("aid") == F.col("xid")).select(
        TAG, (F.col("at") - F.col("high")).alias("low"), (F.col("at") - F.col("low") + length).alias("high")
    )
    wholly = placed.where("n > 1").select(TAG, F.col("lo").alias("low"), (F.col("hi") + length).alias("high"))
    spans = wholly.union(partly).groupBy(TAG).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    made = [("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType())]
    fields = [StructField(f"{OWN}{n}", t, False) for n, t in made]
    if with_text:
        from pyspark.sql.types import ArrayType

        pair = StructType([StructField("start", LongType()), StructField("end", LongType())])
        fields += [StructField(f"{OWN}spans", ArrayType(pair)), StructField(f"{OWN}kept_text", BinaryType())]
    # Kept columns stay in Arrow: pandas would round long ids beside a null.
    out = map_batches(rows.join(spans, TAG, "left"), names, fields, _cut(with_text))
    return out.select(*names, *[F.col(f.name).alias(f.name.removeprefix(OWN)) for f in fields])
