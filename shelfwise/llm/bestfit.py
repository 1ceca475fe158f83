"""Vector best-fit packing of tokenised documents into as few sequences as possible."""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from shelfwise.llm.common import OWN, TAG, release, stage, tagged, text_or_empty
from shelfwise.llm.packing import Encoder

#: Pieces that one task packs together.
POOL = 20_000
RESULT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
#: Weights of tokens, documents and attention cost in the choice of a bin.
WEIGHTS = (1.0, 0.05, 0.05)


class PieceEncoder(Encoder):
    """The same ids; its test of a text tries one pattern after the other, which costs less than half of all at each character."""

    ODD = tuple(re.compile(p) for p in ("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2027]", "[^ \\n.,]{2000}", "[ \\n]{200}"))

    def ids(self, text: str) -> list[int]:
        if any(p.search(text) for p in self.ODD) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def document_pieces(
    docs: DataFrame, keep: list[str], text: str, tokenizer: str, pattern: str, length: int, end_id: int, with_ids: bool
) -> DataFrame:
    """A document's ids and ``end_id``; more than ``length`` are cut from the end, so the first piece is the short one."""
    names = ("piece", "start", "length", "crc")
    fields = [docs.schema[k] for k in keep] + [StructField(f"{OWN}{n}", LongType(), False) for n in names]
    if with_ids:
        fields.append(StructField(f"{OWN}ids", BinaryType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(tokenizer, pattern)
        for batch in batches:
            row, numbers, parts = [], [], []
            for i, t in enumerate(batch.column(batch.schema.get_field_index(f"{OWN}text"))):
                ids = array.array("I", encoder.ids(t.as_py()))
                ids.append(end_id)
                raw = memoryview(np.asarray(ids, "<u4").tobytes())
                first = (len(ids) - 1) % length + 1
                for number, end in enumerate(range(first, len(ids) + 1, length)):
                    start = max(0, end - length)
                    row.append(i)
                    numbers.append((number, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
                    if with_ids:
                        parts.append(bytes(raw[4 * start : 4 * end]))
            at = pa.array(row, pa.int64())
            arrays = [batch.column(batch.schema.get_field_index(k)).take(at) for k in keep]
            arrays += [pa.array(c, pa.int64()) for c in (zip(*numbers) if numbers else [()] * len(names))]
            if with_ids:
                arrays.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    wanted = docs.select(*keep, text_or_empty(text).alias(f"{OWN}text"))
    return wanted.mapInArrow(run, StructType(fields))


def best_fit(
    sizes: np.ndarray, limits: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece under limits on tokens, documents and attention cost (squared lengths).

    Pieces come largest first. Each goes into the open bin that can still take it on every
    count and, with residual capacities in parts of the limits, has the least weighted norm
    afterwards (``norm``) or the least weighted dot product with the piece's demand (``dot``);
    ties take the oldest bin, and a new bin opens only when none can take the piece.

    A bin that has taken a piece is a better choice for an equal piece than it was before, so
    it takes equal pieces until it can't, and all pieces of a length are placed at once.
    """
    caps = np.array(limits, np.int64)
    w = np.array(weights, float)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    if not len(sizes):
        return bins, offsets
    if sizes.max() > caps[0] or caps[1] < 1 or int(sizes.max()) ** 2 > caps[2]:
        raise ValueError("a piece is larger than a whole sequence")
    order = np.argsort(-sizes, kind="stable")
    lengths, firsts = np.unique(-sizes[order], return_index=True)
    least = np.array([-lengths[-1], 1, lengths[-1] ** 2])
    free, number, opened = np.empty((0, 3), np.int64), np.empty(0, np.int64), 0
    for length, items in zip(-lengths, np.split(order, firsts[1:])):
        d = np.array([length, 1, length**2])
        room = (free // d).min(1)
        fits = np.flatnonzero(room > 0)
        scaled = free[fits] / caps
        score = ((scaled - d / caps) ** 2) @ w if rule == "norm" else scaled @ (w * d / caps)
        fits = fits[np.argsort(score, kind="stable")]
        missing = len(items) - int(room[fits].sum())
        if missing > 0:
            each = int((caps // d).min())
            new = -(-missing // each)
            fits = np.concatenate([fits, len(free) + np.arange(new)])
            free, room = np.vstack([free, np.tile(caps, (new, 1))]), np.append(room, np.full(new, each))
            number, opened = np.append(number, opened + np.arange(new)), opened + new
        taken = np.minimum(room[fits], np.maximum(0, len(items) - (np.cumsum(room[fits]) - room[fits])))
        chosen = np.repeat(fits, taken)
        place = np.arange(len(items)) - np.repeat(np.cumsum(taken) - taken, taken)
        bins[items], offsets[items] = number[chosen], caps[0] - free[chosen, 0] + place * length
        free[fits] -= taken[:, None] * d
        usable = (free >= least).all(1)  # the others can't take the smallest piece
        free, number = free[usable], number[usable]
    return bins, offsets


def fewest_bins(
    sizes: np.ndarray, limits: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS
) -> tuple[np.ndarray, np.ndarray]:
    """The better of both rules; the second runs only if the first leaves more bins than the sums of demands need."""
    first = best_fit(sizes, limits, weights, "norm")
    demand = (sizes.sum(), len(sizes), (sizes.astype(np.int64) ** 2).sum())
    least = max(-(-int(d) // c) for d, c in zip(demand, limits))
    if first[0].max(initial=-1) + 1 <= least:
        return first
    second = best_fit(sizes, limits, weights, "dot")
    return second if second[0].max(initial=-1) < first[0].max(initial=-1) else first


def _pack_pool(limits: tuple[int, int, int], weights: tuple[float, float, float]):
    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values([f"{OWN}order", TAG], kind="stable")
        bins, offsets = fewest_bins(pool[f"{OWN}length"].to_numpy(np.int64), limits, weights)
        sequence = (pool[f"{OWN}pool"].to_numpy(np.int64) << 32) + bins
        return pd.DataFrame({TAG: pool[TAG], f"{OWN}sequence": sequence, f"{OWN}offset": offsets})

    return run


def pack_best_fit(
    docs: DataFrame,
    *,
    tokenizer: str,
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    length: int = 1024,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    end_id: int = 2,
    keep: list[str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with the sequence and offset where they lie.

    Only documents of more than ``length`` ids are cut, from the end, so the first piece is the
    short one. A full piece is a sequence by itself; the others are dealt by hash into pools
    of about ``POOL`` and each pool is packed by :func:`fewest_bins`. A sequence holds at most
    ``length`` tokens, ``documents`` pieces and ``attention`` as sum of squared piece lengths.
    Left out, those two are what ``length`` tokens can come to at most, so that they cost no
    sequence; sequence numbers are unique, not gapless. At most about one bin a pool stays
    partly empty.

    Null and empty texts are a piece of the end id alone. Repeated rows are documents of
    their own. An empty table gives an empty result. Columns in ``keep`` come along; one
    with the name of a result column gives way to it. ``with_ids`` adds the ids as
    little-endian 32-bit numbers.
    """
    names = [c for c in (keep or []) if c not in RESULT]
    limits = (length, length if documents is None else documents, length**2 if attention is None else attention)
    if limits[1] < 1 or limits[2] < length**2:
        raise ValueError("a sequence must be able to hold a full piece")
    own = docs.select(*names, F.col(text).alias(f"{OWN}in"), F.col(doc_id).cast("long").alias(f"{OWN}id"))
    pieces = document_pieces(own, [*names, f"{OWN}id"], f"{OWN}in", tokenizer, pattern, length, end_id, with_ids)
    pieces = stage(tagged(pieces), "bestfit-pieces")
    open_pieces = pieces.where(F.col(f"{OWN}length") < length)
    pools = max(1, -(-open_pieces.count() // POOL))
    order = F.xxhash64(f"{OWN}id", f"{OWN}piece", F.lit("pool"))
    slim = open_pieces.select(
        TAG, f"{OWN}length", order.alias(f"{OWN}order"), F.pmod(F.xxhash64(order, TAG), F.lit(pools)).alias(f"{OWN}pool")
    )
    placed = stage(
        slim.groupBy(f"{OWN}pool").applyInPandas(
            _pack_pool(limits, weights), f"{TAG} long, {OWN}sequence long, {OWN}offset long"
        ),
        "bestfit-places",
    )
    out = stage(
        pieces.join(placed, TAG, "left").select(
            *names,
            F.col(f"{OWN}id").alias("doc_id"),
            F.col(f"{OWN}piece").alias("piece"),
            F.col(f"{OWN}start").alias("start"),
            F.col(f"{OWN}length").alias("length"),
            F.col(f"{OWN}crc").alias("ids_crc32"),
            F.coalesce(f"{OWN}sequence", -1 - F.col(TAG)).alias("sequence_id"),
            F.coalesce(f"{OWN}offset", F.lit(0)).cast("long").alias("offset"),
            *([F.col(f"{OWN}ids").alias("ids")] if with_ids else []),
        ),
        "bestfit-result",
    )
    release(pieces)
    release(placed)
    return out
