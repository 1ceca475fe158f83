"""Vector bin packing of tokenised documents into fixed-size sequences."""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from shelfwise.llm.common import OWN, TAG, release, stage, tagged, text_or_empty

#: Pieces that one task packs together.
POOL = 20_000
RESULT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

#: Characters on which both tokenizer libraries agree about letters, numbers and blanks.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2027]|[^ \\n.,]{2000}|[ \\n]{200}")


class Encoder:
    """Token ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    Texts of plain Latin characters go through ``tiktoken`` with the ranks read from the
    same file, which gives the same ids in less than half the time; all other texts, and
    texts with a special token's string in them, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made["added_tokens"]]
        taken = set(self.special)
        letters = self._byte_letters()
        ranks = {
            bytes(letters[c] for c in token): rank for token, rank in made["model"]["vocab"].items() if token not in taken
        }
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _byte_letters() -> dict[str, int]:
        """The letter that byte-level BPE files write for each byte."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown}
        hidden = [b for b in range(256) if b not in set(shown)]
        return letters | {chr(256 + i): b for i, b in enumerate(hidden)}

    def ids(self, text: str) -> list[int]:
        if _PLAIN.search(text) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def token_pieces(
    docs: DataFrame, keep: list[str], text: str, tokenizer: str, pattern: str, length: int, end_id: int, with_ids: bool
) -> DataFrame:
    """Pieces of at most ``length`` ids of each document: full ones, then the rest.

    ``(keep, start, length, ids_crc32, doc_tokens, loss)``; ``loss`` counts the ids that a
    model learns to predict, which is all but a document's first.
    """
    from pyspark.sql.types import StructType

    fields = [docs.schema[k] for k in keep] + [
        StructField(f"{OWN}{n}", LongType(), False) for n in ("start", "length", "crc", "tokens", "loss")
    ]
    if with_ids:
        fields.append(StructField(f"{OWN}ids", BinaryType(), False))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, pattern)
        for batch in batches:
            row, start, size, crc, total, parts = [], [], [], [], [], []
            for i, t in enumerate(batch.column(batch.schema.get_field_index(f"{OWN}text"))):
                ids = array.array("I", encoder.ids(t.as_py()))
                ids.append(end_id)
                raw = memoryview(np.asarray(ids, "<u4").tobytes())
                for at in range(0, len(ids), length):
                    piece = raw[4 * at : 4 * (at + length)]
                    row.append(i)
                    start.append(at)
                    size.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids))
                    if with_ids:
                        parts.append(bytes(piece))
            # Kept columns stay in Arrow: pandas would round long ids beside a null.
            at = pa.array(row, pa.int64())
            arrays = [batch.column(batch.schema.get_field_index(k)).take(at) for k in keep]
            loss = np.asarray(size, np.int64) - (np.asarray(start, np.int64) == 0)
            arrays += [pa.array(x, pa.int64()) for x in (start, size, crc, total, loss)]
            if with_ids:
                arrays.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    wanted = docs.select(*keep, text_or_empty(text).alias(f"{OWN}text"))
    return wanted.mapInArrow(run, StructType(fields))


def dot_product_bins(sizes: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.

    One bin is open at a time. Of the pieces that still fit all three limits it takes the
    one whose demand (tokens, one segment, loss-bearing tokens), measured in parts of the
    limits, has the largest dot product with what the bin has left, until none fits. Equal
    pieces are a class, so a choice looks at classes, not at pieces.
    """
    room = np.array(limits, float)
    order = np.lexsort((np.arange(len(sizes)), loss, sizes))
    kinds, first, counts = np.unique(
        np.stack([sizes[order], loss[order]], 1), axis=0, return_index=True, return_counts=True
    )
    demand = np.column_stack([kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]]).astype(float)
    scaled = demand / room**2
    if (demand > room).any():
        raise ValueError("a piece is larger than a whole sequence")
    left, following = counts.copy(), first.copy()
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    remaining, current, free, used = int(left.sum()), -1, None, 0
    while remaining:
        if free is None:
            current, free, used = current + 1, room.copy(), 0
        gain = scaled @ free
        gain[(left == 0) | (demand > free).any(1)] = -1
        best = int(np.argmax(gain))
        if gain[best] < 0:
            free = None
            continue
        at = order[following[best]]
        bins[at], offsets[at] = current, used
        following[best] += 1
        left[best] -= 1
        remaining -= 1
        used += int(demand[best, 0])
        free -= demand[best]
    return bins, offsets


def _pack_pool(limits: tuple[int, int, int]):
    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values([f"{OWN}order", f"{OWN}start", TAG], kind="stable")
        bins, offsets = dot_product_bins(
            pool[f"{OWN}length"].to_numpy(np.int64), pool[f"{OWN}loss"].to_numpy(np.int64), limits
        )
        return pd.DataFrame({TAG: pool[TAG], f"{OWN}pool": pool[f"{OWN}pool"], f"{OWN}bin": bins, f"{OWN}offset": offsets})

    return run


def pack(
    docs: DataFrame,
    *,
    tokenizer: str,
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    length: int = 1024,
    segments: int = 64,
    loss_tokens: int | None = None,
    end_id: int = 0,
    keep: list[str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with the sequence and offset where they lie.

    A document's ids and ``end_id`` are cut into full pieces, which fill a sequence each,
    and one rest. Pieces are dealt by hash into pools of about ``POOL``, and each pool's
    pieces are placed by the dot-product rule under limits on tokens, segments and
    loss-bearing tokens. Sequences are numbered from 0 without gaps, offsets too.

    Null and empty texts are a piece of the end id alone. Repeated rows are documents of
    their own. An empty table gives an empty result. Columns in ``keep`` come along; one
    with the name of a result column gives way to it. ``with_ids`` adds the ids as
    little-endian 32-bit numbers.
    """
    names = [c for c in (keep or []) if c not in RESULT]
    limits = (length, segments, length if loss_tokens is None else loss_tokens)
    own = docs.select(*names, F.col(text).alias(f"{OWN}in"), F.col(doc_id).cast("long").alias(f"{OWN}id"))
    pieces = token_pieces(own, [*names, f"{OWN}id"], f"{OWN}in", tokenizer, pattern, length, end_id, with_ids)
    pieces = stage(tagged(pieces), "packing-pieces")
    pools = max(1, -(-pieces.count() // POOL))
    order = F.xxhash64(f"{OWN}id", f"{OWN}start", F.lit("pool"))
    slim = pieces.select(
        TAG, f"{OWN}start", f"{OWN}length", f"{OWN}loss", order.alias(f"{OWN}order"),
        F.pmod(F.xxhash64(order, TAG), F.lit(pools)).alias(f"{OWN}pool"),
    )
    placed = stage(
        slim.groupBy(f"{OWN}pool").applyInPandas(
            _pack_pool(limits), f"{TAG} long, {OWN}pool long, {OWN}bin long, {OWN}offset long"
        ),
        "packing-places",
    )
    sizes = placed.groupBy(f"{OWN}pool").agg((F.max(f"{OWN}bin") + 1).alias("bins"))
    earlier = Window.orderBy(f"{OWN}pool").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(f"{OWN}pool", F.coalesce(F.sum("bins").over(earlier), F.lit(0)).alias(f"{OWN}base"))
    out = pieces.join(placed, TAG).join(bases, f"{OWN}pool")
    return out.select(
        *names,
        F.col(f"{OWN}id").alias("doc_id"),
        F.col(f"{OWN}start").alias("start"),
        F.col(f"{OWN}length").alias("length"),
        F.col(f"{OWN}crc").alias("ids_crc32"),
        F.col(f"{OWN}tokens").alias("doc_tokens"),
        (F.col(f"{OWN}base") + F.col(f"{OWN}bin")).alias("sequence_id"),
        F.col(f"{OWN}offset").alias("offset"),
        *([F.col(f"{OWN}ids").alias("ids")] if with_ids else []),
    )
