"""SimHash near-duplicates: pigeonhole blocks, then the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from shelfwise.llm.common import OWN, TAG, map_batches, release, stage, tagged, text_or_empty
from shelfwise.llm.components import components

#: Rows of a bucket that one task compares; larger buckets are dealt out as pairs of tiles.
TILE = 2048
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(raw: bytes, shingle: int) -> int:
    """64-bit SimHash of the XXH64 of word shingles; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    count = len(words) - shingle + 1
    hashes = np.fromiter(
        (h(joined[a:b], 42) for a, b in zip(starts[:count].tolist(), ends[shingle - 1 :].tolist())), np.uint64, count
    )
    by_byte = np.zeros(2048, np.int64)
    for at in range(0, count, 1 << 16):
        lanes = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8) + _LANES
        by_byte += np.bincount(lanes.ravel(), minlength=2048)
    ones = (by_byte.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, keep: list[str], text: str, shingle: int) -> DataFrame:
    """``keep`` and the signed 64-bit fingerprint of each row's text."""

    def work(batch):
        texts = batch.column(batch.schema.get_field_index(f"{OWN}text"))
        prints = np.fromiter((fingerprint(t.as_py().encode("utf-8", "replace"), shingle) for t in texts), np.uint64, len(texts))
        return [prints.view(np.int64)]

    wanted = docs.select(*keep, text_or_empty(text).alias(f"{OWN}text"))
    return map_batches(wanted, keep, [StructField(f"{OWN}fp", LongType(), False)], work)


def _labels(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (smaller, other) of the fingerprints that share a key."""
    n = len(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    label = np.arange(n)
    at, shift = np.arange(n), 1
    while True:
        at = at[at + shift < end[at]]
        if not len(at):
            break
        new = at[label[at] != label[at + shift]]
        near = new[np.bitwise_count(prints[new] ^ prints[new + shift]) <= bits]
        a, b = near, near + shift
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
            left = label[a] != label[b]
            a, b = a[left], b[left]
        shift += 1
    moved = np.flatnonzero(label != np.arange(n))
    return prints[label[moved]], prints[moved]


def _bucket_links(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)

        def made(k, p):
            a, b = _labels(k, p, bits)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            keys = np.concatenate([keys, batch["key"].to_numpy(np.int64)])
            prints = np.concatenate([prints, batch["fp"].to_numpy(np.int64).view(np.uint64)])
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                if cut:
                    yield made(keys[:cut], prints[:cut])
                    keys, prints = keys[cut:], prints[cut:]
        if len(keys):
            yield made(keys, prints)

    return run


def fingerprint_links(prints: DataFrame, bits: int, blocks: int) -> DataFrame:
    """Links ``(a, b)`` that connect distinct fingerprints ``fp`` exactly as all pairs within ``bits`` would.

    64 bits are cut into ``blocks``; two fingerprints that differ in at most ``bits`` bits
    agree in at least ``blocks - bits`` of them, so each choice of that many blocks is a
    bucket key. Inside a bucket all pairs are compared, but only a spanning forest is put
    out. A bucket of more than ``TILE`` rows is dealt out: each pair of its tiles is a task
    key of its own, so no task holds more than two tiles of a bucket.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - bits):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(keys).alias("key"))
    hot = stage(rows.groupBy("key").count().where(F.col("count") > TILE), "simhash-hot")
    if not hot.isEmpty():
        tiles = F.ceil(F.col("count") / TILE).cast("int")
        own = F.pmod(F.xxhash64(F.lit("tile"), "fp"), tiles).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: j != F.col("own"))
        joined = rows.join(hot, "key", "left")
        large = joined.where("count is not null").select("fp", "key", tiles.alias("tiles"), own.alias("own"))
        large = large.select("fp", "key", "own", F.explode(others).alias("other"))
        large = large.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
        rows = joined.where("count is null").select("fp", "key").union(large)
    dealt = rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInPandas(_bucket_links(bits), "a long, b long")


RESULT = {f"{OWN}fingerprint": "fingerprint", f"{OWN}component": "component_id", f"{OWN}kept": "is_kept"}


def simhash_groups(docs: DataFrame, *, keep: list[str] | None = None, **how) -> DataFrame:
    """``keep`` and ``fingerprint``, ``component_id``, ``is_kept`` of every row; see ``placed_groups``.

    A column of the input that has the name of a result column gives way to it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.values()]
    placed = placed_groups(docs, keep=names, **how)
    return placed.select(*names, *[F.col(a).alias(b) for a, b in RESULT.items()])


def one_of_each_group(docs: DataFrame, **how) -> DataFrame:
    """The rows that stay, with exactly the columns of ``docs``."""
    return placed_groups(docs, **how).where(f"{OWN}kept").select(*docs.columns)


def placed_groups(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 4,
    bits: int = 4,
    blocks: int = 7,
    keep: list[str] | None = None,
) -> DataFrame:
    """Fingerprint, group and whether it stays, of every row, in columns with the own prefix.

    The component is the smallest ``doc_id`` that can be reached over links of at most
    ``bits`` differing bits; the kept mark is on exactly one row of each group, the one with
    that id. Null text counts as empty; a text without words has fingerprint zero. A null
    id is never a group's id unless the group has no other, then the group's id is null.
    Rows that repeat an id keep a row each in the result and only one is kept. An empty
    table gives an empty result. Own columns have a prefix, so any column may come along.
    Equal fingerprints are one node, so large groups of copies are counted, not paired.
    """
    keep = list(docs.columns if keep is None else keep)
    wanted = docs.select(*keep, F.col(text).alias(f"{OWN}in"), F.col(doc_id).cast("long").alias(f"{OWN}id"))
    rows = stage(tagged(with_fingerprints(wanted, [*keep, f"{OWN}id"], f"{OWN}in", shingle)), "simhash-rows")
    nodes = rows.groupBy(F.col(f"{OWN}fp").alias("fp")).agg(F.min(f"{OWN}id").alias("least"))
    nodes = stage(nodes, "simhash-prints")
    links = stage(fingerprint_links(nodes.select("fp"), bits, blocks), "simhash-links")
    roots = components(links, "simhash-components")
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias(f"{OWN}root")
    )
    ids = grouped.groupBy(f"{OWN}root").agg(F.min("least").alias("component_id"))
    by_print = stage(
        grouped.join(ids, f"{OWN}root").select(F.col("fp").alias(f"{OWN}fp"), f"{OWN}root", F.col("component_id").alias(f"{OWN}component")),
        "simhash-groups",
    )
    release(links)
    placed = rows.join(by_print, f"{OWN}fp")
    first = (
        placed.where(F.col(f"{OWN}id").eqNullSafe(F.col(f"{OWN}component")))
        .groupBy(F.col(f"{OWN}root").alias(f"{OWN}kept_root"))
        .agg(F.min(TAG).alias(f"{OWN}kept_tag"))
    )
    first = stage(first, "simhash-kept")
    return placed.join(
        first, (F.col(f"{OWN}root") == F.col(f"{OWN}kept_root")) & (F.col(TAG) == F.col(f"{OWN}kept_tag")), "left"
    ).select(
        *keep,
        F.lower(F.lpad(F.hex(f"{OWN}fp"), 16, "0")).alias(f"{OWN}fingerprint"),
        f"{OWN}component",
        F.col(f"{OWN}kept_tag").isNotNull().alias(f"{OWN}kept"),
    )
