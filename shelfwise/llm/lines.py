"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard, union-find."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from shelfwise.llm.common import OWN, TAG, map_batches, release, shuffle_width, stage, tagged, text_or_empty
from shelfwise.llm.components import components

#: Characters of a tile.
CHARACTERS = 1 << 22
#: Characters whose shingles are hashed at once; small enough for a core's cache.
CHUNK = 1 << 16
#: Lines of a tile of a bucket; two tiles are compared in one task.
TILE = 1024
#: Lines of a cell whose pairs are compared one by one, together with those of other cells.
SMALL = 12
#: Band keys of a range, about, and band keys grouped at once.
RANGE_KEYS, PIECE = 1 << 20, 1 << 21
RESULT = ("n_lines", "n_removed", "kept_sha256", "kept_text")
_GOLDEN, _MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_codes(points: np.ndarray, size: int) -> np.ndarray:
    """64-bit code of each run of ``size`` code points, made of the codes of its two halves."""
    if size == 1:
        return points.astype(np.uint64) * _GOLDEN
    first = size - size // 2
    left = shingle_codes(points, first)
    right = left if first == size // 2 else shingle_codes(points, size // 2)
    count = max(0, len(points) - size + 1)
    codes = left[:count] * _MIX
    codes ^= right[first : first + count]
    codes *= _TURN
    codes ^= codes >> np.uint64(31)
    return codes


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingles(line: str, size: int) -> np.ndarray:
    """Distinct codes of a line; a shorter line is one shingle."""
    points = _points(line)
    return np.unique(shingle_codes(points, min(size, max(1, len(points)))))


def _whole_shingles(lines: list[str], lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and code of every shingle of the lines that have at least ``size`` characters."""
    points = _points("".join(lines))
    codes = shingle_codes(points, size)
    starts = np.ones(len(points), bool)
    if len(codes):
        ends = np.cumsum(lengths)
        for k in range(1, size):  # a start this near to a line's end would run into the next line
            starts[ends - k] = False
    owner = np.repeat(np.arange(len(lines)), np.maximum(lengths - size + 1, 0))
    return owner, codes[starts[: len(codes)]]


def signatures(lines: list[str], size: int, bins: int) -> np.ndarray:
    """One-permutation MinHash: the least code in each bin; an empty bin borrows from the next one that is not."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    out = np.full((len(lines), bins), np.iinfo(np.uint64).max, np.uint64)
    owner, codes = _whole_shingles(lines, lengths, size)
    slot = (codes >> np.uint64(40)).astype(np.uint32) % np.uint32(bins)
    np.minimum.at(out.ravel(), owner * bins + slot, codes)
    for i in np.flatnonzero(lengths < size):
        out[i, 0] = shingles(lines[i], size)[0] if lengths[i] else 0
    have = out != np.iinfo(np.uint64).max
    short = np.flatnonzero(~have.all(1))
    if len(short):
        lasting = np.tile(have[short], 2)
        ahead = np.where(lasting, np.arange(2 * bins, dtype=np.int32), np.int32(4 * bins))
        ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][:, :bins]
        distance = (ahead - np.arange(bins, dtype=np.int32)).astype(np.uint64)
        out[short] = np.take_along_axis(out[short], ahead % bins, 1) + distance * _MIX
    return out


def _chunks(lines: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of at most ``most`` lines with about ``CHUNK`` characters; a longer line is a run of its own."""
    at = 0
    while at < len(lines):
        upto, total = at, 0
        while upto < len(lines) and upto < at + most and (upto == at or total + len(lines[upto]) <= CHUNK):
            total += len(lines[upto])
            upto += 1
        yield at, upto
        at = upto


def _band_keys(size: int, bands: int, rows: int, ranges: int):
    """Keys of each line and band with the line's number, packed by range of keys: ``(part, keys, lids)``."""
    salt = np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = batch.column(batch.schema.get_field_index("line")).to_pylist()
            lids = batch.column(batch.schema.get_field_index("lid")).to_numpy(zero_copy_only=False)
            keys = []
            for at, upto in _chunks(lines, len(lines)):
                signature = signatures(lines[at:upto], size, bands * rows).reshape(upto - at, bands, rows)
                key = np.broadcast_to(salt, (upto - at, bands))
                for r in range(rows):
                    key = (key ^ signature[:, :, r]) * _MIX
                    key ^= key >> np.uint64(29)
                keys.append(key.ravel())
            key = np.concatenate(keys)
            order = np.argsort(key)
            key, lid = key[order], np.repeat(lids, bands)[order]
            part = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            offsets = pa.py_buffer((np.r_[first, len(key)] * 8).astype(np.int32).tobytes())
            packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(x.tobytes())]) for x in (key, lid)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), *packed], names=["part", "keys", "lids"])

    return run


class _Company:
    """Buckets of one range of keys, fed in pieces.

    Held are the range's distinct keys, each with the line it is compared with, never the
    lines of a bucket: a bucket of any size passes through.
    """

    def __init__(self) -> None:
        self.keys, self.pivot, self.out = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, keys: np.ndarray, lids: np.ndarray) -> pa.RecordBatch:
        """Rows ``(key, lid, pivot)`` of buckets with company that the piece adds to."""
        order = np.argsort(keys)
        keys, lids = keys[order], lids[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        key, count = keys[start], np.diff(np.r_[start, len(keys)])
        pivot = np.minimum.reduceat(lids, start)
        known = np.isin(key, self.keys, assume_unique=True)
        shown = np.zeros(len(key), bool)
        at = np.searchsorted(self.keys, key[known])
        pivot[known], shown[known] = self.pivot[at], self.out[at]
        company = known | (count > 1)
        self.out[at] = True
        place = np.searchsorted(self.keys, key[~known])
        self.keys = np.insert(self.keys, place, key[~known])
        self.pivot = np.insert(self.pivot, place, pivot[~known])
        self.out = np.insert(self.out, place, company[~known])
        of = np.repeat(pivot, count)
        member = np.repeat(company, count) & (lids != of)
        newly = company & ~shown
        columns = ((keys[member].view(np.int64), key[newly].view(np.int64)), (lids[member], pivot[newly]), (of[member], pivot[newly]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["key", "lid", "pivot"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with company, with the line that the others are compared with; rows come sorted by range."""
    range_now, company, held, size = None, None, [], 0

    def flush() -> pa.RecordBatch:
        return company.add(*(np.concatenate([np.frombuffer(x[i], kind) for x in held]) for i, kind in enumerate((np.uint64, np.int64))))

    for batch in batches:
        for part, keys, lids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and (part != range_now or size > PIECE):
                yield flush()
                held, size = [], 0
            if part != range_now:
                range_now, company = part, _Company()
            held.append((keys, lids))
            size += len(keys) // 8
    if held:
        yield flush()


def _similar(x: list[str], y: list[str], size: int, similarity: float) -> np.ndarray:
    """Whether the shingle sets of each pair of lines are similar; both lists are as long.

    The sets of a chunk of pairs are sorted at once, 57 bits of a code below the pair's number.
    """
    out = np.empty(len(x), bool)
    for at, upto in _chunks([a + b for a, b in zip(x, y)], 128):
        sets = []
        for side in (x[at:upto], y[at:upto]):
            lengths = np.fromiter(map(len, side), np.int64, len(side))
            owner, codes = _whole_shingles(side, lengths, size)
            packed = [owner.astype(np.uint64) << np.uint64(57) | codes >> np.uint64(7)]
            packed += [np.uint64(i << 57) | shingles(side[i], size) >> np.uint64(7) for i in np.flatnonzero(lengths < size)]
            packed = np.sort(np.concatenate(packed))
            sets.append(packed[np.r_[True, packed[1:] != packed[:-1]]] if len(packed) else packed)
        merged = np.sort(np.concatenate(sets))
        twice = merged[1:][merged[1:] == merged[:-1]] if len(merged) else merged
        count = lambda z: np.bincount((z >> np.uint64(57)).astype(np.int64), minlength=upto - at)
        both = count(twice)
        out[at:upto] = both >= similarity * (count(sets[0]) + count(sets[1]) - both)
    return out


def _verify(size: int, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[_similar(batch["line_a"].tolist(), batch["line_b"].tolist(), size, similarity), ["a", "b"]]

    return run


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links ``(a, b)``, one for each node but the first of a component."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(values))
    while len(a := a[left := label[a] != label[b]]):
        b = b[left]
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jumped := label[label]).tolist() != label.tolist():
            label = jumped
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[label[moved]], values[moved]


def _near_roots(roots: np.ndarray, lines: list[str], size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the components of the lines that are similar, all pairs compared."""
    sets = [shingles(x, size) for x in lines]
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    who = np.repeat(np.arange(len(sets)), counts)
    _, column, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = shared[column] > 1
    who, column = who[often], (np.cumsum(shared > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    exact = np.float32 if counts.max() < 1 << 24 else np.float64
    both = np.zeros((len(sets), len(sets)), exact)
    width = max(1, CHARACTERS // len(sets))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        first, last = np.searchsorted(column, [low, low + width])
        has = np.zeros((len(sets), min(width, int(column[-1]) + 1 - low)), exact)
        has[who[first:last], column[first:last] - low] = 1
        both += has @ has.T
    both = both.astype(np.float64)
    near = both >= similarity * (counts[:, None] + counts[None, :] - both)
    a, b = np.nonzero(np.triu(near, 1))
    return _spanning(roots[a], roots[b])


def _near_roots_of_small(cells: np.ndarray, roots: np.ndarray, lines: list[str], size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for the lines of many small cells, which come one cell after another."""
    a, b = [], []
    for apart in range(1, SMALL):
        first = np.flatnonzero((cells[apart:] == cells[:-apart]) & (roots[apart:] != roots[:-apart]))
        a.append(first)
        b.append(first + apart)
    a, b = np.concatenate(a), np.concatenate(b)
    near = _similar([lines[i] for i in a], [lines[i] for i in b], size, similarity)
    return _spanning(roots[a[near]], roots[b[near]])


def _cell_links(size: int, similarity: float):
    """Links between components inside each cell; rows come sorted by cell, and a cell has at most two tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            cells = rows["cell"].to_numpy(np.int64)
            bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
            if batch is not None:  # the last cell may go on in the next batch
                held, bounds = rows.iloc[bounds[-2] :], bounds[:-1]
            roots, lines = rows["root"].to_numpy(np.int64), rows["line"].tolist()
            if len(bounds) > 1:
                many = np.diff(bounds) > SMALL
                found = [_near_roots(roots[i:j], lines[i:j], size, similarity) for i, j in zip(bounds[:-1][many], bounds[1:][many])]
                few = np.flatnonzero(np.repeat(~many, np.diff(bounds)))
                found.append(_near_roots_of_small(cells[few], roots[few], [lines[i] for i in few], size, similarity))
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"a": a, "b": b})

    return run


def _cells(members: DataFrame, mixed: DataFrame) -> DataFrame:
    """Deals the lines of mixed buckets to cells ``(cell, root, line)`` that hold two tiles at most.

    The lines of a bucket's largest component need no comparison with each other: each
    tile of other lines meets each tile of the largest component and each other tile of its
    own kind.
    """
    rows = members.join(mixed, "key").withColumn("main", F.col("root") == F.col("main_root"))
    own = F.pmod(F.xxhash64("lid", F.lit("tile")), F.when(F.col("main"), F.col("tm")).otherwise(F.col("to"))).cast("int")
    rows = rows.withColumn("own", own)
    to, tm = F.sequence(F.lit(0), F.col("to") - 1), F.sequence(F.lit(0), F.col("tm") - 1)
    cell = lambda kind, i, j: F.xxhash64(F.col("key"), F.lit(kind), i, j)
    as_main = F.transform(to, lambda i: cell("main", i, F.col("own")))
    as_other = F.concat(
        F.transform(tm, lambda j: cell("main", F.col("own"), j)),
        F.transform(F.filter(to, lambda j: j != F.col("own")), lambda j: cell("other", F.least(F.col("own"), j), F.greatest(F.col("own"), j))),
    )
    return rows.select(F.explode(F.when(F.col("main"), as_main).otherwise(as_other)).alias("cell"), "root", "line")


def _cut(with_text: bool):
    def work(batch: pa.RecordBatch) -> list[list]:
        rows = []
        texts, gone_of = (batch.column(batch.schema.get_field_index(n)) for n in (f"{OWN}text", "gone"))
        for text, gone in zip(texts, gone_of):
            parts, drop = text.as_py().split("\n"), set(gone.as_py() or ())
            left = "\n".join(p for i, p in enumerate(parts) if i not in drop)
            made = (len(parts), len(drop), hashlib.sha256(left.encode("utf-8", "replace")).hexdigest())
            rows.append((*made, left) if with_text else made)
        return [[r[i] for r in rows] for i in range(4 if with_text else 3)]

    return work


def similar_lines(lines: DataFrame, size: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """Component of each line that has a near copy: ``(lid, root)``, from distinct ``(lid, line)``.

    Keys are shuffled packed by ranges, as a row for each would cost more than the rest.
    Every bucket of a band links its lines to one of them; linked pairs are compared
    shingle by shingle and the links that hold are united, so a large family of near copies
    costs a pair per line. Where a bucket still holds lines of different components, all of
    those are compared inside tasks, tile by tile, and only links that join components are
    put out: no link inside a bucket is lost and no pairs are written. Buckets of different
    bands that hold the same lines are compared once; two 64-bit sums tell the sets apart.
    """
    ranges = max(8 * shuffle_width(lines.sparkSession), -(-lines.count() * bands // RANGE_KEYS))
    dealt = lines.select("line", "lid").mapInArrow(_band_keys(size, bands, rows, ranges), "part int, keys binary, lids binary")
    dealt = dealt.repartition("part").sortWithinPartitions("part")
    buckets = stage(dealt.mapInArrow(_buckets, "key long, lid long, pivot long"), "lines-buckets")
    texts = lines.join(buckets.select("lid").distinct(), "lid", "left_semi").select("lid", "line")
    texts = stage(texts, "lines-candidates")

    first = buckets.where("lid <> pivot").select(F.col("pivot").alias("a"), F.col("lid").alias("b")).distinct()
    pairs = first.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("line_a")), "a")
    pairs = pairs.join(texts.select(F.col("lid").alias("b"), F.col("line").alias("line_b")), "b")
    links = pairs.select("a", "b", "line_a", "line_b").mapInPandas(_verify(size, similarity), "a long, b long")
    roots = components(links, "lines-components").withColumnsRenamed({"node": "lid"})

    rooted = texts.join(roots, "lid", "left").select("lid", F.coalesce("root", "lid").alias("root"), "line")
    rooted = stage(rooted, "lines-rooted")
    release(texts)
    placed = buckets.select("key", "lid").join(rooted.select("lid", "root", F.length("line").alias("chars")), "lid")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), *[F.bit_xor(F.xxhash64("lid", F.lit(i))).alias(f"set_{i}") for i in (1, 2)])
    whole = parts.groupBy("key").agg(
        F.max(F.struct("n", "root", "chars")).alias("main"), F.sum("n").alias("n"), F.sum("chars").alias("chars"),
        *[F.bit_xor(c).alias(c) for c in ("set_1", "set_2")],
    )
    tiles = lambda n, chars: F.greatest(F.ceil(n / TILE), F.ceil(chars / CHARACTERS)).cast("int")
    mixed = whole.where("n > main.n").groupBy("n", "set_1", "set_2").agg(*[F.min_by(c, "key").alias(c) for c in ("main", "chars")], F.min("key").alias("key"))
    mixed = mixed.select(
        "key",
        F.col("main.root").alias("main_root"),
        tiles(F.col("main.n"), F.col("main.chars")).alias("tm"),
        tiles(F.col("n") - F.col("main.n"), F.col("chars") - F.col("main.chars")).alias("to"),
    )
    mixed = stage(mixed, "lines-mixed")
    members = buckets.select("key", "lid").join(mixed.select("key"), "key", "left_semi").join(rooted, "lid")
    cells = _cells(members, mixed).repartition("cell").sortWithinPartitions("cell")
    joined = components(cells.mapInPandas(_cell_links(size, similarity), "a long, b long"), "lines-joined")
    for done in (buckets, rooted, mixed):
        release(done)
    joined = joined.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(joined, F.col("root") == F.col("old"), "left").select("lid", F.coalesce("new", "root").alias("root"))
    alone = joined.select(F.col("old").alias("lid"), F.col("new").alias("root")).join(roots.select("lid"), "lid", "left_anti")
    return moved.union(alone)


def without_similar_lines(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = 8,
    similarity: float = 0.8,
    bands: int = 12,
    rows: int = 5,
    keep: list[str] | None = None,
    with_text: bool = False,
) -> DataFrame:
    """``keep``, ``n_lines``, ``n_removed``, ``kept_sha256`` of every row and, if asked, ``kept_text``.

    Lines are what line feeds separate. Two lines are linked if their sets of ``size``-character
    shingles have a Jaccard similarity of at least ``similarity``; lines are found by
    ``bands`` bands of ``rows`` MinHash values (a pair at the limit is missed once in a
    hundred times, equal lines never). Of each component the first line stays, by document
    id, then row, then place; the others are removed.

    Blank lines always stay, also those of tabs or carriage returns. A line shorter than a shingle is only linked to equal lines.
    Null text counts as empty and has one blank line. A null id comes first. Repeated rows
    are documents of their own. An empty table gives an empty result. A column with the
    name of a result column gives way to it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    own = docs.select(*names, F.col(doc_id).cast("long").alias(f"{OWN}id"), text_or_empty(text).alias(f"{OWN}text"))
    docs_rows = stage(tagged(own), "lines-docs")
    pieces = docs_rows.select(TAG, f"{OWN}id", F.posexplode(F.split(f"{OWN}text", "\n", -1)).alias("place", "line"))
    pieces = pieces.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    digest = F.unhex(F.md5(F.col("line").cast("binary"))).alias("digest")
    distinct = tagged(pieces.select("line").distinct()).select(F.col(TAG).alias("lid"), digest, "line")
    distinct = stage(distinct, "lines-distinct")
    groups = similar_lines(distinct.select("lid", "line"), size, similarity, bands, rows)
    root_of = distinct.select("digest", "lid").join(groups, "lid", "left").select("digest", F.coalesce("root", "lid").alias("root"))
    placed = pieces.select(TAG, f"{OWN}id", "place", digest).join(root_of, "digest").select(TAG, f"{OWN}id", "place", "root")
    placed = stage(placed, "lines-placed")
    release(distinct)
    firsts = placed.groupBy("root").agg(F.min(F.struct(f"{OWN}id", TAG, "place")).alias("first"))
    firsts = firsts.select("root", F.col(f"first.{TAG}").alias("first_tag"), F.col("first.place").alias("first_place"))
    gone = placed.join(firsts, "root").where((F.col(TAG) != F.col("first_tag")) | (F.col("place") != F.col("first_place")))
    gone = gone.groupBy(TAG).agg(F.collect_list("place").alias("gone"))
    made = [("n_lines", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType())]
    made += [("kept_text", StringType())] * with_text
    fields = [StructField(f"{OWN}{n}", t, False) for n, t in made]
    # Kept columns stay in Arrow: pandas would round long ids beside a null.
    out = map_batches(docs_rows.join(gone, TAG, "left"), names, fields, _cut(with_text))
    return out.select(*names, *[F.col(f.name).alias(f.name.removeprefix(OWN)) for f in fields])
