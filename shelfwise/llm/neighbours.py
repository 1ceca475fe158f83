"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import OWN, TAG, stage, tagged

SUBSTRING = 8
_POP = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)


@dataclass(frozen=True)
class Codes:
    """Centre and rotated directions of one vector length, and the Hamming radius to search."""

    mean: np.ndarray
    directions: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """One byte per substring of eight bits."""
        return np.packbits((vectors - self.mean) @ self.directions > 0, axis=1)


def learn_codes(sample: np.ndarray, bits: int, k: int, recall: float, seed: int = 3, steps: int = 40) -> Codes:
    """Principal directions rotated so that signs lose little, and a radius from the sample.

    The radius is the Hamming distance below which the share ``recall`` of the sample's own
    nearest neighbours lies. In all rows neighbours are nearer than in the sample, so the
    radius errs on the safe side.
    """
    mean = sample.mean(0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    dims = len(axes)
    # With more bits than directions, further rotations of the same directions follow.
    turns, rng = [], np.random.default_rng(seed)
    for _ in range(-(-bits // dims)):
        projected = centred @ axes.T
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(steps):
            left, _, right = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (left @ right).T
        turns.append(axes.T @ turn)
    directions = np.hstack(turns)[:, :bits]
    codes = Codes(mean, directions, bits)
    packed = codes.of(sample)
    asked = np.arange(0, len(sample), max(1, len(sample) // 256))
    far = []
    for i in asked:
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        far.append(np.bitwise_count(packed[near] ^ packed[i]).sum(1))
    found = np.concatenate(far) if far else np.zeros(0)
    radius = int(np.quantile(found, recall)) if len(found) else bits
    return Codes(mean, directions, radius)


class SubstringIndex:
    """For each substring the rows sorted by its value, with where each value starts."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.orders = [np.argsort(packed[:, j], kind="stable") for j in range(packed.shape[1])]
        self.starts = [np.searchsorted(packed[o, j], np.arange(257)) for j, o in enumerate(self.orders)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits.

        With ``radius = m * s + a`` such a row differs in at most ``s`` bits in one of the first
        ``a + 1`` of the ``m`` substrings or in at most ``s - 1`` in one of the others: else it
        would differ in more than ``radius`` bits. The buckets that near hold all such rows.
        """
        m = len(self.orders)
        seen = np.zeros(len(self.packed), bool)
        for j in range(m):
            near = radius // m - (j > radius % m)
            values = np.flatnonzero(_POP[np.arange(256) ^ int(code[j])] <= near)
            low, high = self.starts[j][values], self.starts[j][values + 1]
            size = high - low
            if size.sum():
                at = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                seen[self.orders[j][at]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.packed[rows] ^ code).sum(1) <= radius]


def _search(codes: dict[int, Codes], k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["query_tag", "query_id", "vec_id", "score", "tag"]
        if not len(queries) or not len(rows):
            return pd.DataFrame({n: [] for n in names})
        model = codes[int(key[0])]
        base = np.stack(rows["vector"].to_numpy()).astype(float)
        ids, tags = rows["vec_id"].to_numpy(np.int64), rows["tag"].to_numpy(np.int64)
        index = SubstringIndex(model.of(base))
        asked = np.stack(queries["vector"].to_numpy()).astype(float)
        asked_codes = model.of(asked)
        out = []
        for q in range(len(asked)):
            radius = model.radius
            found = index.within(asked_codes[q], radius)
            own = int(queries["tag"].iat[q])
            while (tags[found] != own).sum() < min(k, (tags != own).sum()):
                radius = min(radius + 4, 8 * asked_codes.shape[1])
                found = index.within(asked_codes[q], radius)
            found = found[tags[found] != own]
            exact = np.sqrt(((base[found] - asked[q]) ** 2).sum(1))
            best = np.lexsort((tags[found], ids[found], exact))[:k]
            out.append((np.full(len(best), own), np.full(len(best), queries["vec_id"].iat[q]), ids[found[best]], exact[best], tags[found[best]]))
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out)))))

    return run


def nearest(
    vectors: DataFrame,
    is_query,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 10,
    bits: int = 128,
    recall: float = 0.97,
    max_sample: int = 4096,
    block_rows: int = 4096,
    query_rows: int = 4096,
) -> DataFrame:
    """The ``k`` nearest rows found of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Codes of ``bits`` bits (rotations of the same directions follow each other) and the radius
    are learnt from at most about ``max_sample`` rows, chosen by hash; every row is indexed. Rows are dealt by hash into blocks of about ``block_rows``, each of
    which is indexed by substring where it lies; queries go to every block in groups of
    about ``query_rows``. A block answers with its ``k`` nearest of all codes within the
    radius, measured on the original vectors in double precision; a block that finds fewer
    widens the radius until it has ``k`` or all its rows. The blocks' answers are merged.

    Vectors that are null, empty, zero, or hold a null or a number that is not finite take
    no part; vectors of different length are never compared. Ties go to the smaller id.
    A null id takes no part. Rows that repeat an id are rows of their own, and each such
    query row gets an answer. An empty table gives an empty result.
    """
    vector = F.transform(F.col(embedding), lambda x: x.cast("double"))
    valid = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(valid)
    rows = stage(tagged(rows).withColumn("dim", F.size("vector")).withColumnRenamed(TAG, "tag"), "ann-rows")
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    codes: dict[int, Codes] = {}
    for dim, (n, _) in sizes.items():
        edge = int(min(1.0, max_sample / n) * (1 << 32))
        chosen = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 32)) < edge))
        picked = chosen.select("vec_id", "vector").dropDuplicates(["vector"]).orderBy("vec_id").toPandas()
        sample = np.stack(picked["vector"].to_numpy()) if len(picked) else np.zeros((1, dim))
        codes[dim] = learn_codes(sample.astype(float), bits, k, recall)
    dims = F.create_map(*[x for d, (n, q) in (sizes or {0: (0, 0)}).items() for x in (F.lit(d), F.array(F.lit(-(-n // block_rows)), F.lit(max(1, -(-q // query_rows)))))])
    parts = dims[F.col("dim")]
    blocks, groups = parts[0], parts[1]
    asked = rows.where("asks").select(
        "dim", "tag", "vec_id", "vector",
        F.pmod(F.xxhash64("vec_id", "tag", F.lit("query")), groups).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
    )
    dealt = rows.select(
        "dim", "tag", "vec_id", "vector",
        F.explode(F.sequence(F.lit(0), groups - 1)).alias("group"),
        F.pmod(F.xxhash64("vec_id", "tag", F.lit("block")), blocks).cast("int").alias("block"),
    )
    keys = ["dim", "group", "block"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(
        _search(codes, k), "query_tag long, query_id long, vec_id long, score double, tag long"
    )
    from pyspark.sql import Window

    order = Window.partitionBy("query_tag").orderBy("score", "vec_id", "tag")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
