"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from shelfwise.llm.common import OWN, map_batches, release, stage, text_or_empty

CHUNK = 1 << 14


@dataclass(frozen=True)
class Settings:
    """What the model is made of. ``max_train`` bounds the labelled rows of the linear fit.

    The log-count ratios are counted over every labelled row; the ``features`` n-grams that
    tell the classes apart best go into the fit, which takes at most about ``max_train``
    rows, chosen by the hash of their id.
    """

    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    features: int = 1 << 11
    min_documents: int = 5
    max_train: int = 20_000
    smoothing: float = 1.0
    penalty: float = 1.0
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """Log-odds of a text: ``bias`` plus ``weights`` of the n-gram codes that occur in it."""

    settings: Settings
    bias: float
    codes: np.ndarray
    weights: np.ndarray


def gram_codes(text: str, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Hashed codes of all character n-grams of the lower-cased text, one array per size."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    rolled, out = points * np.uint32(0x9E3779B1), []
    for size in range(2, max(sizes) + 1):
        if len(points) < size:
            break
        rolled = (rolled[:-1] ^ points[size - 1 :]) * np.uint32(0x85EBCA6B)
        rolled = rolled ^ (rolled >> np.uint32(13))
        if size in sizes:
            out.append((rolled * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits))
    return out


def _presence_counts(settings: Settings):
    """For each task: in how many texts of each class a code occurs, in chunks of codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dims = 1 << settings.bits
        counts = np.zeros((2, dims), np.int32)
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"]):
                codes = gram_codes(text, settings.sizes, settings.bits)
                if codes:
                    counts[int(label)][np.unique(np.concatenate(codes))] += 1
        for at in range(0, dims, CHUNK):
            part = counts[:, at : at + CHUNK]
            if part.any():
                yield pd.DataFrame({"chunk": [at], "counts": [part.tobytes()]})

    return run


def _chunk_scores(settings: Settings, totals: tuple[int, int]):
    """Adds up a chunk's counts and scores its codes by how well they tell the classes apart."""

    def scored(start: int, counts: np.ndarray) -> pd.DataFrame:
        clean, toxic = counts.astype(float)
        n0, n1 = totals
        pooled = (clean + toxic) / (n0 + n1)
        spread = np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / n0 + 1 / n1), 1e-300))
        score = np.abs(toxic / n1 - clean / n0) / spread
        a = settings.smoothing
        ratio = np.log((toxic + a) / (n1 + 2 * a)) - np.log((clean + a) / (n0 + 2 * a))
        use = np.flatnonzero(clean + toxic >= settings.min_documents)
        return pd.DataFrame({"code": start + use, "score": score[use], "ratio": ratio[use]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, counts = None, None
        for batch in batches:
            for chunk, raw in zip(batch["chunk"], batch["counts"]):
                if chunk != start:
                    if start is not None:
                        yield scored(start, counts)
                    start, counts = chunk, np.zeros((2, CHUNK), np.int64)
                counts += np.frombuffer(raw, np.int32).reshape(2, CHUNK)
        if start is not None:
            yield scored(start, counts)

    return run


def _rows_of(codes: np.ndarray, settings: Settings):
    """Positions, in the sorted feature list, of the features present in a text."""
    slot = np.full(1 << settings.bits, -1, np.int32)
    slot[codes] = np.arange(len(codes), dtype=np.int32)

    def present(text: str) -> np.ndarray:
        found = [slot[c] for c in gram_codes(text, settings.sizes, settings.bits)]
        found = np.concatenate(found) if found else np.empty(0, np.int32)
        return np.unique(found[found >= 0])

    return present


def fit_logistic(
    rows: np.ndarray, cols: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int, penalty: float
) -> tuple[float, np.ndarray]:
    """Ridge logistic regression by Newton steps with conjugate gradients; deterministic."""
    n = len(labels)
    w = np.zeros(width + 1)

    def times(v):
        return np.bincount(rows, values * v[cols], n) + v[width]

    def back(u):
        return np.append(np.bincount(cols, values * u[rows], width), u.sum())

    ridge = np.append(np.full(width, penalty), 1e-6)

    def cost(v):
        z = times(v)
        return np.logaddexp(0, z).sum() - (labels * z).sum() + 0.5 * (ridge * v * v).sum()

    now = cost(w)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(times(w), -500, 500)))
        gradient = back(p - labels) + ridge * w
        if np.abs(gradient).max() < 1e-5 * max(1, n):
            break
        curve = np.maximum(p * (1 - p), 1e-10)
        step, r = np.zeros_like(w), -gradient
        d, rr = r.copy(), r @ r
        for _ in range(60):
            hd = back(curve * times(d)) + ridge * d
            a = rr / (d @ hd)
            step += a * d
            r -= a * hd
            new = r @ r
            if new < 1e-8 * (gradient @ gradient):
                break
            d, rr = r + (new / rr) * d, new
        scale = 1.0
        while scale > 1e-6 and (tried := cost(w + scale * step)) > now:
            scale /= 2
        if scale <= 1e-6:
            break
        w, gained, now = w + scale * step, now - tried, tried
        if gained < 1e-7 * abs(now):
            break
    return float(w[width]), w[:width]


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Model from rows ``(id, text, label)`` with label 0 or 1; other labels take no part.

    Without rows of both classes the model has no features and gives the smoothed share of
    class 1, or 0 where there are no rows at all.
    """
    rows = stage(labelled.where("label in (0, 1)").select("id", text_or_empty("text").alias("text"), F.col("label").cast("int").alias("label")), "toxicity-labelled")
    per_class = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = per_class.get(0, 0), per_class.get(1, 0)
    nothing = np.empty(0)
    if not n0 or not n1:
        bias = float(np.log((n1 + 1) / (n0 + 1))) if n0 + n1 else -np.inf
        release(rows)
        return Model(settings, bias, nothing.astype(np.int64), nothing)
    counts = rows.select("label", "text").mapInPandas(_presence_counts(settings), "chunk long, counts binary")
    dealt = counts.repartition("chunk").sortWithinPartitions("chunk")
    scored = dealt.mapInPandas(_chunk_scores(settings, (n0, n1)), "code long, score double, ratio double")
    best = scored.orderBy(F.desc("score"), "code").limit(settings.features).toPandas().sort_values("code")
    codes, ratios = best["code"].to_numpy(np.int64), best["ratio"].to_numpy()

    share = min(1.0, settings.max_train / (n0 + n1))
    edge = int(share * (1 << 32))
    sample = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit("fit")), F.lit(1 << 32)) < edge)
    present = _rows_of(codes, settings)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"id": batch["id"], "label": batch["label"], "at": [present(t).tobytes() for t in batch["text"]]}
            )

    fit = sample.mapInPandas(features, "id long, label int, at binary").toPandas().sort_values(["id", "label"])
    found = [np.frombuffer(a, np.int32) for a in fit["at"]]
    at_rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    at_cols = np.concatenate(found) if found else np.empty(0, np.int32)
    bias, weights = fit_logistic(
        at_rows, at_cols, ratios[at_cols], fit["label"].to_numpy(float), len(codes), settings.penalty
    )
    release(rows)
    return Model(settings, bias, codes, weights * ratios)


def with_scores(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the probability of class 1 of each whole text; null counts as empty."""
    present = _rows_of(model.codes, model.settings)
    bias, weights = model.bias, model.weights

    def work(batch):
        odds = np.array(
            [bias + weights[present(t.as_py())].sum() for t in batch.column(batch.schema.get_field_index(f"{OWN}text"))]
        )
        with np.errstate(over="ignore"):
            return [1 / (1 + np.exp(-odds))]

    wanted = docs.select(*keep, text_or_empty(text).alias(f"{OWN}text"))
    return map_batches(wanted, keep, [StructField(f"{OWN}score", DoubleType(), False)], work)


def in_held_out(doc_id: str = "doc_id") -> Column:
    """The third of the rows whose labels are never learnt from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Model from the labelled documents outside the held-out third."""
    marks = labels.where(F.col("toxic").isin(0, 1) & ~in_held_out()).select(
        F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("label")
    )
    texts = docs.where(~in_held_out()).select(F.col("doc_id").cast("long").alias("id"), "text")
    # The same join at every size of the label table.
    return train(texts.join(marks.hint("merge"), "id"), settings)


def toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None
) -> DataFrame:
    """``keep``, ``held_out``, ``score``, ``predicted`` of every document.

    Text is all a score is made of. Null and empty texts get the score of a text without
    n-grams. A document with two labels counts with each; repeated rows get equal scores.
    An input column with the name of a result column gives way to it.
    """
    model = learn(docs, labels, settings)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    scored = with_scores(docs.select(*names, F.col("text").alias(f"{OWN}in"), in_held_out().alias(f"{OWN}held")), model, [*names, f"{OWN}held"], f"{OWN}in")
    score = F.col(f"{OWN}score")
    return scored.select(
        *names, F.col(f"{OWN}held").alias("held_out"), score.alias("score"), (score >= settings.threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels_docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with exactly its columns."""
    model = learn(labels_docs, labels, settings)
    return with_scores(docs, model, docs.columns).where(F.col(f"{OWN}score") < settings.threshold).select(*docs.columns)
