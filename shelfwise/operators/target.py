"""The target label, train/test split and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.features import EPS
from shelfwise.operators.quantiles import quantiles, scalars
from shelfwise.schemas import ensure_columns

# The eight model features, structural columns only.
CLASS_FEATURES = (
    "prix", "remise_pct", "stock", "nb_images", "nb_variants", "en_promo", "categorie_enc",
    "source_enc",
)
# Weights of the target score, and of the container job's target score.
TARGET_WEIGHTS = {"price": 40, "discount": 25, "available": 20, "stock": 15}
CONTAINER_TARGET_WEIGHTS = {"price": 40, "discount": 30, "available": 0, "stock": 30}
# Label quantile, flat-score limit, noise height, seed.
LABEL_QUANTILE, FLAT, NOISE, SEED = 0.7, 1e-6, 10, 42

HASH_SPAN = 1 << 52


def uniform(key: Column, seed: int = SEED) -> Column:
    """Number in [0, 1) fixed by the row's key, whatever the partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(HASH_SPAN)) / F.lit(float(HASH_SPAN))


def target_score(
    df: DataFrame, weights: dict = TARGET_WEIGHTS, clip: bool = True
) -> tuple[DataFrame, bool]:
    """Add ``_target``; terms without a column, or whose column sums to 0 or less, are left out.

    ``clip`` sets negative discounts and stocks to 0. Returns also whether the score
    was flat and got key-based noise instead.
    """
    def amount(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return F.greatest(value, F.lit(0.0)) if clip else value

    price = F.greatest(F.col("prix"), F.lit(0.0))
    aggs = {"price_sum": F.sum("prix"), "lo": F.min(price), "hi": F.max(price)}
    for term, name in (("discount", "remise_pct"), ("stock", "stock")):
        if name in df.columns:
            aggs[f"{term}_sum"] = F.sum(amount(name))
            aggs[f"{term}_max"] = F.max(amount(name))
    s = scalars(df, **aggs)

    score = F.lit(0.0)
    if (s["price_sum"] or 0) > 0:
        norm = (price - F.lit(float(s["lo"]))) / F.lit(float(s["hi"]) - float(s["lo"]) + EPS)
        score = score + (F.lit(1.0) - norm) * weights["price"]
    if (s.get("discount_sum") or 0) > 0:
        top = F.lit(float(s["discount_max"]) + EPS)
        score = score + amount("remise_pct") / top * weights["discount"]
    if weights["available"] and "disponible" in df.columns:
        available = F.coalesce(F.col("disponible").cast("double"), F.lit(0.0))
        score = score + available * weights["available"]
    if (s.get("stock_sum") or 0) > 0:
        score = score + amount("stock") / F.lit(float(s["stock_max"]) + EPS) * weights["stock"]

    df = df.withColumn("_target", score)
    spread = scalars(df, sd=F.stddev_samp("_target"))["sd"]
    flat = spread is not None and spread < FLAT
    if flat:
        key = "uid" if "uid" in df.columns else df.columns[0]
        df = df.withColumn("_target", F.col("_target") + uniform(F.col(key)) * NOISE)
    return df, flat


def create_target(df: DataFrame, weights: dict = TARGET_WEIGHTS, clip: bool = True) -> DataFrame:
    """Label the rows at or above the 70 % quantile of the target score."""
    scored, _ = target_score(df, weights, clip)
    cut = quantiles(scored, {"_target": [LABEL_QUANTILE]})["_target"][LABEL_QUANTILE]
    labelled = scored.withColumn("top_produit", (F.col("_target") >= F.lit(cut)).cast("int"))
    return labelled.drop("_target")


def container_target(df: DataFrame) -> DataFrame:
    return create_target(df, CONTAINER_TARGET_WEIGHTS, clip=False)


def class_balance(df: DataFrame) -> DataFrame:
    """Rows and share per label; the total is the sum of the two counts."""
    counts = df.agg(F.count("*").alias("n"), F.sum("top_produit").alias("ones"))
    pair = F.array(
        F.struct(F.lit(0).alias("top_produit"), (F.col("n") - F.col("ones")).alias("k")),
        F.struct(F.lit(1).alias("top_produit"), F.col("ones").alias("k")),
    )
    rows = counts.select("n", F.explode(pair).alias("p")).where("p.k > 0")
    return rows.select(
        "p.top_produit",
        F.col("p.k").cast("long").alias("n"),
        F.round(F.col("p.k") / F.col("n") * 100, 4).alias("pct"),
    )


def feature_matrix(df: DataFrame, features: tuple = CLASS_FEATURES) -> DataFrame:
    """Model features as doubles, missing columns and nulls as 0."""
    df = ensure_columns(df, {c: F.lit(0.0) for c in features})
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    )


def stratified_marks(
    df: DataFrame, label: str, fractions: list[float], key: str = "uid", seed: int = SEED
) -> tuple[Column, dict]:
    """Hash of the key and, per class, its exact quantiles at ``fractions``.

    Cutting each class at these marks gives exact shares without sorting a class.
    """
    mark = F.xxhash64(F.col(key), F.lit(seed))
    per_class = df.select(
        F.when(F.col(label) == 0, mark).alias("c0"), F.when(F.col(label) == 1, mark).alias("c1")
    )
    cuts = quantiles(per_class, {"c0": fractions, "c1": fractions}, interpolation="lower")
    return mark, cuts


def stratified_split(
    df: DataFrame, label: str = "top_produit", test: float = 0.2, key: str = "uid", seed: int = SEED
) -> DataFrame:
    """Add ``is_test``: the given share of each class, chosen by hash."""
    mark, cuts = stratified_marks(df, label, [test], key, seed)
    bound = F.when(F.col(label) == 0, F.lit(cuts["c0"][test])).otherwise(F.lit(cuts["c1"][test]))
    return df.withColumn("is_test", mark <= bound)


def stratified_folds(
    df: DataFrame, label: str, folds: int = 5, key: str = "uid", seed: int = SEED
) -> DataFrame:
    """Add ``fold`` from 0, equal shares of each class per fold."""
    fractions = [i / folds for i in range(1, folds)]
    mark, cuts = stratified_marks(df, label, fractions, key, seed + 1)
    passed = F.lit(0)
    for q in fractions:
        bound = F.when(F.col(label) == 0, F.lit(cuts["c0"][q])).otherwise(F.lit(cuts["c1"][q]))
        passed = passed + (mark > bound).cast("int")
    return df.withColumn("fold", F.coalesce(passed, F.lit(0)).cast("int"))
