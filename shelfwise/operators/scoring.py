"""Composite scores and the Top-K report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import features as fx
from shelfwise.operators.quantiles import quantiles, scalars
from shelfwise.operators.ranking import rank_descending, top_k

# Weights of the composite score.
WEIGHTS = {"rating": 30, "reviews": 25, "model": 25, "ratio": 15, "available": 5}
# Weights of the container job's composite score.
CONTAINER_WEIGHTS = {"model": 40, "price": 30, "discount": 20, "stock": 10}
# Weights of the dashboard's fallback score.
FALLBACK_WEIGHTS = {"price": 35, "discount": 30, "rating": 25, "available": 10}
# Every weighted term lies between 0 and 1 and the sum is rounded to two decimals.
SCORE_VALUES = 10_001

DISPLAY = (
    "rang", "nom", "categorie", "source", "prix", "rating", "nb_reviews", "remise_pct",
    "disponible", "score_composite", "segment",
)


def composite_score(df: DataFrame, probability: str = "proba_consensus") -> DataFrame:
    """Weighted 0-100 score, two decimals, with its rank; no model column means no model term."""
    parts = {
        "rating": F.col("rating"),
        "reviews": F.log1p("nb_reviews"),
        "model": F.col(probability) if probability in df.columns else F.lit(0.0),
        "ratio": F.col("ratio_qualite_prix"),
    }
    bounds = scalars(
        df,
        **{f"lo_{k}": F.min(c) for k, c in parts.items()},
        **{f"hi_{k}": F.max(c) for k, c in parts.items()},
    )
    total = F.lit(0.0)
    for k, c in parts.items():
        total = total + fx.min_max(c, bounds[f"lo_{k}"], bounds[f"hi_{k}"]) * WEIGHTS[k]
    total = total + F.col("disponible").cast("double") * WEIGHTS["available"]
    scored = df.withColumn("score_composite", F.round(total, 2))
    return rank_descending(scored, "score_composite", distinct_bound=SCORE_VALUES)


def container_score(df: DataFrame, probability: str = "proba_top") -> DataFrame:
    """The container job's score: probability, inverse price, discount and stock."""
    parts = {
        "model": F.col(probability),
        "price": F.lit(1.0) / (F.col("prix") + 1),
        "discount": F.coalesce(F.col("remise_pct"), F.lit(0.0)),
        "stock": F.coalesce(F.col("stock"), F.lit(0)).cast("double"),
    }
    bounds = scalars(
        df,
        **{f"lo_{k}": F.min(c) for k, c in parts.items()},
        **{f"hi_{k}": F.max(c) for k, c in parts.items()},
    )
    if bounds["lo_model"] is None:
        return df.withColumns({"score_composite": F.lit(None).cast("double"), "rang": F.lit(None).cast("int")})
    total = F.lit(0.0)
    for k, c in parts.items():
        total = total + fx.min_max_eps(c, bounds[f"lo_{k}"], bounds[f"hi_{k}"]) * CONTAINER_WEIGHTS[k]
    scored = df.withColumn("score_composite", F.round(total, 2))
    return rank_descending(scored, "score_composite", distinct_bound=SCORE_VALUES)


def fallback_score(df: DataFrame) -> DataFrame:
    """Dashboard score for a table that has none (or only zeros)."""
    if "score_composite" in df.columns:
        total = scalars(df, s=F.sum("score_composite"))["s"]
        if total:
            return df
    low_high = scalars(
        df, lo=F.min("prix"), hi=F.max("prix"),
        rem=F.max("remise_pct") if "remise_pct" in df.columns else F.lit(1.0),
    )
    if low_high["lo"] is None:
        return df.withColumn("score_composite", F.lit(None).cast("double"))
    price = fx.min_max_eps(F.col("prix"), low_high["lo"], low_high["hi"])
    discount = F.col("remise_pct") if "remise_pct" in df.columns else F.lit(0.0)
    rating = F.col("rating") if "rating" in df.columns else F.lit(0.0)
    available = F.col("disponible") if "disponible" in df.columns else F.lit(True)
    w = FALLBACK_WEIGHTS
    total = (
        (F.lit(1.0) - price) * w["price"]
        + (discount / F.lit(float(low_high["rem"]) + fx.EPS)) * w["discount"]
        + (rating / 5) * w["rating"]
        + available.cast("double") * w["available"]
    )
    return df.withColumn("score_composite", F.round(total, 2))


def fallback_rank(df: DataFrame) -> DataFrame:
    return df if "rang" in df.columns else rank_descending(df, "score_composite")


def fallback_label(df: DataFrame) -> DataFrame:
    """Top 30 % by score."""
    if "top_produit" in df.columns:
        return df
    cut = quantiles(df, {"score_composite": [0.7]})["score_composite"][0.7]
    return df.withColumn("top_produit", (F.col("score_composite") >= F.lit(cut)).cast("int"))


def fallback_columns(df: DataFrame) -> DataFrame:
    """Segment, ratio, promotion flag and two scaled columns, each only where absent."""
    add = {}
    if "segment" not in df.columns:
        add["segment"] = fx.score_band(F.col("score_composite"))
    if "ratio_qualite_prix" not in df.columns:
        rating = F.col("rating") if "rating" in df.columns else F.lit(4.0)
        add["ratio_qualite_prix"] = F.round(fx.quality_price_ratio(rating, F.col("prix")), 4)
    if "en_promo" not in df.columns:
        add["en_promo"] = fx.on_promo(F.col("remise_pct"))
    wanted = [c for c in ("prix", "remise_pct") if f"{c}_norm" not in df.columns]
    if wanted:
        b = scalars(
            df, **{f"lo_{c}": F.min(c) for c in wanted}, **{f"hi_{c}": F.max(c) for c in wanted}
        )
        for c in wanted:
            if b[f"lo_{c}"] is None:
                add[f"{c}_norm"] = F.lit(None).cast("double")
            else:
                scaled = fx.min_max_eps(F.col(c), b[f"lo_{c}"], b[f"hi_{c}"])
                add[f"{c}_norm"] = F.round(scaled, 4)
    return df.withColumns(add) if add else df


def dashboard_table(df: DataFrame) -> DataFrame:
    """Everything the dashboard guarantees on the table it shows."""
    numeric = ("prix", "remise_pct", "rating", "nb_reviews", "stock", "score_composite")
    present = {
        c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))
        for c in numeric
        if c in df.columns
    }
    df = df.withColumns(present)
    return fallback_columns(fallback_label(fallback_rank(fallback_score(df))))


def score_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.round(F.avg("score_composite"), 6).alias("moyenne"),
        F.max("score_composite").alias("maximum"),
    )


def filtered_top_k(
    df: DataFrame,
    k: int = 20,
    categorie: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """Top-K by score; ``categorie`` is a case-blind pattern, ``source`` an exact value."""
    if categorie:
        df = df.where(F.coalesce(F.col("categorie").rlike("(?i)" + categorie), F.lit(False)))
    if source:
        df = df.where(F.col("source") == source)
    if "score_composite" not in df.columns:
        return df.orderBy("uid").limit(k)
    return top_k(df, k, "score_composite")


def display_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in DISPLAY if c in df.columns])


def segment_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("segment").agg(F.count("*").alias("n"))


def table_status(raw: DataFrame | None, enriched: DataFrame | None) -> DataFrame:
    """Row counts of both stored tables, 0 when absent."""
    present = [(n, t) for n, t in (("raw", raw), ("enriched", enriched)) if t is not None]
    status = present[0][1].agg(F.count("*").alias(f"{present[0][0]}_products"))
    for name, table in present[1:]:
        other = scalars(table, n=F.count("*"))["n"]
        status = status.withColumn(f"{name}_products", F.lit(other).cast("long"))
    for name in ("raw", "enriched"):
        known = f"{name}_products" in status.columns
        if not known:
            status = status.withColumn(f"{name}_products", F.lit(0).cast("long"))
        status = status.withColumn(f"{name}_data_available", F.lit(known))
    return status


def table_overview(df: DataFrame) -> DataFrame:
    """Row count and column list of a table."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count("*").alias("nb_products")).withColumn(
        "columns", F.array_join(names, ",")
    )
