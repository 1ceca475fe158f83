"""The tables behind each dashboard view; drawing is not part of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import fixed
from shelfwise.operators.quantiles import grouped_quantiles, quantiles, scalars
from shelfwise.operators.ranking import top_k

# Bins, sample sizes, list lengths, label lengths of the views.
SCORE_BINS, PRICE_BINS, PRICE_CLIP = 40, 40, 0.95
SORT_COLUMNS = ("score_composite", "prix", "remise_pct", "rating", "nb_reviews")
# Headings of the detail table.
HEADINGS = {
    "rang": "#", "nom": "Produit", "categorie": "Catégorie", "source": "Source", "prix": "Prix",
    "remise_pct": "Remise", "score_composite": "Score", "rating": "Note", "disponible": "Dispo",
}


def filter_products(
    df: DataFrame,
    source: str | None = None,
    categorie: str | None = None,
    prix_min: float | None = None,
    prix_max: float | None = None,
    promo_only: bool = False,
    top_only: bool = False,
    available_only: bool = False,
) -> DataFrame:
    """All chosen filters at once; they reach the Parquet scan, the source its folder."""
    if source is not None:
        df = df.where(F.col("source") == source)
    if categorie is not None:
        df = df.where(F.col("categorie") == categorie)
    if prix_min is not None:
        df = df.where(F.col("prix") >= F.lit(float(prix_min)))
    if prix_max is not None:
        df = df.where(F.col("prix") <= F.lit(float(prix_max)))
    if promo_only:
        df = df.where(F.col("remise_pct") > 0)
    if top_only and "top_produit" in df.columns:
        df = df.where(F.col("top_produit") == 1)
    if available_only and "disponible" in df.columns:
        df = df.where("disponible")
    return df


def filter_options(df: DataFrame) -> DataFrame:
    """Choices of the filters: ``(kind, value)`` for sources and categories, sorted."""
    kinds = F.explode(
        F.array(
            F.struct(F.lit("source").alias("kind"), F.col("source").alias("value")),
            F.struct(F.lit("categorie").alias("kind"), F.col("categorie").alias("value")),
        )
    )
    pairs = df.select("source", "categorie").distinct().select(kinds.alias("o")).select("o.*")
    return pairs.where(F.col("value").isNotNull()).distinct().orderBy("kind", "value")


def price_range(df: DataFrame) -> DataFrame:
    """Slider ends; equal ends are one apart."""
    low, high = F.min("prix"), F.max("prix")
    return df.agg(
        low.alias("prix_min"), F.when(low >= high, low + 1.0).otherwise(high).alias("prix_max")
    )


def side_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("produits"),
        F.countDistinct("categorie").alias("categories"),
        F.sum("top_produit").cast("long").alias("top_ml"),
    )


def kpi_row(df: DataFrame) -> DataFrame:
    """Headline numbers in one pass; only the exact median needs its own passes."""
    median = quantiles(df, {"prix": [0.5]})["prix"][0.5]
    promo = F.col("remise_pct") > 0
    n = F.count("*")
    top = F.sum("top_produit")
    return df.agg(
        n.alias("produits"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct("categorie").alias("categories"),
        top.cast("long").alias("top_n"),
        F.round(top / F.greatest(n, F.lit(1)) * 100, 4).alias("top_pct"),
        F.count_if(promo).alias("promo_n"),
        F.round(F.avg(F.when(promo, F.col("remise_pct"))), 4).alias("remise_moyenne"),
        F.round(F.avg("score_composite"), 4).alias("score_moyen"),
        F.round(F.avg("prix"), 4).alias("prix_moyen"),
    ).withColumn("prix_median", F.round(F.lit(median).cast("double"), 4))


def top_bars(df: DataFrame, k: int = 15, chars: int = 42, ellipsis: bool = False) -> DataFrame:
    """Best products by score with a short label."""
    label = F.substring("nom", 1, chars)
    if ellipsis:
        label = F.concat(label, F.lit("…"))
    return top_k(df, k, "score_composite").select(
        "uid", label.alias("nom_court"), "categorie", "prix", "score_composite"
    )


def segment_shares(df: DataFrame) -> DataFrame:
    """Rows and percent per segment; the total is one counted number."""
    total = scalars(df, n=F.count("*"))["n"]
    return df.groupBy("segment").agg(
        F.count("*").alias("n"),
        F.round(F.count("*") / F.lit(float(max(total, 1))) * 100, 4).alias("pct"),
    )


def availability(df: DataFrame) -> DataFrame:
    """Available and sold-out counts with their share of both."""
    flags = df.where(F.col("disponible").isNotNull()).agg(
        F.count_if(F.col("disponible")).alias("ok"), F.count_if(~F.col("disponible")).alias("ko")
    )
    total = F.greatest(F.col("ok") + F.col("ko"), F.lit(1))
    pair = F.array(
        F.struct(F.lit("Disponible").alias("label"), F.col("ok").alias("n")),
        F.struct(F.lit("Rupture").alias("label"), F.col("ko").alias("n")),
    )
    return flags.select(total.alias("t"), F.explode(pair).alias("p")).select(
        "p.label", "p.n", F.round(F.col("p.n") / F.col("t") * 100, 4).alias("pct")
    )


def category_volume(df: DataFrame, k: int = 16) -> DataFrame:
    """Largest categories with their mean price."""
    stats = df.groupBy("categorie").agg(
        F.count("nom").alias("n"), F.round(F.avg("prix"), 4).alias("prix_moyen")
    )
    return stats.where(F.col("categorie").isNotNull()).orderBy(F.desc("n"), "categorie").limit(k)


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed: ``(bin, debut, n)``."""
    b = scalars(df, lo=F.min(value).cast("double"), hi=F.max(value).cast("double"))
    low, high = b["lo"], b["hi"]
    if low is None:
        low = high = 0.0
    width = (high - low) / bins if high > low else 1.0
    place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("debut"), "n")


def score_histogram(df: DataFrame, bins: int = SCORE_BINS) -> DataFrame:
    return histogram(df, F.col("score_composite"), bins)


def price_histogram(df: DataFrame, bins: int = PRICE_BINS) -> DataFrame:
    """Prices clipped at their 95 % quantile."""
    cut = quantiles(df, {"prix": [PRICE_CLIP]})["prix"][PRICE_CLIP]
    return histogram(df, F.least(F.col("prix"), F.lit(cut).cast("double")), bins)


def ranked_products(
    df: DataFrame, k: int = 20, sort: str = "score_composite", categorie: str | None = None
) -> DataFrame:
    """Best k by one of the offered columns."""
    if sort not in SORT_COLUMNS or sort not in df.columns:
        sort = "score_composite"
    return top_k(filter_products(df, categorie=categorie), k, sort)


def formatted(df: DataFrame) -> DataFrame:
    """Detail table as shown: text with units, display headings."""
    text = {
        "prix": F.concat(F.lit("€"), fixed(F.col("prix"), 2)),
        "remise_pct": F.concat(fixed(F.col("remise_pct"), 1), F.lit("%")),
        "score_composite": fixed(F.col("score_composite"), 2),
        "rating": fixed(F.col("rating"), 1),
    }
    shown = [c for c in HEADINGS if c in df.columns]
    return df.select(*[text.get(c, F.col(c)).alias(HEADINGS[c]) for c in shown])


def segment_stats(df: DataFrame) -> DataFrame:
    """Mean price, score and discount per segment."""
    means = [F.round(F.avg(c), 2).alias(c) for c in ("prix", "score_composite", "remise_pct")]
    return df.groupBy("segment").agg(*means)


def fixed_sample(df: DataFrame, n: int, seed: int = 42, key: str = "uid") -> DataFrame:
    """At most n rows, always the same ones for a seed: smallest digests of the key."""
    mark = F.md5(F.concat(F.col(key), F.lit(f"_{seed}")))
    return df.orderBy(mark, key).limit(n)


def scatter_rows(df: DataFrame) -> DataFrame:
    """Rows with both price and rating, and a positive price."""
    return df.dropna(subset=["prix", "rating"]).where(F.col("prix") > 0)


def price_stats(df: DataFrame) -> DataFrame:
    median = quantiles(df, {"prix": [0.5]})["prix"][0.5]
    return df.agg(
        F.min("prix").alias("minimum"), F.round(F.avg("prix"), 4).alias("moyenne"),
        F.max("prix").alias("maximum"),
    ).withColumn("mediane", F.lit(median).cast("double"))


def discount_spread(df: DataFrame, k: int = 7) -> DataFrame:
    """Quartiles of the discount in the k categories with most promotions; no category is gathered in a task."""
    promoted = df.where((F.col("remise_pct") > 0) & F.col("categorie").isNotNull()).select("categorie", "remise_pct")
    largest = promoted.groupBy("categorie").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "categorie").limit(k)
    kept = promoted.join(F.broadcast(largest.select("categorie")), "categorie", "left_semi")
    return grouped_quantiles(kept, "categorie", "remise_pct", [0.25, 0.5, 0.75]).select(
        "categorie", "n", F.round("minimum", 6).alias("minimum"),
        *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("q1", "mediane", "q3"))],
        F.round("maximum", 6).alias("maximum"),
    )


def best_ratio(df: DataFrame, k: int = 10) -> DataFrame:
    """Best quality for the price, formatted."""
    return top_k(df, k, "ratio_qualite_prix").select(
        "uid", "nom", "categorie",
        F.concat(F.lit("€"), fixed(F.col("prix"), 2)).alias("prix"),
        fixed(F.col("rating"), 1).alias("rating"),
        F.concat(fixed(F.col("remise_pct"), 1), F.lit("%")).alias("remise_pct"),
        fixed(F.col("ratio_qualite_prix"), 4).alias("ratio_qualite_prix"),
    )


# Columns shown by the raw-data view unless others are chosen.
DEFAULT_COLUMNS = (
    "nom", "categorie", "source", "prix", "remise_pct", "score_composite", "rating",
    "disponible", "rang",
)


def search_products(
    df: DataFrame, pattern: str | None = None, columns: tuple = DEFAULT_COLUMNS
) -> DataFrame:
    """Rows whose name matches a case-blind pattern; chosen columns that exist."""
    if pattern:
        df = df.where(F.coalesce(F.col("nom").rlike("(?i)" + pattern), F.lit(False)))
    chosen = [c for c in columns if c in df.columns]
    return df.select(*chosen) if chosen else df
