"""Synthetic catalogues, made by Spark from row numbers and seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories and their subcategories.
SUBCATEGORIES = {
    "Electronics": ("Smartphones", "Laptops", "Audio", "Wearables"),
    "Sport": ("Fitness", "Outdoor", "Team Sports", "Yoga"),
    "Home": ("Kitchen", "Furniture", "Lighting", "Decor"),
    "Fashion": ("Men", "Women", "Kids", "Accessories"),
    "Beauty": ("Skincare", "Makeup", "Hair", "Fragrance"),
    "Books": ("Fiction", "Non-Fiction", "Education", "Comics"),
    "Toys": ("Action Figures", "Puzzles", "Educational", "Outdoor"),
    "Automotive": ("Parts", "Accessories", "Tools", "Electronics"),
}
# Price log-normal around 40, rating around 4.2, reviews log-normal.
PRICE_MEDIAN, PRICE_SIGMA = 40.0, 0.8
RATING_MEAN, RATING_SIGMA = 4.2, 0.6
REVIEWS_MU, REVIEWS_SIGMA = 5.0, 1.2
DELIVERY_DAYS = (1, 2, 3, 5, 7)
# Our own words for names, companies and countries.
WORDS = ("nova", "terra", "lumen", "atlas", "prisme", "delta", "orion", "zenith", "cobalt", "sierra")
COUNTRIES = ("France", "Belgique", "Suisse", "Canada", "Maroc", "Tunisie")
# Fixed values of the small demonstration catalogue.
DEMO_CATEGORIES = ("Footwear", "Apparel", "Accessories", "Socks", "Care", "Kids")
DEMO_SHOPS = ("prisme.example", "delta.example")
DEMO_BRANDS = ("BrandA", "BrandB", "BrandC")
DEMO_DISCOUNTS = (0.0, 0.0, 0.0, 10.0, 15.0, 20.0, 25.0, 30.0, 40.0)


class _Draws:
    """Numbered random draws of a row; each has its own seed."""

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def uniform(self, low: float = 0.0, high: float = 1.0) -> Column:
        self.seed += 1
        return F.rand(self.seed) * (high - low) + low

    def normal(self, mean: float, sigma: float) -> Column:
        self.seed += 1
        return F.randn(self.seed) * sigma + mean

    def integer(self, low: int, high: int) -> Column:
        """Whole number, both ends included."""
        return F.floor(self.uniform(low, high + 1)).cast("long")

    def pick(self, values: tuple) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.integer(1, len(values)).cast("int"))


def extended_catalogue(spark: SparkSession, n: int = 5000, seed: int = 42) -> DataFrame:
    """Large synthetic catalogue; any number of rows, generated where they are used."""
    draw = _Draws(seed)
    rows = spark.range(1, n + 1).withColumnsRenamed({"id": "product_id"})
    rows = rows.withColumns(
        {
            "category": draw.pick(tuple(SUBCATEGORIES)),
            "price": F.round(F.exp(draw.normal(math.log(PRICE_MEDIAN), PRICE_SIGMA)), 2),
            "promo": draw.uniform() < 0.5,
            "cut": draw.uniform(0.5, 0.9),
            "at": draw.integer(1, 4).cast("int"),
        }
    )
    sub = F.when(F.lit(False), "")
    for category, names in SUBCATEGORIES.items():
        sub = sub.when(
            F.col("category") == category, F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at"))
        )
    rows = rows.withColumns(
        {
            "subcategory": sub,
            "price_promo": F.when(F.col("promo"), F.round(F.col("price") * F.col("cut"), 2)).otherwise(F.col("price")),
        }
    )
    rating = F.least(F.greatest(draw.normal(RATING_MEAN, RATING_SIGMA), F.lit(1.0)), F.lit(5.0))
    return rows.select(
        "product_id",
        F.concat_ws(" ", draw.pick(WORDS), draw.pick(WORDS)).alias("name"),
        F.concat_ws(" ", *[draw.pick(WORDS) for _ in range(12)]).alias("description"),
        "category", "subcategory",
        F.initcap(draw.pick(WORDS)).alias("brand"),
        "price", "price_promo",
        F.round(F.coalesce(F.try_divide(F.col("price") - F.col("price_promo"), "price"), F.lit(0.0)) * 100, 1).alias("discount_pct"),
        F.lit("EUR").alias("currency"),
        F.round(rating, 1).alias("rating"),
        F.floor(F.exp(draw.normal(REVIEWS_MU, REVIEWS_SIGMA))).cast("long").alias("reviews"),
        draw.integer(0, 500).alias("stock"),
        draw.pick(DELIVERY_DAYS).alias("delivery_days"),
        F.initcap(draw.pick(WORDS)).alias("shop"),
        draw.pick(COUNTRIES).alias("country"),
        F.concat(F.lit("https://shop.example/p/"), F.col("product_id").cast("string")).alias("product_url"),
        F.date_add(F.lit("2026-01-01").cast("date"), draw.integer(0, 300).cast("int")).cast("timestamp").alias("date_scraped"),
    )


def demo_catalogue(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    """Small catalogue shown when nothing is stored yet."""
    draw = _Draws(seed)
    number = F.col("id").cast("string")
    return spark.range(n).select(
        F.lit("shopify").alias("source"),
        draw.pick(DEMO_SHOPS).alias("shop_url"),
        number.alias("product_id"),
        F.concat(F.lit("Produit Demo "), number).alias("nom"),
        F.lit("Description exemple").alias("description"),
        draw.pick(DEMO_CATEGORIES).alias("categorie"),
        draw.pick(DEMO_BRANDS).alias("marque"),
        F.round(draw.uniform(15, 300), 2).alias("prix"),
        draw.pick(DEMO_DISCOUNTS).alias("remise_pct"),
        F.round(draw.uniform(3.5, 5.0), 1).alias("rating"),
        draw.integer(0, 1999).alias("nb_reviews"),
        draw.integer(0, 149).alias("stock"),
        (draw.uniform() < 0.8).alias("disponible"),
        draw.integer(1, 7).alias("nb_images"),
        draw.integer(1, 4).alias("nb_variants"),
        F.concat(F.lit("shopify_"), number).alias("uid"),
    )
