"""Normalise collected rows into the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.prices import to_count, to_number, to_truth
from shelfwise.functions.text import clean_name
from shelfwise.operators.ranking import first_per_key
from shelfwise.schemas import required_columns


def clean_columns(df: DataFrame) -> DataFrame:
    """Names, categories, numbers and availability in their final form."""
    return df.withColumns(
        {
            "nom": clean_name(F.col("nom")),
            "categorie": F.trim(F.lower(F.coalesce("categorie", F.lit("inconnu")))),
            "prix": to_number(F.col("prix")),
            "remise_pct": to_number(F.col("remise_pct")),
            "rating": to_number(F.col("rating")),
            "nb_reviews": to_count(F.col("nb_reviews")),
            "stock": to_count(F.col("stock")),
            "disponible": to_truth(F.col("disponible")),
        }
    )


def unique_products(df: DataFrame, order: str = "seq") -> DataFrame:
    """First row per shop and product; the quality filter comes after, as its own step."""
    return first_per_key(df, ["shop_url", "product_id"], [order])


def quality_filter(df: DataFrame) -> DataFrame:
    """Names longer than two characters and no negative price; a null name is dropped."""
    return df.where((F.length("nom") > 2) & (F.col("prix") >= 0))


def normalise_products(df: DataFrame, order: str = "seq") -> DataFrame:
    """Required columns, cleaning, first-kept duplicates, quality filter, global key.

    The only shuffle is the one for duplicates.
    """
    rows = clean_columns(required_columns(df))
    rows = quality_filter(unique_products(rows, order))
    return rows.withColumn(
        "uid", F.concat("source", F.lit("_"), F.col("product_id").cast("string"))
    )


def source_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n"))
