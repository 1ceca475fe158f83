"""From landed source records to catalogue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.prices import discount, parse_price, sale_discount, to_number
from shelfwise.functions.text import html_to_text, names_joined, trimmed
from shelfwise.functions.urls import brand_from_url, category_from_url, stable_id
from shelfwise.operators.ranking import first_per_key


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def shop_products(pages: DataFrame) -> DataFrame:
    """One row per product of the shop pages; an empty page gives none."""
    return pages.select("shop_url", F.explode("products").alias("p")).select("shop_url", "p.*")


def flatten_shop(records: DataFrame, allow_negative: bool = True) -> DataFrame:
    """Shop record to catalogue row; price, availability and stock of its first variant."""
    first = F.get("variants", F.lit(0))
    price, compare = to_number(first["price"]), to_number(first["compare_at_price"])
    return records.select(
        F.lit("shopify").alias("source"),
        F.rtrim("shop_url", F.lit("/")).alias("shop_url"),
        _text(F.col("id").cast("string")).alias("product_id"),
        trimmed(F.col("title")).alias("nom"),
        html_to_text(F.col("body_html")).alias("description"),
        trimmed(F.col("product_type")).alias("categorie"),
        trimmed(F.col("vendor")).alias("marque"),
        F.coalesce(F.array_join("tags", ", "), F.lit("")).alias("tags"),
        price.alias("prix"),
        compare.alias("prix_compare"),
        F.coalesce(first["available"], F.lit(False)).alias("disponible"),
        F.coalesce(first["inventory_quantity"], F.lit(0)).cast("long").alias("stock"),
        _text("created_at").alias("date_creation"),
        _text("updated_at").alias("date_update"),
        F.coalesce(F.array_size("images"), F.lit(0)).alias("nb_images"),
        F.coalesce(F.array_size("variants"), F.lit(0)).cast("long").alias("nb_variants"),
        discount(price, compare, allow_negative).alias("remise_pct"),
    )


def flatten_store(records: DataFrame) -> DataFrame:
    """Store record to catalogue row; its numbers arrive as text."""
    regular, sale = to_number(F.col("regular_price")), to_number(F.col("sale_price"))
    return records.select(
        F.lit("woocommerce").alias("source"),
        F.rtrim("shop_url", F.lit("/")).alias("shop_url"),
        _text(F.col("id").cast("string")).alias("product_id"),
        trimmed(F.col("name")).alias("nom"),
        html_to_text(F.col("description")).alias("description"),
        html_to_text(F.col("short_description")).alias("description_courte"),
        names_joined(F.col("categories")).alias("categorie"),
        names_joined(F.col("tags")).alias("tags"),
        to_number(F.col("price")).alias("prix"),
        regular.alias("prix_regular"),
        sale.alias("prix_promo"),
        sale_discount(regular, sale).alias("remise_pct"),
        to_number(F.col("average_rating")).alias("rating"),
        F.coalesce("rating_count", F.lit(0)).cast("long").alias("nb_reviews"),
        F.coalesce("in_stock", F.lit(False)).alias("disponible"),
        F.coalesce("stock_quantity", F.lit(0)).cast("long").alias("stock"),
        F.coalesce("total_sales", F.lit(0)).cast("long").alias("nb_ventes"),
        _text("weight").alias("poids"),
        _text("date_created").alias("date_creation"),
        F.coalesce(F.array_size("images"), F.lit(0)).alias("nb_images"),
    )


def flatten_cards(cards: DataFrame, dedupe: bool = True) -> DataFrame:
    """Card of a rendered page to catalogue row, first of equal names per page kept."""
    kept = cards.where(F.length(F.trim("nom")) > 2)
    rows = kept.select(
        F.lit("playwright").alias("source"),
        F.col("url").alias("shop_url"),
        stable_id(F.col("nom"), F.col("url")).alias("product_id"),
        F.substring(trimmed(F.col("nom")), 1, 200).alias("nom"),
        F.lit("").alias("description"),
        category_from_url(F.col("url")).alias("categorie"),
        brand_from_url(F.col("url")).alias("marque"),
        F.lit("").alias("tags"),
        parse_price(F.col("prix_raw")).alias("prix"),
        F.lit(0.0).alias("prix_compare"),
        F.lit(0.0).alias("remise_pct"),
        F.lit(True).alias("disponible"),
        F.lit(0).cast("long").alias("stock"),
        F.lit(0.0).alias("rating"),
        F.lit(0).cast("long").alias("nb_reviews"),
        F.when(F.length("image") > 0, 1).otherwise(0).alias("nb_images"),
        F.lit(1).cast("long").alias("nb_variants"),
        F.lit("").alias("date_creation"),
        _text("url_produit").alias("url_produit"),
        _text("image").alias("image"),
        "position",
    )
    return unique_cards(rows) if dedupe else rows


def unique_cards(rows: DataFrame) -> DataFrame:
    """First card per page and name start, negative prices dropped first."""
    keyed = rows.where(F.col("prix") >= 0).withColumn(
        "_key", F.substring(F.lower("nom"), 1, 50)
    )
    return first_per_key(keyed, ["shop_url", "_key"], ["position"]).drop("_key")


def union_sources(*tables: DataFrame) -> DataFrame:
    """All sources in one table, aligned by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
