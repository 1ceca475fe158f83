"""Explicit schemas at every boundary, and the rule for missing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


S, D, L, I, B = StringType(), DoubleType(), LongType(), IntegerType(), BooleanType()

PRODUCTS = _struct(
    shop_url=S, product_id=S, uid=S, nom=S, description=S, categorie=S, marque=S, tags=S,
    prix=D, remise_pct=D, rating=D, nb_reviews=L, disponible=B, stock=L,
    nb_images=I, nb_variants=L, date_creation=S, source=S,
)

# Columns a normalised catalogue must always have.
REQUIRED = (
    "source", "shop_url", "product_id", "nom", "description", "categorie", "prix",
    "remise_pct", "rating", "nb_reviews", "disponible", "stock", "date_creation",
)

SHOP_PRODUCT = _struct(
    id=L, title=S, body_html=S, product_type=S, vendor=S, tags=ArrayType(S),
    variants=ArrayType(_struct(price=S, compare_at_price=S, available=B, inventory_quantity=L)),
    images=ArrayType(_struct(src=S)), created_at=S, updated_at=S,
)
SHOP_PAGE = _struct(products=ArrayType(SHOP_PRODUCT), shop_url=S)

STORE_PRODUCT = _struct(
    id=L, name=S, description=S, short_description=S, price=S, regular_price=S, sale_price=S,
    average_rating=S, rating_count=L, in_stock=B, stock_quantity=L, total_sales=L, weight=S,
    date_created=S, images=ArrayType(_struct(src=S)), categories=ArrayType(_struct(name=S)),
    tags=ArrayType(_struct(name=S)), shop_url=S,
)

CARD = _struct(url=S, position=L, nom=S, prix_raw=S, image=S, url_produit=S)

AUDIT = _struct(
    timestamp=S, server_id=S, tool_name=S, action=S, status=S, duration_ms=D, details=S, error=S,
)


def ensure_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add each named column with its default where ``df`` lacks it."""
    missing = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def required_columns(df: DataFrame) -> DataFrame:
    """Guarantee the thirteen catalogue columns, null where absent."""
    return ensure_columns(df, {name: F.lit(None).cast("string") for name in REQUIRED})
