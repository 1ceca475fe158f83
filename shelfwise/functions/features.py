"""Derived product columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price bands, upper edges included.
PRICE_BANDS = ((20.0, "très_bas"), (50.0, "bas"), (100.0, "moyen"), (200.0, "élevé"))
TOP_PRICE_BAND = "premium"
# Score bands, upper edges included.
SCORE_BANDS = (
    (30.0, "Entrée gamme"), (50.0, "Standard"), (70.0, "Bestseller"), (100.0, "Premium"),
)
# Fixed value: small term that keeps a division defined.
EPS = 1e-9


def quality_price_ratio(rating: Column, price: Column) -> Column:
    """Rating per log price; 0 without a positive price, null without a rating."""
    return F.when(price > 0, rating / F.log1p(price)).otherwise(F.lit(0.0))


def popularity(rating: Column, reviews: Column, available: Column) -> Column:
    return rating * 0.4 + F.log1p(reviews) * 0.4 + available.cast("int") * 0.2


def on_promo(discount: Column) -> Column:
    return F.coalesce((discount > 0).cast("int"), F.lit(0))


def price_band(price: Column) -> Column:
    """Right-closed bands over positive prices; 0 and below belong to none."""
    band = F.when(price <= 0, F.lit(None).cast("string"))
    for edge, label in PRICE_BANDS:
        band = band.when(price <= edge, label)
    return band.when(price.isNotNull(), TOP_PRICE_BAND)


def price_band_order(band: Column) -> Column:
    """Ordinal of a price band, for ordering."""
    labels = [label for _, label in PRICE_BANDS] + [TOP_PRICE_BAND]
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), band) - 1
    return F.when(at >= 0, at.cast("int"))


def score_band(score: Column) -> Column:
    """Right-closed bands with the lowest edge included; outside is the text ``nan``."""
    band = F.when(score < 0, "nan")
    for edge, label in SCORE_BANDS:
        band = band.when(score <= edge, label)
    return band.otherwise("nan")


def min_max(value: Column, low: float | None, high: float | None) -> Column:
    """(x - min) / (max - min); a constant column gives 0."""
    if low is None or low == high:
        return F.when(value.isNotNull(), F.lit(0.0))
    return (value - F.lit(float(low))) / F.lit(float(high) - float(low))


def min_max_eps(value: Column, low: float, high: float) -> Column:
    """Min-max with a small term in the divisor instead of a constant-column rule."""
    return (value - F.lit(float(low))) / F.lit(float(high) - float(low) + EPS)
