"""Facts read off a page address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords looked up in this order, the first hit decides.
CATEGORY_KEYWORDS = (
    ("shoe", "Chaussures"), ("sneaker", "Chaussures"), ("running", "Running"),
    ("men", "Homme"), ("women", "Femme"), ("kids", "Enfants"), ("jacket", "Vestes"),
    ("shirt", "Hauts"), ("pant", "Bas"), ("sport", "Sport"), ("fitness", "Fitness"),
    ("gym", "Gym"), ("dress", "Robes"), ("bag", "Sacs"), ("watch", "Montres"),
)
DEFAULT_CATEGORY = "Mode"


def category_from_url(url: Column) -> Column:
    address = F.lower(url)
    choice = F.when(F.lit(False), F.lit(DEFAULT_CATEGORY))
    for keyword, label in CATEGORY_KEYWORDS:
        choice = choice.when(F.contains(address, F.lit(keyword)), label)
    return choice.otherwise(DEFAULT_CATEGORY)


def brand_from_url(url: Column) -> Column:
    """First label of the host, capitalised."""
    host = F.split_part(F.regexp_replace(url, r"https?://(www\.)?", ""), F.lit("/"), F.lit(1))
    label = F.split_part(host, F.lit("."), F.lit(1))
    return F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substr(label, F.lit(2))))


def stable_id(name: Column, url: Column) -> Column:
    """First twelve hex digits of the digest of address and name."""
    return F.substring(F.md5(F.concat(url, F.lit("_"), name)), 1, 12)
