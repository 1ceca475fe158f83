"""Price text, discounts and number coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(value: Column) -> Column:
    """Number or 0; never fails. A Java type suffix (``5d``) is not a number here."""
    text = F.trim(value.cast("string"))
    number = F.when(~text.rlike(r"[dDfF]$"), text.try_cast("double"))
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def to_count(value: Column) -> Column:
    """Whole number cut towards zero, or 0."""
    return F.coalesce(to_number(value).try_cast("long"), F.lit(0).cast("long"))


# Texts that mean yes.
TRUE_TEXTS = ("true", "1", "yes", "oui")


def to_truth(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin(*TRUE_TEXTS), F.lit(False))


def discount(price: Column, compare: Column, allow_negative: bool = True) -> Column:
    """Percent below the compare price, one decimal, 0 unless both prices are positive.

    With ``allow_negative`` a price above the compare price gives a negative percent;
    without it such rows give 0.
    """
    valid = (compare > 0) & (price > 0) if allow_negative else (compare > price) & (price > 0)
    percent = (F.lit(1.0) - price / F.nullif(compare, F.lit(0.0))) * 100
    return F.when(valid, F.round(percent, 1)).otherwise(F.lit(0.0))


def sale_discount(regular: Column, sale: Column) -> Column:
    """Percent of a real sale: both prices positive, the sale below the regular price."""
    percent = (F.lit(1.0) - sale / F.nullif(regular, F.lit(0.0))) * 100
    valid = (regular > 0) & (sale > 0) & (sale < regular)
    return F.when(valid, F.round(percent, 1)).otherwise(F.lit(0.0))


def parse_price(raw: Column) -> Column:
    """Price shown on a card: digits, commas and dots kept, the last dot is the decimal one."""
    kept = F.replace(F.regexp_replace(raw, r"[^0-9.,]", ""), F.lit(","), F.lit("."))
    pieces = F.split(kept, r"\.")
    whole = F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(1))), "")
    single = F.when(
        F.size(pieces) > 2, F.concat(whole, F.lit("."), F.element_at(pieces, -1))
    ).otherwise(kept)
    return F.coalesce(F.round(single.try_cast("double"), 2), F.lit(0.0))
