"""From the catalogue table to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import features as fx
from shelfwise.operators.encode import label_encode
from shelfwise.operators.quantiles import quantiles, scalars

# Columns imputed by their median, in order.
IMPUTED = (
    "prix", "remise_pct", "rating", "nb_reviews", "stock", "ratio_qualite_prix",
    "score_popularite",
)
# Columns scaled to 0..1; the container job scales all but the last.
SCALED = (
    "prix", "rating", "nb_reviews", "stock", "remise_pct", "ratio_qualite_prix",
    "score_popularite",
)
SCALED_CONTAINER = SCALED[:-1]


def derive(df: DataFrame, bands: bool = True) -> DataFrame:
    """Ratio, popularity, promotion flag and price band."""
    columns = {
        "ratio_qualite_prix": fx.quality_price_ratio(F.col("rating"), F.col("prix")),
        "score_popularite": fx.popularity(
            F.col("rating"), F.col("nb_reviews"), F.col("disponible")
        ),
        "en_promo": fx.on_promo(F.col("remise_pct")),
    }
    if bands:
        columns["segment_prix"] = fx.price_band(F.col("prix"))
    return df.withColumns(columns)


def impute_and_scale(
    df: DataFrame, imputed: tuple = IMPUTED, scaled: tuple = SCALED
) -> DataFrame:
    """Median for nulls, then min-max into ``*_norm``.

    A median lies between the column's minimum and maximum, so one aggregate gives
    the bounds for both steps; medians are only computed for columns with nulls.
    """
    aggs = {"rows": F.count("*")}
    for c in dict.fromkeys(imputed + scaled):
        aggs[f"n_{c}"] = F.count(c)
        aggs[f"lo_{c}"] = F.min(c).cast("double")
        aggs[f"hi_{c}"] = F.max(c).cast("double")
    stats = scalars(df, **aggs)
    holed = [c for c in imputed if stats[f"n_{c}"] < stats["rows"]]
    medians = quantiles(df, {c: [0.5] for c in holed}) if holed else {}
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c][0.5]))
        if c in medians and medians[c][0.5] is not None
        else F.col(c).cast("double")
        for c in imputed
    }
    df = df.withColumns(filled)
    return df.withColumns(
        {f"{c}_norm": fx.min_max(F.col(c), stats[f"lo_{c}"], stats[f"hi_{c}"]) for c in scaled}
    )


def build_features(df: DataFrame) -> DataFrame:
    """Readable catalogue in, table for the models out."""
    table = impute_and_scale(derive(df))
    return label_encode(label_encode(table, "categorie", "categorie_enc"), "source", "source_enc")


def build_features_container(df: DataFrame) -> DataFrame:
    """The container job's shorter variant: no price band, six scaled columns."""
    table = impute_and_scale(derive(df, bands=False), scaled=SCALED_CONTAINER)
    return label_encode(label_encode(table, "categorie", "categorie_enc"), "source", "source_enc")
