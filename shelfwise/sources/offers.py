"""The catalogue table: one row per offer, a part sold by a supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.schemas import PRODUCTS
from shelfwise.sources.landing import landed

# Names of the three kinds of source.
SOURCES = ("shopify", "woocommerce", "playwright")


def build_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derive the offers from line items, parts and suppliers.

    Line items are read and shuffled once, reduced to offers with map-side partials. The
    offers then lie by part, where a window adds the counts of all offers of a part (at
    most one a supplier) and parts join without another exchange of the offers. Money is
    summed in whole cents, so the order of summation cannot change a result.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    offers = lines.groupBy("l_suppkey", "l_partkey").agg(
        F.count("*").alias("nb"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
        F.count_if(F.col("l_returnflag") == "R").alias("ret"),
        F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("open"),
        F.max("l_shipdate").alias("shipped"),
    )
    of_part = Window.partitionBy("l_partkey")
    offers = offers.withColumns({"n": F.sum("nb").over(of_part), "returned": F.sum("ret").over(of_part)})
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size"
    )
    shops = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name"
    )
    joined = offers.join(parts, "l_partkey").join(shops, "l_suppkey")

    part = F.col("l_partkey")
    source = F.element_at(
        F.array(*[F.lit(s) for s in SOURCES]), (F.col("l_suppkey") % 3 + 1).cast("int")
    )
    price = F.col("cents") / F.lit(100.0) / F.col("qty") / (F.lit(1) + part % 40)
    discount = F.when(
        F.col("disc") > 5 * F.col("nb"), F.col("disc") * F.lit(4.0) / F.col("nb")
    ).otherwise(F.lit(0.0))
    text = (
        F.when(part % 7 == 0, F.lit(None).cast("string"))
        .when(part % 7 == 1, F.col("p_name"))
        .otherwise(F.concat_ws(" - ", "p_name", "p_brand", "p_type", "s_name"))
    )
    rows = joined.select(
        F.col("s_name").alias("shop_url"),
        part.cast("string").alias("product_id"),
        F.concat_ws("_", source, F.col("s_name"), part.cast("string")).alias("uid"),
        F.col("p_name").alias("nom"),
        text.alias("description"),
        F.concat_ws(
            " ", F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))
        ).alias("categorie"),
        F.col("p_brand").alias("marque"),
        F.concat_ws(", ", F.lower("p_type"), F.lower("p_brand")).alias("tags"),
        price.alias("prix"),
        discount.alias("remise_pct"),
        (F.lit(5.0) - F.lit(2.0) * F.col("returned") / F.col("n")).alias("rating"),
        (F.col("n") * 30).alias("nb_reviews"),
        (F.col("open") == 1).alias("disponible"),
        F.col("qty").alias("stock"),
        (F.col("p_size") % 7).cast("int").alias("nb_images"),
        F.col("nb").alias("nb_variants"),
        F.date_format("shipped", "yyyy-MM-dd").alias("date_creation"),
        source.alias("source"),
    )
    return rows.to(PRODUCTS)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed catalogue, partitioned by source."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part", "supplier")]
    return landed(
        spark, "products", inputs, lambda: build_products(spark, sf_dir), ("source",)
    )
