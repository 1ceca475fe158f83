"""Landed payloads: shop pages, store pages, cards; and a dirty text catalogue.

The payloads are written by Spark from the whole catalogue, one page per line with the
shop inside, so that files don't grow in number with the shops, and compressed; the same
readers take real captures, plain or compressed, whose folders may name the shop instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from shelfwise.schemas import CARD, SHOP_PAGE, STORE_PRODUCT
from shelfwise.sources.landing import landed_path, partitions, path_exists, settings
from shelfwise.sources.offers import products

PAGE_SPAN = 250
#: Compression of landed payloads, and the most pages and cards of a file: one task reads a whole
#: compressed file, and of small files only so many as their opening costs allow.
CODEC, FILE_PAGES, FILE_CARDS = "gzip", 2_500, 25_000


def part_number() -> Column:
    return F.col("product_id").cast("long")


def read_shop_pages(spark: SparkSession, path: str) -> DataFrame:
    """``{"products": [...]}`` documents, one per line; the document or the folder names the shop."""
    return spark.read.schema(SHOP_PAGE).json(path)


def read_store_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Top-level arrays of products; each element becomes a row, its shop named in it or by the folder."""
    return spark.read.schema(STORE_PRODUCT).option("multiLine", multi_line).json(path)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).json(path)


def shop_name() -> Column:
    """A shop without a name is null."""
    return F.nullif("shop_url", F.lit("")).alias("shop_url")


def _pages(catalogue: DataFrame, product: Column) -> DataFrame:
    """Products of each shop in pages of at most 250.

    The short catalogue rows are shuffled and sorted, the long products are made behind it.
    """
    rows = catalogue.withColumn("page", F.floor(part_number() / PAGE_SPAN)).repartition("shop_url", "page")
    return rows.groupBy("shop_url", "page").agg(F.collect_list(product).alias("products"))


def shop_payload(catalogue: DataFrame) -> DataFrame:
    """Shop pages of at most 250 products as JSON text, with the shop's name."""
    part = part_number()
    cents = F.format_string("%d.%02d", (part % 500 + 1), part % 100)
    compare = (
        F.when(part % 5 == 0, F.lit(None).cast("string"))
        .when(part % 5 == 1, F.lit(""))
        .when(part % 5 == 2, F.format_string("%d.00", part % 400 + 1))
        .otherwise(F.format_string("%d.50", part % 500 + 40))
    )
    variant = F.struct(
        cents.alias("price"),
        compare.alias("compare_at_price"),
        F.col("disponible").alias("available"),
        F.col("stock").alias("inventory_quantity"),
    )
    product = F.struct(
        part.alias("id"),
        F.concat(F.lit("  "), F.col("nom"), F.lit(" ")).alias("title"),
        F.concat(
            F.lit("<p>"), F.col("nom"), F.lit("</p><ul><li>"), F.col("marque"),
            F.lit("</li></ul> &amp; &eacute;"),
        ).alias("body_html"),
        F.col("categorie").alias("product_type"),
        F.col("marque").alias("vendor"),
        F.when(part % 11 != 0, F.array("marque", F.lit("promo"))).alias("tags"),
        F.when(part % 13 == 0, F.array().cast("array<struct<price:string,compare_at_price:string,available:boolean,inventory_quantity:bigint>>"))
        .otherwise(F.array(variant, variant))
        .alias("variants"),
        F.transform(
            F.sequence(F.lit(1), F.col("nb_images") + 1),
            lambda i: F.struct(F.concat(F.lit("img"), i.cast("string")).alias("src")),
        ).alias("images"),
        F.col("date_creation").alias("created_at"),
        F.col("date_creation").alias("updated_at"),
    )
    pages = _pages(catalogue.where(F.col("source") == "shopify"), product)
    return pages.select(F.to_json(F.struct("products", shop_name())).alias("value"))


def store_payload(catalogue: DataFrame) -> DataFrame:
    """Store pages: JSON arrays of at most 250 products, each with the shop's name."""
    part = part_number()
    regular = F.format_string("%d.00", part % 300 + 20)
    sale = (
        F.when(part % 4 == 0, F.lit(""))
        .when(part % 4 == 1, F.format_string("%d.00", part % 300 + 30))
        .otherwise(F.format_string("%d.25", part % 300 + 5))
    )
    product = F.struct(
        part.alias("id"),
        F.concat(F.col("nom"), F.lit(" ")).alias("name"),
        F.concat(F.lit("<div><b>"), F.col("nom"), F.lit("</b></div>")).alias("description"),
        F.col("marque").alias("short_description"),
        F.when(part % 4 < 2, regular).otherwise(sale).alias("price"),
        regular.alias("regular_price"),
        sale.alias("sale_price"),
        F.format_string("%d.%d", part % 4 + 1, part % 10).alias("average_rating"),
        F.when(part % 9 != 0, F.col("nb_reviews")).alias("rating_count"),
        F.col("disponible").alias("in_stock"),
        F.when(part % 8 != 0, F.col("stock")).alias("stock_quantity"),
        (part % 1000).alias("total_sales"),
        F.format_string("%d.5", part % 7).alias("weight"),
        F.col("date_creation").alias("date_created"),
        F.array(F.struct(F.lit("i").alias("src"))).alias("images"),
        F.array(
            F.struct(F.col("categorie").alias("name")), F.struct(F.col("marque").alias("name"))
        ).alias("categories"),
        F.when(part % 6 != 0, F.array(F.struct(F.lit("promo").alias("name")))).alias("tags"),
        shop_name(),
    )
    pages = _pages(catalogue.where(F.col("source") == "woocommerce"), product)
    return pages.select(F.to_json("products").alias("value"))


# Fixed values of the test capture: price texts as shops print them, and page paths.
PRICE_TEXTS = ("€ %d,%02d", "%d.%02d EUR", "1.%03d,50 €", "n/a", "$%d")
PATHS = ("women/shoes", "running", "kids-bags", "new", "gym/shirt")


def card_payload(catalogue: DataFrame) -> DataFrame:
    """Cards as read off rendered pages, with short names and repeated names."""
    part = part_number()
    kind = part % 5
    price = (
        F.when(kind == 0, F.format_string(PRICE_TEXTS[0], part % 300, part % 100))
        .when(kind == 1, F.format_string(PRICE_TEXTS[1], part % 200, part % 100))
        .when(kind == 2, F.format_string(PRICE_TEXTS[2], part % 1000))
        .when(kind == 3, F.lit(PRICE_TEXTS[3]))
        .otherwise(F.format_string(PRICE_TEXTS[4], part % 90))
    )
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (part % 5 + 1).cast("int"))
    shop = F.lower(F.regexp_replace("shop_url", "[^A-Za-z0-9]", ""))
    return catalogue.where(F.col("source") == "playwright").select(
        F.concat(F.lit("https://www."), shop, F.lit(".example/"), path).alias("url"),
        part.alias("position"),
        F.when(part % 37 == 0, F.lit("ab")).otherwise(F.concat("nom", F.lit(" "), "marque")).alias("nom"),
        price.alias("prix_raw"),
        F.when(part % 3 != 0, F.lit("img.jpg")).otherwise("").alias("image"),
        F.concat(F.lit("/p/"), "product_id").alias("url_produit"),
    )


def dirty_catalogue(catalogue: DataFrame) -> DataFrame:
    """Text-only catalogue with bad numbers, nulls, odd spacing and repeated keys."""
    part = part_number()
    rows = catalogue.select(
        "source", "shop_url", "product_id", "description", "date_creation",
        F.when(part % 37 == 0, F.lit(None).cast("string"))
        .when(part % 31 == 0, F.lit("x"))
        .otherwise(F.concat(F.lit("  "), F.replace("nom", F.lit(" "), F.lit("  l'eau-")), F.lit(" ")))
        .alias("nom"),
        F.when(part % 19 != 0, F.concat(F.lit(" "), F.upper("categorie"))).alias("categorie"),
        F.when(part % 23 == 0, F.lit("n/a"))
        .when(part % 29 == 0, F.lit("-5"))
        .otherwise(F.concat(F.floor("prix").cast("string"), F.lit(".50")))
        .alias("prix"),
        F.when(part % 3 == 0, F.lit("12.5")).alias("remise_pct"),
        F.when(part % 17 != 0, F.round("rating", 1).cast("string")).alias("rating"),
        F.concat(F.col("nb_reviews").cast("string"), F.lit(".7")).alias("nb_reviews"),
        F.when(part % 41 != 0, F.col("stock").cast("string")).otherwise("many").alias("stock"),
        F.element_at(
            F.array(F.lit("TRUE"), F.lit("1"), F.lit("Oui"), F.lit("no")), (part % 4 + 1).cast("int")
        ).alias("disponible"),
        F.lit(0).cast("long").alias("seq"),
    )
    again = rows.where(part % 11 == 0).withColumns({"seq": F.lit(1).cast("long"), "prix": F.lit("1.50")})
    return rows.unionByName(again)


def _compressed(df: DataFrame, lines: int) -> DataFrameWriter:
    return df.write.mode("overwrite").option("compression", CODEC).option("maxRecordsPerFile", lines)


def _landed_text(spark: SparkSession, name: str, inputs: list[str], build) -> str:
    """Folder of landed pages; a task's rows don't grow with the tables, and a page needs no more memory than its products."""
    path = landed_path(spark, name, inputs)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        pages = build()
        sized = {"spark.sql.shuffle.partitions": partitions(spark, inputs)}
        # Aggregates that collect lists sort anyway beyond a few groups; like this they sort once, before the lists are made.
        with settings(spark, {**sized, "spark.sql.execution.useObjectHashAggregateExec": "false"}):
            _compressed(pages, FILE_PAGES).text(path)
    return path


def _inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part", "supplier")]


def land_shop_payload(spark: SparkSession, sf_dir: str) -> str:
    return _landed_text(
        spark, "shop-pages", _inputs(sf_dir), lambda: shop_payload(products(spark, sf_dir))
    )


def land_store_payload(spark: SparkSession, sf_dir: str) -> str:
    return _landed_text(
        spark, "store-pages", _inputs(sf_dir), lambda: store_payload(products(spark, sf_dir))
    )


def land_cards(spark: SparkSession, sf_dir: str) -> str:
    path = landed_path(spark, "cards", _inputs(sf_dir))
    if not path_exists(spark, f"{path}/_SUCCESS"):
        _compressed(card_payload(products(spark, sf_dir)), FILE_CARDS).json(path)
    return path
