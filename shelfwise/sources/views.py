"""Tables the reports start from, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.features import score_band
from shelfwise.operators.audit import manifest_table
from shelfwise.operators.cluster import CLUSTER_FEATURES
from shelfwise.operators.density import dbscan
from shelfwise.operators.features import build_features
from shelfwise.operators.scoring import composite_score
from shelfwise.operators.target import create_target
from shelfwise.sources.landing import landed
from shelfwise.sources.offers import products

CATALOGUE_INPUTS = ("lineitem", "part", "supplier")


def catalogue_inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{t}.parquet" for t in CATALOGUE_INPUTS]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed feature table."""
    return landed(
        spark, "features", catalogue_inputs(sf_dir),
        lambda: build_features(products(spark, sf_dir)), ("source",),
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed table with label, score, rank and segment."""
    def build() -> DataFrame:
        scored = composite_score(create_target(features(spark, sf_dir)))
        return scored.withColumn("segment", score_band(F.col("score_composite")))

    return landed(spark, "enriched", catalogue_inputs(sf_dir), build, ("source",))


def outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed feature table with density clusters and outliers."""
    return landed(
        spark, "outlined", catalogue_inputs(sf_dir),
        lambda: dbscan(features(spark, sf_dir), CLUSTER_FEATURES), ("source",),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue categories bought per order, as rule input."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws(
            " ", F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))
        ).alias("categorie"),
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    return lines.join(parts, "l_partkey").select("l_orderkey", "categorie")


def audit_shape(events: DataFrame) -> DataFrame:
    """Events read as audit entries."""
    status = (
        F.when(F.col("event_type") == "error", "FAILURE")
        .when(F.col("event_type") == "signup", "DENIED")
        .when(F.col("event_type") == "view", "WARNING")
        .otherwise("SUCCESS")
    )
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("server-"), (F.col("user_id") % 4).cast("string")).alias("server_id"),
        F.col("event_type").alias("tool_name"),
        F.concat(F.lit("call "), "event_type").alias("action"),
        status.alias("status"),
        F.col("value").alias("duration_ms"),
        F.col("props").alias("details"),
        F.when(status == "FAILURE", "failed").otherwise("").alias("error"),
        F.when(F.col("event_type") == "purchase", "write_data").otherwise("read_data").alias("permission"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_shape(spark.read.parquet(f"{sf_dir}/events.parquet"))


def manifests(spark: SparkSession) -> DataFrame:
    """Registered servers of the test log; the fourth is not registered."""
    return manifest_table(
        spark,
        [
            ("server-0", True, ["read_data", "write_data"]),
            ("server-1", True, ["read_data"]),
            ("server-2", False, ["read_data"]),
        ],
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per category, one on low prices, one on nothing known."""
    cats = products(spark, sf_dir).select("categorie").distinct()
    kinds = F.explode(
        F.array(
            F.concat(F.lit("Quelles promo sur "), F.initcap("categorie"), F.lit(" ?")),
            F.concat(F.lit("Un "), "categorie", F.lit(" avec un petit budget")),
            F.concat(F.lit("Bonjour "), F.substring("categorie", 1, 4)),
        )
    )
    asked = cats.select(kinds.alias("question"))
    return asked.select(F.md5("question").alias("qid"), "question")


def stream_shape(events: DataFrame) -> DataFrame:
    """Audit entries of a stream; event time needs a zoned type, read as UTC in any session."""
    utc = F.concat(F.col("timestamp").cast("string"), F.lit("+00:00")).cast("timestamp")
    return audit_shape(events).withColumn("timestamp", utc)


def utc_day(moment: Column) -> Column:
    """Day of a zoned time in UTC, as text."""
    days = F.floor(F.unix_seconds(moment) / 86_400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
