"""Readers and sinks for catalogue tables and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.schemas import AUDIT
from shelfwise.sources.landing import path_exists

#: Rows of a CSV part file. Records over several lines can't be split, so a file is one task's reading.
CSV_ROWS = 250_000


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Catalogue CSV: header, quotes doubled, records over several lines, mark at the start.

    Such files cannot be split; land them as Parquet once and work from that.
    """
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True)
    return reader.option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files of bounded rows with a header, readable by ``read_csv``."""
    writer = df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", CSV_ROWS)
    writer.option("escape", '"').option("quoteAll", True).csv(path)


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace a named table."""
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit lines; blank and malformed ones are skipped, details stay JSON text."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)


def append_audit(entries: DataFrame, path: str) -> None:
    """Append a batch of entries, one JSON document per line, details as an object."""
    fields = ("timestamp", "server_id", "tool_name", "action", "status", "duration_ms", "error")
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    line = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"details":'), "details", F.lit("}"))
    entries.select(line.alias("value")).write.mode("append").text(path)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """First path that exists, in the given order."""
    return next((p for p in paths if path_exists(spark, p)), None)


def load_catalogue(spark: SparkSession, paths: list[str], fallback) -> DataFrame:
    """First stored table that exists, else the fallback table."""
    path = first_existing(spark, paths)
    return spark.read.parquet(path) if path else fallback()
