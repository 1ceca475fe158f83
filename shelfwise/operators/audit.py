"""Audit log and permission checks as batch queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Refusal reasons, by precedence.
NOT_REGISTERED = "Serveur non enregistré"
NOT_APPROVED = "Serveur non approuvé"
NOT_DECLARED = "Permission '%s' non déclarée dans le manifeste"


def audit_entries(df: DataFrame) -> DataFrame:
    """Entries ready to append: duration with two decimals, empty details and error filled."""
    return df.select(
        "timestamp", "server_id", "tool_name", "action", "status",
        F.round(F.coalesce("duration_ms", F.lit(0.0)), 2).alias("duration_ms"),
        F.coalesce("details", F.lit("{}")).alias("details"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def log_stats(log: DataFrame) -> DataFrame:
    """Counts in total, by status and by server, and mean durations, in one pass."""
    grouped = log.groupingSets(
        [[], [F.col("status")], [F.col("server_id")]], F.col("status"), F.col("server_id")
    ).agg(
        F.grouping_id().alias("g"),
        F.count("*").alias("n"),
        F.round(F.avg("duration_ms"), 2).alias("avg_duration_ms"),
    )
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "status").otherwise("server")
    return grouped.select(
        level.alias("level"), F.coalesce("status", "server_id", F.lit("")).alias("value"),
        "n", "avg_duration_ms",
    )


def recent(log: DataFrame, n: int = 20, tie: str = "event_id") -> DataFrame:
    """Newest entries first."""
    return log.orderBy(F.desc("timestamp"), F.desc(tie)).limit(n)


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))


def check_permissions(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Attach ``reason`` to each request: null when allowed.

    ``manifests`` holds ``(server_id, approved, permissions)``; a server missing there
    is not registered.
    """
    known = manifests.select("server_id", "approved", "permissions")
    reason = (
        F.when(F.col("approved").isNull(), NOT_REGISTERED)
        .when(~F.col("approved"), NOT_APPROVED)
        .when(
            ~F.array_contains("permissions", F.col("permission")),
            F.format_string(NOT_DECLARED, "permission"),
        )
    )
    joined = requests.join(known, "server_id", "left")
    return joined.withColumn("reason", reason).drop("approved", "permissions")


def denied(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    return check_permissions(requests, manifests).where(F.col("reason").isNotNull())


def policy_summary(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Registered and approved servers, and refusals."""
    servers = manifests.agg(
        F.count("*").alias("r"), F.count_if(F.coalesce("approved", F.lit(False))).alias("a")
    ).first()
    refused = check_permissions(requests, manifests).agg(
        F.count_if(F.col("reason").isNotNull()).alias("total_denials")
    )
    return refused.select(
        F.lit(servers["r"]).cast("long").alias("servers_registered"),
        F.lit(servers["a"]).cast("long").alias("servers_approved"),
        "total_denials",
    )


def manifest_table(spark, servers: list[tuple[str, bool, list[str]]]) -> DataFrame:
    """Registered servers as a table Spark knows to be small."""
    def entry(server: str, approved: bool, permissions: list[str]) -> Column:
        granted = F.array(*[F.lit(p) for p in permissions]).cast("array<string>")
        return F.struct(
            F.lit(server).alias("server_id"), F.lit(approved).alias("approved"),
            granted.alias("permissions"),
        )

    return spark.range(1).select(F.inline(F.array(*[entry(*s) for s in servers])))
