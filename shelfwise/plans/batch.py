"""The two whole batch jobs, over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import classify, cluster, density, evaluate, rules, scoring, target
from shelfwise.operators.features import build_features, build_features_container
from shelfwise.operators.ranking import top_k
from shelfwise.session import work_dir
from shelfwise.sources.landing import Steps, code_version, fingerprint
from shelfwise.sources.offers import products
from shelfwise.sources.views import catalogue_inputs


def run_batch(
    catalogue: DataFrame,
    out: str,
    k: int = 20,
    settings: classify.ModelSettings = classify.ModelSettings(),
    restarts: int = cluster.RESTARTS,
    cv: bool = True,
    version: str | None = None,
) -> dict[str, DataFrame]:
    """Features, segments, outliers, projection, models, rules, score and Top-K.

    Each long step is written to the output folder and read back, so that no step
    repeats the ones before it and a lost executor costs one step at most. With a
    ``version`` of the catalogue, a job that is started again on the same folder reads
    the steps that an earlier one finished, their metrics included; other settings or
    another version start anew.
    """
    step = Steps(catalogue.sparkSession, out, _version(version, "batch", k, settings, restarts, cv))
    by_source = ("source",)

    def segment() -> tuple[DataFrame, dict]:
        table, silhouette = cluster.run_kmeans(features, 4, restarts)
        return table, {"clusters": {"silhouette": float(silhouette)}}

    def project() -> tuple[DataFrame, dict]:
        table, explained = cluster.project(outlined)
        return table.select("uid", "PC1", "PC2", "segment"), {"projection": {"explained": explained}}

    def model() -> tuple[DataFrame, dict]:
        measured, table, _ = classify.train_and_evaluate(outlined, settings, cv=cv)
        return table, measured

    features, _ = step("features", lambda: build_features(catalogue), by_source)
    segmented, clusters = step("segmented", segment, by_source)
    outlined, _ = step("outlined", lambda: density.dbscan(segmented, cluster.CLUSTER_FEATURES), by_source)
    _, projection = step("projection", project)
    scored, models = step("modelled", model, by_source)
    found, _ = step("rules", lambda: rules.association_rules(catalogue))
    ranked, _ = step("scored", lambda: scoring.composite_score(scored), by_source)
    best, _ = step("top_k", lambda: top_k(ranked, k, "score_composite"))
    results = {**models, **clusters, **projection}
    metrics, _ = step("metrics", lambda: classify.metrics_table(catalogue.sparkSession, results))
    return {"scored": ranked, "top_k": best, "rules": found, "metrics": metrics}


def run_container_batch(
    catalogue: DataFrame,
    out: str,
    k: int = 20,
    settings: classify.ModelSettings = classify.ModelSettings(),
    restarts: int = cluster.RESTARTS,
    version: str | None = None,
) -> dict[str, DataFrame]:
    """The container job: its own features, label, boosted trees, score and Top-K.

    Steps are kept and reused as those of :func:`run_batch`.
    """
    step = Steps(catalogue.sparkSession, out, _version(version, "container", k, settings, restarts))
    by_source = ("source",)

    def score() -> tuple[DataFrame, dict]:
        table, accuracy, f1 = classify.container_probability(labelled, settings)
        return scoring.container_score(table), {"accuracy": accuracy, "f1": f1}

    features, _ = step("features", lambda: build_features_container(catalogue), by_source)
    labelled, _ = step(
        "labelled", lambda: target.container_target(cluster.container_kmeans(features, 4, restarts)), by_source
    )
    ranked, fit = step("scored", score, by_source)
    best, _ = step("top_k", lambda: top_k(ranked, k, "score_composite"))
    metrics, _ = step("metrics", lambda: evaluate.run_metrics(ranked, fit["accuracy"], fit["f1"]))
    return {"scored": ranked, "top_k": best, "metrics": metrics}


def _version(version: str | None, *settings) -> str | None:
    return version and f"{version}|{code_version()}|{settings!r}"


def registered_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job on the whole catalogue; counts per output."""
    version, out = _place(spark, sf_dir, "batch")
    return _counts(run_batch(products(spark, sf_dir), out, version=version))


def registered_container_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container job on the whole catalogue; counts per output."""
    version, out = _place(spark, sf_dir, "container")
    return _counts(run_container_batch(products(spark, sf_dir), out, version=version))


def _place(spark: SparkSession, sf_dir: str, job: str) -> tuple[str, str]:
    """Version of the inputs, and the job's folder: the same for a restart by another application."""
    version = fingerprint(spark, catalogue_inputs(sf_dir))
    return version, f"{work_dir(spark)}/shelfwise/{job}-{version}"


def _counts(made: dict[str, DataFrame]) -> DataFrame:
    counts = [
        made[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n") for name in made
    ]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total
