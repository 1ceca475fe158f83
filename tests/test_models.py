"""Clusters, outliers, models and the stream: properties and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import classify, cluster, density, evaluate
from shelfwise.operators.features import build_features
from shelfwise.plans import batch
from shelfwise.sources import generators, views
from shelfwise.streaming import audit_counts
from shelfwise.streaming.audit_counts import run_audit_counts

LIGHT = classify.ModelSettings(forest_trees=10, boost_rounds=5, folds=2)


def brute_force(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    current = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if label[j] >= 0:
                continue
            label[j] = current
            stack += [k for k in np.flatnonzero(near[j] & core) if label[k] < 0]
        current += 1
    touched = [set(label[near[i] & core]) for i in range(len(x))]
    return core, label, touched


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("open_limit", [20_000_000, 200, 1])
@pytest.mark.parametrize("dims", [2, 6])
def test_dbscan_equals_brute_force(spark, dims, open_limit):
    rng = np.random.default_rng(dims)
    centres = rng.uniform(0, 1, (4, dims))
    x = np.concatenate(
        [c + rng.normal(0, 0.04, (60, dims)) for c in centres]
        + [rng.uniform(-0.2, 1.2, (40, dims)), np.repeat(rng.uniform(0, 1, (2, dims)), 10, axis=0)]
    )
    names = tuple(f"f{i}" for i in range(dims))
    df = spark.createDataFrame(
        [(f"u{i}", *map(float, row)) for i, row in enumerate(x)], ["uid", *names]
    )
    rows = density.dbscan(df, names, 0.15, 5, open_limit=open_limit).collect()
    got = {r["uid"]: r["cluster_dbscan"] for r in rows}
    labels = np.array([got[f"u{i}"] for i in range(len(x))])
    core, expected, touched = brute_force(x, 0.15, 5)
    assert same_partition(labels[core].tolist(), expected[core].tolist())
    to_ours = dict(zip(expected[core].tolist(), labels[core].tolist()))
    for i in np.flatnonzero(~core):
        assert labels[i] == min((to_ours[t] for t in touched[i]), default=-1)
    assert all(r["is_anomalie"] == int(r["cluster_dbscan"] == -1) for r in rows)


def test_dbscan_on_a_hot_vector(spark):
    """A third of all rows at one place, a bridge and two outliers."""
    rows = [(f"h{i}", 0.0, 0.0) for i in range(500)] + [(f"b{i}", 0.1 * i, 0.0) for i in range(1, 9)]
    rows += [(f"c{i}", 3.0 + i / 1000, 0.0) for i in range(400)] + [("o1", 9.0, 9.0), ("o2", 5.0, 0.0)]
    df = spark.createDataFrame(rows, "uid string, x double, y double")
    got = {r["uid"]: r["cluster_dbscan"] for r in density.dbscan(df, ("x", "y"), 0.15, 3, open_limit=50).collect()}
    assert got["h0"] == got["h499"] == got["b1"] == got["b7"] == got["b8"]
    assert got["c0"] == got["c399"] != got["h0"]
    assert got["o1"] == got["o2"] == -1


@pytest.mark.parametrize("partitions", ["1", "3"])
def test_dbscan_whatever_the_partitions(spark, small, partitions):
    table = views.features(spark, small)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        counts = density.outlier_counts(density.dbscan(table, cluster.CLUSTER_FEATURES)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counts["n_outliers"] == 105  # brute force on this table


def test_kmeans_and_projection(spark, small):
    table = views.features(spark, small)
    labelled, value = cluster.run_kmeans(table, 4, restarts=2)
    assert -1 <= value <= 1
    assert labelled.count() == table.count()
    assert labelled.agg(F.countDistinct("cluster_kmeans")).first()[0] <= 4
    assert labelled.where("segment IS NULL").count() == 0
    coords, explained = cluster.project(table)
    means = coords.agg(F.avg("PC1"), F.avg("PC2")).first()
    assert abs(means[0]) < 1e-9 and abs(means[1]) < 1e-9
    x = np.array(table.select(*cluster.CLUSTER_FEATURES).collect(), dtype=float)
    singular = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert explained == pytest.approx(singular[:2].sum() / singular.sum())


def test_k_range():
    assert list(cluster.k_range(25)) == [2, 3]
    assert list(cluster.k_range(1000)) == [2, 3, 4, 5, 6, 7, 8, 9]


def test_models(spark, small):
    table = views.features(spark, small)
    results, scored, models = classify.train_and_evaluate(table, LIGHT)
    share = 0.7 * 0.7 * 2 / 1.7  # weighted F1 of always naming the majority
    for name in ("random_forest", "xgboost"):
        assert share < results[name]["f1"] <= 1
        assert 0 <= results[name]["cv_mean"] <= 1 and results[name]["cv_std"] >= 0
    row = scored.agg(
        F.min("proba_consensus"), F.max("proba_consensus"),
        F.max(F.abs(F.col("proba_consensus") - (F.col("proba_top_xgb") + F.col("proba_top_rf")) / 2)), F.count("*"),
    ).first()
    assert 0 <= row[0] <= row[1] <= 1 and row[2] < 1e-12 and row[3] == table.count()
    assert classify.importance(models["xgboost"]).count() == 8


def test_models_on_a_bare_table(spark):
    """Missing columns count as 0, a table without key and without rows."""
    df = generators.demo_catalogue(spark).select("prix", "rating", "nb_reviews", "remise_pct", "categorie")
    results, scored, _ = classify.train_and_evaluate(df, LIGHT, cv=False)
    assert scored.count() == 200 and 0 <= results["xgboost"]["accuracy"] <= 1
    with pytest.raises(ValueError):
        classify.train_and_evaluate(df.limit(0), LIGHT)


def test_batch_jobs(spark, tmp_path):
    catalogue = generators.demo_catalogue(spark, 300)
    made = batch.run_batch(catalogue, str(tmp_path / "a"), 10, LIGHT, restarts=1, cv=False)
    assert made["scored"].count() == 300 and made["top_k"].count() == 10
    scores = [r["score_composite"] for r in made["top_k"].orderBy("rang", "uid").collect()]
    assert scores == sorted(scores, reverse=True) and 0 <= scores[-1] <= scores[0] <= 100
    other = batch.run_container_batch(catalogue, str(tmp_path / "b"), 10, LIGHT, restarts=1)
    metrics = {r["metric"]: r["value"] for r in other["metrics"].collect()}
    assert metrics["nb_products"] == 300 and metrics["nb_top_products"] >= 90


def test_registered_batch_computes_fold_scores(spark, small, monkeypatch):
    asked, run = {}, batch.run_batch
    monkeypatch.setattr(batch, "_counts", lambda made: made["metrics"])
    monkeypatch.setattr(
        batch, "run_batch",
        lambda catalogue, out, **how: asked.update(how) or run(generators.demo_catalogue(spark, 300), out, settings=LIGHT, restarts=1, **how),
    )
    found = {(r["model"], r["metric"]): r["value"] for r in batch.registered_run(spark, small).collect()}
    assert "settings" not in asked and "restarts" not in asked
    assert all(0 < found[model, "cv_mean"] <= 1 and (model, "cv_std") in found for model in ("random_forest", "xgboost"))


def test_no_fold_scores_among_metrics_without_folds(spark):
    results, _, _ = classify.train_and_evaluate(build_features(generators.demo_catalogue(spark, 300)), LIGHT, cv=False)
    assert all(set(results[name]) == {"accuracy", "f1"} for name in ("random_forest", "xgboost"))


def test_scores_do_not_depend_on_partitions(spark, small):
    from shelfwise.operators.scoring import composite_score
    from shelfwise.sources.offers import products

    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        scored = composite_score(build_features(products(spark, small).repartition(int(n))))
        seen.append(sorted(tuple(r) for r in scored.select("uid", "score_composite", "rang").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_stream_adds_what_is_new(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    events.where("event_id < 500").coalesce(1).write.mode("append").parquet(folder)

    def run():
        return run_audit_counts(
            spark, folder, events.schema, views.stream_shape, target, files_per_batch=1
        )

    assert run().agg(F.sum("n")).first()[0] == events.where("event_id < 500").count()
    events.where("event_id >= 500").repartition(2).write.mode("append").parquet(folder)
    final = run()
    assert final.agg(F.sum("n")).first()[0] == events.count()
    assert run().agg(F.sum("n")).first()[0] == events.count()  # nothing new, nothing changes
    expected = events.where("event_type = 'error'").count()
    assert final.where("status = 'FAILURE'").agg(F.sum("n")).first()[0] == expected


def test_stream_counts_rows_that_come_late_and_compacts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    edge = events.agg(F.expr("percentile(unix_timestamp(ts), 0.5)")).first()[0]
    newer = F.unix_timestamp("ts") >= edge
    whole = None
    for part in (events.where(newer), events.where(~newer)):  # the older half comes last
        part.repartition(3).write.mode("append").parquet(folder)
        whole = run_audit_counts(spark, folder, events.schema, views.stream_shape, target, files_per_batch=1)
    assert whole.agg(F.sum("n")).first()[0] == events.count()
    before = sorted(whole.collect())
    audit_counts.compact(spark, target, most=1)
    assert sorted(audit_counts.current_state(spark, target).collect()) == before
    assert len(list((tmp_path / "out" / "state").glob("batch=*"))) == 0
    events.limit(10).coalesce(1).write.mode("append").parquet(folder)
    after = run_audit_counts(spark, folder, events.schema, views.stream_shape, target)
    assert after.agg(F.sum("n")).first()[0] == events.count() + 10


def test_confusion_matrix_keeps_every_class(spark):
    df = spark.createDataFrame([(0, 2), (1, 1), (3, 0), (0, 2)], "label int, prediction int")
    rows = {r["label"]: r.asDict() for r in evaluate.confusion_matrix(df).collect()}
    assert sorted(rows) == [0, 1, 2, 3] and rows[0]["pred_2"] == 2 and rows[3]["pred_0"] == 1
