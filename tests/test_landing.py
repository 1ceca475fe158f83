"""Landed tables and resumed batch jobs."""

import os
import re
import uuid

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from shelfwise.operators import classify, cluster, density, rules
from shelfwise.operators.sizing import lookup_side, row_bytes
from shelfwise.plans import batch
from shelfwise.session import work_dir
from shelfwise.sources import generators, landing, offers

LIGHT = classify.ModelSettings(forest_trees=5, boost_rounds=3, folds=2)


def test_fingerprint_sees_files_at_any_depth(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(10).withColumn("day", F.col("id") % 2).write.partitionBy("day").parquet(folder)
    before = landing.fingerprint(spark, [folder])
    assert landing.fingerprint(spark, [folder]) == before
    spark.range(3).write.mode("append").parquet(f"{folder}/day=1")
    after = landing.fingerprint(spark, [folder])
    assert after != before
    one = next(p for p in (tmp_path / "in" / "day=0").iterdir() if p.suffix == ".parquet")
    os.utime(one, (1, 1))
    assert landing.fingerprint(spark, [folder]) != after


def test_landed_is_built_once_per_version(spark, tmp_path):
    folder, built = str(tmp_path / "in"), []
    spark.range(10).write.parquet(folder)

    def build():
        built.append(1)
        return spark.read.parquet(folder).select(F.lit("7").alias("kind"), "id")

    def read():
        return landing.landed(spark, "probe", [folder], build, ("kind",))

    assert sorted(r["id"] for r in read().collect()) == list(range(10)) and len(built) == 1
    again = read()
    assert again.count() == 10 and len(built) == 1
    assert dict(again.dtypes) == {"kind": "string", "id": "bigint"}  # the stored schema, not one guessed from folder names
    home = landing.landed_path(spark, "probe", [folder])
    assert spark.sparkContext.applicationId not in home
    (attempt, _), = landing.folders(spark, home)
    os.remove(f"{home}/{attempt}/{landing.MANIFEST}")  # half written
    assert read().count() == 10 and len(built) == 2
    spark.range(5).write.mode("append").parquet(folder)
    assert read().count() == 15 and len(built) == 3


def test_landing_sorts_no_rows_and_widens_shuffles_with_the_input(spark, tmp_path, monkeypatch):
    folder, seen = str(tmp_path / "in"), {}
    spark.range(100).write.parquet(folder)
    names = ("spark.sql.shuffle.partitions", "spark.sql.maxConcurrentOutputFileWriters")
    before = [spark.conf.get(n, None) for n in names]
    whole = DataFrameWriter.parquet

    def spied(writer, path, **options):
        seen["written with"] = [int(spark.conf.get(n)) for n in names]
        return whole(writer, path, **options)

    def build():
        seen["built with"] = int(spark.conf.get(names[0]))
        # More kinds than files are held open.
        return spark.read.parquet(folder).select((F.col("id") % 40).cast("string").alias("kind"), "id")

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    size = sum(f.stat().st_size for f in (tmp_path / "in").iterdir())
    monkeypatch.setattr(landing, "PARTITION_BYTES", size // 100)
    made = landing.landed(spark, f"wide-{uuid.uuid4().hex}", [folder], build, ("kind",))
    assert seen["built with"] >= 50 and seen["written with"][0] == seen["built with"]
    assert seen["written with"][1] == landing.OPEN_FILES
    assert [spark.conf.get(n, None) for n in names] == before
    assert sorted((r["id"], r["kind"]) for r in made.collect()) == [(i, str(i % 40)) for i in range(100)]


def test_prune_keeps_the_newest_and_the_young(spark):
    name = f"old-{uuid.uuid4().hex}"
    root = f"{work_dir(spark)}/shelfwise/landed/{name}"
    for i in range(5):
        os.makedirs(f"{root}/v{i}")
        os.utime(f"{root}/v{i}", (1000 + i, 1000 + i))
    os.makedirs(f"{root}/new")
    assert landing.prune(spark, name, keep=2, older_than=10**12) == []
    assert sorted(landing.prune(spark, name, keep=3)) == ["v0", "v1", "v2"]
    assert [version for version, _ in landing.folders(spark, root)] == ["new", "v3", "v4"]


def test_steps_start_anew_after_a_changed_step(spark, tmp_path):
    def job(version, names):
        steps = landing.Steps(spark, str(tmp_path / "job"), version)
        made = {n: steps(n, lambda n=n: (spark.range(3).withColumn("step", F.lit(n)), {"share": 0.1})) for n in names}
        return steps.reused, made

    assert job("1", ["a", "b"])[0] == []
    reused, made = job("1", ["a", "b"])
    assert reused == ["a", "b"] and made["b"][1] == {"share": 0.1} and made["b"][0].count() == 3
    assert job("1", ["a", "x", "b"])[0] == ["a"]  # b now follows another step
    assert job("2", ["a", "b"])[0] == []
    assert job(None, ["a"])[0] == [] and job(None, ["a"])[0] == []


def test_batch_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    catalogue, out = generators.demo_catalogue(spark, 300), str(tmp_path / "out")

    def run(version="1", k=10):
        made = batch.run_batch(catalogue, out, k, LIGHT, restarts=1, cv=False, version=version)
        return {name: sorted(map(str, df.collect())) for name, df in made.items()}

    def stop(*_, **__):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(rules, "association_rules", stop)
        with pytest.raises(RuntimeError):
            run()
    with monkeypatch.context() as m:
        for module, name in ((cluster, "run_kmeans"), (density, "dbscan"), (classify, "train_and_evaluate")):
            m.setattr(module, name, stop)
        resumed = run()
        assert run() == resumed
        with pytest.raises(RuntimeError):
            run(version="2")
    fresh = batch.run_batch(catalogue, str(tmp_path / "other"), 10, LIGHT, restarts=1, cv=False)
    assert {name: sorted(map(str, df.collect())) for name, df in fresh.items()} == resumed


def test_container_batch_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    catalogue, out = generators.demo_catalogue(spark, 300), str(tmp_path / "out")
    first = batch.run_container_batch(catalogue, out, 10, LIGHT, restarts=1, version="1")
    metrics = sorted(first["metrics"].collect())
    monkeypatch.setattr(classify, "container_probability", None)
    again = batch.run_container_batch(catalogue, out, 10, LIGHT, restarts=1, version="1")
    assert sorted(again["metrics"].collect()) == metrics


def test_catalogue_reads_and_shuffles_line_items_once(spark, small):
    made = offers.build_products(spark, small)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet.*l_extendedprice|FileScan parquet.*l_suppkey", plan)) == 1
    assert made.count() == offers.products(spark, small).count()


def test_lookup_side_counts_rows_and_bytes(spark):
    def hinted(df, **limits):
        return "ResolvedHint" in lookup_side(df, **limits)._jdf.queryExecution().analyzed().toString()

    small = spark.createDataFrame([(1, "a" * 1000, ["b" * 500]), (2, None, None)], "k int, t string, l array<string>")
    assert small.select(row_bytes(small).alias("n")).agg(F.sum("n")).first()[0] >= 1500 + 2 * 32
    assert hinted(small) and not hinted(small, max_rows=1) and not hinted(small, max_bytes=1500)
    assert hinted(small.limit(0))


def test_landed_files_are_small(spark, tmp_path):
    """Landed tables are compressed by the codec that leaves fewer bytes than the session's own."""
    df = spark.range(20_000).selectExpr("id", "concat('shop ', id % 97, ' of part ', id) AS nom", "id % 7 / 3.0D AS prix")
    made = landing.store(df, str(tmp_path / "landed"))
    df.write.parquet(str(tmp_path / "plain"), compression="snappy")
    size = {k: sum(f.stat().st_size for f in (tmp_path / k).glob("*.parquet")) for k in ("landed", "plain")}
    assert size["landed"] < 0.8 * size["plain"], size
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, df.collect()))


def test_reads_of_a_build_go_by_bytes(spark, tmp_path, monkeypatch):
    """A task of a build reads so many bytes of its inputs, however large they are; reads outside are as before."""
    monkeypatch.setattr(landing, "PARTITION_BYTES", 20_000)
    key, given = "spark.sql.files.maxPartitionBytes", str(tmp_path / "given")
    spark.range(40_000).select("id", F.md5(F.col("id").cast("string")).alias("text")).repartition(12).write.parquet(given)
    before, seen = spark.conf.get(key), []

    def build():
        df = spark.read.parquet(given)
        seen.append(df.rdd.getNumPartitions())
        return df

    assert landing.landed(spark, "by-bytes", [given], build).count() == 40_000
    assert seen[0] > spark.read.parquet(given).rdd.getNumPartitions()
    assert spark.conf.get(key) == before
