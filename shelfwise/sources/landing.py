"""Tables that Spark derives once and keeps in the shared folder: landed views and steps of a batch job."""

from __future__ import annotations

import functools
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from shelfwise.session import work_dir

#: Written last into a finished table's folder; Spark's readers skip names with an underscore.
MANIFEST = "_manifest.json"
#: Place of landed tables below the shared folder.
ROOT = "shelfwise/landed"
#: Versions of a landed table that stay, and the age in seconds below which any version stays.
KEEP_VERSIONS, KEEP_SECONDS = 3, 7 * 86_400
#: Compression of landed tables: they are written once, and their bytes grow with the inputs.
CODEC = "zstd"
#: Bytes of input files behind a task that reads them or a shuffle partition of a landed table, and files of
#: partition values that a task holds open; a task with more values than that sorts its rows.
PARTITION_BYTES, OPEN_FILES = 16 << 20, 24


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of a location."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    system, location = file_system(spark, path)
    return system.exists(location)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, location = file_system(spark, path)
    out = system.create(location, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, or nothing where there is none."""
    system, location = file_system(spark, path)
    if not system.exists(location):
        return None
    stream = system.open(location)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names of the folders directly below a folder, with their times of change in milliseconds."""
    system, location = file_system(spark, path)
    if not system.exists(location):
        return []
    return sorted((e.getPath().getName(), e.getModificationTime()) for e in system.listStatus(location) if e.isDirectory())


@contextmanager
def settings(spark: SparkSession, values: dict[str, int | str]) -> Iterator[None]:
    """Session settings that hold for the work inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _input_files(spark: SparkSession, path: str) -> list[str]:
    """One line per file of an input, at any depth."""
    return sorted(f"{e.getPath()}|{e.getLen()}|{e.getModificationTime()}" for e in _entries(spark, path))


def _entries(spark: SparkSession, path: str) -> list:
    """File entries of an input, at any depth."""
    system, location = file_system(spark, path)
    if system.getFileStatus(location).isFile():
        entries = [system.getFileStatus(location)]
    else:
        entries, listing = [], system.listFiles(location, True)
        while listing.hasNext():
            entries.append(listing.next())
    return entries


def partitions(spark: SparkSession, paths: list[str]) -> int:
    """Shuffle partitions for tables made of some inputs: the session's, or as many as their bytes need."""
    size = sum(e.getLen() for path in paths for e in _entries(spark, path))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes when a file of an input is added, removed, resized or rewritten, at any depth of its folder."""
    digest = hashlib.sha256()
    for path in paths:
        digest.update(json.dumps([path, _input_files(spark, path)]).encode())
    return digest.hexdigest()[:16]


@functools.cache
def code_version() -> str:
    """Changes with the code that tables are derived by, so that no table outlives its rules."""
    package = files("shelfwise")
    digest = hashlib.sha256(package.joinpath("schemas.py").read_bytes())
    for part in ("functions", "operators", "plans", "sources"):
        for module in sorted(package.joinpath(part).iterdir(), key=lambda m: m.name):
            if module.name.endswith(".py"):
                digest.update(module.name.encode() + module.read_bytes())
    return digest.hexdigest()[:16]


def store(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), **manifest) -> DataFrame:
    """Writes a table as Parquet, then its manifest with schema and the given values; reads it back.

    A task keeps a file open for each partition value instead of sorting its whole rows by it.
    """
    spark, schema = df.sparkSession, df.schema
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": OPEN_FILES}):
        df.write.mode("overwrite").parquet(path, partitionBy=list(partition_by) or None, compression=CODEC)
    write_text(spark, f"{path}/{MANIFEST}", json.dumps({**manifest, "schema": schema.json(), "made": time.time()}))
    return spark.read.schema(schema).parquet(path)


def manifest_of(spark: SparkSession, path: str) -> dict | None:
    """Manifest of a finished table; none for one that is absent or half written."""
    text = read_text(spark, f"{path}/{MANIFEST}")
    return json.loads(text) if text else None


def load(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(path)


def landed_path(spark: SparkSession, name: str, inputs: list[str]) -> str:
    """Folder of a table's version: the same in every application that shares the folder, inputs and code."""
    version = hashlib.sha256(f"{fingerprint(spark, inputs)}|{code_version()}".encode()).hexdigest()[:16]
    return f"{work_dir(spark)}/{ROOT}/{name}/{version}"


def landed(
    spark: SparkSession,
    name: str,
    inputs: list[str],
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """Parquet copy of ``build()``, written at the first call and read back by later ones, of any application.

    A version belongs to the state of all input files and of the code. Every attempt writes into a
    folder of its own and adds its manifest last: a half-written copy is never read, and two
    applications that build at once leave two equal copies, of which all read the same. After a
    build, older versions go; see :func:`prune`. Reads and shuffles of the build get partitions by the
    bytes of the inputs, so that a task's rows, and the groups it counts before a shuffle, don't grow with the tables.
    """
    home = landed_path(spark, name, inputs)
    for attempt, _ in folders(spark, home):
        manifest = manifest_of(spark, f"{home}/{attempt}")
        if manifest:
            return load(spark, f"{home}/{attempt}", manifest)
    sized = {"spark.sql.shuffle.partitions": partitions(spark, inputs), "spark.sql.files.maxPartitionBytes": PARTITION_BYTES}
    with settings(spark, sized):
        made = store(build(), f"{home}/{uuid.uuid4().hex}", partition_by, inputs=inputs)
    prune(spark, name)
    return made


def prune(spark: SparkSession, name: str, keep: int = KEEP_VERSIONS, older_than: float = KEEP_SECONDS) -> list[str]:
    """Deletes versions of a landed table but the ``keep`` newest; returns what went.

    A version changed within ``older_than`` seconds stays, as other applications may still read it.
    """
    root = f"{work_dir(spark)}/{ROOT}/{name}"
    aged = sorted(folders(spark, root), key=lambda f: (-f[1], f[0]))[keep:]
    gone = [version for version, changed in aged if time.time() - changed / 1000 >= older_than]
    for version in gone:
        system, location = file_system(spark, f"{root}/{version}")
        system.delete(location, True)
    return gone


class Steps:
    """Steps of a batch job below one folder; a restart reads the finished ones and works on from there.

    ``version`` stands for all that decides the results: inputs, settings, code. A step is
    finished when its manifest names the version that it is asked for; a step depends on all
    before it, so its own version is made of theirs. Without a version nothing is reused.
    One job at a time may write to a folder.
    """

    def __init__(self, spark: SparkSession, out: str, version: str | None = None):
        self.spark, self.out, self.reused = spark, out, []
        self._version = version or uuid.uuid4().hex

    def __call__(
        self, name: str, build: Callable[[], DataFrame | tuple[DataFrame, dict]], partition_by: tuple[str, ...] = ()
    ) -> tuple[DataFrame, dict]:
        """The step's table, and the values that ``build`` returned beside it (any that JSON can hold)."""
        path = f"{self.out}/{name}"
        self._version = hashlib.sha256(f"{self._version}|{name}".encode()).hexdigest()
        manifest = manifest_of(self.spark, path)
        if manifest and manifest.get("version") == self._version:
            self.reused.append(name)
            return load(self.spark, path, manifest), manifest["values"]
        made = build()
        df, values = made if isinstance(made, tuple) else (made, {})
        return store(df, path, partition_by, version=self._version, values=values), values
