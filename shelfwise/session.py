"""Session settings for local runs, and the shared working folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "shelfwise", cores: int | str = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks; on a cluster use the session it gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and landed tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a fresh temporary folder; a cluster session without it is an
    error, since executors could not share a machine-local folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="shelfwise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if current.isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")
