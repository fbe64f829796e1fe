"""A SparkSession for local runs and tests; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and a small number of partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reelframe")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the folder that the driver has it from.

    A cluster whose nodes do not share that folder gets the package with --py-files instead; the setting does no harm there.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that driver and executors all reach: below spark.checkpoint.dir.

    A local session may leave it unset and gets a temporary folder; anywhere else that is an error, as executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="reelframe-")
    return f"{base}/{name}-{uuid.uuid4().hex}"
