"""The session that tests and benchmarks use; on a cluster the job's own session is used as it is."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str, cpus: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where it isn't installed there; once for a session, before the first query."""
    root = Path(__file__).resolve().parent.parent.parent
    folder = tempfile.mkdtemp(prefix="cadenza-")  # the driver serves the archive from there
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/cadenza", "zip", root, "cadenza"))
