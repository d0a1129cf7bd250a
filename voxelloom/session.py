"""Session defaults and the two run-time helpers every family shares."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "voxelloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    AQE sizes shuffles, splits skewed joins and turns a join into a broadcast once it has measured the
    small side. Arrow batches are limited by bytes, because one row can hold a megabyte-sized slice.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that workers import it from any folder."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="voxelloom-"), "voxelloom.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(root):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.join("voxelloom", os.path.relpath(path, root)))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the directory the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary directory.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="voxelloom-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only after counting that ``df`` stays within ``max_rows``.

    Past the bound the DataFrame is returned as it is and the join shuffles. The count stops reading
    one row after the bound.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
