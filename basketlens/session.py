"""What this library needs from a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), "basketlens_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4_000_000


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, unless the session does: Spark's own bound is in rows, and 10,000 long texts are in one."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names. Only where all run on one machine, as in tests, a folder of our own does without."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _folders:
        _folders[context.applicationId] = tempfile.mkdtemp(prefix="basketlens-shared-")
    return _folders[context.applicationId]


def settled(df: DataFrame) -> DataFrame:
    """df computed now, once, and read from the shared folder by all that use it; for tables that are small beside their inputs."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
