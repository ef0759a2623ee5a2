"""Session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def build_session(app: str = "tracewell", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE (coalescing, skew-join splitting, runtime broadcast) is what sizes the
    reduce side at scale, so it is always on. No shuffle partition count is set
    here: a cluster sets it, tests pass a small one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master with nothing configured (tests) gets a folder of its
    own: on a cluster a machine-local folder would be lost with its executor.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can read")
    _local_folder = _local_folder or tempfile.mkdtemp(prefix="tracewell-")
    return _local_folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name for the tables of one run."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The files of a shuffle go when the action ends that wrote them, not when the driver
    happens to collect its garbage. For jobs of many steps that each end in a checkpoint, a
    table or a count: a DataFrame made in here whose rows are asked for twice shuffles twice."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


# Rows a side may have and still be sent to every executor.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting (the count stops past the bound);
    a larger side is joined by shuffle."""
    return broadcast(df) if df.limit(rows + 1).count() <= rows else df


_shipped: SparkContext | None = None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: the grouped
    pandas functions are looked up there by module name."""
    global _shipped
    context = spark.sparkContext
    if _shipped is context:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tracewell-package-"), "tracewell")
    context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped = context
