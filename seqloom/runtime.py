"""Session helpers: time zone, reliable checkpoints, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hand only when its rows, at their given width, stay below this size.
BROADCAST_BYTES = 64 * 1024 * 1024


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom")
    root, name = os.path.split(package)
    spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", root, name))
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: UTC, adaptive re-planning for skewed joins, code on executors."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="seqloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, for tables written mid-job."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """Frames made meanwhile have their shuffle files removed once they were run."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so lost executors cost a re-read only."""
    checkpoint_root(df.sparkSession)
    with _cleaned(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def fetched(df: DataFrame) -> pa.Table:
    """All rows on the driver; no shuffle file of theirs stays."""
    with _cleaned(df.sparkSession):
        return df.select("*").toArrow()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared checkpoint folder; lost executors cost a re-read.

    Nothing reads the write's shuffle files afterwards, so Spark is told to remove them once it is done.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stored")
    with _cleaned(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int = 256) -> DataFrame:
    """Hint a broadcast if the rows, counted up to the limit, fit; else leave the join to AQE."""
    limit = BROADCAST_BYTES // row_bytes
    rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df
