"""Session settings, the shared folder, and how this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# What the operators rely on: adaptive execution splits a skewed shuffle
# partition of an N:1 join even when a later step wants the same partitioning.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL_DIRS: dict[str, str] = {}  # local sessions without the setting


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings above to an existing session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def get_spark(app: str = "terrascout", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_DIRS:
        _LOCAL_DIRS[key] = tempfile.mkdtemp(prefix="terrascout-")
    return _LOCAL_DIRS[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written by a query."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


# Lets Spark delete the shuffle files of a write as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Steps:
    """Owner of the tables that ``cut`` writes while it is the innermost open one."""

    def __init__(self, outer: Steps | None):
        self._outer, self.paths = outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a result that outlives this owner; it belongs to the one around it, if there is one."""
        token = _OWNER.set(self._outer)
        try:
            return cut(df)
        finally:
            _OWNER.reset(token)

    def release(self) -> None:
        """Hand all tables written so far to the owner around it, if there is one."""
        if self._outer:
            self._outer.paths += self.paths
        self.paths = []


_OWNER: ContextVar[Steps | None] = ContextVar("owner of written steps", default=None)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Steps]:
    """Delete every table that was written by ``cut`` inside the block, whether it ends well or not.

    A result that is still needed goes through ``keep``; frames that read the others must
    not be used any more.  Without an owner, tables stay until the folder expires.
    """
    owner = Steps(_OWNER.get())
    token = _OWNER.set(owner)
    try:
        yield owner
    finally:
        _OWNER.reset(token)
        for path in owner.paths:
            drop(spark, path)


def written(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a table of its own; the others that it wrote are deleted."""
    with steps(spark) as own:
        return own.keep(make())


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table below the shared folder, in whatever store it is."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    except AttributeError:  # a remote session has no way to delete; the folder's expiry does it
        return
    store.delete(hadoop, True)


def cut(df: DataFrame) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    The lineage ends at the files, which outlive any executor, and the planner
    sees their true size.  (A checkpointed plan keeps its estimated size, which
    multiplies from join to join in an iterative job.)  The shuffle files behind
    the stage go at once; the table itself goes with its owner (``steps``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    owner = _OWNER.get()
    if owner:
        owner.paths.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def mean_of(df: DataFrame, column: str) -> float:
    """One number for the driver, such as the mean latitude of a grid."""
    from pyspark.sql import functions as F

    return float(df.agg(F.avg(column)).first()[0])
