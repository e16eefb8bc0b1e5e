"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascout.session import cut

BATCH_BYTES = 8 << 20  # text that one Arrow batch hands to a Python worker, unless one row is larger

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, as texts differ in length by a factor of 10^5."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``each`` to the Arrow batches of a frame."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_key(text: str = "text"):
    """A key that only equal texts share; NULL counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def stage(df: DataFrame) -> DataFrame:
    """Write a step to the shared folder; it goes with its owner (``session.steps``)."""
    return cut(df)


def return_memory() -> None:
    """Give what a worker has freed back to the system, as workers of other stages stay beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
