"""Bounds of the batches that pass between Spark and its Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between Spark and a Python worker, besides one row that alone exceeds it.
BATCH_BYTES = 1 << 22
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, always to the same size, unless the session has its own bound.

    Rows vary from a few bytes to whole books, so that a number of rows bounds nothing.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
