"""Helpers that the corpus operators share: bounded batches, materialising, keyed joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.arrow import bound_batches
from mnemospark.sources import tables
from mnemospark.sources.scratch import materialize, shared_dir

__all__ = ["blank", "bound_batches", "map_text", "materialize", "read_table", "shared_dir", "slices", "split_join", "worker_state"]

#: Bytes of text that a Python worker handles at a time, besides one text that alone exceeds it.
SLICE_BYTES = 1 << 21


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, sf_dir, name)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose values in a string or binary column have at most SLICE_BYTES together, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(upto, SLICE_BYTES + (upto[start - 1] if start else 0), side="right")))
        yield batch.slice(start, end - start)
        start = end


def map_text(df: DataFrame, fn: Callable[[list[pa.Array], list], pa.RecordBatch], schema: str) -> DataFrame:
    """Run ``fn(columns, texts)`` over slices of a frame whose last column is the text; a null text arrives as empty."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = "" if pa.types.is_string(batch.column(batch.num_columns - 1).type) else b""
            for x in slices(batch, batch.num_columns - 1):
                *columns, texts = x.columns
                yield fn(columns, [empty if t is None else t for t in texts.to_pylist()])

    return df.mapInArrow(run, schema)


_held: dict[str, Any] = {}


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a Python worker from one batch to the next. A worker holds that of one operator only,
    as Spark goes on using its workers for other operators."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def split_join(rows: DataFrame, info: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with one row of ``info`` per ``key``, so that a key with a great share of ``rows`` can be split.

    ``info`` usually comes from a groupBy on the key and would keep that partitioning; Spark splits a skewed
    partition only where both inputs are freshly exchanged. A second key column, a hash of the first, asks for that.
    """
    second = f"__{key}_hash"
    return rows.withColumn(second, F.xxhash64(key)).join(info.withColumn(second, F.xxhash64(key)), [key, second], how).drop(second)


def blank(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))
