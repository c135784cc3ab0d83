"""Whitening of embeddings: identical vectors are one, their covariance is a weighted, centred matrix product.

Vectors become integers first, so that equal ones are found exactly and sums do not hang on their order. Each distinct
vector is whitened once and joined back to its rows. What passes the driver has the size of one vector, or of the
covariance (width by width), however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import bound_batches, materialize, split_join

#: Steps of a unit, and what is added to make entries positive.
STEPS, OFFSET = 64, 1_000_000
#: Components that are returned, by falling variance.
COMPONENTS = 16
#: Largest vector whose covariance one process holds (doubles: 512 MB).
MOST_WIDTH = 8192
#: Largest entry, in steps, that is exact and whose sums over 1e9 rows are too; a larger one counts as not finite.
MOST_STEPS = 1 << 31


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n vectors (with their weights) with sums S, the eigenvalues and unit eigenvectors, falling, and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(vector: Column) -> Column:
    """floor(64 * entry) + 1000000 as longs; null for a vector that is null or has an entry that is null, not finite or over MOST_STEPS."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * STEPS < MOST_STEPS), F.lit(False)))
    return F.when(fine & (F.size(v) > 0), F.transform(F.when(fine, v), lambda c: F.floor(c * STEPS) + OFFSET))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def distinct_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """(x, rows): each distinct integer vector of the commonest width (the larger of equally common ones), and how many rows have it."""
    found = materialize(rows.select(integers(F.col(f"`{vector}`")).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("rows")))
    best = found.groupBy(F.size("x").alias("width")).agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("width")).first()
    return found.where(F.size("x") == (best.width if best else 0))


def _covariance(vectors: DataFrame, width: int, centred: bool, n: int, mean: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Covariance with divisor n of vectors (x, weight): each task centres its batches, multiplies and gives one sum for each pair of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x, w = _matrix(b.column(0), width), b.column(1).to_numpy(zero_copy_only=False)
            d = (mean[0] * x - mean[1]) / mean[0] if mean else x
            total += (d * w[:, None]).T @ d
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    parts = vectors.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # width x width rows at most
    out = np.zeros((width, width))
    for p in parts:
        out[p.i, p.j] = p.s
    return (out + out.T) / (2 * n)


def _weight(weights: str) -> Column:
    if weights not in ("one", "count"):
        raise ValueError("weights: 'one' or 'count'")
    return F.lit(1).cast("bigint") if weights == "one" else F.col("rows")


def fit(distinct: DataFrame, weights: str = "one") -> Whitening | None:
    """Fit on (x, rows): each distinct vector counts once, or with weights 'count' as often as rows have it. None without vectors."""
    bound_batches(distinct.sparkSession)
    weight = _weight(weights)
    first = distinct.select(F.size("x").alias("width")).first()
    if first is None:
        return None
    width = first.width
    if width > MOST_WIDTH:
        raise ValueError(f"vectors of over {MOST_WIDTH} entries")
    n = distinct.agg(F.sum(weight).alias("n")).first().n
    entries = distinct.select(weight.alias("w"), F.posexplode("x").alias("i", "v"))
    sums = np.array([int(r.s) for r in entries.groupBy("i").agg(F.sum((F.col("w") * F.col("v")).cast("decimal(38,0)")).alias("s")).orderBy("i").collect()], dtype=object)
    sums = sums.astype(np.int64)
    v = _covariance(distinct.select("x", weight.cast("double").alias("w")), width, True, n, (n, sums))
    values, vectors = np.linalg.eigh(v)
    return Whitening(n, sums, values[::-1], vectors[:, ::-1], float(np.trace(v)))


def _deviation(d: np.ndarray) -> list[int | None]:
    """Sums of squares of rows of integers, exact; null where a long does not hold it."""
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    exact = [int(s) for s in (d.astype(object) ** 2).sum(axis=1)]
    return [s if s < 1 << 63 else None for s in exact]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """One row per row and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Each entry c becomes x = floor(64 * c) + 1000000. The fit list is each distinct x once (``weights`` 'count': as
    often as it occurs): n vectors with sums S. ``whitened`` is x - S / n on the component's unit eigenvector of the
    covariance, over the root of its eigenvalue e; ``explained`` is e over the trace; ``deviation`` is the sum of
    (n * x - S) ** 2, null only where a long does not hold it; ``identity_error`` is the largest absolute entry of the
    whitened fit list's covariance minus the identity. Components whose eigenvalue is nothing beside the largest (fewer
    different vectors than dimensions) can't be whitened and have no rows.

    Rows whose vector is null, empty, or has entries that are null, not finite or over MOST_STEPS steps have no rows,
    nor have vectors of another than the commonest width. Repeated rows and null keys return as they are; an empty
    table gives none.
    """
    spark = rows.sparkSession
    schema = rows.select(F.col(f"`{key}`").alias(key)).schema.fields[0].dataType.simpleString()
    distinct = distinct_vectors(rows, vector)
    model = fit(distinct, weights)
    usable = 0 if model is None else int((model.values[:components] > max(model.values[0], 0) * len(model.values) * np.finfo(float).eps).sum())
    if not usable:
        return spark.createDataFrame([], f"`{key}` {schema}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    n, sums, width = model.n, model.sums, len(model.sums)
    turn = model.vectors[:, :usable] / np.sqrt(model.values[:usable])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = n * _matrix(b.column(0), width) - sums
            flat = ((d / n) @ turn).ravel()
            white = pa.FixedSizeListArray.from_arrays(pa.array(flat), usable).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_deviation(d), pa.int64()), white], ["x", "rows", "deviation", "white"])

    done = materialize(distinct.mapInArrow(run, "x array<bigint>, rows bigint, deviation bigint, white array<double>"))
    second = _covariance(done.select("white", _weight(weights).cast("double").alias("w")), usable, False, n)
    error = float(np.abs(second - np.eye(usable)).max())

    ids = rows.select(F.col(f"`{key}`").alias("__key"), integers(F.col(f"`{vector}`")).alias("__x")).where("__x is not null")
    mark = lambda x: F.struct(F.xxhash64(x), F.xxhash64(F.lit(1), x))  # noqa: E731  128 bits in place of the vector
    back = split_join(ids.select("__key", mark("__x").alias("__mark")), done.select(mark("x").alias("__mark"), "deviation", "white"), "__mark")
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:usable]])
    each = back.select("__key", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        F.col("__key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
