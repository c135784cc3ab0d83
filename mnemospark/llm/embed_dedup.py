"""Near-duplicate embeddings: sign hashing by random hyperplanes in several tables, exact cosines, components.

Identical vectors of a label collapse first. Each remaining vector gets one bucket per table, the signs of its
products with that table's hyperplanes. Inside a bucket all cosines are computed as matrix products in double
precision; a large bucket is cut into blocks, and each pair of blocks is a task's work. What leaves a task is one
row per linked vector: how many links it has there, and the smallest vector that its links reach in that block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import bound_batches, materialize, split_join
from mnemospark.llm.components import connected_components

#: Cosine of a link, and the probability at which a pair with just that cosine may share no bucket.
COSINE, MISS = 0.98, 1e-7
#: Hyperplanes of a table grow with the number of vectors, from about this many vectors to a bucket and label.
BUCKET = 2048
#: Vectors of a bucket that are compared as one block.
BLOCK = 1024


def tables_for(rows: int) -> tuple[int, int]:
    """(hyperplanes in a table, tables) for so many vectors."""
    bits = min(24, max(4, math.ceil(math.log2(max(rows, 1) / BUCKET))))
    meet = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-meet))


def hyperplanes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([7, width]).standard_normal((width, bits * tables))


def _valid(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, vec) of the vectors that can link; vec is the vector as doubles, byte for byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            good, raw = [], []
            for i, v in enumerate(x.column(2).to_pylist()):
                if v and None not in v:
                    a = np.array(v, np.float64)
                    if np.isfinite(a).all() and a.any():
                        good.append(i)
                        raw.append((a + 0.0).tobytes())
            kept = x.select([0, 1]).take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(raw, pa.binary())], ["vec_id", "label", "vec"])

    bound_batches(rows.sparkSession)
    picked = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return picked.where("vec_id is not null and label is not null and v is not null").mapInArrow(run, "vec_id bigint, label string, vec binary")


def _compare(held: list[tuple], table: int, i: int, j: int, tables: int) -> pa.RecordBatch:
    """Links inside block i, or between blocks i and j, of one bucket: (vec_id, links, root) of every vector that has any."""
    block = np.array([h[0] for h in held])
    ids, copies = (np.array([h[k] for h in held], np.int64) for k in (1, 2))
    codes = np.frombuffer(b"".join(h[3] for h in held), np.uint32).reshape(-1, tables)
    v = np.frombuffer(b"".join(h[4] for h in held), np.float64).reshape(len(held), -1)
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / scale
    v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    near = v[left] @ v[right].T >= COSINE
    if i == j:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    new = ~(codes[a, :table] == codes[b, :table]).any(axis=1)  # an earlier table has counted the pair
    links = np.zeros(len(held), np.int64)
    np.add.at(links, a[new], copies[b[new]])
    np.add.at(links, b[new], copies[a[new]])
    a, b = a[new], b[new]
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    own = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(links[own]), pa.array(root[own])], ["vec_id", "links", "root"])


def _links(heads: DataFrame, rows: int, bits: int, tables: int) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = (1 << np.arange(bits)).astype(np.uint32)
        for x in batches:
            out: list[bytes | None] = [None] * x.num_rows
            raw = x.column(3).to_pylist()
            widths = np.array([len(r) // 8 for r in raw])
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                v = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(-1, w)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                signs = (v @ hyperplanes(w, bits, tables) >= 0).reshape(len(at), tables, bits)
                for i, c in zip(at.tolist(), (signs * power).sum(axis=2).astype(np.uint32), strict=True):
                    out[i] = c.tobytes()
            keys = [np.frombuffer(c, np.uint32).astype(np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["vec_id", "copies", "label", "vec", "codes", "buckets"])

    placed = materialize(heads.select("vec_id", "copies", "label", "vec").mapInArrow(place, "vec_id bigint, copies bigint, label string, vec binary, codes binary, buckets array<bigint>"), rows)
    spread = placed.select("vec_id", "label", F.octet_length("vec").alias("width"), F.posexplode("buckets").alias("tab", "code"))
    spread = spread.withColumn("bucket", F.xxhash64("label", "width", "tab", "code"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = split_join(spread.select("vec_id", "bucket", "tab"), sizes, "bucket")
    members = members.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("vec_id", "bucket", "tab", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    rows = members.join(placed.select("vec_id", "copies", "codes", "vec"), "vec_id").select("bucket", "tab", "i", "j", "block", "vec_id", "copies", "codes", "vec")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for x in batches:
            for bucket, tab, i, j, *row in zip(*(x.column(c).to_pylist() for c in range(9)), strict=True):
                if (bucket, tab, i, j) != group:
                    if len(held) > 1:
                        yield _compare(held, *group[1:], tables)
                    group, held = (bucket, tab, i, j), []
                held.append(tuple(row))
        if len(held) > 1:
            yield _compare(held, *group[1:], tables)

    return rows.mapInArrow(run, "vec_id bigint, links bigint, root bigint")


def near_embeddings(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Vectors of one non-null label (and one length) link when their cosine, in double precision, is at least COSINE.
    Null or empty vectors, zero vectors, vectors with a null or non-finite component, and rows with a null label or
    key link with nothing: 0 links, their own component. Rows that repeat a key and vector count as copies; a key with
    several vectors is one node, which has the larger of their numbers of links. An empty
    table gives an empty result; other columns are left aside. A pair at the threshold shares no bucket, and is then
    missed, with probability MISS; closer pairs with less.
    """
    valid = materialize(_valid(vectors, key, vector, label).withColumn("vkey", F.sha2(F.concat_ws("|", F.hex(F.encode("label", "utf-8")), F.hex("vec")), 256)))
    # label and vector are the same in all rows of a vkey, so that a hot vector is one row of each task before it is shuffled
    heads = valid.groupBy("vkey").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    heads = materialize(heads, valid.count())
    rows = heads.count()
    links = materialize(_links(heads.drop("vkey"), rows, *tables_for(rows)), rows)
    # keys with several vectors connect what these link with
    placed = split_join(valid.select("vec_id", "vkey"), heads.select("vkey", F.col("vec_id").alias("head")), "vkey")
    several = placed.groupBy("vec_id").agg(F.min("head").alias("a"), F.max("head").alias("top")).where("a <> top")
    joined = split_join(placed.select("vec_id", F.col("head").alias("b")), several.select("vec_id", "a"), "vec_id").select("a", "b").distinct()
    component = connected_components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(joined))
    degree = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    per_head = heads.select(F.col("vec_id").alias("head"), "copies", "vkey").join(degree.withColumnRenamed("vec_id", "head"), "head", "left").join(component.withColumnRenamed("node", "head"), "head", "left")
    per_head = per_head.select("vkey", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id"))
    found = split_join(valid.select("vec_id", "vkey"), per_head, "vkey").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    keys = vectors.select(F.col(key).cast("bigint").alias("vec_id"))
    alone = keys.where("vec_id is null").select("vec_id", F.lit(None).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"))
    out = split_join(keys.where("vec_id is not null"), found, "vec_id", "left").unionByName(alone)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select(F.col("vec_id").alias(key), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
