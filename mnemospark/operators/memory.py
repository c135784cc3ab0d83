"""Bi-temporal memory statements: duplicates, merge decisions, supersession, validity and decay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.columns import content_hash, seconds_of
from mnemospark.functions.intervals import join_moments
from mnemospark.operators.retrieval import unit_rows

STATEMENT_CHARS = (8, 512)
#: Cosines from which a statement is a duplicate, or a candidate for review; stored statements that a task holds.
DUPLICATE, REVIEW, SLICE = 0.9, 0.8, 4096


def statement_hash(statement: Column) -> Column:
    return content_hash(statement)


def exact_duplicates(memories: DataFrame) -> DataFrame:
    """(user_id, statement_hash, memory_id of the first, copies)."""
    return memories.groupBy("user_id", statement_hash(F.col("statement")).alias("statement_hash")).agg(F.min("memory_id").alias("memory_id"), F.count("*").alias("copies"))


def near_duplicates(candidates: DataFrame, stored: DataFrame, by: str = "user_id", duplicate: float = DUPLICATE, review: float = REVIEW, neighbours: int = 1) -> DataFrame:
    """(memory_id, match_id, similarity, relation): of each candidate the nearest earlier statements of its user, from ``review`` on.

    Both sides: memory_id, the user, statement_hash, embedding. Equal statements are settled first, by their hash: the
    first of them is the only match. Others have their ``neighbours`` nearest, of equally near ones the earliest.
    Vectors then meet in slices of a user's stored statements, which a task holds while the user's candidates stream
    past them; a slice leaves one match a candidate, so a user with many statements takes many tasks and few rows.
    """
    first = stored.groupBy(by, "statement_hash").agg(F.min("memory_id").alias("match_id"))
    exact = candidates.select("memory_id", by, "statement_hash").join(first, [by, "statement_hash"]).where("match_id < memory_id").select("memory_id", "match_id", F.lit(1.0).alias("similarity")).distinct()
    open_ = candidates.join(exact.select("memory_id"), "memory_id", "left_anti").where("embedding is not null").select("memory_id", by, F.col("embedding").cast("array<double>").alias("v"))
    held = stored.where("embedding is not null").select("memory_id", by, F.col("embedding").cast("array<double>").alias("v"))
    sizes = held.groupBy(by).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    kept = held.join(sizes, by).withColumn("slice", F.pmod(F.xxhash64("memory_id"), F.col("slices")).cast("int")).select(by, "slice", F.lit(0).alias("side"), "memory_id", "v")
    asked = open_.join(sizes, by).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(by, "slice", F.lit(1).alias("side"), "memory_id", "v")
    rows = kept.unionByName(asked).repartition(by, "slice").sortWithinPartitions(by, "slice", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []
        matrix = keys = None
        for x in batches:
            group = list(zip(*(x.column(i).to_pylist() for i in range(3)), strict=True))
            start = 0
            for end in range(1, len(group) + 1):
                if end < len(group) and group[end] == group[start]:
                    continue
                part, side = x.slice(start, end - start), group[start][2]
                if group[start][:2] != now:
                    now, ids, vectors = group[start][:2], [], []
                if side == 0:
                    ids += part.column(3).to_pylist()
                    vectors += part.column(4).to_pylist()
                    matrix = None
                elif ids:
                    if matrix is None:
                        usable, matrix = unit_rows(pa.array(vectors, pa.list_(pa.float64())))
                        keys = np.array(ids, np.int64)[usable]
                        order = np.argsort(keys, kind="stable")
                        keys, matrix = keys[order], matrix[order]
                    at, v = unit_rows(part.column(4), matrix.shape[1])
                    own = part.column(3).to_numpy()[at]
                    like = np.where(keys[None, :] < own[:, None], np.round(v @ matrix.T, 9), -np.inf)
                    best = np.argsort(-like, axis=1, kind="stable")[:, :neighbours]  # the smallest keys on a tie
                    near = np.take_along_axis(like, best, axis=1)
                    i, j = np.nonzero(near >= review)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(keys[best[i, j]]), pa.array(near[i, j])], ["memory_id", "match_id", "similarity"])
                start = end

    found = rows.mapInArrow(run, "memory_id bigint, match_id bigint, similarity double")
    nearest = Window.partitionBy("memory_id").orderBy(F.desc("similarity"), "match_id")
    best = found.withColumn("__rank", F.row_number().over(nearest)).where(F.col("__rank") <= neighbours).drop("__rank")
    relation = F.when(F.col("similarity") >= duplicate, "duplicate").otherwise("candidate").alias("relation")
    return exact.unionByName(best).select("memory_id", "match_id", F.round("similarity", 6).alias("similarity"), relation)


def merge_decision(relation: Column, match_id: Column) -> Column:
    """What becomes of a new statement given its relation to its match."""
    return F.when(match_id.isNull(), "insert").when(relation == "duplicate", "reject").when(relation == "complementary", "merge").when(relation == "contradictory", "supersede").otherwise("insert")


def adjudicate_with(pairs: DataFrame, relation_udf, left: str, right: str) -> DataFrame:
    """Adds relation and decision by a caller's pandas UDF over two statements."""
    return pairs.withColumn("relation", relation_udf(F.col(left), F.col(right))).withColumn("decision", merge_decision(F.col("relation"), F.col("match_id")))


def supersede(stored: DataFrame, replacements: DataFrame) -> DataFrame:
    """Closes replaced statements and adds the new ones: replacements hold the stored columns and ``replaces``."""
    closing = replacements.groupBy(F.col("replaces").alias("memory_id")).agg(F.min(F.struct("valid_from", "memory_id")).alias("__by"))
    old = stored.join(closing, "memory_id", "left")
    old = old.withColumn("valid_to", F.coalesce("valid_to", F.col("__by.valid_from"))).withColumn("superseded_by", F.coalesce("superseded_by", F.col("__by.memory_id")))
    old = old.withColumn("status", F.when(F.col("__by").isNotNull(), "superseded").otherwise(F.col("status"))).drop("__by")
    return old.unionByName(replacements.select(*stored.columns))


def supersede_chain(statements: DataFrame, subject: str) -> DataFrame:
    """Adds valid_to, superseded_by and status: each statement of a subject holds until the next one."""
    w = Window.partitionBy(subject).orderBy("valid_from", "memory_id")
    out = statements.withColumn("valid_to", F.lead("valid_from").over(w)).withColumn("superseded_by", F.lead("memory_id").over(w))
    return out.withColumn("status", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))


def valid_at(memories: DataFrame, moments: DataFrame) -> DataFrame:
    """Statements that held at each moment (moment_id, at), superseded ones included. Any number of moments: they are joined by the cells of the intervals, to whole seconds, then exactly."""
    held = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    sure = memories.where("valid_from is not null")
    return join_moments(sure, F.floor(seconds_of(F.col("valid_from"))), F.floor(seconds_of(F.col("valid_to"))) + 1, moments, F.floor(seconds_of(F.col("at")))).where(held)


def decay_weight(last: Column, now: Column, accesses: Column, half_life_days: float = 30.0, least: float = 0.1, boost: float = 0.1) -> Column:
    age = (seconds_of(now) - seconds_of(last)) / 86_400.0
    return F.greatest(F.lit(least), (1 + boost * accesses) * F.pow(F.lit(0.5), age / half_life_days))


def archive_stale(memories: DataFrame, cutoff: Column) -> DataFrame:
    stale = (F.col("status") == "active") & (F.coalesce("last_accessed_at", "valid_from") < cutoff) & (F.col("valid_from") < cutoff)
    return memories.withColumn("status", F.when(stale, "archived").otherwise(F.col("status")))


def rewrite(memories: DataFrame, merged: DataFrame) -> DataFrame:
    """Replaces statements by (memory_id, merged_statement) and their hashes with them."""
    out = memories.join(merged, "memory_id", "left").withColumn("statement", F.coalesce("merged_statement", "statement")).drop("merged_statement")
    return out.withColumn("statement_hash", statement_hash(F.col("statement")))


def admit(candidates: DataFrame, chunks: DataFrame, per_document: int = 3, cited: int = 5) -> DataFrame:
    """Candidates (candidate_id, document_id, statement, confidence, importance, ordinals) within bounds, whose cited ordinals exist; the surest of each document."""
    good = candidates.where(F.length("statement").between(*STATEMENT_CHARS) & F.col("confidence").between(0, 1) & F.col("importance").between(0, 1) & F.size("ordinals").between(1, cited))
    wanted = good.select("candidate_id", "document_id", F.explode("ordinals").alias("ordinal"))
    absent = wanted.join(chunks.select("document_id", "ordinal"), ["document_id", "ordinal"], "left_anti").select("candidate_id").distinct()
    w = Window.partitionBy("document_id").orderBy(F.desc("confidence"), "candidate_id")
    return good.join(absent, "candidate_id", "left_anti").withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_document).drop("__rn")


def provenance(memories: DataFrame, sources: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Each memory with its cited chunks (memory_id, chunk_id, excerpt) and their documents.

    The excerpt is the one that was stored when the memory was made. The memory stays, with nulls, when a chunk or
    document is gone, and so does the excerpt.
    """
    held = documents.select("document_id", F.col("title").alias("document_title"), F.col("url").alias("document_url"))
    cited = sources.select("memory_id", "chunk_id", "excerpt").join(chunks.select("chunk_id", "document_id"), "chunk_id", "left").join(held, "document_id", "left")
    return memories.select("memory_id", "statement").join(cited, "memory_id", "left")
