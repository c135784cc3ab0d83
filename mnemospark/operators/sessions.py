"""Sessions and attachment of events to documents, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.columns import seconds_of

LEAST_SESSION = 5


def app_sessions(changes: DataFrame, least_seconds: int = LEAST_SESSION, package: str = "package") -> DataFrame:
    """(device_id, package, started_at, ended_at, seconds) of foreground changes (device_id, package, occurred_at, event_id).

    A change to another package, or to none (screen off), ends a session; repeats of a package prolong it; the last
    open one ends with the device's last event. Short sessions are left out.
    """
    w = Window.partitionBy("device_id").orderBy("occurred_at", "event_id")
    changed = changes.withColumn("__new", ~F.col(package).eqNullSafe(F.lag(package).over(w)) | (F.row_number().over(w) == 1))
    starts = changed.withColumn("__last", F.max("occurred_at").over(Window.partitionBy("device_id"))).where("__new")
    out = starts.withColumn("ended_at", F.coalesce(F.lead("occurred_at").over(w), "__last")).where(F.col(package).isNotNull())
    out = out.withColumn("seconds", seconds_of(F.col("ended_at")) - seconds_of(F.col("occurred_at"))).where(F.col("seconds") >= least_seconds)
    return out.select("device_id", F.col(package).alias("package"), F.col("occurred_at").alias("started_at"), "ended_at", "seconds")


def gap_sessions(events: DataFrame, gap_seconds: int, key: str = "user_id") -> DataFrame:
    """(key, session_no, started_at, ended_at, events): runs of events with no gap over ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy("occurred_at", "event_id")
    gap = seconds_of(F.col("occurred_at")) - F.lag(seconds_of(F.col("occurred_at"))).over(w)
    numbered = events.withColumn("__new", F.when(gap <= gap_seconds, 0).otherwise(1)).withColumn("session_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session_no").agg(F.min("occurred_at").alias("started_at"), F.max("occurred_at").alias("ended_at"), F.count("*").alias("events"))


def attach_events(seeds: DataFrame, events: DataFrame, window_seconds: int) -> DataFrame:
    """(seed_id, event_id, type): events of the same user and url within the window around a seed (event_id, user_id, url, occurred_at).

    The time is cut into buckets of the window's length; a seed looks into three of them, so the join stays an
    equi-join however many events a user has on a url.
    """
    bucket = F.floor(seconds_of(F.col("occurred_at")) / window_seconds)
    left = seeds.select(F.col("event_id").alias("seed_id"), "user_id", "url", F.col("occurred_at").alias("seed_at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    right = events.select("event_id", "user_id", "url", "type", "occurred_at", bucket.alias("bucket"))
    near = F.abs(seconds_of(F.col("occurred_at")) - seconds_of(F.col("seed_at"))) <= window_seconds
    return left.join(right, ["user_id", "url", "bucket"]).where(near & (F.col("seed_id") != F.col("event_id"))).select("seed_id", "event_id", "type")


def document_signals(attached: DataFrame) -> DataFrame:
    """Per seed: whether a selection, copy, bookmark or download belongs to it, and how many events."""
    kinds = ("selection", "copy", "bookmark", "download")
    return attached.groupBy("seed_id").agg(F.count("*").alias("events"), *[F.coalesce(F.bool_or(F.col("type") == k), F.lit(False)).alias(f"has_{k}") for k in kinds])
