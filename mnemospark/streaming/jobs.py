"""Structured Streaming forms of ingest, roll-ups, sessions and attachment; they share the batch operators' columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.functions.columns import seconds_of
from mnemospark.operators.ingest import clamp_clock, event_verdict, keep_first, quarantine, upsert_documents
from mnemospark.operators.sessions import LEAST_SESSION
from mnemospark.sources.scratch import drop_folder

#: How long a client may hold an event back, and so how long a key is remembered.
KEY_MEMORY = "7 days"


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup_stream(events: DataFrame) -> DataFrame:
    """Each (device_id, dedupe_key) once within the key memory; impossible clocks are clamped before the watermark, not dropped."""
    clamped = clamp_clock(events.withColumn("received_ts", F.col("received_at").cast("timestamp")), F.col("received_at")).withColumn("event_ts", F.col("occurred_at").cast("timestamp"))
    return clamped.withWatermark("event_ts", KEY_MEMORY).dropDuplicatesWithinWatermark(["device_id", "dedupe_key"]).drop("received_ts")


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def ingest(events: DataFrame, table: str, rejected: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Clamp impossible clocks, validate each micro-batch, append what is new to ``table`` and the rest with its reason to ``rejected``.

    A batch id is written as a partition of its own and overwritten when the batch is run again, so that a restart
    leaves no event twice. Keys already in the table are found by an anti-join on the key columns alone, among events
    that are at most KEY_MEMORY older than the batch's oldest.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # it is read for its oldest event, for what is good and for what is not
        try:
            good, bad = quarantine(event_verdict(clamp_clock(batch, F.col("received_at"))))
            fresh = keep_first(good, ["device_id", "dedupe_key"], ["occurred_at", "event_id"])
            oldest = batch.agg(F.min("received_at").alias("t")).first().t
            if oldest is not None and _there(spark, table):
                recent = F.col("received_at") >= F.lit(oldest).cast(batch.schema["received_at"].dataType) - F.expr(f"INTERVAL {KEY_MEMORY}")
                stored = spark.read.parquet(table).where((F.col("batch_id") != batch_id) & recent).select("device_id", "dedupe_key")
                fresh = fresh.join(stored, ["device_id", "dedupe_key"], "left_anti")
            fresh.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Parts of a table of documents; a batch rewrites those that it touches.
BUCKETS = 64


#: Snapshots of a table of documents that are kept; readers of older ones have to look again.
SNAPSHOTS = 3


def _snapshots(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the snapshots that are complete, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/snapshots")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    done = [f.getPath() for f in store.listStatus(folder) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch-")) for p in done)


def _heads(spark: SparkSession, table: str, number: int) -> dict[int, int]:
    """Of each bucket of a snapshot the batch that wrote it; as many rows as buckets."""
    return {r.bucket: r.batch for r in spark.read.parquet(f"{table}/snapshots/batch-{number}").collect()}


def _bucket_paths(table: str, heads: dict[int, int]) -> list[str]:
    return [f"{table}/data/batch-{batch}/bucket={b}" for b, batch in sorted(heads.items())]


def read_captures(spark: SparkSession, table: str) -> DataFrame:
    """The table of documents that :func:`upsert_captures` keeps, as its latest whole batch left it."""
    numbers = _snapshots(spark, table)
    if not numbers:
        raise ValueError(f"no batch has been written to {table}")
    return spark.read.parquet(*_bucket_paths(table, _heads(spark, table, numbers[-1])))


def upsert_captures(captures: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Fold captures of documents into a table of one row per content, dealt to buckets by content; read it by :func:`read_captures`.

    A batch reads the buckets that it touches and writes them anew beside the old ones, then a snapshot that names the
    batch of each bucket. A snapshot counts once it is complete, so that a reader sees all of a batch or none of it, a
    batch that failed half-way is written again, and one that is run again after it was complete changes nothing.
    """
    spark = captures.sparkSession
    bucket = F.pmod(F.xxhash64("user_id", "content_hash"), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        numbers = _snapshots(spark, table)
        if numbers and numbers[-1] >= batch_id:
            return
        batch = batch.persist()
        try:
            touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            heads = _heads(spark, table, numbers[-1]) if numbers else {}
            held = _bucket_paths(table, {b: heads[b] for b in touched if b in heads})
            merged = upsert_documents(batch, spark.read.parquet(*held) if held else None)
            merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/batch-{batch_id}")
            heads |= dict.fromkeys(touched, batch_id)
            spark.createDataFrame(sorted(heads.items()), "bucket int, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{table}/snapshots/batch-{batch_id}")
            kept = [*numbers, batch_id][-SNAPSHOTS:]
            needed = {b for n in kept for b in _heads(spark, table, n).values()}
            for old in set(numbers) - set(kept):
                drop_folder(spark, f"{table}/snapshots/batch-{old}")
            for old in range(min([*numbers, batch_id]), batch_id):
                if old not in needed:
                    drop_folder(spark, f"{table}/data/batch-{old}")
        finally:
            batch.unpersist()

    return captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, window: str, *keys: str, lateness: str = "1 day") -> DataFrame:
    timed = events.withColumn("event_ts", F.col("occurred_at").cast("timestamp")).withWatermark("event_ts", lateness)
    out = timed.groupBy(F.window("event_ts", window), *keys).agg(F.count("*").alias("events"), F.sum("duration_seconds").alias("seconds"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "events", "seconds")


def sliding_foreground(events: DataFrame, length: str = "24 hours", slide: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    timed = events.withColumn("event_ts", F.col("occurred_at").cast("timestamp")).withWatermark("event_ts", lateness)
    out = timed.groupBy(F.window("event_ts", length, slide), "user_id").agg(F.sum("duration_seconds").alias("seconds"))
    return out.select(F.col("window.start").alias("window_start"), "user_id", "seconds")


def session_windows(events: DataFrame, gap: str, lateness: str = "1 day") -> DataFrame:
    timed = events.withColumn("event_ts", F.col("occurred_at").cast("timestamp")).withWatermark("event_ts", lateness)
    out = timed.groupBy(F.session_window("event_ts", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("started_at"), "events")


def attach_stream(seeds: DataFrame, events: DataFrame, window: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Interval join of two streams: events of a seed's user and url within the window around it."""
    left = seeds.select(F.col("event_id").alias("seed_id"), "user_id", "url", F.col("occurred_at").cast("timestamp").alias("seed_ts")).withWatermark("seed_ts", lateness).alias("s")
    right = events.select("event_id", "user_id", "url", "type", F.col("occurred_at").cast("timestamp").alias("event_ts")).withWatermark("event_ts", lateness).alias("e")
    near = F.expr(f"e.event_ts between s.seed_ts - interval {window} and s.seed_ts + interval {window}")
    return left.join(right, (F.col("s.user_id") == F.col("e.user_id")) & (F.col("s.url") == F.col("e.url")) & near & (F.col("s.seed_id") != F.col("e.event_id"))).select("seed_id", "event_id", "type")


def embedding_queue(documents: DataFrame, lateness: str = KEY_MEMORY) -> DataFrame:
    """Documents whose extraction has succeeded, each content once, as they arrive."""
    ready = documents.where("extraction_status = 'succeeded' and length(extracted_text) > 0").withColumn("changed_ts", F.col("captured_at").cast("timestamp"))
    return ready.withWatermark("changed_ts", lateness).dropDuplicatesWithinWatermark(["document_id", "content_hash"]).select("document_id", "content_hash")


def device_liveness(events: DataFrame) -> DataFrame:
    """The state has one row per device, and no more."""
    return events.groupBy("device_id").agg(F.max("occurred_at").alias("last_seen_at"))


def app_sessions(changes: DataFrame, lateness: str = "1 hour", least_seconds: int = LEAST_SESSION) -> DataFrame:
    """Sessions per device as a stateful stream: the state is the open session, and a package change or screen-off closes it.

    A micro-batch's changes of a device are applied in time order; one that is older than what has been applied comes
    too late and changes nothing. A session that is still open when the watermark passes its last change by
    ``lateness`` is closed there.
    """
    wait_ms = changes.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {lateness}) AS ms").first().ms
    schema = "device_id bigint, package string, started_s bigint, ended_s bigint"
    state = "package string, started_s bigint, last_s bigint"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def close(package, started, ended) -> None:
            if package is not None and ended - started >= least_seconds:
                out.append((key[0], package, started, ended))

        package, started, last = held.get if held.exists else (None, None, None)
        if held.hasTimedOut:
            close(package, started, last)
            held.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["at_s", "event_id"])
            for now, at in zip(rows["package"], rows["at_s"], strict=True):
                if last is not None and at < last:
                    continue
                now = None if pd.isna(now) else now
                if now != package:
                    if package is not None:
                        close(package, started, at)
                    package, started = now, at
                last = at
            held.update((package, int(started), int(last)))
            held.setTimeoutTimestamp(max(int(last) * 1000 + wait_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["device_id", "package", "started_s", "ended_s"])

    timed = changes.withColumn("event_ts", F.col("occurred_at").cast("timestamp")).withWatermark("event_ts", lateness)
    timed = timed.select("device_id", "event_id", "package", "event_ts", seconds_of(F.col("occurred_at")).alias("at_s"))
    return timed.groupBy("device_id").applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
