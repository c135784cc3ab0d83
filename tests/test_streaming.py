"""Streams over split files against their batch forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import ingest, sessions
from mnemospark.sources import tables
from mnemospark.streaming import jobs


@pytest.fixture(scope="module")
def split(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    events = tables.activity_events(spark, sf).withColumn("importance", F.lit(0.5)).withColumn("package", F.expr("CASE WHEN k % 5 <> 0 THEN 'app' || CAST(k % 4 AS STRING) END"))
    events.orderBy("occurred_at").repartitionByRange(3, "occurred_at").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def stream(spark, split, files=1):
    frame, path = split
    return jobs.read_events(spark, path, frame.schema, files)


def drain(df, mode="append", name="drained"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_ingest_appends_once(spark, split, tmp_path):
    out, bad, check = (str(tmp_path / x) for x in ("out", "bad", "check"))
    jobs.ingest(stream(spark, split), out, bad, check).awaitTermination()
    frame = split[0]
    expected = ingest.append_new(frame, frame.limit(0), ["device_id", "dedupe_key"], ["occurred_at", "event_id"]).count()
    assert spark.read.parquet(out).count() == expected
    jobs.ingest(stream(spark, split), out, bad, str(tmp_path / "again")).awaitTermination()
    assert spark.read.parquet(out).select("device_id", "dedupe_key").distinct().count() == expected


def test_dedup_stream(spark, split):
    got = drain(jobs.dedup_stream(stream(spark, split, 1000)), name="dedup")
    assert got.count() == split[0].select("device_id", "dedupe_key").distinct().count()


def test_tumbling_counts(spark, split):
    got = drain(jobs.tumbling_counts(stream(spark, split), "1 day", "type"), "complete", "tumbling")
    assert got.agg(F.sum("events")).first()[0] == split[0].count()


def test_sliding_and_sessions_and_liveness(spark, split):
    one = drain(jobs.sliding_foreground(stream(spark, split)), "complete", "sliding")
    assert one.agg(F.sum("seconds")).first()[0] == 24 * split[0].agg(F.sum("duration_seconds")).first()[0]
    two = drain(jobs.session_windows(stream(spark, split, 1000), "30 minutes"), "complete", "sessions")
    assert two.count() == sessions.gap_sessions(split[0], 1800).count()
    three = drain(jobs.device_liveness(stream(spark, split)), "complete", "liveness")
    assert three.count() == split[0].select("device_id").distinct().count()


def test_attach_stream(spark, split):
    seeds = stream(spark, split, 1000).where("type = 'page_view'")
    got = drain(jobs.attach_stream(seeds, stream(spark, split, 1000), "24 hours", "40 days"), name="attach")
    batch = sessions.attach_events(split[0].where("type = 'page_view'"), split[0], 86_400)
    assert sorted((r.seed_id, r.event_id) for r in got.collect()) == sorted((r.seed_id, r.event_id) for r in batch.collect())


def test_app_sessions_stream(spark, split):
    got = {(r.device_id, r.package, r.started_s) for r in drain(jobs.app_sessions(stream(spark, split, 1000), "40 days"), name="apps").collect()}
    batch = {(r.device_id, r.package, r.started_s) for r in sessions.app_sessions(split[0]).select("device_id", "package", F.unix_seconds(F.col("started_at").cast("timestamp")).alias("started_s"), F.unix_seconds(F.col("ended_at").cast("timestamp")).alias("ended_s")).collect()}
    assert got <= batch and len(got) > 0.5 * len(batch)  # those that are still open come later


def test_upsert_stream(spark, sf, tmp_path):
    d = tables.documents(spark, sf).select("document_id", "user_id", "content_hash", "url", "captured_at")
    d.repartition(2).write.parquet(str(tmp_path / "d"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    jobs.upsert_captures(s, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    rows = lambda x: sorted(tuple(r) for r in x.select("user_id", "content_hash", "document_id", "url").collect())
    assert rows(jobs.read_captures(spark, str(tmp_path / "t"))) == rows(ingest.upsert_documents(d))
    again = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d"))
    jobs.upsert_captures(again, str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination()  # batches 0 and 1 have been written
    assert rows(jobs.read_captures(spark, str(tmp_path / "t"))) == rows(ingest.upsert_documents(d))


def test_upserts_are_whole_batches(spark, tmp_path):
    table, t = str(tmp_path / "t"), datetime.datetime(2024, 1, 1)
    schema = "document_id bigint, user_id bigint, content_hash string, url string, captured_at timestamp"
    for i in range(6):
        spark.createDataFrame([(10 * i + j, j, f"h{j}", f"u{i}", t + datetime.timedelta(days=i)) for j in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError, match="no batch"):
        jobs.read_captures(spark, table)
    jobs.upsert_captures(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "d")), table, str(tmp_path / "c"), buckets=4).awaitTermination()
    whole = sorted(map(tuple, jobs.read_captures(spark, table).select("user_id", "content_hash", "url").collect()))
    assert len(whole) == 5 and len(list((tmp_path / "t" / "snapshots").glob("batch-*"))) == jobs.SNAPSHOTS
    (tmp_path / "t" / "snapshots" / "batch-5" / "_SUCCESS").unlink()  # as if the last batch had stopped half-way
    half = sorted(map(tuple, jobs.read_captures(spark, table).select("user_id", "content_hash", "url").collect()))
    assert len(half) == 5 and jobs._snapshots(spark, table)[-1] == 4


def test_ingest_clamps_clocks(spark, split, tmp_path):
    frame, _ = split
    off = frame.limit(20).withColumn("occurred_at", F.col("occurred_at") + F.expr("INTERVAL 400 DAYS"))
    off.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(off.schema).parquet(str(tmp_path / "in"))
    jobs.ingest(s, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.where("clamped_from is not null and occurred_at = received_at").count() > 0


def test_embedding_queue(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "h1", "succeeded", "text", t), (1, "h1", "succeeded", "text", t), (2, "h2", "failed", "text", t), (3, "h3", "succeeded", "", t), (1, "h4", "succeeded", "new text", t)]
    d = spark.createDataFrame(rows, "document_id bigint, content_hash string, extraction_status string, extracted_text string, captured_at timestamp")
    d.write.parquet(str(tmp_path / "d"))
    got = drain(jobs.embedding_queue(spark.readStream.schema(d.schema).parquet(str(tmp_path / "d"))), name="queue")
    assert sorted(map(tuple, got.collect())) == [(1, "h1"), (1, "h4")]


@pytest.mark.parametrize("files", [1, 4])
def test_sessions_in_any_order(spark, tmp_path, files):
    """Late, re-sent and shuffled changes give the sessions of the batch; the state keeps nothing of what is done."""
    import random

    from mnemospark.streaming import sessions_state

    rng = random.Random(7)
    t = datetime.datetime(2024, 1, 1)
    rows = [(d, 100 * d + i, rng.choice(["a", "b", None]), t + datetime.timedelta(seconds=20 * i + rng.randrange(15))) for d in range(4) for i in range(40)]
    last = [(99, 9999, "z", t + datetime.timedelta(days=3))]  # moves the watermark past all others
    sent = rows + rng.sample(rows, 50)
    rng.shuffle(sent)
    schema = "device_id bigint, event_id bigint, package string, occurred_at timestamp"
    for i in range(files):
        spark.createDataFrame(sent[i::files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions_state.PROVIDER)
    try:
        changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = drain(sessions_state.ordered_app_sessions(changes, "1 hour"), name="ordered").where("device_id < 99")
        batch = sessions.app_sessions(spark.createDataFrame(rows, schema))
        want = sorted((r.device_id, r.package, int(r.started_at.timestamp()), int(r.ended_at.timestamp())) for r in batch.collect())
        assert sorted((r.device_id, r.package, r.started_s, r.ended_s) for r in got.collect()) == want and len(want) > 60
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
